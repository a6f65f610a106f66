"""Point-cloud orientation and its supporting operators as Spark DataFrame jobs."""
