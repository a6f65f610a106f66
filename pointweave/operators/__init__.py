"""DataFrame operators on clouds and graphs."""
