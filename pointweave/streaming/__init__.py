"""Structured Streaming over clouds that arrive in x order."""
