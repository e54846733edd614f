"""streaming of plaza."""
