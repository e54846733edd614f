"""sources of plaza."""
