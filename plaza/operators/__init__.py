"""operators of plaza."""
