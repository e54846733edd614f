"""functions of plaza."""
