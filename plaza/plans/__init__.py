"""plans of plaza."""
