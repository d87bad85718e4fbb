"""streaming of gridloom."""
