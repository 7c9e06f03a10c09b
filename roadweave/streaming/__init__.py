"""Road network streaming."""
