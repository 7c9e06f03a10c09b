"""Road network sources."""
