"""Road network plans."""
