"""Road network functions."""
