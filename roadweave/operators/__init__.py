"""Road network operators."""
