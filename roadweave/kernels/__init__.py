"""Array kernels that run on one tile at a time, called through grouped functions."""
