"""Column functions, code tables and numpy kernels."""
