"""Column builders and scalar kernels."""
