"""Scalar column functions and image kernels."""
