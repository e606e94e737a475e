"""Kernels on page rasters, run by page or line through Arrow batches."""
