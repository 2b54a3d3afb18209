"""Column and driver-side functions."""
