"""Column functions and driver-side special functions."""
