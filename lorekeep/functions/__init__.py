"""Column functions and driver-side helpers."""
