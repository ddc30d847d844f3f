"""Column functions and Arrow helpers."""
