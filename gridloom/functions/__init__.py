"""Column functions and numerical helpers."""
