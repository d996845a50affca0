"""Column functions over change logs."""
