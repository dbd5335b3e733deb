"""Column functions: they run inside one row and never shuffle."""
