"""PySpark operators that turn images, token grids and documents into training tables."""
