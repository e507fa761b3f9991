"""Column functions over vectors."""
