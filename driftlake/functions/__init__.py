"""Column functions over text, versions and positions."""
