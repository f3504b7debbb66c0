"""Column functions over text, grades and JSON."""
