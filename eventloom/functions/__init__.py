"""Column builders: text, numbers, lexicons."""
