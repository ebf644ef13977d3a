"""Column -> Column helpers built from built-in expressions."""
