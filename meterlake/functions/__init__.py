"""Column functions: each takes columns and gives a column, all of them built-in expressions."""
