"""Column expressions: calendar fields and score formatting."""
