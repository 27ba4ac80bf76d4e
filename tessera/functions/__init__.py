"""Column expressions: time, identifiers, text."""
