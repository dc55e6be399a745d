"""Column expressions: text, arrays and answer matching."""
