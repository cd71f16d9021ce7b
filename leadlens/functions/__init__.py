"""Column expressions and the few Arrow UDFs that need Python strings."""
