"""Column expressions: text, geometry, module ids."""
