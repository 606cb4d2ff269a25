"""Column expressions. Everything here is a native expression and stays in generated code."""
