"""Column expressions: scalar rules that stay inside one projection."""
