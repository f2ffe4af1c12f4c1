"""Column expressions: pure built-ins, no Python workers."""
