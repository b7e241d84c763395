"""Column expressions: text, time, keys and measures."""
