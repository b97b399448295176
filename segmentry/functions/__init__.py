"""Column functions: coercion, text, JSON and numeric helpers."""
