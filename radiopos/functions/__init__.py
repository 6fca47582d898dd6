"""Column functions: geodesy, radio metrics, keys and seeded draws."""
