"""Column functions: vector algebra, score functions, seeded draws and small numerics."""
