"""Column-valued functions: text, vectors, scope predicates."""
