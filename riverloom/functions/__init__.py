"""Column builders: string forms, number parsing, times, casts, predicates."""
