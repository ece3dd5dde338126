"""Column functions: merge operators, statistics, scalars."""
