"""Column expressions: arithmetic, logic, strings, time."""
