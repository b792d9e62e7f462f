"""Column expressions: usage, severities, globs, process fields, report text."""
