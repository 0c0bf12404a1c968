"""Column expressions: text, JSON values, templates, ordering keys, durations."""
