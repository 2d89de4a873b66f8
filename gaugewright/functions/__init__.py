"""Column expressions: each takes and returns columns, and adds no shuffle."""
