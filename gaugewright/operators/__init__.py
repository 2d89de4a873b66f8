"""DataFrame transforms: grouping, joins, windows and graph steps."""
