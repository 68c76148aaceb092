"""DataFrame-to-DataFrame operators: roll-ups, windows, joins, summaries, splits, metrics."""
