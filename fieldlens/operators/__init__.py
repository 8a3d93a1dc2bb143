"""DataFrame operators: filters, joins, aggregates and composite results."""
