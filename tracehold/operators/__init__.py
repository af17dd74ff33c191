"""Table operators: flattening, deduplication, aggregation, joins and checks."""
