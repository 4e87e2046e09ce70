"""Operators of a training-data pipeline: extraction, filters, joins, mixing, sharding."""
