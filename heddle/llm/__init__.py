"""Operators of a training-data pipeline: search, filters, joins, packing and scoring."""
