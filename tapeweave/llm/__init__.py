"""Operators for large-scale training-data pipelines; nothing outside this folder imports them."""
