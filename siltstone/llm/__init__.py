"""Operators of large training-data pipelines; nothing else in the package imports them."""
