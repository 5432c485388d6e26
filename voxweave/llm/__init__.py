"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; it is free-standing and
may be removed as a whole.
"""
