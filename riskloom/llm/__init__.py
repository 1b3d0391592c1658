"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  One module per
operator; ``queries`` registers one query per operator and its SQL text.
"""
