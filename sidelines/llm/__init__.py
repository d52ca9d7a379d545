"""Operators of a training-data pipeline: one module per operator, each with
its queries in ``catalog``.  Nothing outside this package imports it."""
