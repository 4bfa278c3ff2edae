"""Operators for preparing large text and vector collections for model training.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""
