"""Operators for pipelines of training text. Nothing outside this package imports it."""
