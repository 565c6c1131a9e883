"""Operators for training text. Optional: nothing outside this sub-package imports it."""
