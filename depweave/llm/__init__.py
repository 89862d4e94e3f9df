"""Operators on training text: packing, leakage of evaluation items, sentence boundaries."""
