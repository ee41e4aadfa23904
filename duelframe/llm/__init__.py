"""Operators for training text: linkage, ranking, tokenising and span matching. Nothing outside imports this package."""
