"""Operators for text that trains language models. Nothing outside imports this package."""
