"""Operators for text that is to train language models. Nothing else in the library imports this."""
