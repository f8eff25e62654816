"""Operators that prepare a corpus for language-model training."""
