"""Operators that prepare text corpora for model training; nothing outside imports this."""
