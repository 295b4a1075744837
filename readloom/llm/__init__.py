"""Operators for large text corpora (training-data preparation); nothing else in readloom imports this."""
