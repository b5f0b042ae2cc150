"""Corpus operators for training data: scoring, searching, cleaning, encoding and packing.

Nothing else in the library imports this subpackage.
"""
