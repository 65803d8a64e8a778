"""Operators of the book-segmentation engine."""
