"""Streaming of the book-segmentation engine."""
