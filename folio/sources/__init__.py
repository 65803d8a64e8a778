"""Sources of the book-segmentation engine."""
