"""Functions of the book-segmentation engine."""
