"""Plans of the book-segmentation engine."""
