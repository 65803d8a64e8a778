"""Book-segmentation analytics expressed as Spark DataFrame jobs."""
