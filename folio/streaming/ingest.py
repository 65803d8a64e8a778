"""Incremental segmentation of books that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.operators.runs import worklist
from folio.operators.segment import segment
from folio.operators.tables import stored

PAGE_SCHEMA = "book_id long, page_index int, text string, version int"


def run_incremental(spark: SparkSession, source_dir: str, results_path: str, checkpoint: str, mode: str = "heuristic") -> StreamingQuery:
    """Segments every book that has no result of its version and mode yet, then stops.

    A book arrives whole and again as a new version, so no watermark is needed.  A batch's results go to a folder
    of its own that a replay overwrites, which makes replays harmless.  A result marked ``corrupt`` counts as none, and
    a book without chapters has a row without any, so that it is not segmented again.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        books = rows.select("book_id", "version").distinct().withColumn("mode", F.lit(mode))
        own = f"{results_path}/batch={batch_id}"
        try:
            done = session.read.option("mergeSchema", "true").parquet(results_path).filter(F.col("batch") != batch_id)
        except Exception as missing:  # no results yet
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            done = books.filter(F.lit(False))
        todo = worklist(books, done)
        # the latest version that a batch brings of a book is the one that counts
        latest = stored(todo.groupBy("book_id").agg(F.max("version").alias("version")))
        found, _ = segment(rows.join(latest, ["book_id", "version"], "left_semi").select("book_id", "page_index", "text"))
        found.join(latest.withColumn("mode", F.lit(mode)), "book_id", "right").write.mode("overwrite").parquet(own)

    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(source_dir)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
