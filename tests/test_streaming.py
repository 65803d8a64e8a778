"""Books that arrive as files in three batches, a replay, and a corrupt result."""

from pyspark.sql import functions as F

from folio.streaming.ingest import PAGE_SCHEMA, run_incremental

FILLER = "so the text of this page goes on and on for many more words than any title has, and more of it follows here. " * 2


def book(book_id, version, starts):
    titles = ["A river runs along", "The stone and its law", "Trees beside the road"]
    texts = [f"{FILLER}\n{k}" for k in range(14)]
    texts[1] = "Contents\n" + "\n".join(f"{t} .... {s}" for t, s in zip(titles, starts, strict=True))
    for t, s in zip(titles, starts, strict=True):
        texts[s] = f"{t}\n\n{texts[s]}"
    return [(book_id, k, t, version) for k, t in enumerate(texts)]


def test_three_batches_a_replay_and_a_corrupt_result(spark, tmp_path):
    source, results, checkpoint = (f"file://{tmp_path}/{x}" for x in ("source", "results", "checkpoint"))

    def arrive(*books):
        spark.createDataFrame([r for b in books for r in b], PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(at=checkpoint):
        run_incremental(spark, source, results, at).awaitTermination()
        rows = spark.read.option("mergeSchema", "true").parquet(results)
        return {
            (r.book_id, r.version, r.batch): sorted(x for x in r.starts if x is not None) for r in rows.groupBy("book_id", "version", "batch").agg(F.collect_list("pdf_start_index").alias("starts")).collect()
        }

    arrive(book(1, 1, (3, 6, 9)), book(2, 1, (2, 5, 8)))
    assert run() == {(1, 1, 0): [3, 6, 9], (2, 1, 0): [2, 5, 8]}
    arrive(book(1, 2, (4, 7, 10)), [(3, 0, "no contents at all", 1)])
    second = run()
    assert second == {(1, 1, 0): [3, 6, 9], (2, 1, 0): [2, 5, 8], (1, 2, 1): [4, 7, 10], (3, 1, 1): []}
    # what is there already is not segmented again
    arrive(book(2, 1, (3, 6, 9)), [(3, 0, "no contents at all", 1)])
    assert run() == second
    # a corrupt result counts as none
    spark.createDataFrame([(5, 1, "heuristic", True)], "book_id long, version int, mode string, corrupt boolean").write.parquet(f"{results}/batch=90")
    arrive(book(5, 1, (3, 6, 9)))
    fourth = run()
    assert fourth == second | {(5, 1, 90): [], (5, 1, 3): [3, 6, 9]}
    # all files again as one batch: its folder is written anew, and nothing that another batch holds is done twice
    again = run(f"file://{tmp_path}/fresh")
    assert again.keys() == fourth.keys() and again[1, 2, 1] == [4, 7, 10] and again[5, 1, 3] == [3, 6, 9]
