"""Readers and writers of the engine's inputs: page texts, manifests, ground truth, outlines, layout files and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAPTER = "struct<title:string,authors:array<string>,pdf_start_index:int,pdf_end_index:int,citation_pages:string>"
EVIDENCE = "struct<title:string,authors:array<string>,printed_page_number:int,pdf_page_index:int,chapter_doi:string,source:string,metadata_confidence:double>"


def _named(df: DataFrame, suffix: str) -> DataFrame:
    """Adds book_key, the file's name without its suffix."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return df.withColumn("book_key", F.regexp_replace(name, suffix.replace(".", r"\.") + "$", ""))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(book_key, page_index, text) from page caches with an array ``pages``."""
    rows = _named(spark.read.schema("pages array<string>").option("multiLine", True).json(path), ".json")
    return rows.select("book_key", F.posexplode("pages").alias("page_index", "text"))


def read_manifest(spark: SparkSession, path: str, local: str | None = None) -> DataFrame:
    """Books of a corpus manifest and of a local one if there is any."""
    schema = "books array<struct<filename:string,title:string,language:string,extraction_type:string,embedded_toc:boolean,oa:boolean,doi:string,download_url:string,license:string,license_source:string>>"
    read = lambda p: spark.read.schema(schema).option("multiLine", True).json(p).select(F.inline("books"))
    return read(path) if local is None else union_manifests(read(path), read(local))


def union_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def list_corpora(manifests: DataFrame, include_toc_only: bool = False) -> DataFrame:
    rows = manifests if include_toc_only else manifests.filter(~F.coalesce("toc_only", F.lit(False)))
    return rows.select("corpus").distinct()


def scorable_books(books: DataFrame, expected: DataFrame, pages: DataFrame) -> DataFrame:
    """Books that have both ground truth and pages."""
    keys = ["corpus", "book_id"]
    return books.join(expected.select(*keys).distinct(), keys, "left_semi").join(pages.select(*keys).distinct(), keys, "left_semi")


def read_expected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chapters, contents) of ground-truth files; a contents field that is null differs from one that is absent."""
    raw = _named(spark.read.option("wholetext", True).text(path), ".expected.json")
    parsed = raw.select("book_key", "value", F.from_json("value", f"chapters array<{CHAPTER}>, toc struct<toc_start_index:int,toc_end_index:int>").alias("x"))
    chapters = parsed.select("book_key", F.posexplode("x.chapters").alias("chapter_no", "c")).select("book_key", "chapter_no", "c.*")
    keys = F.json_object_keys("value")
    return chapters, parsed.select("book_key", F.array_contains(keys, "toc").alias("has_toc_field"), F.col("x.toc.toc_start_index").alias("toc_start"), F.col("x.toc.toc_end_index").alias("toc_end"))


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """Evidence rows of outline snapshots; the source defaults to outline and confidence to 1."""
    rows = _named(spark.read.schema(f"candidates array<{EVIDENCE}>").option("multiLine", True).json(path), ".outline.json")
    rows = rows.select("book_key", F.posexplode("candidates").alias("cand_no", "c")).select("book_key", "cand_no", "c.*")
    return rows.fillna({"source": "outline", "metadata_confidence": 1.0})


def write_outline(evidence: DataFrame, path: str) -> None:
    fields = F.struct("title", "authors", "printed_page_number", "pdf_page_index", "chapter_doi", "source", "metadata_confidence")
    ordered = F.array_sort(F.collect_list(F.struct("cand_no", fields.alias("c"))))
    evidence.groupBy("book_key").agg(F.transform(ordered, lambda x: x["c"]).alias("candidates")).write.mode("overwrite").json(path)


def read_record_cache(spark: SparkSession, path: str) -> DataFrame:
    """Evidence rows of cached bibliographic records; files that cannot be parsed count as missing."""
    schema = f"isbn string, fetched_at string, chapters array<{EVIDENCE}>, _corrupt_record string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null").select("isbn", F.posexplode("chapters").alias("cand_no", "c")).select("isbn", "cand_no", "c.*")


def read_llm_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each book and model of stored model results."""
    schema = f"models map<string,struct<chapters:array<{CHAPTER}>,elapsed_seconds:double,demand_at_run:int,generated_at:string>>"
    rows = _named(spark.read.schema(schema).option("multiLine", True).json(path), ".json")
    return rows.select("book_key", F.explode("models").alias("model_id", "r")).select("book_key", "model_id", "r.*")


def read_alto(spark: SparkSession, path: str) -> DataFrame:
    """Layout lines of page-layout XML: a row for each text line with its box, text and font size."""
    box = "_HPOS double, _VPOS double, _WIDTH double, _HEIGHT double"
    line = f"array<struct<{', '.join(x.replace(' ', ':') for x in box.split(', '))},String:array<struct<_CONTENT:string,_STYLEREFS:string>>>>"
    pages = spark.read.format("xml").option("rowTag", "Page").schema(f"_PHYSICAL_IMG_NR int, _WIDTH double, _HEIGHT double, PrintSpace struct<TextBlock:array<struct<TextLine:{line}>>>").load(path)
    styles = spark.read.format("xml").option("rowTag", "TextStyle").schema("_ID string, _FONTSIZE double").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_ID").alias("style"), F.col("_FONTSIZE").alias("font"))
    lines = F.flatten(F.transform("PrintSpace.TextBlock", lambda b: b["TextLine"]))
    rows = pages.select(F.col("_metadata.file_path").alias("file"), (F.col("_PHYSICAL_IMG_NR") - 1).alias("page_index"), F.col("_WIDTH").alias("page_width"), F.col("_HEIGHT").alias("page_height"), F.posexplode_outer(lines).alias("line_no", "l"))
    style = F.get(F.split(F.get("l.String", F.lit(0))["_STYLEREFS"], " "), F.lit(0))
    rows = rows.select("file", "page_index", "page_width", "page_height", "line_no", F.col("l._HPOS").alias("hpos"), F.col("l._VPOS").alias("vpos"), F.col("l._WIDTH").alias("width"), F.col("l._HEIGHT").alias("height"), F.array_join(F.transform("l.String", lambda s: s["_CONTENT"]), " ").alias("content"), style.alias("style"))
    return rows.join(styles, ["file", "style"], "left").drop("style")


def write_results(results: DataFrame, path: str) -> None:
    """Classifier results, a folder for each corpus."""
    results.write.mode("overwrite").partitionBy("corpus").parquet(path)


def write_finetune_jsonl(rows: DataFrame, path: str) -> None:
    """(split, corpus, book_id, text, target) as JSON lines, a folder for each split."""
    rows.select("split", F.to_json(F.struct("corpus", "book_id", "text", "target")).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def build_target(chapters: DataFrame) -> DataFrame:
    """(book_id, target): a book's chapters in order as JSON, start pages as strings or null."""
    from folio.functions.pagenum import citation_start

    item = F.struct("title", "authors", citation_start(F.col("citation_pages")).alias("page"))
    ordered = F.array_sort(F.collect_list(F.struct("chapter_no", item.alias("c"))))
    return chapters.groupBy("book_id").agg(F.to_json(F.struct(F.transform(ordered, lambda x: x["c"]).alias("chapters"))).alias("target"))
