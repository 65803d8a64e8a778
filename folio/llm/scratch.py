"""Shared scratch tables, row numbers and checked broadcasts.

Lineage is cut by writing Parquet where all executors can read it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys that are broadcast at most; beyond that they are shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; unset, a temporary one, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return f"file://{tempfile.mkdtemp(prefix='folio-')}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and returns a reader of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *taken: str) -> str:
    """``name``, lengthened until no column has it."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A stored copy of ``docs`` with a number for each row, and that column's name."""
    name = fresh("row_number", *docs.columns)
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def limited(keys: DataFrame) -> DataFrame:
    """A stored table of narrow keys, marked for broadcast if its counted rows allow it and else for a shuffled hash join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``."""
    return rows.join(limited(stored(gone.select(key), "gone")), key, "left_anti")


def digest(text: Column) -> Column:
    """16 bytes of SHA-256; null for a null text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def row_digest(id_col: str, text_col: str) -> Column:
    """16 bytes of SHA-256 of a row's id and text, which tells nulls from empty values; equal rows share it."""
    told = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, text_col))
    return digest(F.concat_ws(" ", *told))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
