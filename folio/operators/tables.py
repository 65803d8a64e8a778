"""Tables that later steps read more than once: written where all executors can read them, which also cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that nothing has used before.

    Only a local master may leave that setting out; a temporary folder is used then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return f"{base.rstrip('/') if base else 'file://' + tempfile.mkdtemp(prefix='folio-')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a narrow result below the shared folder and returns a reader of it."""
    spark = df.sparkSession
    path = new_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """Marks a table that grows with the corpus: a join deals it by key, however small its files are.

    Else it may be sent whole to the driver and all tasks, as a table of numbers is many times larger there than stored.
    """
    return df.hint("merge")


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns as they are now: later expressions would work them out again for each use."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: Rows of a narrow table that one task sorts.
ROWS = 500_000


def dealt(df: DataFrame, key: str, n_rows: int, rows: int = ROWS) -> DataFrame:
    """``df`` dealt by ``key`` into as many parts as its number of rows asks for, so that no task's share grows with the table.

    Windows and groups over the key and more keep this dealing; a part is a few hundred thousand rows, or one key.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n_rows // rows)), key)
