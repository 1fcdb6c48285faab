"""Shared pieces of the training-data operators: text columns, shared tables, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of most contracts: a run of characters other than space, tab, line feed, \x0b, \x0c, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests)
    gets a new local one; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and is
    computed once however often it is read. Results may be read from it lazily, so it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textmill-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textmill-{uuid.uuid4().hex}/{name}"


def portions(docs: DataFrame, size: Column, per_part: int) -> int:
    """How many parts of about per_part units the table has; the count follows the data."""
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    return int(total // per_part) + 1


def chunks(items: list, weight: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive runs of items whose weights add up to about limit."""
    at = total = 0
    for i, w in enumerate(weight):
        if i > at and total + w > limit:
            yield at, i
            at, total = i, 0
        total += w
    if at < len(items):
        yield at, len(items)
