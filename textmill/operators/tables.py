"""Tables that a job writes for itself, and numbering rows without one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a side that may be sent to all tasks once they are counted.
SENT = 1 << 19
#: Rows of a range in numbering, and the most ranges.
RANGE, RANGES = 1 << 17, 4096


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a job's own files, in spark.checkpoint.dir, which driver and executors share; it goes when the
    application ends. Where that is unset a local session gets a local folder; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", at)
    folder = f"{at.rstrip('/')}/textmill-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{name}"


def stored(df: DataFrame, name: str = "table", schema: StructType | None = None) -> DataFrame:
    """df as a Parquet table: computed once however often it is read, and safe from lost executors. schema: the types to read it
    with, where they aren't df's own."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def side(df: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table as the side of a join: sent to all tasks if it has at most `most` rows (SENT), else merged."""
    return F.broadcast(df) if df.count() <= (SENT if most is None else most) else df.hint("merge")


def numbered(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """df as a stored table with its rows numbered from 0 in ascending order of the columns `order`, which must tell rows apart.
    Rows are sorted in ranges; a number is the row's place in its range and the rows of the ranges before it."""
    own = stored(df)
    ranges = min(own.count() // RANGE + 1, RANGES)
    dealt = own.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    shift, before = {}, 0
    for r in dealt.groupBy("_range").agg(F.min("_at").alias("first"), F.count("*").alias("n")).orderBy("_range").collect():  # at most RANGES rows
        shift[r["_range"]], before = before - r["first"], before + r["n"]
    if not shift:
        return dealt.select(*df.columns, F.lit(0).cast("long").alias(name))
    table = df.sparkSession.createDataFrame(list(shift.items()), "_range int, _shift long")
    return stored(dealt.join(F.broadcast(table), "_range").select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name)))
