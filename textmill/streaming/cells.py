"""All audit counters kept from a stream as cells (hour, dimension, name, n) that add up.

A micro-batch's cells are a folder of its own, which a repeated batch replaces, so each event counts once. Every COMPACT
batches the folders before the current one are added up into a base that says which batch it reaches; reading takes the newest
complete base and the batches after it: never more than COMPACT + 1 folders, whatever has gone by. Nothing waits for a
watermark: late events add to their own hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.audit_log import SCALARS, counter_rows

SCHEMA = "hour timestamp, dimension string, name string, n long"
KEYS = ("hour", "dimension", "name")
COMPACT = 16
UNIT = "hour"


def summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def cells_of(events: DataFrame, time_col: str = "time", stage_col: str = "event_stage", action_col: str = "action") -> DataFrame:
    """The cells of these events; those without a time that can be read are in the hour null."""
    hour = F.date_trunc(UNIT, F.col(time_col).try_cast("timestamp"))
    return summed(counter_rows(events.withColumn("hour", hour), ("hour",), stage_col, action_col))


class CellTable:
    """A folder of cells, written batch by batch."""

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.path, self.compact = spark, path.rstrip("/"), compact

    def _folders(self) -> dict[tuple[str, int], bool]:
        """(kind, number) -> complete, of the folders there are."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return {}
        out = {}
        for s in fs.listStatus(top):
            kind, _, number = s.getPath().getName().partition("=")
            if kind in ("base", "batch") and number.isdigit():
                out[kind, int(number)] = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return out

    def _current(self, before: int | None = None) -> tuple[int, list[str]]:
        """The last batch of the newest complete base (-1: none), and the folders to read, those of batches before `before`."""
        have = self._folders()
        base = max((n for (kind, n), done in have.items() if kind == "base" and done), default=-1)
        batches = sorted(n for (kind, n), done in have.items() if kind == "batch" and done and n > base and (before is None or n < before))
        return base, [f"{self.path}/base={base}"] * (base >= 0) + [f"{self.path}/batch={n}" for n in batches]

    def put(self, cells: DataFrame, batch: int) -> None:
        """Writes the cells of a batch in place of any it had; adds up older ones when enough have come."""
        base, folders = self._current(batch)
        if batch <= base:
            return  # counted in the base
        cells.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if len(folders) > self.compact:
            # stops at any point: what a complete base holds is not read again from the folders it came from
            summed(self.spark.read.schema(SCHEMA).parquet(*folders)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base={batch - 1}")
            fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for kind, n in self._folders():
                if (kind == "batch" and n < batch) or (kind == "base" and n < batch - 1):
                    fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={n}"), True)

    def cells(self) -> DataFrame:
        _, folders = self._current()
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return summed(self.spark.read.schema(SCHEMA).parquet(*folders))

    def writer(self, events: DataFrame, checkpoint: str, **columns):
        """A writer of a stream of events into the table."""
        put = lambda rows, batch: self.put(cells_of(rows, **columns), batch)
        return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)


def since(cells: DataFrame, at: Column, events: DataFrame | None = None, **columns) -> DataFrame:
    """The cells of events from `at` on. Whole hours come from the cells; of the hour that `at` divides only its events can tell,
    so these (any table of events, of which that hour is read) must be given unless `at` is a full hour: else its later part
    is left out."""
    first = F.date_trunc(UNIT, at)
    whole = cells.where((F.col("hour") > first) | ((F.col("hour") == first) & (first == at)))
    if events is None:
        return whole
    time = F.col(columns.get("time_col", "time")).try_cast("timestamp")
    part = events.where((time >= at) & (time < first + F.expr(f"interval 1 {UNIT}")) & (first != at))
    return summed(whole.unionByName(cells_of(part, **columns)))


def stats(cells: DataFrame) -> DataFrame:
    """A3 from cells: one row of scalar counters."""
    n = lambda name: F.coalesce(F.sum(F.when((F.col("dimension") == "counter") & (F.col("name") == name), F.col("n"))), F.lit(0)).cast("long").alias(name)
    return cells.agg(*map(n, SCALARS))


def counts(cells: DataFrame) -> DataFrame:
    """A4 from cells: (dimension, name, count)."""
    return cells.where("dimension <> 'counter'").groupBy("dimension", "name").agg(F.sum("n").alias("count"))


def union_of(tables: list[CellTable]) -> DataFrame:
    """The cells of several tables, such as one a region, added up."""
    return summed(reduce(DataFrame.unionByName, (t.cells() for t in tables)))
