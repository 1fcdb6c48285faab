"""The audit log as a table of day partitions: read with pruning, kept for a number of days, expired by dropping days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The partition of events without a time that can be read.
NO_DAY = "none"


class EventLog:
    """JSON lines in folders day=YYYY-MM-DD (UTC). Events are redacted before they are written. A day older than `days` is
    dropped when events are written and never read; 0 keeps all days."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, days: int = 0, time_col: str = "time"):
        self.spark, self.path, self.days, self.time_col = spark, path.rstrip("/"), days, time_col
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def _fs(self):
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return top, top.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def days_there(self) -> list[str]:
        top, fs = self._fs()
        return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(top) if s.getPath().getName().startswith("day=")) if fs.exists(top) else []

    def oldest(self, now: dt.datetime) -> str | None:
        """The first day that is kept, counted back from now."""
        return (now - dt.timedelta(days=self.days)).date().isoformat() if self.days > 0 else None

    def expire(self, now: dt.datetime) -> list[str]:
        """Drops the days before the first that is kept; tells which. Only folders are removed, no file is read or rewritten."""
        first, (_, fs) = self.oldest(now), self._fs()
        gone = [d for d in self.days_there() if d != NO_DAY and first is not None and d < first]
        for d in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/day={d}"), True)
        return gone

    def append(self, events: DataFrame, now: dt.datetime | None = None) -> list[str]:
        """Writes events, each to its day, and drops the days that have expired. Events that lack the time column are
        stamped with the time of writing; those that have expired already are not written."""
        from textmill.operators.audit_log import redact

        now = now or dt.datetime.now(dt.UTC)
        own = redact(events)
        if self.time_col not in own.columns:
            own = own.withColumn(self.time_col, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        own = own.withColumn("day", F.coalesce(F.date_format(F.col(self.time_col).try_cast("timestamp"), "yyyy-MM-dd"), F.lit(NO_DAY)))
        first = self.oldest(now)
        if first is not None:
            own = own.where((F.col("day") >= first) | (F.col("day") == NO_DAY))
        own.write.mode("append").partitionBy("day").json(self.path)
        return self.expire(now)

    def writer(self, events: DataFrame, checkpoint: str, now=None):
        """T4: a writer of a stream of events; now() is the clock of expiry. A batch that is repeated after a failure of the
        driver may append twice, as appending JSON lines does."""
        put = lambda rows, _batch: self.append(rows, now() if now else None)
        return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)

    def read(self, since: Column | None = None, now: dt.datetime | None = None) -> DataFrame:
        """The events, blank and broken lines skipped; with since those before it and those without a readable time go too.
        Only folders of wanted days are read: the day is a partition column, so its filter is the scan's."""
        if not self.days_there():
            return self.spark.createDataFrame([], self.schema)
        full = T.StructType([*self.schema.fields, T.StructField("_corrupt_record", T.StringType())])
        # value: the line; day stays a string, whatever it looks like
        lines = self.spark.read.schema("value string, day string").text(self.path)
        first = self.oldest(now or dt.datetime.now(dt.UTC))
        if first is not None:
            lines = lines.where((F.col("day") >= first) | (F.col("day") == NO_DAY))
        if since is not None:
            lines = lines.where((F.col("day") >= F.date_format(since, "yyyy-MM-dd")) & (F.col("day") != NO_DAY))
        parsed = lines.where(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")).where("e._corrupt_record is null").select("e.*").drop("_corrupt_record")
        return parsed if since is None else parsed.where(F.col(self.time_col).try_cast("timestamp") >= since)
