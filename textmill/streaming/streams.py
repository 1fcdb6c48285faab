"""The same operators on unbounded tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.decide import Semantic, moderate_turns, no_semantic
from textmill.functions.detect import Pack
from textmill.operators.audit_log import event_results, redact


def moderate_stream(turns: DataFrame, pack: Pack, semantic: Semantic = no_semantic) -> DataFrame:
    """Verdicts of a stream of (message, reply) rows. No state: every row is decided alone."""
    return moderate_turns(turns, pack, semantic)


def event_counts_stream(events: DataFrame, time_col: str = "time", window: str = "1 hour", late: str = "10 minutes", stage_col: str = "event_stage") -> DataFrame:
    """Results, blocked, rewritten and hits per time window and stage. Rows later than the watermark are
    dropped; state is one row per open window and stage."""
    marked = events.withWatermark(time_col, late)
    r = event_results(marked, stage_col, keep=(time_col,))
    return r.groupBy(F.window(time_col, window).alias("window"), "stage").agg(
        F.count("*").alias("results"), F.count_if("blocked").alias("blocked"), F.count_if("rewritten").alias("rewritten"),
        F.sum("rule_hits").alias("rule_hits"), F.sum("semantic_hits").alias("semantic_hits"),
    ).select(F.col("window.start").alias("window_start"), "stage", "results", "blocked", "rewritten", "rule_hits", "semantic_hits")


def keyed_sink(counts: DataFrame, path: str, checkpoint: str):
    """A writer of every change of a count, open windows included. A batch is a folder of its own, which a repeated
    batch replaces; latest() reads the table."""
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: Collection[str]) -> DataFrame:
    """The row of each key that the last batch with the key wrote to a keyed sink."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def since_stream(events: DataFrame, since: Column, time_col: str = "time") -> DataFrame:
    """T3."""
    return events.where(F.col(time_col).try_cast("timestamp") >= since)


def redacted_sink(events: DataFrame, path: str, checkpoint: str):
    """T4: a writer of the stream whose events are redacted before anything is stored."""
    return redact(events).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
