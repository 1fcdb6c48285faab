"""Stateful streams against batch: turns split over micro-batches, counters after many batches, repeated batches."""

import random

from pyspark.sql import functions as F

from textmill.functions.decide import moderate_turns, turn_pairs
from textmill.functions.detect import Pack
from textmill.operators import audit_log as A
from textmill.streaming import cells as K
from textmill.streaming.streams import moderate_stream
from textmill.streaming.turns import keyed_state, turn_pairs_stream

TURNS = "conv_id long, turn long, role string, text string, at double"


def played(spark, folder, batches, wait="1 hour"):
    """What the stream makes of these batches of rows."""
    schema = spark.createDataFrame([], TURNS).withColumn("time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).schema
    for rows in batches:
        df = spark.createDataFrame(rows, TURNS)
        df.withColumn("time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with keyed_state(spark):
        q = turn_pairs_stream(stream, wait, "1 second").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=repr)


def test_turns_split_over_batches_equal_the_batch(spark, tmp_path):
    rng, rows = random.Random(4), []
    for conv in range(12):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", None])
            rows.append((conv, turn, role, rng.choice([None, f"{conv}-{turn}", ""]), turn * 60.0 + conv + 1))
    batches = [[r for r in rows if r[1] // 2 == b] for b in range(4)] + [[(-1, 0, "system", "", 1e6)]]
    got = played(spark, str(tmp_path), [rng.sample(b, len(b)) for b in batches])
    want = turn_pairs(spark.createDataFrame(rows, TURNS).na.fill("other", ["role"]))
    assert sorted(((c, t, m, r) for c, t, m, r, _ in got), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_time_out_repeats_and_late_rows(spark, tmp_path):
    batches = [
        [(1, 0, "user", "a", 1.0), (2, 0, "user", "b", 5.0), (3, 0, "user", "c", 6.0)],
        [(1, 0, "user", "a", 7.0), (1, 1, "assistant", "A", 8.0), (9, 0, "system", "x", 9000.0)],  # turn 0 again; then the clock moves on
        [(2, 1, "assistant", "too late", 9001.0), (None, 1, "user", "no key", 9001.0), (2, 2, "user", "b2", 9002.0)],
        [(2, 3, "assistant", "B2", 9003.0)],
        [(9, 1, "system", "x", 99000.0)],
    ]
    assert played(spark, str(tmp_path), batches) == [(1, 0, "a", "A", False), (2, 0, "b", None, True), (2, 2, "b2", "B2", False), (3, 0, "c", None, True)]


EVENTS = "event_id long, time timestamp, event_stage string, action string, result struct<stage:string,action:string,risk_score:int,detections:array<struct<category:string,source:string>>>"


def events(spark, n):
    e = F.col("id")
    found = F.when(e % 3 == 0, F.array(F.struct(F.lit("ad").alias("category"), F.when(e % 2 == 0, "regex").otherwise("semantic_ml").alias("source")))).otherwise(F.array().cast("array<struct<category:string,source:string>>"))
    result = F.when(e % 4 != 0, F.struct(F.when(e % 5 != 0, "input").alias("stage"), F.when(e % 3 == 0, "block").otherwise("pass").alias("action"), (e % 100).cast("int").alias("risk_score"), found.alias("detections")))
    return spark.range(n).select(e.alias("event_id"), F.when(e % 11 != 0, F.timestamp_micros(e * 977_000_000 % 360_000_000_000)).alias("time"), F.when(e % 4 == 0, "final").otherwise("output").alias("event_stage"), F.when(e % 8 == 0, "pass").alias("action"), result.alias("result"))


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_cells_after_many_batches(spark, tmp_path):
    all_events = events(spark, 1000)
    own = K.CellTable(spark, str(tmp_path / "cells"), compact=4)
    assert own.cells().count() == 0
    for b in range(25):
        rows = K.cells_of(all_events.where(F.col("event_id") % 25 == b))
        own.put(rows, b)
        if b in (3, 12):
            own.put(rows, b)  # a repeated batch
        assert len(own._current()[1]) <= 6 and len(own._folders()) <= 6
    own.put(K.cells_of(all_events), 3)  # long since in the base
    assert same(K.stats(own.cells()), A.event_stats(all_events)) and same(K.counts(own.cells()), A.counts_by(all_events))
    for at in ("1970-01-02 00:00:00", "1970-01-01 05:17:33.5", "1970-01-03 23:59:59", "2030-01-01 00:00:00"):
        t = F.lit(at).cast("timestamp")
        got = K.since(own.cells(), t, all_events)
        assert same(K.stats(got), A.event_stats(all_events, t)) and same(K.counts(got), A.counts_by(A.since_window(all_events, t, "time")))


def test_a_stopped_compaction_counts_once(spark, tmp_path):
    own = K.CellTable(spark, str(tmp_path / "cells"), compact=2)
    part = lambda b: K.cells_of(events(spark, 100).where(F.col("event_id") % 4 == b))
    for b in range(3):
        own.put(part(b), b)
    # a base that was written while its batches still stand, and one that was never finished
    K.summed(spark.read.schema(K.SCHEMA).parquet(*own._current()[1])).write.parquet(f"{own.path}/base=2")
    (tmp_path / "cells" / "base=7").mkdir()
    own.put(part(3), 3)
    assert same(K.stats(own.cells()), A.event_stats(events(spark, 100)))


def test_turns_moderated_on_a_stream_equal_the_batch(spark, tmp_path):
    pack = Pack({"ad": ["wxyz"], "porn": ["foul"]}, [("ad", r"\d{6}", "medium", 60, "number")])
    words = [None, "", "fine", "foul", "wxyz now", "call 123456", "a@b.com", "1234567 and wxyz"]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in words[1:] for b in words)], "id long, message string, reply string")
    df.write.parquet(f"{tmp_path}/in")
    out = moderate_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), pack)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    want = moderate_turns(df, pack)
    assert {r["out_action"] for r in want.select("out_action").collect()} == {None, "pass", "sanitize", "block"}
    assert same(spark.read.schema(out.schema).parquet(f"{tmp_path}/out"), want)
