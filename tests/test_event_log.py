"""The event log in day partitions: pruning, expiry on write, broken lines, redaction."""

import datetime as dt
import os

from pyspark.sql import functions as F

from textmill.sources.event_log import EventLog

SCHEMA = "time string, stage string, input string, n int"


def at(day, hour=12):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.UTC)


def rows(spark, days):
    return spark.createDataFrame([(f"2024-01-{d:02d}T10:30:00" if d else "odd", "input", "secret", i) for i, d in enumerate(days)], SCHEMA)


def test_days_are_pruned_and_expire_on_write(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA, days=5)
    assert log.read(now=at(9)).count() == 0 and log.days_there() == []
    assert log.append(rows(spark, [1, 2, 3, 3, 0]), at(4)) == []
    assert log.days_there() == ["2024-01-01", "2024-01-02", "2024-01-03", "none"]
    # two days expire, and an event that has expired already isn't written
    assert log.append(rows(spark, [8, 8, 1]), at(8)) == ["2024-01-01", "2024-01-02"]
    assert log.days_there() == ["2024-01-03", "2024-01-08", "none"] and not os.path.exists(f"{log.path}/day=2024-01-01")
    got = log.read(now=at(8))
    assert got.count() == 5 and {r["input"] for r in got.collect()} == {"[REDACTED]"}
    assert log.read(now=at(12)).where("time <> 'odd'").count() == 2  # not read though still there
    with open(f"{log.path}/day=2024-01-08/extra.json", "w") as f:
        f.write("\n{broken\n" + '{"time":"2024-01-08T23:00:00","n":9}\n')
    since = F.lit("2024-01-08 11:00:00").cast("timestamp")
    assert [r["n"] for r in log.read(since, at(8)).collect()] == [9]


def test_only_wanted_days_are_scanned(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA)
    log.append(rows(spark, range(1, 21)), at(20))
    df = log.read(F.lit("2024-01-18 00:00:00").cast("timestamp"))
    assert sorted(r["n"] for r in df.collect()) == [17, 18, 19]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-18" in plan
    scan = [x for x in plan.splitlines() if "PartitionFilters" in x]
    assert len(scan) == 1


def test_a_stream_of_events(spark, tmp_path):
    rows(spark, [1, 2, 9]).write.parquet(str(tmp_path / "in"))
    log = EventLog(spark, str(tmp_path / "log"), SCHEMA, days=3)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    log.writer(stream, str(tmp_path / "state"), now=lambda: at(10)).trigger(availableNow=True).start().awaitTermination()
    assert log.days_there() == ["2024-01-09"]


def test_events_without_a_time_are_stamped(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), "time string, stage string")
    log.append(spark.createDataFrame([("a",)], "stage string"))
    assert log.read().where(F.col("time").try_cast("timestamp").isNotNull()).count() == 1 and "none" not in log.days_there()
