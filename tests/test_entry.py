"""The driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_flagship(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["n3_norm_map", "d1_detect_keywords", "d8_semantic_detection", "a4_counts_by", "c5_duplicate_groups", "j4_overlap", "p1_stratified_split", "g8_space_insert", "m6_per_class_metrics"])
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "events", "conversations", "benchmark"):
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = sorted(repr([show(r[c]) for c in sorted(cols)]) for r in got.collect())
    assert sorted(cols) == sorted(got.columns)
    assert rows == sorted(repr([show(v) for _, v in sorted(zip(cols, r, strict=True))]) for r in want.fetchall())
