"""The first distinct variants of a group: only hashes are grouped, ties in order are decided by text."""

from pyspark.sql import functions as F

from textmill.operators import adversarial as G


def test_first_variants_group_no_texts(spark, monkeypatch):
    rows = [(1, "b b", "x"), (1, "a a", "x"), (2, "a a", "x"), (2, "c c", "x"), (3, "d d", "x"), (4, "a a", "x")]
    seeds = spark.createDataFrame(rows, "at long, text string, label string")
    plans, kept = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a, **k))
    made = {}
    for most in (1, 2, 3, 9):
        out = G.build_v1(seeds, G.Rules({}, {"x": ["q"]}, ()), "at", most, kinds=("symbol_insertion",))
        made[most] = sorted((r["at"], r["adversarial_text"]) for r in out.collect())
    every = [(1, "a@ a"), (1, "b@ b"), (2, "c@ c"), (3, "d@ d")]
    assert made == {n: every[:n] for n in made}
    first = [line for p in plans[::2] for line in p.splitlines() if "Exchange hashpartitioning" in line]
    assert first and not any("adversarial_text" in line for line in first)
