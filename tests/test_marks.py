"""Marks of personal data rule out only what can't match, and results are those of the patterns alone."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from textmill.functions import detect as D
from textmill.functions import fixed_values as V
from textmill.functions import normalize as N
from textmill.functions.marks import BITS, marks

PIECES = ["13812345678", "+86-", "1", "2", "34", "567890123", "x", "X", " ", "-", ".", "@", "a", "ab.co", "192.168.", "0.1", "://", "http", "https", "WWW.", "wWw.", "，", "微信", "号:", "VX", "vx", "v信", "qQ", "Qq:", "北京", "市", "中山", "路", "小区", "é", "ß", "١", "１", "१", "\n", "abcde12345", "+", "#", "_", "中 文", "　"]


def texts(n, seed=5):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PIECES, k=rng.randrange(0, 12))) for _ in range(n)]
    return [*made, "", None, "１" * 17 + "x", "".join("1234567890 1234567"), "a" * 9 + "1-2-3-4-5-6-7-8-9-0 1 2 3 4 5 6"]


def test_marks_rule_out_only_what_cannot_match():
    rows = texts(4000)
    for own in (pa.array(rows), pa.array(["1.2.3.4@", *rows]).slice(1)):
        got = marks(own).to_pylist()
        assert len(got) == len(rows)
        for name, pattern, _ in V.PRIVACY:
            p = re.compile(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", pattern))
            hits = [bool(t and p.search(t)) for t in rows]
            assert any(hits) and all(m & BITS[name] for m, h in zip(got, hits, strict=True) if h)
            assert sum(bool(m & BITS[name]) for m in got) < len(rows)
    assert marks(pa.array([], pa.string())).to_pylist() == [] and marks(pa.array([None, ""])).to_pylist() == [0, 0]


def test_marked_texts_have_the_results_of_the_patterns_alone(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(1500, 6))], "id long, text string").repartition(3)
    got = df.select("id", "text", D.privacy(F.col("text")).alias("p"), D.masked_privacy(F.col("text")).alias("m"), N.norm_noise(F.col("text")).alias("n")).collect()
    plan = df.select(D.privacy(F.col("text")).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_marks") > 0
    monkeypatch.setattr(D, "_with_marks", lambda text, rules, body: body(None))
    monkeypatch.setattr(D, "_SIGN_OF", {})
    noise = F.regexp_replace("text", f"({N._MAIL})|{N._DROPPED}", "$1")
    old = {r["id"]: r for r in df.select("id", D.privacy(F.col("text")).alias("p"), noise.alias("n")).collect()}
    assert all(r["p"] == old[r["id"]]["p"] and r["m"] == r["p"]["masked"] and r["n"] == old[r["id"]]["n"] for r in got)
    assert sum(r["p"]["masked"] != r["text"] for r in got) > 300


def test_a_pattern_that_starts_with_plain_letters(spark):
    assert D.needed_start(r"\bthe [a-z]+ing\b") == "[tT][hH][eE] " and D.needed_start("abcd?e") == "[aA][bB][cC]"
    assert all(D.needed_start(p) is None for p in ("ab", "this", "abc|def", "[abc]de", "(abc)", "abc?", r"\bab\w"))
    df = spark.createDataFrame([("THE KING the sing",), ("a king",), ("thE doing",), (None,)], "text string")
    for pattern in (r"\bthe [a-z]+ing\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"):
        plain = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?iU){pattern}"), F.lit(0)))
        rows = df.union(spark.createDataFrame([("1.2.3.4 and 1.2.3",), ("1.2.3",), ("١.٢.٣.٤",)], "text string"))
        assert all((r[0] or []) == (r[1] or []) for r in rows.select(D._matches(F.col("text"), pattern), plain).collect())
