"""Features and classifiers against plain Python: tf-idf by its formula, logistic regression by gradient descent."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import features as X
from textmill.operators import models as M
from textmill.operators import tables


def plain_grams(kind, text):
    if text is None:
        return []
    if kind == "word":
        w = re.findall(r"\b\w\w+\b", text.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    t = re.sub(r"\s\s+", " ", text.lower())
    return [t[i : i + n] for n in range(2, 6) for i in range(len(t) - n + 1)]


def plain_features(kind, fit, texts, min_df=1, max_df=1.0, most=None):
    counts = [Counter(plain_grams(kind, t)) for t in fit]
    df, total = Counter(g for c in counts for g in c), sum(counts, Counter())
    kept = [g for g in df if df[g] >= min_df and df[g] <= max_df * len(fit)]
    kept = sorted(sorted(kept, key=lambda g: (-total[g], g))[:most])
    out = np.zeros((len(texts), len(kept)))
    for row, t in zip(out, texts, strict=True):
        c = Counter(plain_grams(kind, t))
        row[:] = [c[g] * (math.log((1 + len(fit)) / (1 + df[g])) + 1) for g in kept]
        row /= np.linalg.norm(row) or 1.0
    return kept, out


def plain_regression(x, y, k, c):
    """The minimum of c * sum of weighted log losses + half the squares (intercepts free), by accelerated descent."""
    n = np.bincount(y, minlength=k)
    weight = len(y) / (k * n[y])
    w, b, step = np.zeros((k, x.shape[1])), np.zeros(k), 0.5 / (1 + c * weight.sum())
    free = np.arange(k) > 0 if k == 2 else np.ones(k, bool)  # two labels: one row of coefficients
    v, u, target = w, b, np.eye(k)[y]
    for i in range(20_000):
        m = x @ v.T + u
        e = np.exp(m - m.max(axis=1, keepdims=True))
        d = c * weight[:, None] * (e / e.sum(axis=1, keepdims=True) - target)
        new_w, new_b = (v - step * (d.T @ x + v)) * free[:, None], (u - step * d.sum(axis=0)) * free
        v, u, w, b = new_w + i / (i + 3) * (new_w - w), new_b + i / (i + 3) * (new_b - b), new_w, new_b
    return w, b


def texts(n, seed=3):
    rng = random.Random(seed)
    words = {"a": "red  blue green", "b": "one two\t\tthree blue", "c": "Äpfel über straße two"}
    rows = []
    for i in range(n):
        label = rng.choice("abc")
        rows.append((i, " ".join(rng.choice((words[label] + " the of x").split(" ")) for _ in range(rng.randrange(1, 9))), label))
    return rows + [(n, None, "a"), (n + 1, "", "b"), (n + 2, "x", "c"), (n + 3, "zzz qqq", None)]


@pytest.mark.parametrize("kind", ["word", "char"])
@pytest.mark.parametrize("sent", [None, 0])
def test_features(spark, kind, sent, monkeypatch):
    monkeypatch.setattr(tables, "RANGE", 20)
    rows = texts(40)
    df = spark.createDataFrame(rows, "id long, text string, label string")
    counts = X.gram_counts(df, "id", X.grams_of(kind, F.col("text")))
    for limits in ((1, 1.0, None), (2, 0.5, None), (1, 1.0, 7)):
        words = X.fit_dictionary(counts, len(rows), *limits)
        kept, want = plain_features(kind, [t for _, t, _ in rows], [t for _, t, _ in rows], *limits)
        assert [r["gram"] for r in words.table.orderBy("index").collect()] == sorted(kept, key=lambda g: g.encode())
        got = np.zeros_like(want)
        for r in X.weighted(counts, words, sent=1 << 20 if sent is None else sent).collect():
            got[r["id"], kept.index(r["gram"])] = r["weight"]
        assert np.abs(got - want).max() < 1e-12
        for r in X.feature_rows(counts, words).collect():
            assert r["indices"] == sorted(r["indices"]) and np.allclose(want[r["id"]][[kept.index(g["gram"]) for g in words.table.where(F.col("index").isin(r["indices"])).orderBy("index").collect()]], r["weights"])


@pytest.mark.parametrize(("labels", "kind", "c"), [("ab", "word", 1.0), ("abc", "word", 10.0), ("abc", "char", 1.0)])
def test_classifier_is_the_regression(spark, labels, kind, c):
    rows = [r for r in texts(60) if r[2] is None or r[2] in labels]
    df = spark.createDataFrame(rows, "probs long, text string, label string")  # a column of a clashing name is overwritten
    model = M.train_classifier(df, "text", "label", kind, c, tol=1e-12)
    own = [(t, y) for _, t, y in rows if y]
    _, x = plain_features(kind, [t for t, _ in own], [t for t, _ in own])
    w, b = plain_regression(x, np.array([labels.index(y) for _, y in own]), len(labels), c)
    _, every = plain_features(kind, [t for t, _ in own], [t for _, t, _ in rows])
    e = np.exp(every @ w.T + b)
    want = e / e.sum(axis=1, keepdims=True)
    got = {r["text"]: r["probs"] for r in M.score_table(model, df, "text").collect()}
    assert len(got) == len({t for _, t, _ in rows})
    for (_, t, _), p in zip(rows, want, strict=True):
        assert [q["label"] for q in got[t]] == list(labels) and np.abs(np.array([q["p"] for q in got[t]]) - p).max() < 2e-3


def test_one_label_is_an_error(spark):
    with pytest.raises(ValueError, match="two labels"):
        M.train_classifier(spark.createDataFrame([("a b", "x")], "text string, label string"), "text", "label")


def test_numbered(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE", 7)
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    assert [r["index"] for r in tables.numbered(df, ["k"]).orderBy("k").collect()] == list(range(100))
    assert tables.numbered(df.limit(0), ["k"]).count() == 0


def test_training_sends_a_gradient_a_core_and_joins_no_features(spark, monkeypatch):
    for name, value in (("KNOWN", 0), ("BATCH", 300), ("RANGE", 200)):
        monkeypatch.setattr(X, name, value)
    monkeypatch.setattr(M, "KNOWN", 0)
    seen, fit = [], M.LogisticRegression.fit
    monkeypatch.setattr(M.LogisticRegression, "fit", lambda self, points: seen.append(points) or fit(self, points))
    rows = texts(60)
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = M.train_classifier(df, "text", "label", "char", tol=1e-12)
    (points,) = seen
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan and model.words.counts.batches > points.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    own = [(t, y) for _, t, y in rows if y]
    assert points.count() == len(own)  # those without n-grams too
    kept, x = plain_features("char", [t for t, _ in own], [t for t, _ in own])
    order = sorted(range(len(kept)), key=lambda i: kept[i].encode())
    got = sorted([round(r["number"]), *np.round(r["features"].toArray(), 9)] for r in points.collect())
    assert np.allclose(got, sorted([["abc".index(y), *np.round(v[order], 9)] for v, (_, y) in zip(x, own, strict=True)]))
    # scores: only they are joined with the rows
    scored = M.score_table(model, df, "text")
    monkeypatch.setattr(M, "KNOWN", 1 << 16)
    p = lambda d: {r["id"]: [q["p"] for q in r["probs"]] for r in d.collect()}
    wide, want = p(scored), p(M.score_table(model, df, "text"))
    assert "indices" not in scored._jdf.queryExecution().executedPlan().toString() and wide.keys() == want.keys()
    assert all(np.allclose(wide[k], want[k]) for k in want)
