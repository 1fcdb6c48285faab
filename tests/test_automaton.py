"""Large word lists: the automaton finds and replaces what literals do."""

import random

from pyspark.sql import functions as F

from textmill.functions import automaton
from textmill.functions import detect as D
from textmill.functions import normalize as N

TEXTS = [None, "", "a", "ababab abba", "Über STRASSE ab é漢字", "xyz" * 500, " a b\ta\nb "] + ["".join(random.Random(k).choices("abcd é", k=60)) for k in range(30)]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdé", k=rng.randrange(1, 5))) for _ in range(n)]


def test_same_matches_as_literals(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    lexicons = {"ad": words(40, 1) + ["a", "a"], "porn": [], "violence": words(40, 2)}
    phrases = {"ad": ["A B", "ab", "Ba"], "abuse": words(70, 4)}
    out = []
    for few in (10**6, 3):
        monkeypatch.setattr(D, "FEW", few)
        out.append(df.select("id", D.detect_keywords(F.col("text"), lexicons).alias("k"), D.detect_high_risk(F.col("text"), phrases).alias("h")).orderBy("id").collect())
    assert out[0] == out[1]
    for r, t in zip(out[1], TEXTS, strict=True):
        want = [] if t is None else [(c, [w for w in ws if w in t]) for c, ws in sorted(lexicons.items(), key=lambda x: list(lexicons).index(x[0]))]
        assert [(d["category"], d["matches"]) for d in r["k"]] == [(c, m) for c, m in want if m]


def test_same_cascade_as_literals(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    rng = random.Random(9)
    entries = [(s, "".join(rng.choices("abcdé", k=rng.randrange(0, 4)))) for s in dict.fromkeys(words(80, 7))]
    out = []
    for few in (10**6, 3):
        monkeypatch.setattr(N, "FEW", few)
        out.append([(r["t"], r["m"] or []) for r in df.select("id", N.norm_map(F.col("text"), entries).alias("t"), N.map_match_counts(F.col("text"), entries).alias("m")).orderBy("id").collect()])
    assert out[0] == out[1]


def test_fifty_thousand_words(spark):
    rng = random.Random(3)
    many = sorted({"".join(rng.choices("abcdefgh", k=8)) for _ in range(50_000)})
    df = spark.range(200).select(F.concat(F.lit(many[7]), F.lit(" x "), F.lit(many[3])).alias("text"))
    got = df.select(D.detect_keywords(F.col("text"), {"ad": many})[0]["matches"].alias("m")).distinct().collect()
    assert [r["m"] for r in got] == [[many[3], many[7]]]
    assert automaton._places(automaton._machine("none", [""]), "abc") == {0}


def test_cascade_looks_through_a_text_once_and_about_its_replacements(monkeypatch):
    rng, read = random.Random(5), []
    places = automaton._places
    monkeypatch.setattr(automaton, "_places", lambda machine, t: read.append(len(t)) or places(machine, t))
    many = sorted({"".join(rng.choices("abcdefgh", k=6)) for _ in range(400)})
    pairs, text, want = [(w, w[::-1] + "_") for w in many], " ".join(many), " ".join(many)
    got = automaton._applied(automaton._machine("once", many), pairs, 6, text)
    for s, t in pairs:
        want = want.replace(s, t)
    assert got["text"] == want and len(got["matches"]) >= 400
    assert sum(read) < 10 * len(text)
    for _ in range(2000):
        pairs = [tuple("".join(rng.choices("ab", k=rng.randrange(k, 4))) for k in (1, 0)) for _ in range(8)]
        text = "".join(rng.choices("ab", k=30))
        want, counts = text, []
        for s, t in pairs:
            counts += [want.count(s)] if s in want else []
            want = want.replace(s, t)
        got = automaton._applied(automaton._machine(repr(pairs), [s for s, _ in pairs]), pairs, 3, text)
        assert (got["text"], [m["count"] for m in got["matches"]]) == (want, counts)
