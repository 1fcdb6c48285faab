"""The corpus pipeline, stage by stage against plain Python, on nulls, repeats, ties, extra columns and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from textmill.llm import mixing, near_dedup, quality, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"


def fixture():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    rows = []
    for i in range(60):
        text = prose(rng.randint(20, 120)) if i % 3 else "BUY NOW!!! $$$\n" * rng.randint(3, 30)
        rows.append((i, text, f"s{i % 3}" if i % 7 else None))
    base = rows[1][1]
    rows += [(100 + i, base.replace(base.split()[i], "changed", 1), "s1") for i in range(3)]  # near copies
    rows += [(200, rows[2][1], "s2"), (201, "password = 'hunter2222' and " + prose(60), "s0")]
    rows += [rows[4], rows[4], (None, prose(40), "s1"), (None, prose(41), None), (300, None, "s0"), (301, "", "s1"), (302, " \n ", "s1"), (303, prose(9000), "s2")]
    return [(i, t, "en", s, None if t is None else len(t), True, 0.5) for i, t, s in rows]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, at = fixture(), str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 3 != 0), 0) for i in range(0, 60, 2)] + [(None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, docs


def rows_of(df):
    assert df.columns == list(pipeline.COLUMNS)
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_quality_keeps_what_scores_above_the_threshold(spark, corpus):
    at, rows, docs = corpus
    got = rows_of(pipeline.quality_classifier(spark, docs, at))
    labels = spark.read.parquet(f"{at}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scores = quality.scores([(r[1] or "").encode() for r in rows], model)
    assert got == Counter((r[0], r[1], r[3]) for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD)
    assert not any(t and t.startswith("BUY") for _, t, _ in got) and any(i == 1 for i, _, _ in got)


def test_one_document_of_each_group_stays(spark, corpus):
    at, rows, docs = corpus
    got = rows_of(pipeline.near_duplicates(spark, docs, at))
    sets = {}
    for k, (i, t, *_) in enumerate(rows):
        w = (t or "").lower().split()
        sets[k] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {k: k for k in sets}
    for a in sets:
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    kept = set()
    for g in set(group.values()):
        members = [rows[k] for k in group if group[k] == g]
        first = min(members, key=lambda r: (r[0] is None, r[0]))
        kept.add((first[0], first[1]))
    assert {(i, t) for i, t, _ in got} == kept and max(got.values()) == 1


def test_secrets_are_masked(spark, corpus):
    at, rows, docs = corpus
    out = pipeline.secret_masking(spark, docs, at)
    assert rows_of(out) == Counter((r[0], r[1] and secret_scan.masked(r[1]), r[3]) for r in rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect()) and not out.where("text like '%hunter2222%'").count()


def test_mix_comes_near_its_targets(spark, corpus):
    at, rows, docs = corpus
    got = rows_of(pipeline.mix_to_weights(spark, docs, at))
    own = Counter((r[0], r[1], r[3]) for r in rows)
    assert set(got) <= set(own) and all(n <= 3 * own[k] for k, n in got.items())
    size = lambda t: len(WORD.findall(t or ""))
    have, taken = Counter(), Counter()
    for (_, t, s), n in own.items():
        have[s] += size(t) * n
    for (_, t, s), n in got.items():
        taken[s] += size(t) * n
    targets = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(have.items()), "source string, source_size long")).collect()}
    for s in have:
        passes, sums = min(3, int(targets[s] // have[s])), 1
        for (_, t, own_source), n in own.items():
            for _ in range(n if own_source == s else 0):
                sums |= sums << size(t)
        reach = [passes * have[s] + x for x in range(have[s] + 1) if sums >> x & 1] if passes < 3 else [3 * have[s]]
        assert abs(taken[s] - targets[s]) <= min(abs(x - targets[s]) for x in reach) + 1


def test_packing_loses_nothing(spark, corpus):
    from tokenizers import Tokenizer

    from textmill.llm import tokens

    at, rows, docs = corpus
    got = pipeline.packed(spark, docs, at).collect()
    tok = Tokenizer.from_file(tokens.default_path())
    assert sum(r["length"] for r in got) == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    used = Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and {r["doc_id"] for r in got} == {r[0] for r in rows}


def test_stages_on_an_empty_table(spark, corpus):
    at, _, docs = corpus
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0


def test_whole_pipeline(spark, corpus):
    at, rows, _ = corpus
    got = pipeline.run(spark, at).collect()
    ids = {r["doc_id"] for r in got}
    assert ids and ids <= {r[0] for r in rows} and not ids & {100, 101, 102, 200, 0, 3} and near_dedup.K > 0 and np.all([r["length"] > 0 for r in got])
