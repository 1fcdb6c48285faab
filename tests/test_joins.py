"""Similarity joins and greedy quotas against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.operators import adversarial as G
from textmill.operators import linkage as J
from textmill.operators import set_blocks, tables


def sets(n, seed, start=0):
    """Sets in families that share most members, of a few common and many rare ones."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        family = random.Random(rng.randrange(8))
        core = [f"m{int(family.paretovariate(0.4)) % 400}" for _ in range(20)]
        own = [x for x in core if rng.random() < 0.85] + [f"m{rng.randrange(400)}" for _ in range(rng.randrange(6))]
        rows.append((start + i, own + own[:2]))
    return rows + [(start + n, []), (start + n + 1, None), (start + n + 2, ["m1"])]


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
@pytest.mark.parametrize("sent", [None, 0])
def test_similar_pairs(spark, monkeypatch, threshold, sent):
    if sent is not None:
        monkeypatch.setattr(tables, "SENT", sent)
    a, b = sets(60, 1), sets(50, 2, 100)
    one, two = (spark.createDataFrame(x, "id long, members array<string>").repartition(3) for x in (a, b))
    want = {}
    for i, x in a:
        for j, y in b:
            if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold:
                want[i, j] = len(set(x) & set(y)) / len(set(x) | set(y))
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in J.similar_pairs(one, two, threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    if threshold in (0.55, 0.8):
        assert J.candidate_pairs(*J.ranked_sets([one, two], threshold), threshold).count() <= 3 * len(want) + 3
    best = {i: min((-s, j) for (k, j), s in want.items() if k == i) for i in {i for i, _ in want}}
    near = {r["candidate_id"]: (r["reference_id"], r["similarity"]) for r in J.nearest_reference(one, two, threshold).collect()}
    assert near == {i: (j, round(-s, 6)) for i, (s, j) in best.items()}


def test_a_small_side_is_not_shuffled_and_gives_the_same(spark, monkeypatch):
    one, two = (spark.createDataFrame(x, "id long, members array<string>") for x in (sets(60, 1), sets(300, 2, 100)))
    rows = lambda df: {tuple(r) for r in df.collect()}
    small, swapped = J.similar_pairs(one, two, 0.4), J.similar_pairs(two, one, 0.4)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString() and small.count() > 50
    monkeypatch.setattr(set_blocks, "CELLS", 500)  # many blocks
    blocked = rows(J.similar_pairs(one, two, 0.4))
    monkeypatch.setattr(J, "FEW_SETS", 0)
    indexed = rows(J.similar_pairs(one, two, 0.4))
    assert rows(small) == blocked == indexed == {(b, a, s) for a, b, s in rows(swapped)}


def test_similar_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "id long, members array<string>")
    some = spark.createDataFrame(sets(5, 1), none.schema)
    assert J.similar_pairs(none, some, 0.5).count() == J.similar_pairs(some, none, 0.5).count() == J.similar_pairs(none, none, 0.5).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_greedy_blocks(spark, seed):
    rng = random.Random(seed)
    rows = [(b, n, h, 1 + b % 3) for b in range(9) for n, h in enumerate(rng.sample([f"h{i}" for i in range(14 if seed else 4)], rng.randrange(1, 5 if not seed else 12)))]
    used, count, want = set(), {}, []
    for b, n, h, quota in sorted(rows):
        if h not in used and count.get(b, 0) < quota:
            used.add(h)
            count[b] = count.get(b, 0) + 1
            want.append((b, h))
    got = G.greedy_blocks(spark.createDataFrame(rows, "_block int, _n int, _h string, _quota int").repartition(3))
    assert sorted((r["_block"], r["_h"]) for r in got.collect()) == sorted(want)


def test_build_v2_is_the_sequential_rule(spark):
    """Variants of all seeds, taken one by one."""
    targets, kinds = {"ad": 2, "violence": 1}, ("space_insertion", "symbol_insertion", "repeat_character", "url_obfuscation")
    rng = random.Random(1)
    seeds = spark.createDataFrame([(i, rng.choice(["加 微信 x", "加微信 http://a.com", "杀人 了", "http://b.com/x 微信", "加微信"]), rng.choice(["ad", "violence", "normal"])) for i in range(40)], "id long, text string, label string").withColumn("other", F.lit(1))
    rules = G.Rules(keywords={"ad": ("微信", "加"), "violence": ("杀人",)})
    rows = sorted(G.variants(seeds.where("label in ('ad', 'violence')"), rules, kinds, "text", "label").collect(), key=lambda r: (r["kind_order"], list(targets).index(r["label"]), r["id"]))
    used, count, want = set(), {}, []
    for r in rows:
        block = (r["kind_order"], r["label"])
        if r["adversarial_text"] not in used and count.get(block, 0) < targets[r["label"]]:
            used.add(r["adversarial_text"])
            count[block] = count.get(block, 0) + 1
            want.append((r["perturbation_type"], r["label"], r["id"], r["adversarial_text"]))
    got = G.build_v2(seeds, rules, "id", targets, kinds=kinds)
    assert want and sorted((r["perturbation_type"], r["label"], r["id"], r["adversarial_text"]) for r in got.collect()) == sorted(want)
