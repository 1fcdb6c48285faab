"""Exact top-k, lexical ranking and the Merkle manifest against plain Python: nulls, ties, repeated rows, empty tables,
hot keys, other columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill import llm
from textmill.llm import lexical, merkle, topk

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
NEW = ("op11_uniform_threshold_topk", "op12_bag_dedup_search", "op13_slot_pivot_manifest")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = llm.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({llm.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


# top-k


def brute_topk(rows, is_query, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    whole = sorted({(i, tuple(v)) for i, v in whole})
    out = []
    for q, v in whole:
        if is_query(q):
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def vectors(n, dim, seed, hot=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.15) for _ in range(dim)]) for i in range(n)]
    same = [rng.gauss(0, 0.3) for _ in range(dim)]
    rows += [(n + i, same) for i in range(hot)]
    rows += [(5, None), (None, same), (7001, [0.1, None]), (7002, [float("nan")] * dim), (7003, [float("inf")] * dim), (7010, [0.0] * dim), (7020, [0.5]), rows[3], (10, same), (7030, [])]
    return rows


@pytest.mark.parametrize(("n", "dim", "hot", "lists", "part", "lane"), [(300, 16, 150, 2, 100, 7), (300, 16, 0, 3, 1000, 1000), (4, 3, 0, 2, 10, 10), (120, 1, 60, 2, 50, 5)])
def test_topk(spark, n, dim, hot, lists, part, lane):
    rows = vectors(n, dim, n + dim, hot)
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, list string, score double").repartition(3)
    got = topk.search(df, F.col("id") % 10 == 0, lists=lists, part=part, lane=lane, k=4, gather=1 + n % 8)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_topk(rows, lambda i: i % 10 == 0, 4)


def test_topk_whole_numbers_and_ties(spark):
    """Few distinct scores, so that cutoffs tie; entries so large that floats can't hold their sums."""
    rng = random.Random(5)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(4)]) for i in range(200)]
    big = [(i, [float(rng.randrange(-(1 << 20), 1 << 20)) for _ in range(4)]) for i in range(60)]
    for data in (rows, big):
        got = topk.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 7 == 0, part=50)
        assert sorted(map(tuple, got.collect())) == brute_topk(data, lambda i: i % 7 == 0, 5)
    with pytest.raises(OverflowError):
        topk.search(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"), F.col("id") > 0)


def test_topk_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, F.lit(True)).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0])], none.schema), F.lit(True)).count() == 0


def test_shares_add_up():
    import numpy as np

    assert topk.shares(None, np.zeros(2)) is None
    for cut in (-100, 0, 7, 10**12):
        for mean in ([0.0, 0.0], [3.7, -2.2, 1e6]):
            assert sum(topk.shares(cut, np.array(mean))) == cut


# ranking


def brute_rank(docs, items, top=20):
    found = lambda t: re.findall(lexical.TERM, (t or "").translate(UPPER))
    bags = [(i, found(t)) for i, t in docs]
    bags = [(i, t, Counter(t)) for i, t in bags if t]
    n_docs, total = len(bags), sum(len(t) for _, t, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in set(items):
        own = []
        for i, t, bag in bags:
            m = 75 + 25 * len(t) * n_docs // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 12 * m)) for w, c in Counter(found(text)).items() if w in bag)
            if score > 0:
                own.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(own)[:top])]
    return sorted(out, key=repr)


DOCS = [(i, f"Common word{i % 7} w{i % 3} É漢字 x-y_z the the") for i in range(60)] + [(100 + i, "the copy of a text about word3") for i in range(40)] + [
    (200, None), (201, ""), (202, "--- ,,, "), (203, "word1 " * 5000), (None, "word2 word5"), (7, "word2 word2"), (7, "word2 word2"), (204, "WORD3 word3!word3")]
ITEMS = [(1, "word3 the"), (2, "word2, word2 WORD5"), (3, "nothing here"), (4, None), (5, "..."), (1, "word3 the"), (1, "copy"), (6, "É漢字 common")]


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_rank(spark, block):
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in DOCS], "doc_id long, text string, item_id string, score long, rank int").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.rank(docs, items, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_rank(DOCS, ITEMS)


def test_rank_few_sums_at_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 10)
    best = lexical.Best(2, 3)
    best.limit = 4
    import numpy as np

    rng, rows = random.Random(1), []
    for k in range(50):
        item, score, first = rng.randrange(2), rng.randrange(1, 9), rng.randrange(100)
        rows.append((item, -score, first, k))
        best.add(np.array([item]), np.array([score]), np.array([first]), [[k]])
    item, score, ids = best.cut()
    want = [r for i in range(2) for r in sorted(r for r in rows if r[0] == i)[:3]]
    assert sorted(zip(item.tolist(), (-score).tolist(), strict=True)) == sorted((i, s) for i, s, _, _ in want)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, lexical.rank(docs, items).collect()), key=repr) == brute_rank(DOCS, ITEMS)


def test_rank_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame(ITEMS, items.schema)
    assert lexical.rank(docs, items).count() == lexical.rank(docs, full).count() == lexical.rank(spark.createDataFrame(DOCS, docs.schema), items).count() == 0


# manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha(*(put(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def up(nodes):
        """root, and of each node its siblings (left, right) level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for n, p in enumerate(at):
                run = runs[p // 8]
                paths[n].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at, nodes = [p // 8 for p in at], [sha(*r) for r in runs]
        return nodes[0], paths

    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for x in langs:
        trees[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        done[x] = up([leaf(r) for r in trees[x]])
    root, over = up([done[x][0] for x in langs])
    out = []
    for x, above in zip(langs, over, strict=True):
        for r, own in zip(trees[x], done[x][1], strict=True):
            path, bad = own + above, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            fold = leaf(r | {"text": r["text"] and r["text"].translate(UPPER)} if bad else r)
            for a, b in path:
                fold = sha(a, fold, b)
            out.append((r["doc_id"], leaf(r), done[x][0], root, sha(*(a + b for a, b in path)), fold, fold == root))
    return sorted(map(repr, out))


def documents(langs, per, seed=1):
    rng = random.Random(seed)
    row = lambda i, lang: {"doc_id": i, "source": rng.choice(["s", None, "é"]), "lang": lang, "n_chars": rng.choice([None, 5]), "text": rng.choice(["Ab c", "low", "", None, "Ünï 漢"]), "leaf": "clash", "pos": 3}
    rows = [row(rng.randrange(10_000), lang) for lang, n in zip(langs, per, strict=True) for _ in range(n)]
    if rows:
        rows += [rows[0], rows[0], rows[0] | {"text": "Other"}, rows[0] | {"doc_id": None}]
    return rows


@pytest.mark.parametrize(("langs", "per"), [
    (["en", "de", None, "", "zh", "é"], [150, 9, 8, 1, 65, 2]), (["en"], [1]), (["en"], [0]), ([f"l{i}" for i in range(75)], [1 + i % 3 for i in range(75)]),
])
def test_manifest(spark, monkeypatch, langs, per):
    monkeypatch.setattr(merkle, "RANGE", 40)
    rows = documents(langs, per)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int").repartition(3)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(df, tampered=third).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(repr, map(tuple, got.collect()))) == (brute_manifest(rows) if rows else [])


def test_manifest_lone_leaf_and_hot_id(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 10)
    one = [{"doc_id": 5, "source": "s", "lang": "en", "n_chars": 1, "text": "T", "leaf": "", "pos": 1}]
    hot = documents(["en"], [30]) + one * 200
    for rows in (one, hot):
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos int").repartition(4)
        monkeypatch.setattr(merkle, "SENT", 0)  # the shuffled way for the table of ranges
        got = merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
        assert sorted(map(repr, map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))) == brute_manifest(rows)
