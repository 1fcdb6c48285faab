"""Near-duplicates by bottom-k sketches of one hash function.

A document is its set of distinct word shingles, hashed to 64 bits by one function. Documents of equal
sets form a class; all later work is on classes. A class's sketch is its K smallest hashes.

* Inverted lists of retained values generate overlaps. Two sets of the wanted similarity share at
  least NEED(k) retained values, so each class need only be listed under its (size - NEED + 1) rarest
  retained values: any such pair meets in one of these lists. Values that one class alone holds make no
  list, and a passage that thousands of documents share makes one only for documents that consist of
  such passages.
* In a list of up to LIST_SMALL classes every pair is a candidate. In a longer one each class is paired
  with the HUBS most typical ones (whose retained values are the most widely shared).
* Union-sketch estimation (the K smallest of both sketches, and how many of them both hold) drops
  candidates; exact Jaccard on full sets verifies the rest.
* Links make components by alternating large and small stars. Members of long lists that are by then still in
  several components meet once more by what sets them apart from their hub (see _beside_hubs), which finds
  every link that the hubs can't show. So no link between different components is lost, no list is capped,
  and no group is expanded into all its pairs.

NEED for full sketches is the count that a pair of just the wanted similarity falls short of with a
probability under 1e-6; for sets smaller than K it is exact. With exact=True sketches hold whole sets, so that no pair at
all can be missed, at the cost of longer lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

K = 64
LIST_SMALL, HUBS = 12, 2
MISS = 1e-6
#: Classes (of some 100 bytes in memory) that are sent to every task that reads texts.
SENT = 1 << 18


def least_shared(k: int, percent: int, miss: float = MISS) -> int:
    """The largest count that a binomial of k draws at the similarity falls short of with at most `miss`."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > miss:
            return x
    return k


def need(size: int, percent: int, k: int = K) -> int:
    """How many retained values a set of `size` must share with any set of the similarity or more."""
    full = least_shared(k, percent)
    if size >= k:
        return full
    exact = -(-percent * size // 100)  # of its own values
    beyond = max(0, 100 * size // percent - k)  # of the other's values, these may lie past its sketch
    return max(1, min(exact - beyond, full) if beyond else exact)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words make one shingle."""
    own = text.encode("utf-8").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    n = min(words, len(own))
    with np.errstate(over="ignore"):
        out = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(own) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """64-bit values as an Arrow array of lists of signed numbers."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str, k: int | None = K) -> DataFrame:
    """doc_id, tkey (a hash of the text), n_shingles, node (a 128-bit hash of the set, null if empty), sketch."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column(2).to_pylist()]
            nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), _lists([s[:k] for s in sets])], names=["doc_id", "tkey", "n_shingles", "node", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("tkey"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(told, f"doc_id {kind}, tkey long, n_shingles long, node binary, sketch array<long>")


def _padded(column: pa.Array) -> np.ndarray:
    """Sketches as rows of K, the rest filled with the largest value, in unsigned order."""
    out = np.full((len(column), K), np.iinfo(np.uint64).max, np.uint64)
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    size = np.diff(ends)
    out[np.repeat(np.arange(len(size)), size), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = flat[ends[0] : ends[-1]]
    return out


def estimate_passes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair's union sketch allows the similarity: of its K smallest values (fewer where the
    union is smaller, then exactly) so many lie in both."""
    none = np.iinfo(np.uint64).max
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    same = np.concatenate([np.zeros((len(both), 1), bool), (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)], axis=1)
    real = both != none
    rank = np.cumsum(real & ~same, axis=1)
    shared = (same & (rank <= K)).sum(axis=1)
    union = rank[:, -1]
    full = (a[:, -1] != none) | (b[:, -1] != none) | (union > K)
    return np.where(full, shared >= least_shared(K, percent), 100 * shared >= percent * union)


def _candidates_checked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those whose union sketch passes."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("sketch").alias(f"s{name}"))
    joined = pairs.join(side("a").hint("shuffle_merge"), "a").join(side("b").hint("shuffle_merge"), "b").select("a", "b", "sa", "sb")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = estimate_passes(_padded(batch.column(2)), _padded(batch.column(3)), percent) if len(batch) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.mapInArrow(told, "a binary, b binary")


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, own: the full set) of classes, made anew from the text of one document of each."""
    chosen = written(classes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key")).join(nodes.distinct().hint("shuffle_hash"), "node", "left_semi"), "chosen")
    # few classes are sent to the texts; many meet them in a shuffle
    few = chosen.count() <= SENT
    text = docs.select(F.col(id_col).alias("rep_id"), F.xxhash64(text_of(text_col)).alias("rep_key"), text_of(text_col).alias("text"))
    on = text["rep_id"].eqNullSafe(chosen["rep_id"]) & (text["rep_key"] == chosen["rep_key"])
    texts = text.join(F.broadcast(chosen) if few else chosen.hint("shuffle_merge"), on).select(chosen["node"], "text")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_hashes(t, words) for t in batch.column(1).to_pylist()])], names=["node", "own"])

    return written(texts.mapInArrow(told, "node binary, own array<long>").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs those of the similarity on full sets."""

    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("own").alias(f"s{name}")).hint("shuffle_merge")

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(linked, "a binary, b binary")


def _beside_hubs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among the members (hub, node, root) of one hub's lists, of different roots, that can be
    linked although one of them, x, isn't linked with the hub h.

    Let D(x) be the symmetric difference of x and h; that of x and y is the one of D(x) and D(y). As x and h
    fall short of similarity p and x and y don't, D(x) and D(y) share at least p / (1 + p) of D(y), whatever x.
    So y need only be listed under its rarest members of D(y), all but that share and one; there every such
    pair meets x's whole D(x), at its first common member, where enough must be left on both sides. In a
    group of thousands of copies these rarest members are each copy's own changes."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, apart, diffs = [], [], []
            for x, h in zip(batch.column(3), batch.column(4), strict=True):
                x, h = x.values.to_numpy(), h.values.to_numpy()
                diff = np.setxor1d(x, h, assume_unique=True)
                shared = (len(x) + len(h) - len(diff)) // 2
                sizes.append(len(x)), diffs.append(diff.view(np.uint64)), apart.append(100 * shared < percent * (shared + len(diff)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(apart, pa.bool_()), pa.array([len(d) for d in diffs], pa.int64()), _lists(diffs)], names=["hub", "node", "root", "size", "apart", "n", "diff"])

    own = members.join(sets.select("node", F.col("own").alias("x")).hint("shuffle_merge"), "node").join(sets.select(F.col("node").alias("hub"), F.col("own").alias("h")).hint("shuffle_merge"), "hub")
    rows = own.select("hub", "node", "root", "x", "h").mapInArrow(changes, "hub binary, node binary, root binary, size long, apart boolean, n long, diff array<long>")
    rows = written(rows, "changes")
    tokens = rows.select("hub", "node", "root", "size", "apart", "n", F.explode("diff").alias("value"))
    often = tokens.groupBy("hub", "value").agg(F.count("*").alias("df"), F.count_if("apart").alias("apart_df")).where("df > 1 and apart_df > 0")
    # values of one member alone come first in its order; only their number matters
    place = Window.partitionBy("hub", "node").orderBy("df", "value")
    shared = tokens.join(often.hint("shuffle_hash"), ["hub", "value"])
    listed = shared.withColumn("place", F.row_number().over(place) + F.col("n") - F.count("*").over(Window.partitionBy("hub", "node")))
    listed = written(listed.select("hub", "node", "root", "size", "apart", "n", "value", "place"), "change_lists")
    side = lambda name, rows: rows.select("hub", "value", *(F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "size", "n", "place")))
    x = side("x", listed.where("apart"))
    y = side("y", listed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0 + percent) - 1e-9) + 1))
    least = (F.col("x_n") + F.col("y_n") - (F.col("x_size") + F.col("y_size")) * F.lit((100.0 - percent) / (100.0 + percent))) / 2 - 1e-9
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) + 1
    on = (x["hub"] == y["hub"]) & (x["value"] == y["value"]) & (x["x_root"] != y["y_root"]) & (left >= least)
    pairs = x.join(y.hint("shuffle_hash"), on)
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child: one grouping tells."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    bad = ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)")
    return bad.limit(1).count() == 0


def components(links: DataFrame, spark) -> DataFrame:
    """(node, root) of every linked node, by alternating large and small stars until only stars of one parent
    are left. root is the component's smallest node."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_forest_of_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low.hint("shuffle_hash"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and tkey (a hash of the row's text) of every row.

    Rows are linked at a Jaccard similarity of percent or more. component_id is the smallest doc_id that
    links reach, null only if all are null. kept marks that row (of equal rows, all). A row without
    words is linked with nothing and kept. Equal ids with different texts aren't linked by that. An empty
    table gives no row; extra columns are ignored. exact compares whole sets (see above). A text is read whole by one task."""
    spark = docs.sparkSession
    own = written(sketches(docs, words, id_col, text_col, None if exact else K), "sketches")
    classes = own.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "tkey")).alias("rep"), F.any_value("sketch").alias("sketch"), F.any_value("n_shingles").alias("size"))
    classes = written(classes, "classes")
    # lists: values of two classes or more; each class under its rarest ones
    values = classes.select("node", "size", F.explode("sketch").alias("value"))
    # a table of its own, so that the join may split the rows of a value that many classes hold
    held = written(values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "held")
    retained = F.col("size") if exact else F.least("size", F.lit(K))
    needs = F.floor((F.col("size") * percent + 99) / 100) if exact else F.element_at(F.array(*[F.lit(need(s, percent)) for s in range(1, K + 1)]), retained.cast("int"))
    by_class = Window.partitionBy("node")
    listed = (
        values.join(held.hint("shuffle_hash"), "value")
        .withColumn("place", F.row_number().over(by_class.orderBy("df", "value")))
        .withColumn("spread", F.sum("df").over(by_class))
        .withColumn("alone", retained - F.count("*").over(by_class))
        .where(F.col("alone") + F.col("place") <= retained - needs + 1)
        .select("value", "node", "spread")
    )
    listed = written(listed, "lists")
    count = listed.groupBy("value").agg(F.count("*").alias("n"), F.max(F.struct("spread", "node"))["node"].alias("hub"), F.min(F.struct((-F.col("spread")).alias("s"), "node"))["node"].alias("hub2")).where("n > 1")
    count = written(count, "list_sizes")
    short = listed.join(count.where(F.col("n") <= LIST_SMALL).select("value").hint("shuffle_hash"), "value").select("value", "node")
    near = short.select("value", F.col("node").alias("a")).join(short.select("value", F.col("node").alias("b")).hint("shuffle_hash"), "value").where("a < b").select("a", "b")
    long_lists = count.where(F.col("n") > LIST_SMALL)
    star = listed.join(long_lists.hint("shuffle_hash"), "value").select("node", F.explode(F.array_distinct(F.array("hub", "hub2"))).alias("hub")).where("node <> hub")
    star = star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    first = near.union(star).distinct()
    first = written(first if exact else _candidates_checked(first, classes, percent), "candidates")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    links = written(_verified(first, _sets(ends(first), docs, classes, words, id_col, text_col), percent), "links")
    roots = written(components(links, spark), "roots")
    if long_lists.limit(1).count():
        # long lists whose members are still in several components
        placed = listed.join(long_lists.select("value", "hub").hint("shuffle_hash"), "value").join(roots.hint("shuffle_hash"), "node", "left").select("value", "hub", "node", F.coalesce("root", "node").alias("root"))
        open_lists = placed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
        members = written(placed.join(open_lists.hint("shuffle_hash"), "value").select("hub", "node", "root").distinct(), "members")
        sets = _sets(members.select("node").union(members.select(F.col("hub").alias("node"))), docs, classes, words, id_col, text_col)
        again = written(_verified(_beside_hubs(members, sets, percent), sets, percent), "more_links")
        if again.limit(1).count():
            roots = written(components(links.union(again), spark), "roots")
    # the smallest id of each component, over classes
    placed = classes.select("node", F.col("rep.doc_id").alias("first_id")).join(roots.hint("shuffle_hash"), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = placed.join(ids.hint("shuffle_hash"), "root").select("node", "component_id")
    rows = own.select("doc_id", "tkey", "n_shingles", "node")
    out = rows.join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tkey")


def op4_bottom_k_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, 85 percent: the contract's."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("tkey")
