"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum over LISTS score lists: list j holds, for a query, every candidate's inner product over the dimensions j,
j + LISTS, …. No list is stored; it is made in tasks that hold one list's columns of a part of the candidates and of a lane of
the queries.

1. Each list gives a query's highest local scores (best of each part, then of the list). The candidates gathered so are scored
   whole, as local scores may be negative and partial sums then bound nothing. The last of the best of them is a safe cutoff t:
   at least as many candidates as wanted reach it.
2. t is dealt evenly over the lists, each list's share measured from the list's mean score; the shares, integers, add up to t.
   A candidate below its share in every list is below t. So each list sends all entries that reach its share. With two lists
   that is about the square root of the table for each query.
3. Entries of a candidate are added up. Seen in all lists, its score is known; the best known scores raise t. Of the others
   those whose sum, with just under the share for each list that lacks them, can reach t are scored whole.

Equal vectors are one candidate with its k + 1 smallest ids, and one query. All scores are integers: products are made in
floats only where every sum that can occur is exact in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 5
LISTS = 2
#: Local scores that phase 1 gathers of each query and list (k + 1 at least): more make the cutoff higher and phase 2 smaller.
GATHER = 32
#: Candidates of a part and queries of a lane: what a task holds; queries scored at once.
PART, LANE, TILE = 65_536, 16_384, 64
KEYS = ["q1", "q2", "c1", "c2"]
ENTRY = "q1 long, q2 long, c1 long, c2 long, first long, list int, score long"
SALTS = 64


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v (floor(scale * x) of each component x as double; zeros behind a vector shorter than the longest), h1, h2 (hashes
    of v): rows with an id whose vector is not null and holds finite numbers only. v has the narrowest integer type that
    holds all of them."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x")).where("id is not null and x is not null")
    own = own.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("id", F.transform("x", lambda x: F.floor(F.lit(scale) * x)).alias("v"))
    most = own.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    dim, reach = max(most["dim"] or 0, 1), max(most["high"] or 0, -(most["low"] or 0))
    if reach * reach * dim >= 1 << 63:
        raise OverflowError("inner products of these vectors don't fit 64 bits")
    kind = "smallint" if reach < 1 << 15 else "int" if reach < 1 << 31 else "bigint"
    wide = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).cast(f"array<{kind}>")
    return own.select("id", wide.alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def products(asks: np.ndarray, held: np.ndarray) -> np.ndarray:
    """asks @ held.T, exact: in the fastest type that holds any sum that can occur."""
    a, b = (max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (asks, held))
    most = a * b * asks.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return asks.astype(kind) @ held.astype(kind).T


def shares(cut: int | None, mean: np.ndarray) -> list[int] | None:
    """Integers that add up to cut, each about as far above its list's mean score; none without a cutoff."""
    if cut is None:
        return None
    over = (cut - float(mean.sum())) / len(mean)
    own = [int(np.floor(m + over)) for m in mean[:-1].tolist()]
    return [*own, cut - sum(own)]


def _entries(list_no: int, held: pa.Table, asks: pa.Table, choose) -> pa.Table:
    """The entries that choose(scores of a tile of queries, place of the tile) picks: places in the tile and in held."""
    columns = [[] for _ in range(7)]
    if held.num_rows and asks.num_rows:
        x, q = matrix(held["v"], held.num_rows), matrix(asks["v"], asks.num_rows)
        sides = [asks["q1"].to_numpy(), asks["q2"].to_numpy(), held["c1"].to_numpy(), held["c2"].to_numpy(), held["first"].to_numpy()]
        for t in range(0, len(q), TILE):
            s = products(q[t : t + TILE], x)
            a, b = choose(s, t)
            for c, values in zip(columns, [sides[0][t + a], sides[1][t + a], sides[2][b], sides[3][b], sides[4][b], np.full(len(a), list_no, np.int32), s[a, b].astype(np.int64)], strict=True):
                c.append(values)
    kinds = [np.int64] * 5 + [np.int32, np.int64]
    return pa.table({n: np.concatenate(c) if c else np.zeros(0, k) for n, c, k in zip(("q1", "q2", "c1", "c2", "first", "list", "score"), columns, kinds, strict=True)})


def whole_scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (KEYS, first) with score, the inner product of the whole vectors."""

    def dotted(batches):
        for batch in batches:
            n = len(batch)
            a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64) if n else np.zeros((0, 1), np.int64) for i in (5, 6))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array((a * b).sum(axis=1), pa.int64())], names=[*KEYS, "first", "score"])

    # pairs come from Python, whose sizes Spark can't know: the strategies are named
    both = pairs.join(vectors.select("c1", "c2", F.col("v").alias("x")).hint("merge"), ["c1", "c2"]).join(queries.select("q1", "q2", F.col("v").alias("y")).hint("merge"), ["q1", "q2"])
    return both.select(*KEYS, "first", "x", "y").mapInArrow(dotted, "q1 long, q2 long, c1 long, c2 long, first long, score long")


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: float = 256.0, lists: int = LISTS, part: int = PART, lane: int = LANE, gather: int = GATHER) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products (all, if fewer) of each query, ties to the smaller
    id, over vectors of integers floor(scale * x).

    is_query is a Column of `id`. Candidates are all vectors but those with the query's own id. Rows that repeat an id and a
    vector count once; an id with several vectors stands for each of them. At most 62 lists. Zero vectors take part; null ones, those with null
    or non-finite components and rows without an id don't. Components that a shorter vector lacks are 0. An empty table gives
    no row; scores that may exceed 64 bits are an error. Other columns are not read."""
    spark, g = rows.sparkSession, k + 1  # a query may find itself
    gather = max(gather, g)
    own = written(quantized(rows, id_col, vector_col, scale).dropDuplicates(["h1", "h2", "id"]), "vectors")
    # the g smallest ids of each distinct vector: first within salts, so that no vector is one group
    salted = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    few = own.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= g).withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= g)
    few = few.groupBy(F.col("h1").alias("c1"), F.col("h2").alias("c2")).agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = written(few.withColumn("first", F.get("ids", F.lit(0))), "classes")
    asked = written(own.where(is_query).select(F.col("id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "v"), "asked")
    queries = written(asked.groupBy("q1", "q2").agg(F.any_value("v").alias("v")), "queries")
    n, n_queries = vectors.count(), queries.count()
    out = "query_id long, rank int, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], out)
    dim = vectors.select(F.size("v")).first()[0]
    lists = min(lists, dim)
    means = {r["i"]: r["mean"] for r in vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean")).collect()}  # a row a dimension
    mean = np.array([means[i] for i in range(dim)])
    parts = n // part + 1
    lanes = max(n_queries // lane + 1, -(-2 * spark.sparkContext.defaultParallelism // (parts * lists)))  # few parts: more lanes, so that all cores have work

    each = lambda df, name, count: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    columns = F.filter("v", lambda x, i: i % lists == F.col("list"))
    held = each(each(vectors.select("c1", "c2", "first", "v"), "list", lists).withColumn("v", columns), "lane", lanes).withColumn("part", F.pmod("c1", F.lit(parts)))

    def over_lists(asks: DataFrame, choose) -> DataFrame:
        """choose(asks): a chooser of _entries for one group's queries and list."""
        side = each(each(asks.withColumn("lane", F.pmod("q2", F.lit(lanes)).cast("int")), "list", lists).withColumn("v", columns), "part", parts)

        def scored(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return _entries(key[0].as_py(), left, right, choose(key[0].as_py(), right))

        group = ("list", "part", "lane")
        side = side.withColumn("part", F.col("part").cast("long"))
        return held.groupBy(*group).cogroup(side.groupBy(*group)).applyInArrow(scored, ENTRY)

    def highest(_list: int, _asks: pa.Table):
        def choose(s: np.ndarray, _t: int):
            if s.shape[1] <= gather:
                return tuple(x.ravel() for x in np.indices(s.shape))
            at = np.argpartition(s, s.shape[1] - gather, axis=1)[:, -gather:]
            return np.repeat(np.arange(len(s)), gather), at.ravel()

        return choose

    # phase 1
    by_list = Window.partitionBy("q1", "q2", "list").orderBy(F.desc("score"))
    gathered = over_lists(queries, highest).withColumn("r", F.row_number().over(by_list)).where(F.col("r") <= gather).groupBy(*KEYS).agg(F.any_value("first").alias("first"))
    by_score = Window.partitionBy("q1", "q2").orderBy(F.desc("score"))
    best = whole_scores(gathered, vectors, queries).withColumn("r", F.row_number().over(by_score)).where(F.col("r") == g).select("q1", "q2", F.col("score").alias("cut"))

    def with_shares(batches):
        for batch in batches:
            n = len(batch)
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, dim))
            middle = np.stack([v[:, j::lists] @ mean[j::lists] for j in range(lists)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shares(c, m) for c, m in zip(batch.column(3).to_pylist(), middle, strict=True)], pa.list_(pa.int64()))], names=["q1", "q2", "v", "cut", "shares"])

    kind = dict(queries.dtypes)["v"]
    limits = queries.join(best.hint("merge"), ["q1", "q2"], "left").select("q1", "q2", "v", "cut").mapInArrow(with_shares, f"q1 long, q2 long, v {kind}, cut long, shares array<long>")
    limits = written(limits, "limits")  # made once: the shares of all lists must be of one making

    def reaching(list_no: int, asks: pa.Table):
        least = np.array([-(1 << 62) if x is None else x[list_no] for x in asks["shares"].to_pylist()], np.int64)
        return lambda s, t: np.nonzero(s >= least[t : t + len(s), None].astype(s.dtype if s.dtype == np.int64 else np.float64))

    # phase 2
    sums = over_lists(limits.select("q1", "q2", "v", "shares"), reaching).groupBy(*KEYS).agg(F.any_value("first").alias("first"), F.sum("score").alias("score"), F.expr("bit_or(shiftleft(1L, list))").alias("seen"))
    sums = written(sums, "entries")
    every = (1 << lists) - 1
    known = sums.where(F.col("seen") == every).select(*KEYS, "first", "score")
    raised = known.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == g).select("q1", "q2", F.col("score").alias("raised"))
    # phase 3
    bars = written(limits.select("q1", "q2", "shares", "cut").join(raised.hint("merge"), ["q1", "q2"], "left").select("q1", "q2", "shares", F.greatest("cut", "raised").alias("bar")), "bars")
    lacking = F.expr("aggregate(transform(shares, (s, j) -> if((seen & shiftleft(1L, j)) = 0, s - 1, 0L)), 0L, (a, s) -> a + s)")
    rest = sums.where(F.col("seen") != every).join(bars.hint("merge"), ["q1", "q2"]).where(F.col("score") + lacking >= F.col("bar")).select(*KEYS, "first")
    found = known.unionByName(whole_scores(rest, vectors, queries))
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first"))).where(F.col("r") <= g)
    # from classes to ids
    ids = top.join(vectors.select("c1", "c2", "ids").hint("merge"), ["c1", "c2"]).select("q1", "q2", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")))
    # an id that stands for several vectors may take several of the first places
    near = F.transform(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score")))
    near = ids.groupBy("q1", "q2").agg(near.alias("near"))  # at most g * g
    mine = asked.select("query_id", "q1", "q2").join(near.hint("merge"), ["q1", "q2"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op11_uniform_threshold_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


TOPK_SQL = f"""with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) as q from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::INT as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
