"""Approximate nearest neighbours by adaptive dimension scan of probed lists.

Vectors are rotated by one random orthogonal matrix and dealt to lists by their nearest centroid. Within
a probed list dimensions are read block by block; after each block a hypothesis test compares a
candidate's scaled partial distance with the best distances known so far, and abandons candidates that are
unlikely to be nearer. What is left gets its exact distance on the original vectors.

Equal vectors are searched once: only distinct ones are indexed, each with the K + 1 smallest ids that
have it (more can't be among K nearest), so a vector that a third of all rows hold costs one entry.
Long lists are cut into parts of at most PART vectors, so a crowded list isn't one task. The index is fitted on a
sample of at most SAMPLE distinct vectors (those of the smallest hash), which also gives every query a first
bound: the distance within which 2 K + 1 sample vectors of its probed lists lie; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 10
SAMPLE = 16_384
#: Lists probed: at least PROBES, and as many as hold TARGET of the nearest neighbours of TRIALS sample vectors within the sample.
#: Neighbours among all vectors are nearer, so they lie in fewer lists. Clustered vectors need few lists; those without structure most.
PROBES, TARGET, TRIALS = 16, 0.97, 512
#: Vectors and queries that one task holds of a list.
PART, ASKS = 8192, 8192
#: Dimensions per block, vectors per tile, and the test's width: larger abandons less.
BLOCK, TILE, WIDTH = 16, 1024, 2.1


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def nearest_centroids(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    d = (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T
    k = min(k, len(centroids))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means on the sample; an empty list is moved to a sample vector far from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centroids(sample, centroids, 1)[:, 0]
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-((sample - centroids[own]) ** 2).sum(axis=1))[: len(empty)]
            centroids[empty] = sample[far]
    return centroids


def fitted_probes(sample: np.ndarray, centroids: np.ndarray, own: np.ndarray, k: int = K, target: float = TARGET, trials: int = TRIALS) -> int:
    """How many lists, nearest first, hold the target share of the trial vectors' k nearest others in the sample."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    # spread over the sample, which is in order of hashes
    q = sample[np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(np.int64)]
    d = (sample * sample).sum(axis=1) - 2 * q @ sample.T
    near = np.argpartition(d, k, axis=1)[:, : k + 1]  # the vector itself among them: in the first list mostly
    place = np.empty((len(q), len(centroids)), np.int64)
    np.put_along_axis(place, nearest_centroids(q, centroids, len(centroids)), np.arange(len(centroids))[None, :], axis=1)
    at = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))))]) + 1


def scan_part(x: np.ndarray, rotated: np.ndarray, q: np.ndarray, rotated_q: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows found for one query, and their exact distances. bound: a distance within which
    k vectors of the whole index are known to lie."""
    n, dim = rotated.shape
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    limit = bound * bound * (1 + 1e-9)  # may be infinite
    for t in range(0, n, TILE):
        alive = np.arange(t, min(n, t + TILE))
        partial = np.zeros(len(alive))
        for d in range(0, dim, BLOCK):
            part = rotated[alive, d : d + BLOCK] - rotated_q[d : d + BLOCK]
            partial += np.einsum("ij,ij->i", part, part)
            seen = min(dim, d + BLOCK)
            # a partial distance over `seen` random dimensions, scaled, is within WIDTH / sqrt(seen) of the whole
            wide = limit * (1 + WIDTH / np.sqrt(seen)) ** 2 * seen / dim if seen < dim else limit * (1 + 1e-9)
            stay = partial <= wide
            alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        if len(alive):
            diff = x[alive] - q
            best_d = np.concatenate([best_d, np.sqrt((diff * diff).sum(axis=1))])
            best_i = np.concatenate([best_i, alive])
            if len(best_d) > k:
                order = np.argsort(best_d, kind="stable")
                # equal distances at the end stay: the ids decide later
                cut = best_d[order[k - 1]]
                keep = best_d <= cut
                best_d, best_i = best_d[keep], best_i[keep]
                limit = min(limit, cut * cut * (1 + 1e-9))
    return best_i, best_d


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles, no minus zero), h1, h2 (two hashes of v): rows with an id whose vector is not
    null or zero, holds only finite numbers, and has the most common dimension (ties: the larger)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    top = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    own = own.where(F.size("v") == (top["dim"] if top else 0))
    return own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest found, nearest first, ties to the
    smaller id; score is the Euclidean distance of the original vectors in double precision.

    is_query is a Column of vec_id. Candidates are all valid vectors but those of the query's own id; rows
    that repeat an id and vector count once. An invalid query gives no row; an empty table gives none."""
    own = valid_vectors(rows, id_col, vector_col)
    spark, keys = rows.sparkSession, ["h1", "h2"]
    # the k + 1 smallest ids of each distinct vector: first within salts, so no vector is one group
    salted = Window.partitionBy("h1", "h2", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    once = own.dropDuplicates([*keys, "vec_id"])  # repeated rows would fill a salt's places
    few = once.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    vectors = written(few.groupBy(*keys).agg(F.any_value("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    queries = written(own.where(is_query).select("vec_id", *keys, "v"), "queries")
    wanted = queries.dropDuplicates(keys).select(*keys, "v")

    count = vectors.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = np.array([r["v"] for r in vectors.select("v", *keys).orderBy(*keys).limit(sample).collect()])
    lists = max(1, min(int(count**0.5), len(chosen) // 8))  # as many as a sample can fit
    turn, centroids = rotation(chosen.shape[1]), fit_centroids(chosen, lists)
    chosen_list = nearest_centroids(chosen, centroids, 1)[:, 0]
    probes = min(lists, max(PROBES, fitted_probes(chosen, centroids, chosen_list, k)))
    index = spark.sparkContext.broadcast((centroids, turn, chosen, chosen_list))  # at most `sample` vectors
    # a list's queries go in blocks, each of which meets every part of the list
    blocks = int(wanted.count() * probes / lists / ASKS) + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            own_list = nearest_centroids(x, index.value[0], 1)[:, 0] if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own_list, pa.int64())], names=["h1", "h2", "v", "ids", "list"])

    placed = written(vectors.select(*keys, "v", "ids").mapInArrow(dealt, "h1 long, h2 long, v array<double>, ids array<long>, list long"), "lists")
    parts = {r["list"]: r["count"] // PART + 1 for r in placed.groupBy("list").count().collect()}  # one row a list

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _, known, known_list = index.value
        square = (known * known).sum(axis=1)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
            for s in range(0, len(x), 512):
                part = x[s : s + 512]
                near = nearest_centroids(part, centroids, probes)
                d = np.maximum(square + (part * part).sum(axis=1)[:, None] - 2 * part @ known.T, 0)
                open_list = np.zeros((len(part), len(centroids)), bool)
                np.put_along_axis(open_list, near, True, axis=1)
                d[~open_list[:, known_list]] = np.inf
                # twice as many as wanted: a few may be abandoned, and the query itself stands among them
                at = min(2 * k, len(known) - 1)
                bound = np.sqrt(np.partition(d, at, axis=1)[:, at] + 1e-9 * square.max()) if len(known) > 2 * k else np.full(len(part), np.inf)
                rows_at = [(s + i, m, p) for i in range(len(part)) for m in near[i].tolist() for p in range(parts.get(m, 0))]
                at = pa.array([r[0] for r in rows_at], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array([r[1] for r in rows_at], pa.int64()), pa.array([r[2] for r in rows_at], pa.int64()), pa.array(bound[[r[0] - s for r in rows_at]])], names=["h1", "h2", "v", "list", "part", "bound"])

    asked = wanted.mapInArrow(probed, "h1 long, h2 long, v array<double>, list long, part long, bound double").withColumn("block", F.pmod("h2", F.lit(blocks)))
    n_parts = F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.col("list"))
    placed = placed.withColumn("part", F.pmod("h1", n_parts).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def scanned(key: tuple, held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asks):
            x, q = np.stack(held["v"].to_list()), np.stack(asks["v"].to_list())
            turned, turned_q = x @ index.value[1], q @ index.value[1]
            ids = held["ids"].to_list()
            for i, (a, b, bound) in enumerate(zip(asks["h1"], asks["h2"], asks["bound"], strict=True)):
                at, dist = scan_part(x, turned, q[i], turned_q[i], bound, k + 1)
                out += [(a, b, float(d), ids[j]) for j, d in zip(at.tolist(), dist.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["h1", "h2", "score", "ids"])

    found = placed.groupBy("list", "part", "block").cogroup(asked.groupBy("list", "part", "block")).applyInPandas(scanned, "h1 long, h2 long, score double, ids array<long>")
    by_query = Window.partitionBy(*keys)
    best = (
        found.withColumn("r", F.row_number().over(by_query.orderBy("score", F.get("ids", F.lit(0))))).where(F.col("r") <= k + 1)
        .select(*keys, "score", F.explode("ids").alias("vec_id"))
        .withColumn("r", F.row_number().over(by_query.orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    )
    asked_ids = queries.select(F.col("vec_id").alias("query_id"), *keys).distinct()
    mine = asked_ids.join(best.hint("shuffle_hash"), keys).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op1_adaptive_dimension_scan(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
