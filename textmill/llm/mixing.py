"""Mixing sources to target weights by fitting whole documents to each source's budget.

A source's target is made of whole passes over it (at most MAX_TIMES in all) and a rest. The rest is
fitted with whole documents: documents are counted by exact length; every length first gets its share
of the rest rounded down; what then is left is filled by bounded-knapsack dynamic programming over
the leftover counts, so that the source's taken words come as near to the target as these
documents allow. Which documents of a length are taken goes by a seeded hash of their ids, bucket by
bucket, so that no group of equal lengths is ever ranked in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, text_of, written

WEIGHTS = (1, 2, 3)
MAX_TIMES = 3
#: Buckets by which documents of one source and length are counted and chosen.
BUCKETS = 512
#: The knapsack fits a rest of about so many of a source's longest documents.
SPAN = 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Weights go round by code point, null last. Shares are poured by weight; a source is full at
    max_times its size; the rest's common rate is found at the first point, in order of size per weight,
    where no other is above. One row per source is ordered here, not the documents."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rate = Window.orderBy("full_at", "rank")
    every = Window.partitionBy()
    got = (
        sizes.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * max_times)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        # the rate, were all earlier ones full and this and all later ones open; the first that holds is it
        .withColumn("spent", F.coalesce(F.sum("cap").over(rate.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(rate.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("rate", (F.col("total") - F.col("spent")) / F.col("open_weight"))
        .withColumn("level", F.min(F.when(F.col("rate") <= F.col("full_at"), F.struct("full_at", "rank", "rate"))).over(every)["rate"])
    )
    target = F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("weight"))
    return got.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes nearest to the budget.

    Lengths are distinct and positive. Shares rounded down leave a rest; documents are taken, the longest
    first, or given back, one of each of the shortest lengths, until the rest is about SPAN times the largest length (or all of a
    small source is given back); it is then fitted by bounded knapsack on a bit set of reachable sums, over all documents not yet taken."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(lengths)[::-1]
    span = SPAN * int(lengths.max())
    for i in order:
        if rest <= span:
            break
        more = min(int(counts[i] - taken[i]), (rest - span) // int(lengths[i]) + 1)
        taken[i] += more
        rest -= more * int(lengths[i])
    while rest < span and taken.any():
        for i in order[::-1]:
            if taken[i] and rest < span:
                taken[i] -= 1
                rest += int(lengths[i])
    top = max(0, rest) + int(lengths.max())
    reach, steps, mask = 1, [], (1 << (top + 1)) - 1
    for i in order[::-1]:
        left, k = int(min(counts[i] - taken[i], top // lengths[i])), 1
        while left:  # a count as powers of two and a remainder
            part = min(k, left)
            new = (reach | reach << part * int(lengths[i])) & mask
            if new != reach:
                steps.append((i, part, reach))
                reach = new
            left -= part
            k *= 2
        if reach >> max(0, rest) & 1:
            break
    at = next(s for d in range(top + 1) for s in (rest - d, rest + d) if 0 <= s <= top and reach >> s & 1)
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with size (its words), source_size, target (its source's), times and taken = size x times;
    the columns named in keep come along.

    A null text has no words; a document without words is taken once. Null is a source of its own. A
    repeated row counts as often as it stands; equal ids go by their text's hash. An empty table
    gives no row; if no document has words, all targets are 0. Extra columns are ignored."""
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("draw"), *(F.col(c).alias(f"kept_{c}") for c in keep),
    )
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int"))
    rows = rows.withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
    counted = written(rows.groupBy("skey", "source", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    sizes = counted.groupBy("skey", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(sizes.select("source", "source_size")), "targets").withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))).drop("source")

    def fitted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's counts by length: as many rows as there are lengths."""
        pdf = pdf[pdf["size"] > 0].sort_values("size")
        if pdf.empty:
            return pd.DataFrame({"skey": [], "size": [], "passes": [], "quota": []})
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(MAX_TIMES, int(target // total))
        budget = 0 if passes == MAX_TIMES else round(target - passes * total)
        quota = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget)
        return pd.DataFrame({"skey": key[0], "size": pdf["size"].to_numpy(), "passes": passes, "quota": quota})

    by_length = counted.groupBy("skey", "size").agg(F.sum("n").alias("n"))
    quotas = by_length.join(targets.hint("shuffle_hash"), "skey").groupBy("skey").applyInPandas(fitted, "skey string, size long, passes long, quota long")
    # quota of each bucket: what the earlier buckets of its source and length leave
    before = Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(quotas.hint("shuffle_hash"), ["skey", "size"], "left")
        .withColumn("open", F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("quota", F.lit(0)) - F.col("before"))))
        .select("skey", "size", "bucket", "open", F.coalesce("passes", F.lit(1)).alias("passes"))
    )
    plan = plan.join(targets.hint("shuffle_hash"), "skey")
    plan = written(plan, "plan")
    place = Window.partitionBy("skey", "size", "bucket").orderBy("draw", "doc_id")
    times = F.col("passes") + (F.col("place") <= F.col("open")).cast("long")
    return (
        rows.withColumn("place", F.row_number().over(place))
        .join(plan.hint("shuffle_hash"), ["skey", "size", "bucket"])
        .withColumn("times", times)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", *(F.col(f"kept_{c}").alias(c) for c in keep))
    )


def op5_subset_sum_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
