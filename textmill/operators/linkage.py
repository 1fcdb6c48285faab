"""Leakage, overlap, similarity, review and version joins.

Equality of texts is decided on stacked keys (kind, key), so every comparison is an equi-join. Groups of equal
texts are never expanded into all pairs: a row is linked with the first row of its group.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textmill.operators import set_blocks
from textmill.operators.tables import numbered, side, stored

#: Kinds of equality, the strongest first; keys are given as Columns by kind.
Keys = Mapping[str, Column]
#: Sets, and members of all sets, of a side that every task may have.
FEW_SETS, FEW_MEMBERS = 1 << 13, 1 << 21


def stacked(df: DataFrame, keys: Keys, keep: Sequence[str]) -> DataFrame:
    """One row per row and kind: the kept columns, rank (of the kind), match_type, key (a hash of 256 bits)."""
    kinds = [F.struct(F.lit(i).alias("rank"), F.lit(k).alias("match_type"), F.sha2(c, 256).alias("key")) for i, (k, c) in enumerate(keys.items())]
    return df.select(*keep, F.explode(F.array(*kinds)).alias("_k")).select(*keep, "_k.*").where("key is not null")


def find_leakage(train: DataFrame, evaluation: DataFrame, keys: Keys, id_col: str = "id", label_col: str = "label", pairs: bool = False) -> DataFrame:
    """Evaluation rows equal to a training row, by the strongest kind of equality: (eval_id, match_type,
    train_id: the first, train_rows, eval_label, train_label: the first's). With pairs=True a row per pair
    instead, whose number is the product of equal groups' sizes."""
    left = stacked(train.select(F.col(id_col).alias("train_id"), F.col(label_col).alias("train_label"), "*"), keys, ("train_id", "train_label"))
    right = stacked(evaluation.select(F.col(id_col).alias("eval_id"), F.col(label_col).alias("eval_label"), "*"), keys, ("eval_id", "eval_label"))
    if pairs:
        found = right.join(left.drop("rank").hint("shuffle_merge"), ["match_type", "key"])
        return found.groupBy("eval_id", "train_id").agg(F.min(F.struct("rank", "match_type", "train_label", "eval_label")).alias("m")).select("train_id", "eval_id", "m.match_type", "m.train_label", "m.eval_label")
    first = left.groupBy("match_type", "key").agg(F.min(F.struct("train_id", "train_label")).alias("t"), F.count("*").alias("train_rows"))
    found = right.join(first.hint("shuffle_merge"), ["match_type", "key"]).groupBy("eval_id", "eval_label").agg(F.min(F.struct("rank", "match_type", "t", "train_rows")).alias("m"))
    return found.select("eval_id", "m.match_type", F.col("m.t.train_id").alias("train_id"), "m.train_rows", "eval_label", F.col("m.t.train_label").alias("train_label"))


def internal_duplicates(df: DataFrame, keys: Keys, id_col: str = "id") -> DataFrame:
    """Each row that isn't the first of its group, with the first, by the strongest kind at which it
    isn't: (left_id, right_id, match_type)."""
    rows = stacked(df.select(F.col(id_col).alias("right_id"), "*"), keys, ("right_id",))
    first = rows.groupBy("match_type", "key").agg(F.min("right_id").alias("left_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = rows.join(first.hint("shuffle_hash"), ["match_type", "key"]).where("left_id <> right_id")
    return found.groupBy("right_id").agg(F.min(F.struct("rank", "match_type", "left_id")).alias("m")).select("m.left_id", "right_id", "m.match_type")


def leakage_by_set(found: DataFrame, evaluation: DataFrame, id_col: str, set_col: str) -> DataFrame:
    """Leaking evaluation rows per set."""
    return found.select("eval_id").distinct().join(evaluation.select(F.col(id_col).alias("eval_id"), F.col(set_col).alias("set_type")).hint("shuffle_merge"), "eval_id").groupBy("set_type").agg(F.count("*").alias("leaks"))


def overlap(candidates: DataFrame, references: DataFrame, keys: Keys, id_col: str = "id", label_col: str = "label", source_col: str = "source") -> DataFrame:
    """Per candidate and kind of equality (each kind): the first equal reference, how many there are, and
    whether one has another label."""
    left = stacked(candidates.select(F.col(id_col).alias("candidate_id"), F.col(label_col).alias("candidate_label"), "*"), keys, ("candidate_id", "candidate_label"))
    right = stacked(references.select(F.col(id_col).alias("reference_id"), F.col(label_col).alias("reference_label"), F.col(source_col).alias("reference_source"), "*"), keys, ("reference_id", "reference_label", "reference_source"))
    first = right.groupBy("match_type", "key").agg(F.min(F.struct("reference_id", "reference_label", "reference_source")).alias("r"), F.count("*").alias("references"), F.collect_set("reference_label").alias("labels"))
    return left.join(first.hint("shuffle_merge"), ["match_type", "key"]).select("match_type", "candidate_id", "candidate_label", F.col("r.reference_id").alias("reference_id"), F.col("r.reference_source").alias("reference_source"), "references", F.exists("labels", lambda x: x != F.col("candidate_label")).alias("label_conflict"))


def internal_overlap(df: DataFrame, keys: Keys, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """Per kind (each kind) every row that isn't its group's first, with the first: (match_type, left_id,
    right_id, label_conflict: the group has several labels)."""
    rows = stacked(df.select(F.col(id_col).alias("right_id"), F.col(label_col).alias("label"), "*"), keys, ("right_id", "label"))
    group = rows.groupBy("match_type", "key").agg(F.min("right_id").alias("left_id"), F.count("*").alias("n"), F.count_distinct("label").alias("labels")).where("n > 1")
    return rows.join(group.hint("shuffle_hash"), ["match_type", "key"]).where("left_id <> right_id").select("match_type", "left_id", "right_id", (F.col("labels") > 1).alias("label_conflict"))


def label_conflicts(found: DataFrame) -> DataFrame:
    """Of J4 or J5 rows those with a conflict."""
    return found.where("label_conflict")


def jaccard(a: Column, b: Column) -> Column:
    """0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _least_overlap(threshold: float, a: str, b: str) -> Column:
    """How many members two sets of these sizes share at least, if their Jaccard similarity is the threshold or more."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(a) + F.col(b)) - F.lit(1e-9))


def ranked_sets(sides: Sequence[DataFrame], threshold: float, id_col: str = "id", members_col: str = "members") -> list[DataFrame]:
    """(id, size, ranks) of the sets of each side whose size some set of the other side can match, as one stored table: members as
    numbers in order of how many sets hold them, ascending, so rare members come first."""
    own = [x.select(F.lit(i).alias("side"), F.col(id_col).alias("id"), F.array_distinct(members_col).alias("members")).withColumn("size", F.size("members")).where("size > 0") for i, x in enumerate(sides)]
    both = stored(own[0].unionByName(own[1]), "sets")
    spans = {r["side"]: (r["low"], r["high"]) for r in both.groupBy("side").agg(F.min("size").alias("low"), F.max("size").alias("high")).collect()}  # a row a side
    low, high = (F.create_map(*[F.lit(x) for i in (0, 1) for x in (i, spans.get(1 - i, (0, -1))[k])])[F.col("side")] for k in (0, 1))
    members = both.where((F.col("size") >= threshold * low) & (F.col("size") * threshold <= high)).select("side", "id", "size", F.explode("members").alias("member"))
    often = members.groupBy("member").agg(F.count("*").alias("df"))
    words = numbered(often, ["df", "member"], "rank").select("member", "rank")
    sets = members.join(side(words), "member").groupBy("side", "id").agg(F.any_value("size").alias("size"), F.sort_array(F.collect_list("rank")).alias("ranks"))
    sets = stored(sets, "ranked")
    return [sets.where(F.col("side") == i).drop("side") for i in (0, 1)]


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id) of ranked sets that may have the similarity. An index holds each set's |A| - ceil(t |A|) + 1 rarest
    members with their positions; two sets of the similarity share one of them. At a meeting no more can be shared than what
    lies before and behind it in the smaller part; when all meetings of a pair are together, those before the last one are
    known one by one."""
    index = lambda x, p: x.select(F.col("id").alias(f"{p}_id"), F.col("size").alias(f"{p}_size"), F.posexplode(F.slice("ranks", F.lit(1), (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)) + 1).cast("int"))).alias(f"{p}_at", "rank"))
    rest = F.least(F.col("left_size") - F.col("left_at"), F.col("right_size") - F.col("right_at")) - 1
    need = _least_overlap(threshold, "left_size", "right_size")
    met = index(left, "left").join(index(right, "right").hint("merge"), "rank")
    met = met.where((F.col("left_size") >= threshold * F.col("right_size")) & (F.col("right_size") >= threshold * F.col("left_size")) & (F.least("left_at", "right_at") + 1 + rest >= need))
    pairs = met.groupBy("left_id", "right_id").agg(F.count("*").alias("met"), F.max_by(F.struct(rest.alias("rest"), need.alias("need")), "rank").alias("last"))
    # a pair of the similarity has kept all its meetings, as the bound holds at each of them
    return pairs.where(F.col("met") + F.col("last.rest") >= F.col("last.need")).select("left_id", "right_id")


def _few_sets(df: DataFrame, id_col: str, members_col: str) -> pa.Table | None:
    """A small side's sets (id, members), which every task can have; None for a larger one."""
    if df.count() > FEW_SETS:
        return None
    own = stored(df.select(F.col(id_col).alias("id"), F.array_compact(F.array_distinct(members_col)).alias("members")).where(F.size("members") > 0), "few")
    return own.toArrow() if (own.agg(F.sum(F.size("members"))).first()[0] or 0) <= FEW_MEMBERS else None


def _similar_to_few(few: pa.Table, many: DataFrame, threshold: float, id_col: str, members_col: str, swapped: bool) -> DataFrame:
    """J8 of a small side's sets with all of the other side's; swapped: the small side is the right one."""
    spark = many.sparkSession
    sent = spark.sparkContext.broadcast(few)
    sides = [spark.createDataFrame(few.select(["id"]).slice(0, 0)).schema["id"].dataType, many.schema[id_col].dataType]
    ids = dict(zip(("right_id", "left_id") if swapped else ("left_id", "right_id"), sides, strict=True))
    schema = StructType([*(StructField(c, ids[c]) for c in ("left_id", "right_id")), StructField("similarity", DoubleType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = set_blocks.blocks(sent.value)
        for batch in batches:
            for own, other, similarity in set_blocks.similar(blocks, batch, threshold):
                pair = (other, own) if swapped else (own, other)
                yield pa.RecordBatch.from_arrays([*pair, similarity], names=["left_id", "right_id", "similarity"])

    return many.select(F.col(id_col).alias("id"), F.col(members_col).alias("members")).mapInArrow(make, schema)


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, id_col: str = "id", members_col: str = "members") -> DataFrame:
    """All (left_id, right_id, similarity) of Jaccard threshold or more, found through an index of their rarest members with
    positions and decided on the whole sets. Where one side is small, every task has its sets and counts what the other side's
    share with each of those whose size can match: one pass, nothing shuffled. Ids tell the rows of a side apart; empty and null
    sets are similar to none."""
    few = _few_sets(left, id_col, members_col), _few_sets(right, id_col, members_col)
    if few[0] is not None or few[1] is not None:
        swapped = few[0] is None or (few[1] is not None and few[1].num_rows < few[0].num_rows)
        return _similar_to_few(few[swapped], left if swapped else right, threshold, id_col, members_col, swapped)
    a, b = ranked_sets([left, right], threshold, id_col, members_col)
    pairs = stored(candidate_pairs(a, b, threshold), "pairs")
    full = pairs.join(a.select(F.col("id").alias("left_id"), F.col("ranks").alias("_a")).hint("merge"), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("ranks").alias("_b")).hint("merge"), "right_id")
    return full.select("left_id", "right_id", jaccard(F.col("_a"), F.col("_b")).alias("similarity")).where(F.col("similarity") >= threshold)


def internal_similar_pairs(df: DataFrame, threshold: float, id_col: str = "id", members_col: str = "members") -> DataFrame:
    """J8 within a table: unordered pairs once. Equal sets count as one class (its smallest id), so copies make
    no pairs."""
    classes = df.groupBy(F.array_sort(members_col).alias("members")).agg(F.min(id_col).alias("id"))
    return similar_pairs(classes, classes, threshold).where("left_id < right_id")


def nearest_reference(candidates: DataFrame, references: DataFrame, threshold: float = 0.55, **kwargs) -> DataFrame:
    """Each candidate's most similar reference of the threshold or more; ties go to the first reference."""
    best = similar_pairs(candidates, references, threshold, **kwargs).groupBy("left_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "right_id")).alias("b"))
    return best.select(F.col("left_id").alias("candidate_id"), F.col("b.right_id").alias("reference_id"), F.round(-F.col("b.s"), 6).alias("similarity"))


def overlap_by_source(found: DataFrame, kinds: Sequence[tuple[str, str]], source_col: str = "reference_source") -> DataFrame:
    """Overlaps per match type and kind of source; kinds: (name, pattern), the first that matches."""
    kind = None
    for name, pattern in kinds:
        kind = F.when(F.col(source_col).rlike(pattern), name) if kind is None else kind.when(F.col(source_col).rlike(pattern), name)
    return found.groupBy("match_type", kind.otherwise("other").alias("source_kind")).agg(F.count("*").alias("overlaps"))


def coverage_report(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of several groupings at once; a dimension that a grouping lacks is null."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, dims)).agg(F.count("*").alias("count"))


def overlap_gate(found: DataFrame, conflicts: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """One row: overlaps, conflicts, repeated ids, and whether all are 0."""
    a, b = found.agg(F.count("*").alias("overlaps")), conflicts.agg(F.count("*").alias("conflicts"))
    c = ids.groupBy(id_col).count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    return a.crossJoin(b).crossJoin(c).withColumn("passed", (F.col("overlaps") == 0) & (F.col("conflicts") == 0) & (F.col("repeated_ids") == 0))  # one row each


def review_agreement(first: DataFrame, second: DataFrame, id_col: str = "sample_id", status: str = "review_status", reviewer: str = "reviewer") -> DataFrame:
    """One row: reviewed, agreed, rate; and what would make the review fail: pending, without_reviewer, unknown_ids."""
    both = first.select(id_col, F.col(status).alias("_a")).join(second.select(id_col, F.col(status).alias("_b")), id_col)
    got = both.agg(F.count("*").alias("reviewed"), F.count_if(F.col("_a") == F.col("_b")).alias("agreed"))
    unknown = second.join(first, id_col, "left_anti").agg(F.count("*").alias("unknown_ids"))
    faults = second.agg(F.count_if(F.coalesce(F.col(status), F.lit("pending")) == "pending").alias("pending"), F.count_if(F.coalesce(F.trim(reviewer), F.lit("")) == "").alias("without_reviewer"))
    rate = F.coalesce(F.try_divide("agreed", "reviewed"), F.lit(0.0))
    return got.crossJoin(unknown).crossJoin(faults).withColumn("rate", F.round(rate, 6))  # one row each


def review_disagreements(first: DataFrame, second: DataFrame, id_col: str = "sample_id", status: str = "review_status", notes: str = "notes", carry: Sequence[str] = ()) -> DataFrame:
    """Rows with different status, both notes, and the columns named in carry (text, label, expected action) of
    the first review."""
    a = first.select(id_col, *carry, F.col(status).alias("first_status"), F.col(notes).alias("first_notes"))
    b = second.select(id_col, F.col(status).alias("second_status"), F.col(notes).alias("second_notes"))
    return a.join(b, id_col).where("first_status <> second_status")


def version_diff(old: DataFrame, new: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, change_type, reason, old_ and new_ of each column): added, removed, changed (with the columns) or unchanged."""
    a = old.select(F.col(id_col).alias("_id"), F.struct(*columns).alias("_a"))
    b = new.select(F.col(id_col).alias("_jd"), F.struct(*columns).alias("_b"))
    both = a.join(b, F.col("_id") == F.col("_jd"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("_id").isNull(), "added").when(F.col("_jd").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return both.select(F.coalesce("_id", "_jd").alias("id"), kind.alias("change_type"), F.when(kind == "changed", F.array_join(changed, "|")).otherwise("").alias("reason"), *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for n, s in (("old", "_a"), ("new", "_b")) for c in columns))


def version_counts(diff: DataFrame) -> DataFrame:
    """One row: added, removed, changed, unchanged and retained_total (in both versions)."""
    n = lambda kind: F.count_if(F.col("change_type") == kind)
    return diff.agg(*(n(k).alias(k) for k in ("added", "removed", "changed", "unchanged")), (n("changed") + n("unchanged")).alias("retained_total"))


def replace_rows(df: DataFrame, eliminated: DataFrame, replacements: DataFrame, id_col: str, strata: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Eliminated rows swapped one for one, within each stratum (null is one) in order of id; the new table, and the manifest
    (old_id, new_id, strata). A stratum with fewer replacements than eliminated rows, or a new id that a kept row has, is an
    error: two small aggregates are looked at here. Of the replacements only as many are ranked as the largest
    stratum needs."""
    gone = df.join(eliminated.select(id_col).distinct(), id_col, "left_semi")
    keys = [F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")).alias(f"_k{i}") for i, c in enumerate(strata)]
    names = [f"_k{i}" for i in range(len(strata))]
    wanted = gone.groupBy(*keys).agg(F.count("*").alias("_out"))  # a row a stratum
    there = replacements.groupBy(*keys).agg(F.count("*").alias("_in"))
    short = wanted.join(there.hint("shuffle_hash"), names, "left").agg(F.max("_out").alias("most"), F.count_if(F.col("_out") > F.coalesce("_in", F.lit(0))).alias("short")).first()
    if short["short"]:
        raise ValueError(f"{short['short']} strata have too few replacements")
    order = Window.partitionBy(*names).orderBy(id_col)
    out = gone.select("*", *keys).withColumn("_n", F.row_number().over(order))
    new = replacements.select("*", *keys).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= (short["most"] or 0))
    manifest = out.select(F.col(id_col).alias("old_id"), *strata, *names, "_n").join(new.select(F.col(id_col).alias("new_id"), *names, "_n").hint("shuffle_hash"), [*names, "_n"]).select("old_id", "new_id", *strata)
    taken_ids = manifest.select(F.col("new_id").alias(id_col)).join(df.select(id_col), id_col, "left_semi").join(gone.select(id_col), id_col, "left_anti")
    if taken_ids.limit(1).count():
        raise ValueError("a replacement has the id of a kept row")
    kept = df.join(manifest.select(F.col("old_id").alias(id_col)), id_col, "left_anti")
    taken = replacements.join(manifest.select(F.col("new_id").alias(id_col)), id_col, "left_semi")
    return kept.unionByName(taken, allowMissingColumns=True), manifest


def eliminated_rows(df: DataFrame, review: DataFrame, id_col: str, status: str, named: Sequence = ()) -> DataFrame:
    """Rows that the review rejects or that are named."""
    rejected = review.where(F.col(status) == "rejected").select(id_col)
    return df.join(rejected, id_col, "left_semi").unionByName(df.where(F.col(id_col).isin(*named))).distinct() if named else df.join(rejected, id_col, "left_semi")
