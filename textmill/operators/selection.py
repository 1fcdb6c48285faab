"""Deterministic splits, quotas, sampling and gates. Order comes from hashes, never from random draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import fixed_values as V

UNIT = "\x1f"
SPLITS = (("train", 0.70), ("validation", 0.15), ("test", 0.15))


def hash_order(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, F.lit(str(seed)), *parts), 256)


def _ranked(df: DataFrame, strata: Sequence[str], key: Column, tie: str) -> DataFrame:
    """_n: place of a row in its stratum by (key, tie); _size. A stratum may hold a third of all rows, so places
    are counted by the key's first digits: rows before a bucket come from the bucket counts, the place within
    from a window over that bucket."""
    df = df.withColumn("_key", key).withColumn("_b", F.substring("_key", 1, 3))
    counts = df.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_size", F.sum("_c").over(Window.partitionBy(*strata))).drop("_c")
    within = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_key", tie))
    return df.withColumn("_w", within).join(counts.hint("shuffle_hash"), [*strata, "_b"]).withColumn("_n", F.col("_before") + F.col("_w")).drop("_before", "_w", "_b", "_key")


def split_bounds(size: Column, splits: Sequence[tuple[str, float]] = SPLITS) -> list[tuple[str, Column]]:
    """Largest-remainder counts as running ends; ties go to the earlier split."""
    exact = [(n, size * F.lit(r)) for n, r in splits]
    floors = [F.floor(x) for _, x in exact]
    left = size - sum(floors[1:], floors[0])
    rest = [x - f for (_, x), f in zip(exact, floors, strict=True)]
    ends, total = [], F.lit(0)
    for i, (name, _) in enumerate(exact):
        # how many others come first: a larger remainder, or an equal one earlier
        ahead = sum([((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int") for j in range(len(exact)) if j != i], F.lit(0))
        total = total + floors[i] + (ahead < left).cast("long")
        ends.append((name, total))
    return ends


def stratified_split(df: DataFrame, label: str, group_id: str, seed: int = 42, splits: Sequence[tuple[str, float]] = SPLITS) -> DataFrame:
    """Adds split."""
    rows = _ranked(df, [label], hash_order(seed, F.col(label), F.col(group_id).cast("string")), group_id)
    out = None
    for name, end in split_bounds(F.col("_size"), splits):
        out = F.when(F.col("_n") <= end, name) if out is None else out.when(F.col("_n") <= end, name)
    return rows.withColumn("split", out).drop("_n", "_size")


def gold_split(df: DataFrame, label: str, action: str, group_id: str, seed: int = 42, share: float = 0.4) -> DataFrame:
    """Adds evaluation_split: the first floor(share n + 0.5) of each (label, action) are calibration."""
    rows = _ranked(df, [label, action], hash_order(seed, F.col(label), F.col(action), F.col(group_id).cast("string")), group_id)
    return rows.withColumn("evaluation_split", F.when(F.col("_n") <= F.floor(F.col("_size") * share + 0.5), "calibration").otherwise("test")).drop("_n", "_size")


def gold_faults(df: DataFrame, status: str, reviewer: str, group: str) -> DataFrame:
    """One row of what stands against a gold set, and ready."""
    a = df.agg(
        F.count_if(~F.coalesce(F.col(status), F.lit("")).isin("verified", "pending", "rejected")).alias("invalid_status"), F.count_if(F.col(status) == "pending").alias("pending"),
        F.count_if((F.col(status) != "pending") & (F.coalesce(F.trim(reviewer), F.lit("")) == "")).alias("without_reviewer"), F.count_if(F.col(status) == "verified").alias("verified"),
    )
    b = df.where(F.col(status) == "verified").groupBy(group).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_groups"))
    ready = (F.col("invalid_status") == 0) & (F.col("pending") == 0) & (F.col("without_reviewer") == 0) & (F.col("verified") > 0) & (F.col("duplicate_groups") == 0)
    return a.crossJoin(b).withColumn("ready", ready)  # one row each


def build_gold(df: DataFrame, status: str, reviewer: str, group: str) -> DataFrame:
    """The verified rows; an error names the faults, if any."""
    faults = gold_faults(df, status, reviewer, group).first()
    if not faults["ready"]:
        raise ValueError(f"not ready: {faults.asDict()}")
    return df.where(F.col(status) == "verified")


def random_stratified_split(df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: exactly round(share n) rows of each label are test, by a seeded hash."""
    rows = _ranked(df, [label], hash_order(seed, F.col(id_col).cast("string")), id_col)
    return rows.withColumn("split", F.when(F.col("_n") <= F.round(F.col("_size") * test_share), "test").otherwise("train")).drop("_n", "_size")


#: P5 looks at so many times the quota first, and at all rows of a label beyond WHOLE.
FIRST, WHOLE = 8, 1 << 20


def quota_unique_select(df: DataFrame, keys: Sequence[str], label: str, quotas: Mapping[str, int], order: str, write=None) -> DataFrame:
    """P5: in order of labels (as in quotas) and `order`, rows none of whose keys an earlier selected row has,
    up to each label's quota.

    A skipped row reserves nothing, so this is a fixpoint: a row that is the earliest undecided one of each of its
    keys is selected; undecided rows that share a key with a selected one go; and so on. What is selected among a label's first
    rows doesn't depend on later ones, so only FIRST times the quota are looked at, and more only if they don't fill it. write
    stores a table between rounds (default: checkpoint)."""
    write = write or (lambda x: x.checkpoint())
    kind = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in keys]
    stacked = lambda rows, *keep: rows.select(*keep, F.explode(F.array(*kind)).alias("_k")).select(*keep, "_k.*")

    def selected(left: DataFrame, taken: DataFrame | None) -> DataFrame | None:
        """All that is selected of these rows, given the (kind, key) of rows selected before."""
        own = None
        while True:
            if taken is not None:
                bad = stacked(left, order).join(taken.hint("shuffle_merge"), ["kind", "key"], "left_semi").select(order).distinct()
                left = write(left.join(bad.hint("shuffle_merge"), order, "left_anti"))
            rows = stacked(left, order)
            first = rows.groupBy("kind", "key").agg(F.min(order).alias("_first"))
            good = write(rows.join(first.hint("shuffle_merge"), ["kind", "key"]).groupBy(order).agg(F.bool_and(F.col(order) == F.col("_first")).alias("_ok")).where("_ok").select(order))
            if not good.limit(1).count():
                return own
            picked = left.join(good.hint("shuffle_merge"), order, "left_semi")
            own = write(picked if own is None else own.unionByName(picked))
            new = stacked(picked).distinct()
            taken = write(new if taken is None else taken.union(new).distinct())
            left = write(left.join(good.hint("shuffle_merge"), order, "left_anti"))

    taken = chosen = None
    for name, quota in quotas.items():
        of_label, ahead = df.where((F.col(label) == name) & F.col(order).isNotNull()), FIRST * max(quota, 1)
        while True:
            whole = ahead > WHOLE
            part = of_label if whole else write(of_label.orderBy(order).limit(ahead))
            own = selected(part, taken)
            if whole or (own is not None and own.count() >= quota) or part.count() < ahead:
                break
            ahead *= FIRST
        if own is None:
            continue
        # rows past the quota reserve nothing for later labels
        kept = write(own.orderBy(order).limit(quota))
        chosen = kept if chosen is None else write(chosen.unionByName(kept))
        taken = write(stacked(chosen).distinct())
    return df.limit(0) if chosen is None else chosen


def quota_coverage(selected: DataFrame, label: str, key: str, targets: Mapping[str, int]) -> DataFrame:
    """Target, actual, unique and shortfall of each label."""
    spark = selected.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).cast("long").alias("target")) for k, v in targets.items()])).alias("d")).select("d.*")
    got = selected.where(F.col(label).isin(*targets)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("actual"), F.count_distinct(key).alias("unique"))
    out = dim.join(F.broadcast(got), "label", "left").na.fill(0, ["actual", "unique"])  # a row a label at most
    return out.withColumn("shortfall", F.greatest(F.lit(0), F.col("target") - F.col("actual")))


def oversample(df: DataFrame, label: str, target: int, seed: int = 42) -> DataFrame:
    """Every row of a class ceil(target / n) times, with its copy number and a seeded order column."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    times = F.greatest(F.lit(1), F.ceil(F.lit(target) / F.col("_c"))).cast("int")
    out = df.join(F.broadcast(counts), label).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_c")  # a row a label
    return out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.struct(*df.columns), "copy"))


def template_augment(words: DataFrame, word: str, label: str, templates: Sequence[str], affixes: Sequence[tuple[str, str]], most: int = 50, seed: int = 42) -> DataFrame:
    """The first `most` words (by seeded hash) of each class in every template ({} stands for the word), with a
    prefix and suffix chosen by hash: (label, word, text). A class adds at most `most` x templates rows."""
    drawn = lambda *parts: F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts))
    order = Window.partitionBy(label).orderBy(drawn(F.col(word)), word)
    top = words.select(label, word).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    row = top.select(label, word, F.explode(F.array(*map(F.lit, templates))).alias("_t"))
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in affixes]), (F.conv(F.substring(drawn(F.col(word), F.col("_t")), 1, 4), 16, 10).cast("int") % len(affixes) + 1).cast("int"))
    return row.withColumn("_p", pick).select(F.col(label).alias("label"), F.col(word).alias("word"), F.replace("_t", F.lit("{}"), F.concat("_p.a", F.col(word), F.col("_p.b"))).alias("text"))


def validate_distribution(df: DataFrame, dims: Sequence[str], expected: DataFrame) -> DataFrame:
    """Strata whose count differs from the expected: (dims, expected, actual)."""
    got = df.groupBy(*dims).agg(F.count("*").alias("actual"))
    both = expected.join(got, list(dims), "full_outer").na.fill(0, ["expected", "actual"])
    return both.where("expected <> actual")


def id_faults(df: DataFrame, id_col: str, recomputed: Column, status: str) -> DataFrame:
    """One row: repeated ids, ids that don't recompute, rows not pending."""
    a = df.agg(F.count_if(F.col(id_col) != recomputed).alias("wrong_ids"), F.count_if(F.col(status) != "pending").alias("not_pending"))
    b = df.groupBy(id_col).count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    return a.crossJoin(b)  # one row each


def review_summary(df: DataFrame, kind: str, status: str, statuses: Sequence[str] = ("verified", "pending", "rejected")) -> DataFrame:
    """P10: status counts per kind, total and verified rate (4 digits)."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    out = df.groupBy(F.col(kind).alias("kind")).agg(*counts, F.count("*").alias("total"), F.count_if(~F.coalesce(F.col(status), F.lit("")).isin(*statuses)).alias("invalid"))
    return out.withColumn("verified_rate", F.round(F.col("verified") / F.col("total"), 4))


def targeted_review_pick(df: DataFrame, kind: str, id_col: str, kinds: Sequence[str], priority: Column, patterns: Column, most: int = 3) -> DataFrame:
    """The first `most` of each chosen kind by (priority, id), and all rows of the patterns; a row once."""
    order = Window.partitionBy(kind).orderBy(priority, id_col)
    top = df.where(F.col(kind).isin(*kinds)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return top.unionByName(df.where(patterns)).dropDuplicates([id_col])


def structure_gates(df: DataFrame, label: str = "label", text: str = "text", fragment: str = "risk_fragment", rewritten: str = "sanitized_text", signature: str = "template_signature", structure: str = "structure_type", position: str = "risk_position", operation: str = "sanitize_operation", meta: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Counts of faults and whether all gates hold, as one row. A signature's or structure's rows are
    counted before they meet."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col(text), w)) if words else F.lit(False)
    t, f, r = F.col(text), F.coalesce(F.col(fragment), F.lit("")), F.coalesce(F.col(rewritten), F.lit(""))
    whole = df.agg(
        F.count("*").alias("rows"), F.count_if((f == "") | ~F.contains(t, f)).alias("missing_fragment"),
        F.count_if((F.trim(r) == "") | (r == t) | ((f != "") & F.contains(r, f))).alias("invalid_rewrite"),
        F.count_if(has(meta)).alias("meta_phrases"), *(F.count_if(F.col(x)).alias(f"flag_{x}") for x in flags),
    )
    repeats = df.groupBy(signature).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).cast("long").alias("repeated_signatures"))
    by = df.groupBy(label, structure).agg(F.count("*").alias("c"), F.count_if(F.col(position) == "end").alias("e"), F.collect_set(operation).alias("ops"))
    per = by.groupBy(label).agg(F.max("c").alias("top"), F.sum("c").alias("n"), F.sum("e").alias("ends"), F.count("*").alias("structures"), F.size(F.array_distinct(F.flatten(F.collect_list("ops")))).alias("operations"))
    ok = (F.col("structures") >= 4) & (F.col("operations") >= 3) & (F.col("top") / F.col("n") <= 0.4) & (F.col("ends") / F.col("n") <= 0.4)
    labels = per.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("label_gates"))
    out = whole.crossJoin(repeats).crossJoin(labels)  # one row each
    zero = F.lit(True)
    for c in ("missing_fragment", "invalid_rewrite", "meta_phrases", "repeated_signatures", *(f"flag_{x}" for x in flags)):
        zero = zero & (F.col(c) == 0)
    return out.withColumn("passed", zero & F.col("label_gates"))


def linkage_gates(df: DataFrame, expected: DataFrame, forbidden: DataFrame, id_col: str = "sample_id", status: str = "linkage_status", fields: Sequence[str] = ("legal_context", "linkage_reason", "risk_fragment")) -> DataFrame:
    """One row: statuses, missing fields, repeated, unexpected, absent and forbidden ids, and passed."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    a = df.agg(F.count_if(F.col(status) == "accepted").alias("accepted"), F.count_if(F.col(status) != "accepted").alias("not_accepted"), *(F.count_if(blank(c)).alias(f"missing_{c}") for c in fields))
    parts = [
        df.groupBy(id_col).count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids")),
        df.join(expected, id_col, "left_anti").agg(F.count("*").alias("unexpected_ids")),
        expected.join(df, id_col, "left_anti").agg(F.count("*").alias("absent_ids")),
        df.join(forbidden, id_col, "left_semi").agg(F.count("*").alias("forbidden_ids")),
    ]
    for p in parts:
        a = a.crossJoin(p)  # one row each
    passed = F.lit(True)
    for c in a.columns:
        if c != "accepted":
            passed = passed & (F.col(c) == 0)
    return a.withColumn("passed", passed)


def publish_if_passed(df: DataFrame, gates: DataFrame, path: str, passed: str = "passed") -> bool:
    """Writes df as Parquet only if every gate row holds."""
    ok = all(r[0] for r in gates.select(passed).collect())  # a gate table has a row per audit
    if ok:
        df.write.mode("overwrite").parquet(path)
    return ok


def validate_manifest(df: DataFrame, required: Sequence[str], labels: Sequence[str], splits: Sequence[str], label: str = "label", split: str = "split") -> DataFrame:
    """One row: rows, bad_labels, bad_splits, valid. Absent columns are an error that names them."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    out = df.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(F.col(label).isin(*labels), F.lit(False))).alias("bad_labels"), F.count_if(~F.coalesce(F.col(split).isin(*splits), F.lit(False))).alias("bad_splits"))
    return out.withColumn("valid", (F.col("rows") > 0) & (F.col("bad_labels") == 0) & (F.col("bad_splits") == 0))


def partition_xy(df: DataFrame, name: str, text: str = "text", label: str = "label", split: str = "split") -> DataFrame:
    """Text and label of one split; an empty one is an error."""
    out = df.where(F.col(split) == name).select(F.col(text).alias("text"), F.col(label).alias("label"))
    if out.isEmpty():
        raise ValueError(f"no rows in split {name}")
    return out


def number_replacements(df: DataFrame, strata: Sequence[str], id_col: str, prefix: str = "replacement") -> DataFrame:
    """A running number per stratum in order of id, as source_reference."""
    rows = _ranked(df, list(strata), F.sha2(F.col(id_col).cast("string"), 256), id_col)
    return rows.withColumn("source_reference", F.concat_ws(":", F.lit(prefix), *strata, F.format_string("%04d", F.col("_n")))).drop("_n", "_size")


def replacement_faults(df: DataFrame, strata: Sequence[str], id_col: str, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row: strata whose count isn't the expected one (strata, expected), repeated ids, ids that are
    forbidden, and whether none of these is."""
    got = df.groupBy(*strata).agg(F.count("*").alias("_got"))  # a row a stratum
    wrong = got.join(expected.hint("shuffle_hash"), [*strata], "full_outer").agg(F.count_if(~F.coalesce("_got", F.lit(0)).eqNullSafe(F.coalesce("expected", F.lit(0)))).alias("wrong_strata"))
    repeated = df.groupBy(id_col).count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    shared = df.join(forbidden.select(id_col).distinct().hint("shuffle_hash"), id_col, "left_semi").agg(F.count("*").alias("forbidden_ids"))
    out = wrong.crossJoin(repeated).crossJoin(shared)  # one row each
    return out.withColumn("valid", (F.col("wrong_strata") == 0) & (F.col("repeated_ids") == 0) & (F.col("forbidden_ids") == 0))


#: Columns of a structured sample's specification that are texts, and those that are marks.
SPEC_TEXTS = ("structure_type", "risk_position", "sanitize_operation", "risk_fragment", "sanitized_text", "template_signature", "semantic_relation")
SPEC_MARKS = ("obvious_two_part", "safe_context_reference", "severe_core_intent", "uses_real_identifier")


def spec_id(text: Column, label: Column, prefix: str) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 over label and text."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(UNIT, label, text), 256), 1, 16))


def structure_metadata(specs: DataFrame, prefix: str = "siev1", text: str = "text", label: str = "label") -> DataFrame:
    """A row a specification (text, label, SPEC_TEXTS, SPEC_MARKS): sample_id, text, label, the texts, and the marks
    as true or false in words. A null text counts as empty, a null mark as false; other columns are ignored."""
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    marks = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("string").alias(c) for c in SPEC_MARKS]
    return specs.select(spec_id(own(text), own(label), prefix).alias("sample_id"), own(text).alias("text"), own(label).alias("label"), *(own(c).alias(c) for c in SPEC_TEXTS), *marks)


def linkage_rows(metadata: DataFrame, mechanisms: Mapping[str, str] = V.LINKAGE_MECHANISMS, default: str = V.LINKAGE_DEFAULT, closing: str = V.LINKAGE_CLOSING, note: str = V.LINKAGE_NOTE) -> DataFrame:
    """The audit of how each sample's fragment belongs to its context, from the rows of structure_metadata: linkage_reason is the
    sample's relation, its structure type's mechanism (or the default) and the closing words."""
    table = F.create_map(*[F.lit(x) for kv in mechanisms.items() for x in kv])
    reason = F.concat("semantic_relation", F.lit("；"), F.coalesce(table[F.col("structure_type")], F.lit(default)), F.lit("，"), F.lit(closing))
    return metadata.select(
        "sample_id", "label", "text", "structure_type", "risk_position", "sanitize_operation", F.col("sanitized_text").alias("legal_context"), "risk_fragment",
        reason.alias("linkage_reason"), F.lit("linked").alias("linkage_status"), F.lit(note).alias("notes"),
    )


def coverage_rows(df: DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, int]], duplicates: DataFrame, leakage: DataFrame) -> DataFrame:
    """P19's rows, and by name what is short of the targets of a dimension, and how many duplicates and leaked
    rows two other reports list: (dimension, name, count)."""
    out = evaluation_coverage(df, dims)
    cells = [F.struct(F.lit(d).alias("of"), F.lit(n).alias("name"), F.lit(t).cast("long").alias("target")) for d, ts in targets.items() for n, t in ts.items()]
    dim = df.sparkSession.range(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    got = out.select(F.col("dimension").alias("of"), "name", "count")
    short = dim.join(F.broadcast(got), ["of", "name"], "left").select(F.concat(F.lit("shortfall_"), "of").alias("dimension"), "name", F.greatest(F.lit(0), F.col("target") - F.coalesce("count", F.lit(0))).alias("count"))  # a row a target
    rest = [report.agg(F.lit(name).alias("dimension"), F.lit("all").alias("name"), F.count("*").alias("count")) for name, report in (("duplicates", duplicates), ("leakage", leakage))]
    return out.unionByName(short).unionByName(rest[0]).unionByName(rest[1])


def evaluation_coverage(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, name, count) of several columns in one grouping."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("name")) for d in dims])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.name").agg(F.count("*").alias("count"))
