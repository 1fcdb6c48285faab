"""Cleaning and auditing labelled text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.fixed_values import LABELS
from textmill.functions.normalize import trim
from textmill.operators.tables import side, stored
from textmill.sources.lines import text_lines

UNIT = "\x1f"


def stable_id(text: Column, label: Column, source: Column, prefix: str) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 over text, label and source."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(UNIT, text, label, source), 256), 1, 16))


def _prepared(df: DataFrame, text: str, label: str, row: str, labels: Sequence[str]) -> DataFrame:
    return df.select(
        F.col(row).alias("row_number"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lower(trim(F.coalesce(F.col(label), F.lit("")))).alias("label"),
    ).withColumn("empty", (trim(F.col("text")) == "") | (F.col("label") == "")).withColumn("invalid", ~F.col("empty") & ~F.col("label").isin(*labels))


def _groups(good: DataFrame) -> DataFrame:
    """Per raw text: rows and distinct labels, pre-aggregated before the shuffle."""
    return good.groupBy("text").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("labels"))


def clean_dataset(df: DataFrame, text: str = "text", label: str = "label", row: str = "row_number", source: str = "source", version: str = "v1", labels: Sequence[str] = LABELS) -> DataFrame:
    """One row (sample_id, text, label, source, data_version) per text of a single valid label."""
    good = _prepared(df, text, label, row, labels).where("not empty and not invalid")
    one = _groups(good).where(F.size("labels") == 1).select("text", F.get("labels", F.lit(0)).alias("label"))
    return one.select(stable_id(F.col("text"), F.col("label"), F.lit(source), "train").alias("sample_id"), "text", "label", F.lit(source).alias("source"), F.lit(version).alias("data_version"))


def conflict_queue(df: DataFrame, text: str = "text", label: str = "label", row: str = "row_number", labels: Sequence[str] = LABELS) -> DataFrame:
    """Every row of a text with several labels, and rows without a valid label: (row_number, text, labels, reason)."""
    rows = _prepared(df, text, label, row, labels)
    many = _groups(rows.where("not empty and not invalid")).where(F.size("labels") > 1).select("text", F.array_join("labels", "|").alias("labels"))
    conflicts = rows.where("not empty and not invalid").join(many.hint("shuffle_hash"), "text").select("row_number", "text", "labels", F.lit("conflicting_labels").alias("reason"))
    invalid = rows.where("invalid").select("row_number", "text", F.col("label").alias("labels"), F.lit("invalid_label").alias("reason"))
    return conflicts.unionByName(invalid)


def clean_summary(df: DataFrame, text: str = "text", label: str = "label", row: str = "row_number", labels: Sequence[str] = LABELS) -> DataFrame:
    """One row of counts."""
    rows = _prepared(df, text, label, row, labels)
    a = rows.agg(F.count("*").alias("input_rows"), F.count_if("empty").alias("empty_rows"), F.count_if("invalid").alias("invalid_rows"))
    g = _groups(rows.where("not empty and not invalid"))
    one, several = F.size("labels") == 1, F.size("labels") > 1
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    b = g.agg(F.count_if(one).alias("output_rows"), F.count_if(several).alias("conflict_groups"), total(F.when(one, F.col("n") - 1)).alias("duplicate_rows"), total(F.when(several, F.col("n"))).alias("conflict_rows"))
    return a.crossJoin(b).withColumn("review_rows", F.col("conflict_rows") + F.col("invalid_rows"))  # one row each


def audit_issues(df: DataFrame, text: str = "text", label: str = "label", row: str = "row_number", labels: Sequence[str] = LABELS) -> DataFrame:
    """C4: (row_number, issue), several a row if so."""
    t, lab = F.col(text), F.col(label)
    blank = trim(F.coalesce(lab, F.lit("")))
    issues = F.array_compact(F.array(
        F.when(t.isNull(), "missing_text"), F.when(t.isNotNull() & (trim(t) == ""), "blank_text"),
        F.when(blank == "", "missing_label"), F.when((blank != "") & ~F.lower(blank).isin(*labels), "invalid_label"),
    ))
    return df.select(F.col(row).alias("row_number"), F.explode(issues).alias("issue"))


def duplicate_classes(df: DataFrame, text: str = "text", label: str = "label", row: str = "row_number") -> DataFrame:
    """Texts that occur more than once: text, count, labels, first_row. Counted within tasks first, so copies that are a third
    of all rows are no large group."""
    found = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("count"), F.array_sort(F.collect_set(label)).alias("labels"), F.min(row).alias("first_row"))
    return found.where("count > 1").select("text", "count", F.array_join("labels", "|").alias("labels"), "first_row")


def duplicate_members(df: DataFrame, text: str = "text", row: str = "row_number") -> DataFrame:
    """The rows of these classes one by one: row, first_row, count. Texts travel as hashes; the classes are joined, and a
    large one's rows may be split over tasks."""
    keyed = df.where(F.col(text).isNotNull()).select(F.col(row).alias("row"), F.sha2(text, 256).alias("_key"))
    classes = stored(keyed.groupBy("_key").agg(F.count("*").alias("count"), F.min("row").alias("first_row")).where("count > 1"), "classes")
    return keyed.join(side(classes), "_key").select("row", "first_row", "count")


def duplicate_groups(df: DataFrame, text: str = "text", label: str = "label", row: str = "row_number") -> DataFrame:
    """C5 as the report has it: text, count, labels and the list of row numbers, which is as long as the group is large: for
    reports of moderate groups. duplicate_classes and duplicate_members say the same in rows."""
    found = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("count"), F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.collect_list(F.col(row))).alias("rows"))
    return found.where("count > 1").select("text", "count", F.array_join("labels", "|").alias("labels"), F.array_join(F.transform("rows", lambda x: x.cast("string")), "|").alias("row_numbers"))


def conflicting_labels(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Texts with several labels: count and labels."""
    found = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("count"), F.array_sort(F.collect_set(label)).alias("labels"))
    return found.where(F.size("labels") > 1).select("text", "count", F.array_join("labels", "|").alias("labels"))


def trimmed_duplicate_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """How many texts occur more than once after trimming."""
    return df.where(F.col(text).isNotNull()).groupBy(trim(F.col(text)).alias("t")).count().agg(F.count_if(F.col("count") > 1).alias("groups"))


def label_distribution(df: DataFrame, label: str = "label", labels: Sequence[str] = LABELS) -> DataFrame:
    """Count and ratio (6 digits) of each label, zeros kept."""
    spark = df.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    counts = df.where(F.col(label).isin(*labels)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    joined = dim.join(F.broadcast(counts), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("count"))  # at most one row a label
    return joined.withColumn("ratio", F.round(F.coalesce(F.try_divide("count", F.sum("count").over(Window.partitionBy())), F.lit(0.0)), 6))


def text_length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """C8."""
    n = df.select(F.length(text).alias("n"))
    return n.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.avg("n"), 3).alias("mean"), F.median("n").alias("median"), F.count_if(F.col("n") < 2).alias("shorter_than_2"), F.count_if(F.col("n") > 500).alias("longer_than_500"))


def grouped(df: DataFrame, normalized: str, label: str, order: Sequence[str]) -> DataFrame:
    """group_id, labels of the group, size, and place within it. Labels and sizes are aggregated first; the
    place is needed for the first row alone."""
    df = df.withColumn("group_id", F.sha2(F.col(normalized), 256))
    groups = df.groupBy("group_id").agg(F.array_sort(F.collect_set(label)).alias("group_labels"), F.count("*").alias("group_size"), F.min(F.struct(*order)).alias("_first"))
    joined = df.join(groups.hint("shuffle_hash"), "group_id")
    return joined.withColumn("is_first", F.struct(*order) == F.col("_first")).drop("_first")


def group_dedup(df: DataFrame, normalized: str, label: str, order: Sequence[str]) -> DataFrame:
    """The first row (in `order`, which must tell rows apart) of each group of one label; groups with several
    labels go."""
    return grouped(df, normalized, label, order).where((F.size("group_labels") == 1) & F.col("is_first")).drop("group_labels", "group_size", "is_first")


def duplicate_report(df: DataFrame, text: str, normalized: str, label: str, order: Sequence[str], id_col: str) -> DataFrame:
    """Each dropped row with the kept one: (group_id, dropped_id, kept_id, match_type)."""
    rows = grouped(df, normalized, label, order).where((F.size("group_labels") == 1) & (F.col("group_size") > 1))
    kept = rows.where("is_first").select("group_id", F.col(id_col).alias("kept_id"), F.col(text).alias("_kept"))
    return rows.where("not is_first").join(kept.hint("shuffle_hash"), "group_id").select("group_id", F.col(id_col).alias("dropped_id"), "kept_id", F.when(F.col(text) == F.col("_kept"), "exact").otherwise("normalized_equivalent").alias("match_type"))


def label_conflict_report(df: DataFrame, normalized: str, label: str, source: str) -> DataFrame:
    """C11: groups with several labels: labels, occurrences and their sources as JSON."""
    found = df.groupBy(F.sha2(F.col(normalized), 256).alias("group_id")).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("occurrence_count"), F.array_sort(F.collect_set(source)).alias("sources"))
    return found.where(F.size("labels") > 1).select("group_id", F.array_join("labels", "|").alias("labels"), "occurrence_count", F.to_json("sources").alias("sources"))


def cross_split_leakage(df: DataFrame, keys: dict[str, Column], split: str = "split", label: str = "label", group: str = "group_id") -> DataFrame:
    """Per kind of key, values that occur in more than one split."""
    kinds = F.array(*[F.struct(F.lit(k).alias("match_type"), F.sha2(c, 256).alias("match_sha256")) for k, c in keys.items()])
    rows = df.select(F.explode(kinds).alias("k"), F.col(split).alias("split"), F.col(label).alias("label"), F.col(group).alias("group_id")).select("k.*", "split", "label", "group_id")
    found = rows.groupBy("match_type", "match_sha256").agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("split", "label", "group_id")))
    return found.where(F.size("splits") > 1).select("match_type", "match_sha256", *(F.array_join(f"{c}s", "|").alias(f"{c}s") for c in ("split", "label", "group_id")))


def data_manifest(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Counts by label, by split, by both, and in all (null: all)."""
    return df.cube(F.col(label).alias("label"), F.col(split).alias("split")).agg(F.count("*").alias("count"))


def dedup_steps(df: DataFrame, normalized: str, text: str = "text", label: str = "label") -> DataFrame:
    """One row of what C9 did: rows in, conflict groups and rows, exact and normalized-equal rows dropped, rows kept.
    Groups are counted by key, never listed."""
    groups = df.groupBy(F.col(normalized).alias("_key")).agg(F.count("*").alias("n"), F.count_distinct(F.col(text)).alias("texts"), F.count_distinct(F.col(label)).alias("labels"))
    one = F.col("labels") <= 1
    total = lambda value, cond: F.coalesce(F.sum(F.when(cond, value)), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(~one).alias("conflict_groups"), total(F.col("n"), ~one).alias("conflict_rows"),
        total(F.col("n") - F.col("texts"), one).alias("exact_duplicates"), total(F.col("texts") - 1, one).alias("normalized_duplicates"), F.count_if(one).alias("kept"),
    )


def source_profile(spark: SparkSession, path: str, pattern: str | None = None, most: int = 1 << 30) -> DataFrame:
    """C14: path, bytes, sha256 of the content, lines and lines that aren't blank of each file. Lines are counted by byte ranges;
    only the hash needs a whole file in one task, so files of more than `most` bytes have none (null). Spark's readers pass
    empty files over, so these aren't listed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).withColumn("file", F.col("_metadata.file_path"))
    hashes = files.where(F.col("length") <= most).select("file", F.sha2("content", 256).alias("sha256"))
    lines = text_lines(spark, path, pattern, recursive=True).groupBy("file").agg(F.count("*").alias("lines"), F.count_if(trim(F.col("value")) != "").alias("nonblank_lines"))
    out = files.select("file", F.col("length").alias("bytes")).join(hashes.hint("merge"), "file", "left").join(lines.hint("merge"), "file", "left")
    return out.select(F.col("file").alias("path"), "bytes", "sha256", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("nonblank_lines", F.lit(0)).alias("nonblank_lines"))


def content_fingerprint(df: DataFrame, id_col: str, text_col: str, ids: DataFrame | None = None) -> DataFrame:
    """One hash of all (id, text) rows, or of those whose ids are given (an absent one is an error), whatever their
    order: each of a million buckets is hashed in order, then each 256th of the buckets, then these hashes."""
    if ids is not None:
        wanted = ids.select(id_col).distinct()
        absent = wanted.join(df.select(id_col), id_col, "left_anti").count()
        if absent:
            raise ValueError(f"{absent} ids are absent")
        df = df.join(wanted.hint("shuffle_hash"), id_col, "left_semi")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.sha2(F.concat(F.col(id_col).cast("string"), F.lit("\t"), F.coalesce(F.col(text_col), F.lit(""))), 256).alias("h"))
    part = rows.groupBy(F.substring("h", 1, 5).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    part = part.groupBy(F.substring("bucket", 1, 2).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("bucket", "h")))["h"], "\n"), 256).alias("h"), F.sum("n").alias("n"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("bucket", "h")))["h"], "\n"), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def same_content(before: DataFrame, after: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whether both tables have the same fingerprint."""
    a, b = (content_fingerprint(x, id_col, text_col).select(F.col("fingerprint").alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.crossJoin(b).select(F.col("a").eqNullSafe(F.col("b")).alias("unchanged"))  # one row each
