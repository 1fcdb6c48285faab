"""Sources and sinks of rule packs, labelled texts, tables and audit events. All read and write through Spark, so
any store it knows will do."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.detect import compiles, confidence_bucket
from textmill.functions.normalize import trim
from textmill.operators.tables import numbered, side, stored
from textmill.sources.lines import numbered_lines

STEM = r"([^/\\]+?)(?:\.[^./\\]*)?$"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(category: the file's stem, pos, word) of all *.txt, trimmed, without blank and # lines."""
    rows = numbered_lines(spark, path, "*.txt").withColumn("word", trim(F.col("line")))
    return rows.where((F.col("word") != "") & ~F.col("word").startswith("#")).select(F.url_decode(F.regexp_extract("file", STEM, 1)).alias("category"), F.col("line_number").alias("pos"), "word")


def lexicon_dict(rows: DataFrame) -> dict[str, list[str]]:
    """A lexicon as a rule pack's argument: it is literal in the plan, so it must be of that size."""
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("category", "pos").collect():
        out.setdefault(r["category"], []).append(r["word"])
    return out


def _exists(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


@F.arrow_udf(T.BooleanType())
def _compiles(patterns: pa.Array) -> pa.Array:
    return pa.array([p is not None and compiles(p) for p in patterns.to_pylist()], pa.bool_())


RULE_SCHEMA = "name string, category string, pattern string, level string, score int, reason string"


def read_regex_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules whose pattern isn't empty and compiles; an absent file has none. Patterns are checked in tasks."""
    found = _exists(lambda: spark.read.schema(RULE_SCHEMA).json(path, multiLine=True))
    if found is None:
        return spark.createDataFrame([], RULE_SCHEMA)
    return found.where("pattern <> ''").where(_compiles("pattern"))


MAP_COLUMNS = ("source", "target", "type", "category_hint", "confidence", "confidence_score", "rationale")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """S3: entries of a JSON object in either format; entries without a source or a text target are left out; an
    absent or broken file has none."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MAP_COLUMNS])
    found = _exists(lambda: spark.read.option("wholetext", True).text(path))
    if found is None:
        return spark.createDataFrame([], schema)
    entry = F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,variant>")
    rows = found.select(F.explode(entry).alias("source", "v")).where("source <> ''")
    get = lambda c: F.try_variant_get("v", f"$.{c}", "string")
    is_text = F.schema_of_variant("v") == "STRING"
    target = F.when(is_text, F.try_variant_get("v", "$", "string")).when(F.schema_of_variant(F.try_variant_get("v", "$.target", "variant")) == "STRING", get("target"))
    out = rows.select("source", target.alias("target"), *(F.when(~is_text, get(c)).alias(c) for c in MAP_COLUMNS[2:]))
    return out.where("target is not null")


def merge_maps(maps: Sequence[DataFrame]) -> DataFrame:
    """A later map's entry overrides an earlier one's of the same source."""
    all_ = None
    for i, m in enumerate(maps):
        part = m.withColumn("_priority", F.lit(i))
        all_ = part if all_ is None else all_.unionByName(part)
    last = Window.partitionBy("source").orderBy(F.desc("_priority"))
    return all_.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_priority")


def read_labelled_lines(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(text, label, source_file, source_line, source_order) of line files by label; blank and # lines go."""
    out = None
    for i, (label, path) in enumerate(paths.items()):
        rows = numbered_lines(spark, path, None).withColumn("text", trim(F.col("line"))).where((F.col("text") != "") & ~F.col("text").startswith("#"))
        part = rows.select("text", F.lit(label).alias("label"), F.regexp_extract("file", r"([^/\\]+)$", 1).alias("source_file"), F.col("line_number").alias("source_line"), F.lit(i).alias("source_order"))
        out = part if out is None else out.unionByName(part)
    return out


def read_table_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header, all strings, a byte-order mark allowed; absent columns are an error that names them."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.na.fill("")


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, since: Column | None = None) -> DataFrame:
    """JSON lines; blank and broken ones are skipped; with since those before it and those without a time that
    can be read go as well. Times without a zone are UTC."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("e")).where("e._corrupt_record is null").select("e.*").drop("_corrupt_record")
    return parsed if since is None else parsed.where(F.col("time").try_cast("timestamp") >= since)


def write_events(df: DataFrame, path: str) -> None:
    """Redacted events with the time of writing, appended as JSON lines."""
    from textmill.operators.audit_log import redact

    redact(df).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time"), "*").write.mode("append").json(path)


def write_report(df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str]) -> None:
    """A CSV of these fields in this order; absent ones are empty, others are left out, the header is always there."""
    cols = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in fields]
    df.orderBy(*order).select(*cols).write.mode("overwrite").csv(path, header=True)


def reference_union(tables: Mapping[str, tuple[DataFrame, str, str | None, Sequence[str]]]) -> DataFrame:
    """(reference_id, text, label, reference_file) of tables given as name: (df, id, label or None, text columns);
    a row's equal texts count once."""
    out = None
    for name, (df, id_col, label, texts) in tables.items():
        own = F.array_distinct(F.filter(F.array(*[F.col(t).cast("string") for t in texts]), lambda t: t.isNotNull() & (t != "")))
        part = df.select(F.col(id_col).cast("string").alias("reference_id"), F.explode(own).alias("text"), (F.col(label) if label else F.lit("")).cast("string").alias("label"), F.lit(name).alias("reference_file"))
        out = part if out is None else out.unionByName(part)
    return out


def sample_union(tables: Mapping[str, tuple[DataFrame, str, str, Sequence[str], str]]) -> DataFrame:
    """(sample_id, text, label, source, set_type) of tables given as name: (df, id, label, text columns, set_type);
    the first text that isn't empty counts, rows without one go."""
    out = None
    for name, (df, id_col, label, texts, kind) in tables.items():
        text = F.coalesce(*[F.when(F.col(t) != "", F.col(t)) for t in texts])
        part = df.select(F.col(id_col).cast("string").alias("sample_id"), text.alias("text"), F.col(label).cast("string").alias("label"), F.lit(name).alias("source"), F.lit(kind).alias("set_type")).where("text is not null")
        out = part if out is None else out.unionByName(part)
    return out


def catalog_places(df: DataFrame, label: str, scenario: str, text: str) -> DataFrame:
    """(label, scenario, pos, text): the distinct texts of each label and scenario with their places from 0, in order of the text.
    Places come from one numbering of all rows in ranges, so a label that most rows have isn't one task."""
    rows = numbered(df.select(F.col(label).alias("label"), F.col(scenario).alias("scenario"), F.col(text).alias("text")).distinct(), ["label", "scenario", "text"])
    first = stored(rows.groupBy("label", "scenario").agg(F.min("index").alias("_first")), "first")
    same = rows.alias("r").join(side(first).alias("f"), F.col("r.label").eqNullSafe(F.col("f.label")) & F.col("r.scenario").eqNullSafe(F.col("f.scenario")))
    return same.select("r.label", "r.scenario", (F.col("index") - F.col("_first")).alias("pos"), "text")


def label_catalog_rows(catalog: DataFrame, source_type: str, sanitize_first: int = 10) -> DataFrame:
    """A catalogue (label, scenario, texts: array; or a row a text: pos from 0, text) as candidate rows: normal passes; of
    a risk label's texts the first `sanitize_first` are medium and to be sanitized, the others high and to be blocked."""
    rows = catalog.select("label", "scenario", F.posexplode("texts").alias("pos", "text")) if "texts" in catalog.columns else catalog.select("label", "scenario", "pos", "text")
    soft = F.col("pos") < sanitize_first
    return rows.select(
        F.concat(F.lit("siev1_"), F.substring(F.sha2(F.concat_ws("\x1f", "label", "text"), 256), 1, 16)).alias("sample_id"), "text", "label",
        F.when(F.col("label") == "normal", "none").when(soft, "medium").otherwise("high").alias("risk_level"),
        F.when(F.col("label") == "normal", "pass").when(soft, "sanitize").otherwise("block").alias("expected_action"),
        "scenario", F.lit(source_type).alias("source_type"), F.concat_ws(":", "label", (F.col("pos") + 1).cast("string")).alias("source_reference"),
        F.lit("pending").alias("review_status"),
    )


def map_entries(entries: DataFrame) -> DataFrame:
    """Entries of a map as rules use them: variant, source, target, confidence, confidence_level, rationale, type."""
    number = F.coalesce(F.col("confidence").try_cast("double"), F.col("confidence_score").try_cast("double"), F.lit(0.0))
    return entries.select(F.col("source").alias("variant"), "source", "target", number.alias("confidence"), confidence_bucket(F.coalesce("confidence", F.lit("0"))).alias("confidence_level"), F.coalesce("rationale", F.lit("")).alias("rationale"), F.coalesce("type", F.lit("")).alias("type")).orderBy("variant")


def rule_listing(lexicon: DataFrame, rules: DataFrame) -> DataFrame:
    """(kind, category, value) of words and patterns, sorted."""
    words = lexicon.select(F.lit("word").alias("kind"), "category", F.col("word").alias("value"))
    return words.unionByName(rules.select(F.lit("regex").alias("kind"), "category", F.col("pattern").alias("value"))).orderBy("kind", "category", "value")
