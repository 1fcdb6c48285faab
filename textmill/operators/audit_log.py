"""Audit events: redaction by field name, and counters."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.fixed_values import REDACTED, SENSITIVE_FIELDS


def _redacted(value: Column, kind: T.DataType, hidden: bool, names: Collection[str]) -> Column:
    if hidden:
        if isinstance(kind, T.ArrayType):
            return F.when(F.size(value) > 0, F.array(F.lit(REDACTED))).when(value.isNotNull(), F.array().cast("array<string>"))
        return F.when(value.isNotNull(), F.lit(REDACTED))
    if isinstance(kind, T.StructType):
        made = F.struct(*[_redacted(value[f.name], f.dataType, f.name in names, names).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: _redacted(x, kind.elementType, False, names))
    return value


def redact(df: DataFrame, names: Collection[str] = SENSITIVE_FIELDS) -> DataFrame:
    """A1: every field of a sensitive name, at any depth, is hidden: null stays null, a list becomes one mark (an
    empty one stays empty), anything else becomes the mark. The expressions follow the schema."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType, f.name in names, names).alias(f.name) for f in df.schema.fields])


def _field(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


RESULT = "struct<stage:string,action:string,risk_score:int,risk_level:string,risk_categories:array<string>,blocked:boolean,rewritten:boolean,detections:array<struct<category:string,source:string>>>"


def _as_result(value: Column, kind: T.DataType | None) -> Column:
    """A result of any schema in the common shape; fields that it lacks are null."""
    if not isinstance(kind, T.StructType):
        return F.lit(None).cast(RESULT)
    has = {f.name: f for f in kind.fields}
    get = lambda n, t: value[n].cast(t) if n in has else F.lit(None).cast(t)
    detections = F.transform(value["detections"], lambda d: F.struct(d["category"].alias("category"), d["source"].alias("source"))) if "detections" in has else F.lit(None).cast("array<struct<category:string,source:string>>")
    made = F.struct(get("stage", "string").alias("stage"), get("action", "string").alias("action"), get("risk_score", "int").alias("risk_score"), get("risk_level", "string").alias("risk_level"), get("risk_categories", "array<string>").alias("risk_categories"), get("blocked", "boolean").alias("blocked"), get("rewritten", "boolean").alias("rewritten"), detections.alias("detections"))
    return F.when(value.isNotNull(), made)


def event_results(events: DataFrame, stage_col: str = "event_stage", keep: Collection[str] = ()) -> DataFrame:
    """A2: one row per result of an event (input_filter, output_filter, result), its stage falling back on the
    event's, then on unknown; absent action is unknown, level is made from the score, categories from the
    detections, then normal."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    found = [_as_result(F.col(c), kinds[c]) for c in ("input_filter", "output_filter", "result") if c in kinds]
    rows = events.select(*keep, _field(events, stage_col, "string").alias("_stage"), F.explode(F.array_compact(F.array(*found))).alias("r"))
    score = F.coalesce(F.col("r.risk_score"), F.lit(0))
    detections = F.coalesce(F.col("r.detections"), F.array().cast("array<struct<category:string,source:string>>"))
    named = F.filter(F.transform(detections, lambda d: d["category"]), lambda c: c.isNotNull() & (c != ""))
    own = F.coalesce(F.col("r.risk_categories"), F.array().cast("array<string>"))
    is_rule = lambda d: rule_source(d["source"])
    is_semantic = lambda d: semantic_source(d["source"])
    return rows.select(
        *keep,
        F.coalesce(F.when(F.col("r.stage") != "", F.col("r.stage")), F.when(F.col("_stage") != "", F.col("_stage")), F.lit("unknown")).alias("stage"),
        F.coalesce("r.action", F.lit("unknown")).alias("action"),
        F.coalesce(F.col("r.risk_level"), F.when(score >= 80, "high").when(score >= 40, "medium").when(score > 0, "low").otherwise("none")).alias("risk_level"),
        F.when(F.size(own) > 0, own).when(F.size(named) > 0, named).otherwise(F.array(F.lit("normal"))).alias("categories"),
        named.alias("detection_categories"),
        (F.coalesce(F.col("r.action") == "block", F.lit(False)) | F.coalesce("r.blocked", F.lit(False))).alias("blocked"),
        (F.coalesce(F.col("r.action").isin("sanitize", "rewrite"), F.lit(False)) | F.coalesce("r.rewritten", F.lit(False))).alias("rewritten"),
        F.size(detections).cast("long").alias("detections"),
        F.size(F.filter(detections, is_rule)).cast("long").alias("rule_hits"),
        F.size(F.filter(detections, is_semantic)).cast("long").alias("semantic_hits"),
    )


def rule_source(source: Column) -> Column:
    """A5."""
    return F.coalesce(source.isin("keyword", "regex") | source.startswith("rule"), F.lit(False))


def semantic_source(source: Column) -> Column:
    """A5."""
    return F.coalesce(source.startswith("semantic"), F.lit(False))


def event_stats(events: DataFrame, since: Column | None = None, time_col: str = "time", stage_col: str = "event_stage") -> DataFrame:
    """A3: all scalar counters as one row."""
    if since is not None:
        events = since_window(events, since, time_col)
    total = events.agg(F.count("*").alias("total_events"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    r = event_results(events, stage_col)
    scalars = r.agg(
        count(F.col("blocked")).alias("blocked"), count(F.col("rewritten")).alias("rewritten"),
        count(F.col("rule_hits")).alias("rule_hit_count"), count(F.col("semantic_hits")).alias("semantic_hit_count"),
        count((F.col("rule_hits") > 0) & (F.col("semantic_hits") > 0)).alias("joint_rule_semantic_hit_count"),
        count(F.when(F.col("stage") == "input", F.col("detections")).otherwise(0)).alias("input_detection_count"),
        count(F.when(F.col("stage") == "output", F.col("detections")).otherwise(0)).alias("output_detection_count"),
    )
    return total.crossJoin(scalars)  # one row each


DIMENSIONS = ("stage", "action", "input_action", "output_action", "final_action", "risk_level", "category", "category_detection")


def dimension_rows(events: DataFrame, keep: Collection[str] = (), stage_col: str = "event_stage", action_col: str = "action") -> DataFrame:
    """(keep, dimension, name): a row for each count that an event adds to."""
    r = event_results(events, stage_col, keep)
    pair = lambda d, n: F.struct(F.lit(d).alias("dimension"), n.alias("name"))
    arrays = [
        F.array(pair("stage", F.col("stage")), pair("action", F.col("action")), pair("risk_level", F.col("risk_level"))),
        F.when(F.col("stage").isin("input", "output"), F.array(F.struct(F.concat("stage", F.lit("_action")).alias("dimension"), F.col("action").alias("name")))),
        F.transform("categories", lambda c: pair("category", c)),
        F.transform("detection_categories", lambda c: pair("category_detection", c)),
    ]
    pairs = r.select(*keep, F.explode(F.flatten(F.array_compact(F.array(*arrays)))).alias("p")).select(*keep, "p.*")
    final = events.where(_field(events, stage_col, "string") == "final")
    final_action = _field(events, action_col, "string")
    own = final.select(*keep, F.explode(F.array_compact(F.array(pair("stage", F.lit("final")), F.when(F.coalesce(final_action, F.lit("")) != "", pair("final_action", final_action))))).alias("p")).select(*keep, "p.*")
    return pairs.unionByName(own)


def counts_by(events: DataFrame, dims: Collection[str] = DIMENSIONS, stage_col: str = "event_stage", action_col: str = "action") -> DataFrame:
    """(dimension, name, count), all dimensions in one grouping."""
    pairs = dimension_rows(events, (), stage_col, action_col)
    return pairs.where(F.col("dimension").isin(*dims)).groupBy("dimension", "name").agg(F.count("*").alias("count"))


#: A3's counters, in order.
SCALARS = ("total_events", "blocked", "rewritten", "rule_hit_count", "semantic_hit_count", "joint_rule_semantic_hit_count", "input_detection_count", "output_detection_count")


def counter_rows(events: DataFrame, keep: Collection[str] = (), stage_col: str = "event_stage", action_col: str = "action") -> DataFrame:
    """(keep, dimension, name, n) whose sums are A4's counts, and A3's counters in the dimension counter."""
    r = event_results(events, stage_col, keep)
    c = lambda name: F.col(name).cast("long")
    values = (
        c("blocked"), c("rewritten"), c("rule_hits"), c("semantic_hits"), ((F.col("rule_hits") > 0) & (F.col("semantic_hits") > 0)).cast("long"),
        F.when(F.col("stage") == "input", F.col("detections")).otherwise(0), F.when(F.col("stage") == "output", F.col("detections")).otherwise(0),
    )
    sums = r.groupBy(*keep).agg(*(F.sum(v).alias(n) for n, v in zip(SCALARS[1:], values, strict=True)))
    total = events.groupBy(*keep).agg(F.count("*").alias("total_events"))
    long = lambda df, names: df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("x")).select(*keep, F.lit("counter").alias("dimension"), "x.name", "x.n")
    rows = dimension_rows(events, keep, stage_col, action_col).withColumn("n", F.lit(1).cast("long"))
    return rows.unionByName(long(sums, SCALARS[1:])).unionByName(long(total, SCALARS[:1]))


def stats_long(events: DataFrame, **kwargs) -> DataFrame:
    """The counters of categories, levels, actions and stages, sorted."""
    return counts_by(events, ("category", "risk_level", "action", "stage"), **kwargs).orderBy("dimension", "name")


def dashboard_metrics(df: DataFrame, input_action: str = "input_action", output_action: str = "output_action", missed: str = "baseline_missed") -> DataFrame:
    """A7."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(F.col(input_action) != "pass").alias("handled"), F.count_if(F.col(input_action) == "block").alias("blocked"),
        F.count_if(F.col(output_action) == "block").alias("output_blocked"), F.count_if(F.col(missed)).alias("baseline_missed"),
    )


def value_share(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share), null and empty as unknown. The total is that of the grouped counts."""
    value = F.coalesce(F.when(F.col(column).cast("string") != "", F.col(column).cast("string")), F.lit("unknown"))
    counts = df.groupBy(value.alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") / F.col("total")).alias("share"))  # total: one row


def detection_lift(df: DataFrame, enhanced: Column, recovered: Column) -> DataFrame:
    """(baseline, enhanced, recovered) counts."""
    got = df.agg(F.count_if(enhanced).alias("enhanced"), F.count_if(recovered).alias("recovered"))
    return got.select(F.greatest(F.col("enhanced") - F.col("recovered"), F.lit(0)).alias("baseline"), "enhanced", "recovered")


def crosstab(df: DataFrame, expected: str, actual: str, values: list[str] | None = None) -> DataFrame:
    """A10: a row per expected value, a column per actual one, zeros kept."""
    return df.groupBy(expected).pivot(actual, values).count().na.fill(0)


def since_window(df: DataFrame, since: Column, time_col: str = "time") -> DataFrame:
    """Rows whose time can be read (without a zone: UTC) and isn't before since."""
    return df.where(F.col(time_col).try_cast("timestamp") >= since)


def retention_filter(df: DataFrame, now: Column, days: int, time_col: str = "time") -> DataFrame:
    """Rows not older than `days` before now; 0 keeps all."""
    return df if days <= 0 else df.where(F.col(time_col) >= now - F.make_dt_interval(F.lit(days)))
