"""What the registered queries share: the registry, the corpus rule pack and derived inputs with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.detect import Pack
from textmill.functions.normalize import Maps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly where the scan has fewer tasks than the cluster has cores (a few large files); a table of
    many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A rule pack in the corpus's own words; a deployment passes its own.
LEXICONS = {"ad": ["ention", "with the"], "porn": ["ererst"], "sensitive": ["ouen", "undch"], "violence": ["tionnd", "é la"]}
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
RULES = [("ad", MAIL, "medium", 60, "possible email address"), ("ad", IP, "low", 30, "possible IPv4 address"), ("sensitive", r"\bthe [a-z]+ing\b", "medium", 45, "phrase")]
MAPS = Maps(emoji=[("|", " ")], symbol=[("e-n", "en")], variant=[("ß", "ss"), ("é", "e")], homophone=[("tion", "shun"), ("nd", "n"), ("the", "da")], pinyin=[("that", "dat"), ("of", "ov")], abbreviation=[("is", "iz")])
PACK = Pack(LEXICONS, RULES, MAPS)
PLAIN_PACK = Pack(LEXICONS, RULES)


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def number(key: Column, at: int) -> Column:
    """Four hex digits of a key's SHA-256 as a number: an input that SQL can make as well."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), at, 4), 16, 10).cast("long")


def sql_number(key: str, at: int) -> str:
    return f"('0x' || substr(sha256(({key})::varchar), {at}, 4))::BIGINT"


LABEL_SQL = "case when l.quality is null then '' when l.toxic = 1 then 'violence' when l.quality = 0 then 'ad' else 'normal' end"
#: documents with a label of text: '' where there is none.
DOCS_SQL = f"docs as (select d.doc_id, d.text, d.lang, d.source, {LABEL_SQL} as label from documents d left join labels l using (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    label = F.when(F.col("quality").isNull(), "").when(F.col("toxic") == 1, "violence").when(F.col("quality") == 0, "ad").otherwise("normal")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", label.alias("label"))


CLASSES = ("normal", "ad", "porn", "violence", "sensitive")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of every document from its id's hash, and a true label likewise: (doc_id, true_label, probs, p_*)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    v = [(number(F.col("doc_id"), 1 + 4 * i) + 1).cast("double") for i in range(5)]
    v[0] = v[0] * 1.5
    total = v[0] + v[1] + v[2] + v[3] + v[4]
    true = F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod(number(F.col("doc_id"), 21), F.lit(5)) + 1).cast("int"))
    out = d.select("doc_id", true.alias("true_label"), *((x / total).alias(f"p_{c}") for x, c in zip(v, CLASSES, strict=True)))
    return out.withColumn("probs", F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"p_{c}").alias("p")) for c in CLASSES]))


_V = [f"({sql_number('doc_id', 1 + 4 * i)} + 1)::DOUBLE" for i in range(5)]
_V[0] += " * 1.5"
PROBS_SQL = f"""v as (select doc_id, {", ".join(f"{x} as v{i}" for i, x in enumerate(_V))}, {sql_list(CLASSES)}[({sql_number("doc_id", 21)} % 5) + 1] as true_label from documents),
probs as (select doc_id, true_label, {", ".join(f"v{i} / (v0 + v1 + v2 + v3 + v4) as p_{c}" for i, c in enumerate(CLASSES))} from v),
tops as (select *, greatest(p_normal, p_ad, p_porn, p_violence, p_sensitive) as top_p,
 case greatest(p_normal, p_ad, p_porn, p_violence, p_sensitive) when p_normal then 'normal' when p_ad then 'ad' when p_porn then 'porn' when p_violence then 'violence' else 'sensitive' end as top_label from probs)"""
GATE_SQL = "case top_label when 'ad' then 0.25 when 'porn' then 0.25 when 'violence' then 0.55 when 'sensitive' then 0.65 end"


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events from the events table: two in three carry a result, the rest are final ones."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    stage = F.element_at(F.array(F.lit("input"), F.lit("output"), F.lit("final")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    score = F.pmod(n, F.lit(101)).cast("int")
    action = F.when(score >= 80, "block").when(score >= 40, "sanitize").otherwise("pass")
    category = F.when(score >= 40, F.when(F.pmod(n, F.lit(2)) == 0, "ad").otherwise("violence"))
    source = F.when(F.pmod(n, F.lit(5)) == 0, "semantic_ml").otherwise("keyword")
    one = F.struct(category.alias("category"), source.alias("source"), F.array(F.col("event_type")).alias("matches"))
    both = F.struct(category.alias("category"), F.lit("semantic_ml").alias("source"), F.array().cast("array<string>").alias("matches"))
    found = F.when(score < 40, F.array().cast("array<struct<category:string,source:string,matches:array<string>>>")).when(F.pmod(n, F.lit(7)) == 0, F.array(one, both)).otherwise(F.array(one))
    level = F.when(F.pmod(n, F.lit(4)) != 0, F.when(score >= 80, "high").when(score >= 40, "medium").otherwise("low"))
    result = F.struct(F.when(F.pmod(n, F.lit(6)) != 0, stage).alias("stage"), action.alias("action"), score.alias("risk_score"), level.alias("risk_level"), F.array().cast("array<string>").alias("risk_categories"), (score >= 80).alias("blocked"), F.lit(None).cast("boolean").alias("rewritten"), found.alias("detections"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("time"), stage.alias("event_stage"), F.when(stage == "final", action).alias("action"), F.col("event_type").alias("input"), F.when(stage != "final", result).alias("result"))


EVENTS_SQL = """e0 as (select event_id, ts, event_type, ['input','output','final'][(event_id % 3) + 1] as stage, event_id % 101 as score from events),
e as (select *, case when score >= 80 then 'block' when score >= 40 then 'sanitize' else 'pass' end as action,
 case when score >= 40 then case when event_id % 2 = 0 then 'ad' else 'violence' end end as category,
 case when score < 40 then 0 when event_id % 7 = 0 then 2 else 1 end as n_found,
 case when event_id % 5 = 0 then 1 else 0 end as first_semantic,
 case when event_id % 4 <> 0 then case when score >= 80 then 'high' when score >= 40 then 'medium' else 'low' end
      else case when score >= 80 then 'high' when score >= 40 then 'medium' when score > 0 then 'low' else 'none' end end as risk_level from e0),
r as (select *, case when n_found = 0 then 0 else 1 - first_semantic end as rule_hits, case when n_found = 0 then 0 else first_semantic + (n_found - 1) end as semantic_hits from e where stage <> 'final')"""
