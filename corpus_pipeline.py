"""A corpus from raw documents to packed sequences: five stages, each a function (spark, docs, sf_dir) to a
DataFrame that is written as Parquet and read again as the next one's docs.

All but the last keep the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill import ship
from textmill.llm import mixing, near_dedup, packing, quality, secret_scan
from textmill.llm.common import shared_path, table, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below its threshold go; it learns from the labelled ones."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score_quality(docs.select(*COLUMNS), model, score_col="_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document of the smallest doc_id stays;
    of rows equal in id and text, one."""
    own = docs.select(*COLUMNS)
    kept = near_dedup.near_duplicates(own, SHINGLE_WORDS, SIMILARITY).where("kept").select("doc_id", "tkey").distinct()
    keys = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_none": F.col("doc_id").isNull()}
    kept = kept.withColumns(keys).select("_id", "_none", F.col("tkey").alias("_key"))
    rows = own.withColumns({**keys, "_key": F.xxhash64(text_of())}).join(kept.hint("shuffle_hash"), ["_id", "_none", "_key"], "left_semi")
    first = Window.partitionBy("_id", "_none", "_key").orderBy("source", "lang")
    return rows.withColumn("_row", F.row_number().over(first)).where("_row = 1").select(*COLUMNS)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is masked; n_chars follows the text."""
    own = secret_scan.mask_secrets(docs.select(*COLUMNS))
    return own.withColumn("n_chars", F.length("text").cast("long"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or repeated."""
    mixed = mixing.mix(docs.select(*COLUMNS), keep=COLUMNS[1:])
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_masking", secret_masking),
    ("mix_to_weights", mix_to_weights),
    ("packing", packed),
]

#: Trained scores, sketches and tokenizers can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table lies in the shared folder."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
