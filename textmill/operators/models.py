"""Text classifiers on exact tf-idf features, thresholds and evaluation metrics.

Metrics are arithmetic over one grouping by (actual, predicted): at most one row a pair of labels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from textmill.functions.fixed_values import GATE_MARGIN, GATE_THRESHOLDS, LABELS, RISK_LABELS
from textmill.operators import gram_batches as B
from textmill.operators.features import KNOWN, Counts, Dictionary, by_batch, fit_dictionary, gram_counts, grams_of
from textmill.operators.tables import SENT, stored


def label_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (labels * n of the label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))  # total: one row


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight = n / (labels * n of the label)."""
    return df.join(F.broadcast(label_weights(df, label)), label)  # a row a label


@dataclass
class TextModel:
    """A linear model over tf-idf features: kind of n-grams, labels in ascending order, dictionary, a row of coefficients a label
    (over the dictionary's indices) and an intercept each. Of two labels the first has zeros."""

    kind: str
    labels: list[str]
    words: Dictionary
    coefficients: np.ndarray
    intercepts: np.ndarray
    rounds: int = 0


def keyed(df: DataFrame) -> DataFrame:
    """df as a stored table whose rows have a key of their own."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()))


def train_classifier(df: DataFrame, text: str, label: str, kind: str = "char", c: float = 1.0, max_iter: int = 2000, vocabulary: int | None = None, min_df: int = 1, max_df: float = 1.0, tol: float = 1e-6) -> TextModel:
    """M2 (and, with kind="word", M3): logistic regression on exact tf-idf features with balanced weights over the labels that
    occur: C times the weighted log loss plus half the squared coefficients; multinomial, or binomial for two labels. Rows
    without a label are left out; texts without n-grams count with no feature. The driver holds the coefficients: labels times
    n-grams of the dictionary."""
    rows = keyed(df.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where(F.col(label).isNotNull()))
    weight = {r["label"]: r["weight"] for r in label_weights(rows, "label").collect()}  # a row a label
    labels = sorted(weight)
    if len(labels) < 2:
        raise ValueError(f"training needs two labels, not {labels}")
    # a row's label goes with its key, so that nothing is joined with the features
    counts = gram_counts(rows.select(F.struct("_row", "label").alias("_key"), "text"), "_key", grams_of(kind, F.col("text")))
    words = fit_dictionary(counts, rows.count(), min_df, max_df, vocabulary)
    size = max(words.size, 1)
    points = _points(counts, words, labels, [weight[n] for n in labels])
    total = rows.count()  # the sum of the weights
    family = "binomial" if len(labels) == 2 else "multinomial"
    # a gradient of the coefficients' size goes out from every partition in every round: no more partitions than cores. The features
    # aren't stored, as the blocks that training keeps are: they are made once for their statistics and once for the blocks
    points = points.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    # a block of rows at least as large as the coefficients, which each block's gradient has the size of
    block = max(1.0, 32e-6 * size * len(labels))
    fitted = LogisticRegression(maxBlockSizeInMB=block, labelCol="number", weightCol="weight", family=family, regParam=1.0 / (c * total), standardization=False, maxIter=max_iter, tol=tol).fit(points)
    coefficients, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if family == "binomial":
        coefficients, intercepts = np.vstack([np.zeros_like(coefficients), coefficients]), np.concatenate([[0.0], intercepts])
    return TextModel(kind, labels, words, coefficients, intercepts, fitted.summary.totalIterations)


#: A sparse vector as Spark stores it.
_LISTS = [pa.list_(pa.field("element", kind, nullable=False)) for kind in (pa.int32(), pa.float64())]
_VECTOR = [pa.field("type", pa.int8(), nullable=False), pa.field("size", pa.int32()), pa.field("indices", _LISTS[0]), pa.field("values", _LISTS[1])]


def _points(counts: Counts, words: Dictionary, labels: list[str], weights: list[float]) -> DataFrame:
    """weight, number (of the label) and features of every text."""
    size, of = max(words.size, 1), {n: (float(i), w) for i, (n, w) in enumerate(zip(labels, weights, strict=True))}

    def make(texts: pa.Table, known: pa.Table, found: tuple[np.ndarray, ...]) -> pa.Table:
        row, at, _, weight = found
        index = known["index"].to_numpy()[at]
        order = np.lexsort((index, row))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v[order]), type=t) for v, t in zip((index.astype(np.int32), weight), _LISTS, strict=True)]
        own = [of[k["label"]] for k in texts["id"].to_pylist()]
        kind, sizes = pa.array(np.zeros(len(texts), np.int8)), pa.array(np.full(len(texts), size, np.int32))
        vector = pa.StructArray.from_arrays([kind, sizes, *lists], fields=_VECTOR)
        return B.in_pieces(pa.table({"weight": pa.array([w for _, w in own], pa.float64()), "number": pa.array([n for n, _ in own], pa.float64()), "features": vector}), 1 << 8)

    return by_batch(counts, words, SENT, ["index", "idf"], make, StructType([StructField("weight", DoubleType()), StructField("number", DoubleType()), StructField("features", VectorUDT())]))


def train_legacy(df: DataFrame, text: str, label: str, max_iter: int = 1000, tol: float = 1e-6) -> TextModel:
    """M3: words and pairs, at most 10,000 of those in 2 texts or more and at most 80 percent, C = 10."""
    return train_classifier(df, text, label, "word", 10.0, max_iter, 10_000, 2, 0.8, tol)


def _likely(row: np.ndarray, index: np.ndarray, weight: np.ndarray, rows: int, w: np.ndarray, intercepts: np.ndarray) -> pa.Array:
    """The labels' probabilities of each of so many rows, from the features there are: row, index, weight."""
    margin = np.stack([c + np.bincount(row, weight * v[index], minlength=rows) for c, v in zip(intercepts, w, strict=True)], axis=1)
    e = np.exp(margin - margin.max(axis=1, keepdims=True)) if rows else margin
    p = e / e.sum(axis=1, keepdims=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))


def _scored_in_place(model: TextModel, df: DataFrame, text: str) -> DataFrame:
    grams, given = grams_of(model.kind, F.col(text)), model.words.sent
    lengths, sent = (grams.low, grams.high, grams.separator), df.sparkSession.sparkContext.broadcast((model.coefficients, model.intercepts))

    @F.arrow_udf("array<double>")
    def likely(tokens: pa.Array) -> pa.Array:
        column, out = pa.chunked_array([tokens]), [pa.array([], pa.list_(pa.float64()))]
        index = given.value["index"].to_numpy()
        for a, b in B.sliced(column):
            row, at, _, weight = B.weights_known(column.slice(a, b - a), given.value, *lengths)
            out.append(_likely(row, index[at], weight, b - a, *sent.value))
        return pa.concat_arrays(out)

    return df.withColumn("_p", likely.asNondeterministic()(grams.tokens(grams.text)))


def _labelled(model: TextModel) -> Column:
    """_p as (label, p)."""
    return F.array(*[F.struct(F.lit(n).alias("label"), F.get("_p", F.lit(i)).alias("p")) for i, n in enumerate(model.labels)])


def score_table(model: TextModel, df: DataFrame, text: str) -> DataFrame:
    """M5: adds probs, the array of (label, p) of the labels in ascending order. A text without a known n-gram (null and empty
    ones too) has the intercepts' probabilities. A model of at most KNOWN n-grams goes to every task, which scores its texts where
    they are."""
    scored = _scored_in_place(model, df, text) if model.words.size <= KNOWN else _scored_in_batches(model, df, text)
    return scored.withColumn("probs", _labelled(model)).drop("_p")


def _scored_in_batches(model: TextModel, df: DataFrame, text: str) -> DataFrame:
    rows = keyed(df)
    counts = gram_counts(rows, "_row", grams_of(model.kind, F.col(text)))
    sent = df.sparkSession.sparkContext.broadcast((model.coefficients, model.intercepts))  # as large as the model

    def make(texts: pa.Table, known: pa.Table, found: tuple[np.ndarray, ...]) -> pa.Table:
        row, at, _, weight = found
        return pa.table({"_row": texts["id"], "_p": _likely(row, known["index"].to_numpy()[at], weight, len(texts), *sent.value)})

    p = by_batch(counts, model.words, SENT, ["index", "idf"], make, StructType([StructField("_row", LongType()), StructField("_p", ArrayType(DoubleType()))]))
    return rows.join(p.hint("merge"), "_row", "left").drop("_row")


def ranked(probs: Column) -> Column:
    """M5: probs by falling p, ties by label: the record of a scored row."""
    order = F.array_sort(F.transform(probs, lambda x: F.struct((-x["p"]).alias("n"), x["label"].alias("label"), x["p"].alias("p"))))
    return F.transform(order, lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p")))


def select_model(metrics: DataFrame) -> DataFrame:
    """M4: of (name, macro_f1, accuracy) the best by macro F1, then accuracy, then name."""
    return metrics.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "name").limit(1)


def confusion_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class_metrics(df: DataFrame, actual: str, predicted: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """M6: precision, recall, f1 and support of each label; 0 on zero division."""
    c = confusion_counts(df, actual, predicted)
    spark = df.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    sides = c.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit("a").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))).alias("s"), "actual", "predicted", "n")
    sums = sides.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.side") == "a", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when((F.col("s.side") == "a") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)).alias("hits"),
    )
    out = dim.join(F.broadcast(sums), "label", "left").na.fill(0)  # a row a label
    p, r = _ratio(F.col("hits"), F.col("called")), _ratio(F.col("hits"), F.col("support"))
    return out.select("label", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), "support", "called", "hits")


def classification_metrics(df: DataFrame, actual: str, predicted: str, labels: Sequence[str] = LABELS, over: str = "all") -> DataFrame:
    """M6, M8: one row: samples, accuracy, macro precision, recall and F1 (over all labels, or over those that occur),
    weighted F1, normal false-positive rate, risk recall (any risk, and the same label)."""
    per = per_class_metrics(df, actual, predicted, labels)
    if over == "present":
        per = per.where((F.col("support") > 0) | (F.col("called") > 0))
    macro = per.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    c = confusion_counts(df, actual, predicted)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    a, p = F.col("actual"), F.col("predicted")
    whole = c.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), _ratio(n(a == p), F.sum("n")).alias("accuracy"),
        _ratio(n((a == "normal") & (p != "normal")), n(a == "normal")).alias("normal_fpr"),
        _ratio(n((a != "normal") & (p != "normal")), n(a != "normal")).alias("risk_recall_any"),
        _ratio(n((a != "normal") & (p == a)), n(a != "normal")).alias("risk_recall_same"),
    )
    return whole.crossJoin(macro)  # one row each


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """M7: a row per label, a column per predicted label, zeros kept."""
    spark = df.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("actual"))
    wide = confusion_counts(df, actual, predicted).groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n"))
    return dim.join(F.broadcast(wide), "actual", "left").na.fill(0)  # a row a label


def action_metrics(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """M9."""
    e, a = F.col(expected), F.col(actual)
    return df.agg(_ratio(F.count_if(e == a), F.count("*")).alias("action_accuracy"), _ratio(F.count_if((e == "block") & (a == "block")), F.count_if(e == "block")).alias("block_recall"), _ratio(F.count_if((e == "sanitize") & (a == "sanitize")), F.count_if(e == "sanitize")).alias("sanitize_recall"))


def mode_verdict(rule: Column, semantic: Column, mode: str, block: int = 80, sanitize: int = 40) -> Column:
    """(label, action, score) of a mode: rule_only, semantic_only or combined. The label is the category of the
    first detection by (-score, category, source)."""
    found = {"rule_only": rule, "semantic_only": semantic, "combined": F.concat(rule, semantic)}[mode]
    best = F.array_min(F.transform(found, lambda d: F.struct((-d["score"]).alias("s"), d["category"].alias("category"), d["source"].alias("source"))))
    score = F.coalesce(-best["s"], F.lit(0))
    return F.struct(F.coalesce(best["category"], F.lit("normal")).alias("label"), F.when(score >= block, "block").when(score >= sanitize, "sanitize").otherwise("pass").alias("action"), score.alias("score"))


def apply_thresholds(top_label: Column, top_p: Column, normal_p: Column, thresholds: Mapping[str, float] = GATE_THRESHOLDS, margin: float = GATE_MARGIN) -> Column:
    """M11."""
    table = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    passes = (top_label != "normal") & (top_p >= table[top_label]) & (top_p - normal_p >= margin)
    return F.when(passes, top_label).otherwise("normal")


def legacy_fallback(ranked: Column) -> Column:
    """Ranked: array of (label, p), likeliest first."""
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    rescue = (top["p"] < 0.6) & second.isNotNull() & (second["label"] != "normal") & (second["p"] > 0.15)
    return F.when(top["p"] < 0.15, "normal").when(top["label"] != "normal", top["label"]).when(rescue, second["label"]).otherwise("normal")


GRID = tuple(round(0.20 + 0.05 * i, 2) for i in range(11))
MARGINS = tuple(round(0.05 * i, 2) for i in range(6))


def calibrate_grid(df: DataFrame, true_label: str, top_label: str, top_p: str, normal_p: str, grid: Sequence[float] = GRID, margins: Sequence[float] = MARGINS, defaults: Mapping[str, float] = GATE_THRESHOLDS, most_fpr: float = 0.10, labels: Sequence[str] = RISK_LABELS) -> DataFrame:
    """The best feasible setting of a threshold a label and one margin, as one row, with evaluated and
    feasible counts.

    A prediction depends on the top label's own threshold and the margin alone. So the data is grouped once into
    cells (top label, true label, how far up the grid p and the margin reach); every setting's counts come from
    these few cells: for each label and threshold and margin the hits and false calls, joined on the margin."""
    spark = df.sparkSession
    p, m = F.col(top_p), F.col(top_p) - F.col(normal_p)
    reach = lambda x, values: reduce(lambda a, b: a + b, [(x >= v).cast("int") for v in values])
    cells = df.groupBy(F.col(top_label).alias("top"), F.col(true_label).alias("true"), reach(p, grid).alias("t"), reach(m, margins).alias("m")).agg(F.count("*").alias("n"))
    totals = df.groupBy(F.col(true_label).alias("true")).agg(F.count("*").alias("n"))
    total = {r["true"]: r["n"] for r in totals.collect()}  # a row a label
    n_all, n_normal = sum(total.values()), total.get("normal", 0)
    axis = lambda name, values: spark.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias(f"{name}_i", name))
    settings = axis("threshold", list(grid)).crossJoin(axis("margin", list(margins)))  # 66 rows
    joined = settings.join(F.broadcast(cells), (F.col("t") > F.col("threshold_i")) & (F.col("m") > F.col("margin_i")))  # at most labels^2 x 12 x 7 cells
    per = joined.where(F.col("top") != "normal").groupBy("top", "threshold", "margin").agg(F.sum(F.when(F.col("true") == F.col("top"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("called"), F.sum(F.when(F.col("true") == "normal", F.col("n")).otherwise(0)).alias("fp"))
    f1 = lambda hits, called, support: F.coalesce(F.try_divide(2.0 * hits, called + support), F.lit(0.0))
    out = None
    for name in labels:
        side = settings.join(F.broadcast(per.where(F.col("top") == name)), ["threshold", "margin"], "left").na.fill(0, ["hits", "called", "fp"])
        one = side.select("margin", F.col("threshold").alias(f"threshold_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("hits", "called", "fp")), f1(F.col("hits"), F.col("called"), F.lit(total.get(name, 0))).alias(f"f1_{name}"), F.abs(F.col("threshold") - F.lit(defaults[name])).alias(f"off_{name}"))
        out = one if out is None else out.join(F.broadcast(one), "margin")
    add = lambda c: reduce(lambda a, b: a + b, [F.col(f"{c}_{n}") for n in labels])
    fp, hits, called = add("fp"), add("hits"), add("called")
    normal_hits = F.lit(n_normal) - fp
    normal_called = F.lit(n_all) - called
    out = out.select(
        "margin", *(f"threshold_{n}" for n in labels),
        ((f1(normal_hits, normal_called, F.lit(n_normal)) + add("f1")) / (len(labels) + 1)).alias("macro_f1"),
        ((hits + normal_hits) / F.lit(max(n_all, 1))).alias("accuracy"), (fp / F.lit(max(n_normal, 1))).alias("normal_fpr"),
        (hits / F.lit(max(n_all - n_normal, 1))).alias("risk_recall"), F.round(add("off"), 9).alias("distance"),
    )
    counts = out.agg(F.count("*").alias("evaluated"), F.count_if(F.col("normal_fpr") <= most_fpr).alias("feasible"))
    best = out.where(F.col("normal_fpr") <= most_fpr).orderBy(F.desc(F.round("macro_f1", 12)), F.desc(F.round("accuracy", 12)), "normal_fpr", F.desc("risk_recall"), "distance", "margin", *(f"threshold_{n}" for n in labels)).limit(1)
    return best.crossJoin(counts)  # one row each


def load_partition(df: DataFrame, name: str, split: str = "evaluation_split", status: str = "review_status", label: str = "label", labels: Sequence[str] = LABELS) -> DataFrame:
    """The rows of a partition; an error if it is empty, holds other than verified rows or other labels."""
    own = df.where(F.col(split) == name)
    bad = own.agg(F.count("*").alias("n"), F.count_if(F.col(status) != "verified").alias("s"), F.count_if(~F.col(label).isin(*labels)).alias("l")).first()
    if not bad["n"] or bad["s"] or bad["l"]:
        raise ValueError(f"partition {name}: {bad['n']} rows, {bad['s']} not verified, {bad['l']} of other labels")
    return own


def case_regression(cases: DataFrame, moderate, baseline: Column, default_reply: str, message: str = "message", reply: str = "reply", expected_action: str = "expected_action", expected_output: str = "expected_output_action", expected_category: str | None = None, expected_baseline: str | None = None) -> DataFrame:
    """Each case moderated with its own reply, or default_reply where it has none, and compared with what it expects:
    adds the verdict's columns, baseline_action, baseline_missed, action_matches, output_matches and, where columns for them
    are named, category_matches (the expected one is among the found; none found is normal) and baseline_matches.
    moderate is O7 with its rule pack: DataFrame -> DataFrame."""
    df = moderate(cases.withColumn(reply, F.coalesce(F.col(reply), F.lit(default_reply)))).withColumn("baseline_action", baseline)
    found = F.col("in_risk_categories")
    new = {
        "baseline_missed": (F.col("baseline_action") == "pass") & (F.col("in_action") != "pass"),
        "action_matches": F.col(expected_action).eqNullSafe(F.col("in_action")),
        "output_matches": F.col(expected_output).eqNullSafe(F.col("out_action")),
    }
    if expected_category:
        new["category_matches"] = F.array_contains(found, F.col(expected_category)) | ((F.size(found) == 0) & (F.col(expected_category) == "normal"))
    if expected_baseline:
        new["baseline_matches"] = F.col(expected_baseline).eqNullSafe(F.col("baseline_action"))
    return df.withColumns(new)


def case_metrics(df: DataFrame, demo: str = "demo_only", expected_action: str = "expected_action", action: str = "in_action", expected_output: str = "expected_output_action", output: str = "out_action", missed: str = "baseline_missed") -> DataFrame:
    """Match rates over rows that aren't demos, or over all if every one is."""
    if demo in df.columns:
        flags = df.agg(F.coalesce(F.bool_or(~F.col(demo)), F.lit(False)).alias("_real"))
        df = df.crossJoin(F.broadcast(flags)).where(~F.col("_real") | ~F.col(demo))  # flags: one row
    return df.agg(F.count("*").alias("cases"), _ratio(F.count_if(F.col(expected_action) == F.col(action)), F.count("*")).alias("action_match"), _ratio(F.count_if(F.col(expected_output).eqNullSafe(F.col(output))), F.count("*")).alias("output_match"), _ratio(F.count_if((F.col(expected_action) != "pass") & (F.col(action) != "pass")), F.count_if(F.col(expected_action) != "pass")).alias("risk_match"), F.count_if(missed).alias("baseline_missed"))
