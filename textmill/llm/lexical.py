"""Ranked lexical search with bag deduplication.

A score depends on a document through its counts of the items' terms and its length class m alone. So documents are reduced
to these (their bag), hashed by them, and documents of one hash are grouped with those whose bags are identical, not only
their hashes. Each class is scored once against all items, and its members take its scores in ascending order of doc_id; as
no item lists more than `top` documents, a class keeps its `top` smallest ids, which are picked within each task first, so a
class that a third of all documents belong to is no large group.

Items go in blocks of about BLOCK words, so that what is sent to the tasks is bounded: the block's terms, their weights and
the items that hold them. A block is one pass over the texts, which counts all documents and terms as well; a class's scores
are sums over the postings of its own terms, never a table of all items and terms. Each task keeps `top` classes an item.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

#: Anything but ASCII other than letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Words of items (with an item at least) that a block has in the mean.
BLOCK = 1 << 18
#: Postings read, and sums held, at once in a task.
PAIRS = 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
_FIND = re.compile(TERM).findall


def terms(text: str) -> list[str]:
    return _FIND(text.translate(_FOLD))


def restricted(docs: DataFrame, number, id_col: str, text_col: str) -> DataFrame:
    """id, n (the document's terms), words (numbers of its vocabulary terms, ascending) and tf of each document with a term.
    number: a broadcast of term -> number. A document is a row in and a row out; nothing is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            ids, n, words, tf = [], [], [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms(text.as_py())
                if found:
                    bag = sorted((known[t], c) for t, c in Counter(found).items() if t in known)
                    ids.append(key)
                    n.append(len(found))
                    words.append([w for w, _ in bag])
                    tf.append([c for _, c in bag])
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], pa.int64()), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["id", "n", "words", "tf"])

    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(counted, "id long, n long, words array<int>, tf array<long>")


def classes(bags: DataFrame, top: int) -> DataFrame:
    """words, tf, m and ids (the `top` smallest, nulls last) of each distinct bag (words, tf, m): dealt by its hash, held to be
    one only where all of it is equal."""
    hashed = bags.withColumn("h", F.xxhash64("m", "words", "tf"))
    key = ["h", "m", "words", "tf"]
    few = hashed.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("id")))).where(F.col("r") <= top)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"])
    return few.groupBy(*key).agg(ids.alias("ids")).drop("h")


def posting_lists(bags: list[list[tuple[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start (of each term's postings), item, count: the items that hold a term, terms in order of their numbers."""
    flat = sorted((w, i, c) for i, bag in enumerate(bags) for w, c in bag)
    start = np.zeros(size + 1, np.int64)
    np.cumsum(np.bincount([w for w, _, _ in flat], minlength=size), out=start[1:])
    return start, np.array([i for _, i, _ in flat], np.int64), np.array([c for _, _, c in flat], np.int64)


def scored(start: np.ndarray, item: np.ndarray, gain: np.ndarray, n_items: int, words: np.ndarray, part: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums over a row's terms of part (the term's share by its count in the row) times gain (the weight times the count in the
    item), for each row and item: rows x n_items, 64-bit integers."""
    length = start[words + 1] - start[words]
    at = np.repeat(start[words] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    out = np.zeros(rows * n_items, np.int64)
    np.add.at(out, np.repeat(row, length) * n_items + item[at], np.repeat(part, length) * gain[at])
    return out.reshape(rows, n_items)


class Best:
    """The `top` classes of each item by score, then by first id, among those added so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)  # a score of 0 isn't listed
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list]] = []
        self.limit, self.size = 2 * items * top + 65_536, 0

    def add(self, item: np.ndarray, score: np.ndarray, first: np.ndarray, ids: list) -> None:
        self.held.append((item, score, first, ids))
        self.size += len(item)
        if self.size > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, list]:
        item, score, first = (np.concatenate([h[k] for h in self.held]) if self.held else np.zeros(0, np.int64) for k in range(3))
        ids = [x for h in self.held for x in h[3]]
        order = np.lexsort((first, -score, item))
        own = item[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        keep = order[place < self.top]
        last = order[place == self.top - 1]
        self.least[item[last]] = score[last]
        self.held, self.size = [(item[keep], score[keep], first[keep], [ids[k] for k in keep.tolist()])], len(keep)
        return item[keep], score[keep], self.held[0][3]


def block_ranks(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, top: int) -> DataFrame:
    """item_id, score, id: of each item (item_id, text) of the block, documents among which its `top` are."""
    spark = docs.sparkSession
    found = [Counter(terms(text or "")) for _, text in items]
    number = {t: k for k, t in enumerate(sorted(set().union(*found)))}
    bags = [[(number[t], c) for t, c in bag.items()] for bag in found]
    counted = written(restricted(docs, spark.sparkContext.broadcast(number), id_col, text_col), "bags")
    total = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total["n"], total["l"]
    df = np.zeros(len(number), np.int64)
    for r in counted.select(F.explode("words").alias("w")).groupBy("w").count().collect():  # a row a term of the block
        df[r["w"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    start, item, count = posting_lists(bags, len(number))
    gain = count * np.repeat(weight, np.diff(start))
    sent = spark.sparkContext.broadcast((start, item, gain))
    n_items, out_schema = len(items), "item int, score long, ids array<long>"

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, item, gain = sent.value
        best = Best(n_items, top)
        for batch in batches:
            words, tf, ids = batch.column(0), batch.column(1), batch.column(3).to_pylist()
            size = words.value_lengths().to_numpy(zero_copy_only=False)
            words, tf = words.flatten().to_numpy(), tf.flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), size)
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * batch.column(2).to_numpy()[row])
            first = np.array([i[0] if i[0] is not None else 1 << 62 for i in ids], np.int64)
            work = np.concatenate([[0], np.cumsum(np.bincount(row, start[words + 1] - start[words], len(batch)) + n_items)])
            a = 0
            while a < len(batch):  # as many rows as fit, one at least
                b = max(a + 1, int(np.searchsorted(work, work[a] + PAIRS, side="right")) - 1)
                own = (row >= a) & (row < b)
                s = scored(start, item, gain, n_items, words[own], part[own], row[own] - a, b - a)
                at, to = np.nonzero(s >= best.least)
                best.add(to, s[at, to], first[a + at], [ids[a + i] for i in at.tolist()])
                a = b
        to, score, ids = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["item", "score", "ids"])

    m = F.expr(f"cast(100 - 25 + ((25 * n * {n_docs}L) div {max(n_terms, 1)}L) as long)")
    once = written(classes(counted.where(F.size("words") > 0).select("id", "words", "tf", m.alias("m")), top), "classes")
    hits = once.select("words", "tf", "m", "ids").mapInArrow(ranked, out_schema)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("item", "item_id", "score", F.explode("ids").alias("id"))  # names: the block's items


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), id_col, score of each item's `top` highest-scoring documents with a score above 0, equal scores
    by ascending id (null last).

    A document is a row: rows repeated are ranked each, and all count in the statistics; those without a term (null or empty
    text) count in none. Rows that repeat an item's id and text are one item; items without a term get no row. Whole texts are
    read, other columns are not. Empty tables give no row."""
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), text_of(item_text).alias("text")).distinct()
    asked = written(asked.withColumn("words", F.size(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).where("words > 0"), "items")
    blocks = (asked.agg(F.sum("words")).first()[0] or 0) // block + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in asked.where(F.col("block") == b).select("item_id", "text").orderBy("item_id", "text").collect()]  # about `block` words
        if own:
            parts.append(block_ranks(docs, own, id_col, text_col, top).withColumn("block", F.lit(b)))
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id long, rank int, {id_col} long, score long")
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    hits = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return hits.select("item_id", "rank", F.col("id").alias(id_col), "score")


def op12_bag_dedup_search(spark, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
RANK_SQL = f"""with t as (select row_number() over () as rid, doc_id, {_SQL_TERMS} as ts from documents),
q as (select row_number() over () as iid, item_id, ts from (select distinct item_id, {_SQL_TERMS} as ts, coalesce(text, '') as x from benchmark)),
qt as (select iid, item_id, unnest(ts) as term from q), qc as (select iid, item_id, term, count(*) as c from qt group by all),
vocabulary as (select distinct term from qc), s as (select count(*) as n_docs, sum(len(ts))::BIGINT as n_terms from t where len(ts) > 0),
u as (select rid, doc_id, len(ts) as n, unnest(ts) as term from t),
tf as (select rid, doc_id, n, term, count(*)::BIGINT as tf from u where term in (select term from vocabulary) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT as w from (select term, count(*) as df from tf group by term) cross join s),
x as (select iid, item_id, rid, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT as score from qc join tf using (term) join w using (term) cross join s group by all),
r as (select *, row_number() over (partition by iid order by score desc, doc_id nulls last) as rank from x where score > 0)
select item_id, rank::INT as rank, doc_id, score from r where rank <= {TOP}"""
