"""Improbable-feature digests: similarity fingerprints of whole texts.

Every 64-byte window of a text has a collision entropy (order 2: from the sum of the squared counts of its
bytes). Prose has a typical entropy; the farther a window's is from it the rarer the window, except that
windows of low entropy (runs, padding) rank last. A window is a feature if its rank is the best within
RADIUS windows on either side, ties by a hash of its bytes. Features in text order go into a chain of
Bloom filters, FEATURES_MAX to a filter. Two digests are compared filter by filter: the overlap of set
bits, less what chance gives, over the possible overlap; each filter of the shorter chain counts with its
best partner. A digest depends on its text alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, portions, table, text_of

WINDOW = 64
#: Below WINDOW, so that windows of neighbouring texts in one buffer never compete.
RADIUS = 31
#: Typical sum of squared byte counts of a 64-byte window of prose, and from where it counts as low entropy. They are fixed
#: numbers, not taken from a corpus, so that digests of different days can be compared.
TYPICAL, LOW = 380, 700
FILTER_BITS, HASHES, FEATURES_MAX = 2048, 5, 160
#: Bytes worked on at once: small against a CPU's cache.
BUFFER = 1 << 18
#: Characters per partition of the ordered table.
PART_CHARS = 6_000_000
#: Buckets that one small driver table can describe; beyond, partitions grow (they are streamed).
PARTS_MAX = 1 << 16

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squares(buf: np.ndarray) -> np.ndarray:
    """The sum of squared byte counts of each window of the buffer: WINDOW and twice the pairs of equal bytes in it. The
    next window has those of its new last byte more and those of the old first byte less."""
    n = len(buf)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (buf[:-d] == buf[d:]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = np.bincount(buf[:WINDOW], minlength=256)
    steps = behind[WINDOW:].astype(np.int32) - ahead[: n - WINDOW]
    # the old first byte may equal the new last one, WINDOW places on: not within WINDOW - 1, so neither counts it
    return np.concatenate([[int((first * first).sum())], int((first * first).sum()) + 2 * np.cumsum(steps)]).astype(np.int32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    up, down = np.full(n, _ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """The features of each text, as 64-bit hashes in text order, repeats left out. A text shorter than
    a window is one feature of its own; an empty one has none."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for i, t in enumerate(texts):
        if 0 < len(t) < WINDOW:
            out[i] = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), np.uint64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    if len(buf) < WINDOW:
        return out
    sq = squares(buf)
    n = len(sq)
    rare = np.abs(sq - TYPICAL)
    rare[sq >= LOW] = 0
    up, down = _powers(len(buf))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up)])
    content = _mixed((total[WINDOW:] - total[:-WINDOW]) * down[:n])
    key = (rare.astype(np.uint32) << np.uint32(16)) | (content >> np.uint64(48)).astype(np.uint32)
    key += 1
    for e in ends[:-1].tolist():  # windows that cross into the next text
        key[max(0, e - WINDOW + 1) : e] = 0
    best = np.concatenate([np.zeros(RADIUS, np.uint32), key, np.zeros(RADIUS + 1, np.uint32)])
    step, width = 1, 2 * RADIUS + 2
    while step < width:
        best = np.maximum(best[:-step], best[step:])
        step *= 2
    at = np.flatnonzero((key == best[:n]) & (key > 0))
    owner = np.searchsorted(ends, at, side="right")
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        own = content[at[cut[i] : cut[i + 1]]]
        if len(own):
            _, first = np.unique(own, return_index=True)
            out[i] = own[np.sort(first)]
    return out


def filters(own: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of a text's features: rows of FILTER_BITS bits as bytes."""
    if not len(own):
        return np.zeros((0, FILTER_BITS // 8), np.uint8)
    bits = np.zeros((-(-len(own) // FEATURES_MAX), FILTER_BITS), np.uint8)
    row = np.arange(len(own)) // FEATURES_MAX
    for k in range(HASHES):
        bits[row, ((own >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Two chains without filters are alike; one without is unlike any with."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    score = 0.0
    for i in range(len(a)):
        both = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        chance = na[i] * nb / FILTER_BITS
        most = np.minimum(na[i], nb)
        score += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return score / len(a)


def shown(chain: np.ndarray) -> str:
    """The digest as text: filters, then base64 of their bytes."""
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def digests(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in chunks(texts, [len(t) for t in texts], BUFFER):
        out += [filters(f) for f in features(texts[a:b])]
    return out


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column fingerprint; a null text is empty."""

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([shown(d) for d in digests([t.encode() for t in texts.to_pylist()])], pa.string())

    return docs.withColumn("fingerprint", made(text_of(text_col)))


def edited(text: str, after: str) -> str:
    """The text whose last floor(n / 3) code points are replaced by the first as many of `after`."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in it in the order of the documents; a bucket's last row is a guest: the
    first document of the following bucket, which only serves as a neighbour."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last: tuple | None = None  # bucket, doc_id, text, digest
    for batch in batches:
        buckets, ids, guests, texts = (batch.column(i).to_pylist() for i in range(4))
        weights = [len(t) for t in texts]
        for a, b in chunks(texts, weights, 8 * BUFFER):
            own = digests([t.encode() for t in texts[a:b]])
            rows = [*([last] if last else []), *zip(buckets[a:b], ids[a:b], texts[a:b], own, guests[a:b], strict=True)]
            pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[4]]
            last = rows[-1]
            new = [edited(x[2], y[2]).encode() for x, y in pairs]
            then = digests(new)
            if pairs:
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[1] for x, _ in pairs], pa.int64()), pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in new]), pa.array([shown(x[3]) for x, _ in pairs]), pa.array([shown(t) for t in then]),
                    pa.array([likeness(x[3], t) for (x, _), t in zip(pairs, then, strict=True)]), pa.array([likeness(x[3], y[3]) for x, y in pairs]),
                ], names=names)


def _not_above(cuts: list[float], x):
    """How many of the sorted cuts are not above x: first among every so many of them, then within one run."""
    if not cuts:
        return F.lit(0)
    run = max(1, int(len(cuts) ** 0.5))
    numbers = lambda values: "array(" + ", ".join(f"{c!r}D" for c in values) + ")"
    runs = [cuts[i : i + run] for i in range(0, len(cuts), run)]
    first = F.size(F.filter(F.expr(numbers([r[0] for r in runs])), lambda c: c <= x))
    own = F.get(F.expr("array(" + ", ".join(map(numbers, runs)) + ")"), first - 1)
    return F.when(first == 0, 0).otherwise((first - 1) * run + F.size(F.filter(own, lambda c: c <= x)))


def neighbour_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, and that to the next document.

    Documents go by descending doc_id, null last, equal ids by text; after the last comes the first. A null
    text is empty. One document alone is its own next. An empty table gives no row.

    Tasks stream their rows, so larger parts only sort more. Texts are shuffled once, by buckets of consecutive ids; the first document of each bucket also goes
    to the bucket before as a guest, found by one small aggregate, one row a bucket."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parts = min(PARTS_MAX, portions(docs, F.length(text_of(text_col)) + 1, PART_CHARS))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))
    cuts = sorted({x for x in own.select(place.alias("p")).agg(F.percentile_approx("p", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] or []}) if parts > 1 else []
    # bucket 0 holds the largest ids
    bucket = F.lit(len(cuts)) - _not_above(cuts, place)
    own = own.withColumn("bucket", bucket)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    heads = {r["bucket"]: r["head"]["doc_id"] for r in own.groupBy("bucket").agg(F.max(order).alias("head")).collect()}
    used = sorted(heads)
    home = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")))
    if used:
        # the first bucket's head is also the guest of the last; all rows of a head's id go, the first serves
        before = dict(zip(used, [used[-1], *used[:-1]], strict=True))
        at = lambda values, kind: F.get(F.expr("array(" + ", ".join("null" if v is None else f"{v}L" for v in values) + ")").cast(f"array<{kind}>"), F.col("bucket"))
        every = range(len(cuts) + 1)
        guest = F.array(F.struct(at([before.get(b) for b in every], "int").alias("bucket"), F.lit(True).alias("guest")))
        head = F.when(at([None if b not in heads else int(heads[b] is None) for b in every], "int") == 1, F.col("doc_id").isNull()).otherwise(at([heads.get(b) for b in every], "long") == F.col("doc_id"))
        home = F.when(F.coalesce(head, F.lit(False)), F.concat(home, guest)).otherwise(home)
    dealt = own.withColumn("to", F.explode(home)).select(F.col("to.bucket").alias("bucket"), "doc_id", F.col("to.guest").alias("guest"), "text")
    dealt = dealt.repartition(max(parts, 1), "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc(F.md5("text")))
    return dealt.mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_improbable_feature_digest(spark, sf_dir: str) -> DataFrame:
    return neighbour_digests(table(spark, sf_dir, "documents"))
