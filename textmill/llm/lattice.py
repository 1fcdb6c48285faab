"""Language-model scores by subword lattice likelihood.

A text is words (ASCII lower case) and one end. A word, with its word-start mark, can be cut into pieces
of an existing public vocabulary in many ways; its probability is the sum over all of them of the
product of the pieces' unigram probabilities, found by forward recursion in log space. Pieces hold no
inner word start, so the whole text's lattice factors at word starts. A character that no piece holds goes
by its byte pieces. The pieces' scores start from the vocabulary's own order and are fitted to all
training words by expectation-maximisation (forward-backward) until a round gains little; the end is one more symbol.

Every distinct word of the corpus is counted and scored once. The scores of the TOP most frequent words, a table of
bounded size, are sent to the tasks that read the texts; a text's other words go through one join with the word table, as
pairs of hashes. No text is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table, text_of, written

START = "▁"
#: EM stops after the round whose words had gained less in mean log10 probability than this since the round before.
GAIN = 0.02
#: Longer words take the plain recursion; shorter ones go together, all of one length at once, so many that their
#: edges number about EDGES.
SHORT, EDGES = 64, 1 << 18
#: Words of the table that every task gets (24 bytes each), bytes of text worked on at once, and words counted before they are given out.
TOP, BUFFER, COUNTED = 1 << 18, 1 << 19, 1 << 17
#: Words whose lattices are made in one go.
GATHERED = 1 << 15
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_ODD2 = 0xD1342543DE82EF95


class Pieces:
    """A vocabulary and its log probabilities (natural)."""

    def __init__(self, pieces: list[str], bytes_at: list[int], logs: np.ndarray):
        self.pieces, self.bytes_at, self.logs = pieces, np.array(bytes_at), logs
        self.longest = max(len(p) for p in pieces)
        taken = set(bytes_at)
        own = [i for i in range(len(pieces)) if i not in taken]
        self.index = {pieces[i]: i for i in own}
        # a single character's hash is a small number: the product spreads it over all bits
        hashed = np.array([self._hash(pieces[i]) for i in own], np.uint64) * np.uint64(_ODD)
        order = np.argsort(hashed)
        # found by the first bits of their hash; the end is a mark that no hash reaches twice
        self.hashes, self.ids = np.append(hashed[order], np.uint64(0)), np.append(np.array(own)[order], -1)
        self.first = np.searchsorted(hashed[order], np.arange((1 << 18) + 1, dtype=np.uint64)[:-1] << np.uint64(46)).astype(np.int32)
        self.most = int(np.bincount((hashed >> np.uint64(46)).astype(np.int64)).max(initial=0))

    def with_logs(self, logs: np.ndarray) -> Pieces:
        """The same vocabulary with other scores."""
        new = object.__new__(Pieces)
        new.__dict__ = self.__dict__ | {"logs": logs}
        return new

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 where none is."""
        h = h * np.uint64(_ODD)
        at = self.first[(h >> np.uint64(46)).astype(np.int64)]
        last = len(self.hashes) - 1
        out = np.where(self.hashes[at] == h, self.ids[at], -1)
        for k in range(1, self.most):
            more = np.minimum(at + k, last)
            out = np.where(self.hashes[more] == h, self.ids[more], out)
        return out

    @staticmethod
    def _hash(piece: str) -> int:
        return sum((ord(c) + 1) * pow(_ODD, k, 1 << 64) for k, c in enumerate(piece)) % (1 << 64)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """A sentencepiece file's vocabulary; first scores by its order: the earlier, the likelier."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_at = [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_at.append(len(pieces))
            elif model.is_control(i) or model.is_unknown(i) or START in piece[1:]:
                continue
            pieces.append(piece)
        rank = np.arange(len(pieces)) + 10.0
        weight = 1 / rank
        weight[bytes_at] = 1e-6
        return cls(pieces, bytes_at, np.log(weight / weight.sum() * 0.9))


class _Lattice:
    """The lattices of words of one length: for each edge (from character i to j) every word's piece and its log."""

    def __init__(self, words: list[str], own: Pieces):
        self.own, n = own, len(words[0]) + 1
        points = np.frombuffer((START + START.join(words)).encode("utf-32-le"), np.uint32).reshape(len(words), n)
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]))
        back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK, np.uint64)]))
        total = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], axis=1)], axis=1).T.copy()
        self.n, self.i, self.j = n, *np.array([(i, j) for j in range(1, n + 1) for i in range(max(0, j - own.longest), j)]).T
        self.ids = own.find((total[self.j] - total[self.i]) * back[self.i][:, None])
        self.logs = np.where(self.ids >= 0, own.logs[self.ids], -np.inf)
        # single characters without a piece go by their bytes
        self.single = np.flatnonzero(self.j - self.i == 1)
        self.edge, self.word = np.nonzero(self.ids[self.single] < 0)
        self.chars, self.which = np.unique(points[self.word, self.i[self.single][self.edge]], return_inverse=True)
        self.spelled = [own.bytes_at[list(chr(c).encode("utf-8"))] for c in self.chars.tolist()]
        if len(self.chars):
            self.logs[self.single[self.edge], self.word] = np.array([own.logs[b].sum() for b in self.spelled])[self.which]

    def forward(self) -> np.ndarray:
        """Log probability of reaching each character, over all ways."""
        alpha = np.full((self.n + 1, self.logs.shape[1]), -np.inf)
        alpha[0] = 0
        for j in range(1, self.n + 1):
            into = np.flatnonzero(self.j == j)
            alpha[j] = _log_sum(alpha[self.i[into]] + self.logs[into])
        return alpha

    def uses(self, times: np.ndarray, total: np.ndarray) -> float:
        """Adds to total the expected uses of each piece, each word as often as its times; gives the log likelihood."""
        alpha = self.forward()
        beta = np.full_like(alpha, -np.inf)
        beta[self.n] = 0
        for i in range(self.n - 1, -1, -1):
            out = np.flatnonzero(self.i == i)
            beta[i] = _log_sum(self.logs[out] + beta[self.j[out]])
        use = np.exp(alpha[self.i] + self.logs + beta[self.j] - alpha[self.n]) * times
        known = self.ids >= 0
        total += np.bincount(self.ids[known], use[known], len(total))
        spelled = np.bincount(self.which, use[self.single[self.edge], self.word], len(self.chars))
        for b, u in zip(self.spelled, spelled, strict=True):
            np.add.at(total, b, u)
        return float((alpha[self.n] * times).sum())


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over the first axis."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _long_edges(text: str, own: Pieces) -> Iterator[tuple[int, int, list[int], float]]:
    """(i, j, pieces, log) of one long word's edges, by j."""
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - own.longest), j):
            k = own.index.get(text[i:j])
            if k is not None:
                yield i, j, [k], float(own.logs[k])
            elif i == j - 1:
                spelled = own.bytes_at[list(text[i].encode("utf-8"))]
                yield i, j, spelled.tolist(), float(own.logs[spelled].sum())


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _long_forward(text: str, own: Pieces) -> list[float]:
    """The same recursion for one long word, in time and memory linear in its length."""
    alpha = [0.0] + [-math.inf] * len(text)
    for i, j, _, lp in _long_edges(text, own):
        alpha[j] = _logadd(alpha[j], alpha[i] + lp)
    return alpha


def _long_uses(text: str, own: Pieces, times: float, total: np.ndarray) -> float:
    alpha, edges = _long_forward(text, own), list(_long_edges(text, own))
    beta = [-math.inf] * len(text) + [0.0]
    for i, j, pieces, lp in reversed(edges):
        use = math.exp(alpha[i] + lp + beta[j] - alpha[-1]) * times if beta[j] > -math.inf else 0.0
        for k in pieces:
            total[k] += use
        beta[i] = _logadd(beta[i], lp + beta[j])
    return alpha[-1] * times


def _batches(words: list[str], own: Pieces) -> Iterator[list[int]]:
    """Positions of words of one length; none of the long ones."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= SHORT:
            by.setdefault(len(w), []).append(i)
    for n, group in by.items():
        step = max(16, EDGES // ((n + 1) * min(n + 1, own.longest)))
        for s in range(0, len(group), step):
            yield group[s : s + step]


def word_logs(words: list[str], own: Pieces) -> np.ndarray:
    """Natural log probability of each word, over all its segmentations."""
    out = np.empty(len(words))
    for group in _batches(words, own):
        out[group] = _Lattice([words[i] for i in group], own).forward()[-1]
    for i, w in enumerate(words):
        if len(w) > SHORT:
            out[i] = _long_forward(START + w, own)[-1]
    return out


def expected(words: list[str], counts: np.ndarray, own: Pieces) -> tuple[np.ndarray, float]:
    """Expected uses of each piece in the words, each as often as its count, and the words' log likelihood."""
    total, likelihood = np.zeros(len(own.pieces)), 0.0
    weight = np.asarray(counts, float)
    for group in _batches(words, own):
        likelihood += _Lattice([words[i] for i in group], own).uses(weight[group], total)
    for i, w in enumerate(words):
        if len(w) > SHORT:
            likelihood += _long_uses(START + w, own, float(weight[i]), total)
    return total, likelihood


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together, as long as they have GATHERED rows or fewer: words of one length go together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= GATHERED:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def fitted(counts: DataFrame, own: Pieces, ends: int, tokens: int, gain: float = GAIN) -> tuple[Pieces, float]:
    """Scores fitted to the training words (word, c; tokens in all); and the end's log probability. What comes back to
    the driver each round is one number a piece, and the likelihood."""
    spark = counts.sparkSession
    end_log, before = math.log(0.1), -math.inf
    while True:
        shared = spark.sparkContext.broadcast(own)  # the vocabulary: its size doesn't follow the corpus

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros(len(shared.value.pieces)), 0.0
            for batch in gathered(batches):
                uses, own_likelihood = expected(batch.column(0).to_pylist(), batch.column(1).to_numpy(), shared.value)
                total += uses
                likelihood += own_likelihood
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([likelihood, *total[at].tolist()], pa.float64())], names=["piece", "uses"])

        uses, likelihood = np.zeros(len(own.pieces)), 0.0
        for r in counts.where("c > 0").select("word", "c").mapInArrow(step, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            if r["piece"] < 0:
                likelihood = r["uses"] / tokens / math.log(10)
            else:
                uses[r["piece"]] = r["uses"]
        # a little of the first order keeps unseen pieces possible
        weight = uses + 0.01 * max(1.0, uses.sum() / 1e4) * np.exp(own.logs) + 1e-9
        whole = weight.sum() + max(ends, 1)
        own, end_log = own.with_logs(np.log(weight / whole)), math.log(max(ends, 1) / whole)
        if likelihood - before < gain:
            return own, end_log
        before = likelihood


#: Lower case of ASCII letters, and which bytes are white space.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(odd: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, odd, np.uint64)]))


_POWERS = {}


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and two 64-bit hashes of each word of a buffer, in lower case."""
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    gap = np.concatenate([[True], _SPACE[buf], [True]])
    start = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    stop = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    value, hashes = buf.astype(np.uint64) + np.uint64(1), []
    for odd in (_ODD, _ODD2):
        if len(_POWERS.get(odd, ((),))[0]) <= len(buf):
            _POWERS[odd] = (_powers(odd, len(buf)), _powers(pow(odd, -1, 1 << 64), len(buf)))
        up, back = _POWERS[odd]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(buf)])])
        hashes.append((total[stop] - total[start]) * back[start] ^ (stop - start).astype(np.uint64) << np.uint64(44))
    return start, *hashes


def count_words(docs: DataFrame, held_out, text_col: str) -> DataFrame:
    """(word, c): every distinct word and how often it stands in training rows. A task gives out counts of at most
    about COUNTED words at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, every = Counter(), set()

        def out() -> pa.RecordBatch:
            words = [*learned, *(w for w in every if w not in learned)]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in words], pa.string()), pa.array([learned[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (every if held else learned).update(text.as_py().encode("utf-8").lower().split())
                if len(learned) + len(every) > COUNTED:
                    yield out()
                    learned, every = Counter(), set()
        yield out()

    rows = docs.select(held_out.alias("held"), text_of(text_col).alias("text")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def lattice_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", pieces: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    held_out is a Column of docs: true rows take no part in learning. A null text is empty: its only token
    is the end. Repeated rows and null ids are kept and each counts. Extra columns are ignored. An empty table
    gives no row; without training rows all counts are 0 and the pieces keep their first scores. A very long text is read
    whole by one task, some 60 bytes a byte; a very long word takes time in proportion to its length."""
    counts = written(count_words(docs, held_out, text_col), "words")
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    ends = docs.where(~held_out).count()
    n, v = seen["n"] + ends, seen["v"] + (ends > 0)
    own, end_log = Pieces.load(pieces or public_tokenizers.path("piece_bpe_32k.model")), math.log(0.1)
    if seen["n"]:
        own, end_log = fitted(counts, own, ends, seen["n"])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(own)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            words = batch.column(0).to_pylist()
            _, h1, h2 = word_hashes(" ".join(words).encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(1).combine_chunks(), pa.array(word_logs(words, shared.value) / math.log(10))], names=["h1", "h2", "c", "log"])

    lexicon = written(counts.mapInArrow(scored, "h1 long, h2 long, c long, log double"), "lexicon")
    top = lexicon.orderBy(F.desc("c"), "h1", "h2").limit(TOP).toArrow()
    h1, h2, c, logs = (top.column(k).to_numpy() for k in ("h1", "h2", "c", "log"))
    order = np.argsort(h1.view(np.uint64))
    # at most TOP words
    known = spark.sparkContext.broadcast((h1.view(np.uint64)[order], h2.view(np.uint64)[order], c[order], logs[order]))
    base_end, log_end = math.log10((ends + 1) / (n + v + 1)), end_log / math.log(10)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, c, logs = known.value
        base = np.log10((c + 1) / (n + v + 1))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t.encode("utf-8") for t in batch.column(2).to_pylist()]
            for a, b in chunks(texts, [len(t) for t in texts], BUFFER):
                start, w1, w2 = word_hashes(b"\n".join(texts[a:b]))
                ends_at = np.cumsum([len(t) + 1 for t in texts[a:b]])
                doc = np.searchsorted(ends_at, start, side="right")
                at = np.minimum(np.searchsorted(h1, w1), max(len(h1) - 1, 0))
                hit = (h1[at] == w1) & (h2[at] == w2) if len(h1) else np.zeros(len(w1), bool)
                size, d, i = b - a, doc[hit], at[hit]
                rare = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=size))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(rare), pa.array(w[~hit].view(np.int64))) for w in (w1, w2)]
                sums = [np.bincount(doc, minlength=size) + 1, np.bincount(d, c[i] > 0, size).astype(np.int64) + (ends > 0), np.bincount(d, base[i], size) + base_end, np.bincount(d, logs[i], size) + log_end]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + size)), *(batch.column(k)[a:b] for k in (0, 1)), *map(pa.array, sums), *lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "log", "r1", "r2"])
                row += size

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"))
    # the rows' numbers hold once the table is written
    part = written(rows.mapInArrow(read, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, log double, r1 array<long>, r2 array<long>"), "read")
    rare = part.where(F.size("r1") > 0).select("row", F.explode(F.arrays_zip("r1", "r2")).alias("w")).select("row", F.col("w.r1").alias("h1"), F.col("w.r2").alias("h2"))
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    more = (
        rare.join(lexicon.hint("shuffle_merge"), ["h1", "h2"]).groupBy("row")
        .agg(F.count_if(F.col("c") > 0).alias("more_known"), F.sum(base).alias("more_base"), F.sum("log").alias("more_log"))
    )
    out = part.drop("r1", "r2").join(more.hint("shuffle_hash"), "row", "left")
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", F.col("more_known"))("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", F.col("more_base"))("base_score"), plus("log", F.col("more_log"))("score"))


def op6_subword_lattice_likelihood(spark, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return lattice_scores(table(spark, sf_dir, "documents"), held)
