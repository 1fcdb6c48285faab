"""Packing token ids into fixed windows by multiway differencing.

Documents are dealt evenly to tasks, whatever their ids. A task reads its documents one after another, tokenizes
each and gives its whole windows at once; what is left is cut into slices of at most SLICE ids. As soon as a
group of slices has GROUP_IDS ids or GROUP_SLICES slices it is packed and given out, so a task holds one group, not
its partition. Karmarkar-Karp differencing merges the slices' partial partitions, the largest imbalance first,
largest window against smallest, into near-equal windows. Whenever a window exceeds the capacity, the
window count rises by one and the differencing starts anew. Windows are padded to the capacity,
unless their length is a power of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import portions, table, text_of

CAPACITY = 4096
#: Slices are small against the capacity, so that near-equal windows exist close to it.
SLICE = 512
#: A group: some 240 windows, or as many slices where documents are tiny.
GROUP_IDS, GROUP_SLICES = 1_000_000, 8192
#: Characters per task, a document counting as ROW_CHARS more.
PART_CHARS, ROW_CHARS = 16_000_000, 64


def differencing(sizes: Iterable[int], ways: int) -> list[list[int]]:
    """The items (by position) of each of `ways` windows of near-equal sums.

    A state is a partition's window sums, least taken off, in descending order, with the items of each
    window; windows without items, all of sum 0, aren't stored. The two states of the largest spread are merged, largest
    window with smallest. Ties go by the item that came first. Items of one window form a tree, so a
    merge costs the two states' windows, and all states together hold at most as many windows as there are items."""
    sizes = list(sizes)
    if not sizes:
        return [[] for _ in range(ways)]
    # a node of the forest: (item, left, right); windows refer to nodes
    item, left, right = list(range(len(sizes))), [-1] * len(sizes), [-1] * len(sizes)
    heap: list[tuple] = [(-s, i, None, None) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        top, i, a, na = heapq.heappop(heap)
        other, j, b, nb = heapq.heappop(heap)
        a, na = (np.array([-top]), np.array([i])) if a is None else (a, na)
        b, nb = (np.array([-other]), np.array([j])) if b is None else (b, nb)
        both = max(0, len(a) + len(b) - ways)  # windows of a that meet one of b
        b, nb = b[::-1], nb[::-1]
        sums = np.concatenate([a[: len(a) - both], a[len(a) - both :] + b[:both], b[both:]])
        nodes = np.concatenate([na, nb[both:]])
        for k, w in enumerate(range(len(a) - both, len(a))):
            item.append(-1), left.append(int(na[w])), right.append(int(nb[k]))
            nodes[w] = len(item) - 1
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == ways:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), min(i, j), sums, nodes))
    roots = [0] if heap[0][3] is None else heap[0][3]
    windows = []
    for root in roots:
        found, stack = [], [int(root)]
        while stack:
            n = stack.pop()
            if item[n] >= 0:
                found.append(item[n])
            else:
                stack += [right[n], left[n]]
        windows.append(found)
    return windows + [[] for _ in range(ways - len(windows))]


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows within the capacity: the count starts at the least possible one."""
    if max(sizes, default=0) > capacity:
        raise ValueError("a slice is larger than the capacity")
    ways = -(-sum(sizes) // capacity)
    while ways:
        found = differencing(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return [w for w in found if w]
        ways += 1
    return []


def pack_slices(slices: list[tuple[int, int, int]], capacity: int = CAPACITY) -> Iterator[list[tuple[int, int, int]]]:
    """(document, start, length) of the pieces of each window; neighbouring slices in one window are one piece."""
    for w in windows_of([n for _, _, n in slices], capacity):
        pieces: list[list[int]] = []
        for d, s, n in (slices[i] for i in sorted(w)):
            if pieces and pieces[-1][0] == d and pieces[-1][1] + pieces[-1][2] == s:
                pieces[-1][2] += n
            else:
                pieces.append([d, s, n])
        yield [(d, s, n) for d, s, n in pieces]


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")


class _Packer:
    """Packs the documents of one task; rows gather until they are taken."""

    def __init__(self, task: int, capacity: int, with_ids: bool):
        self.capacity, self.with_ids, self.next = capacity, with_ids, task << 32
        self.rows: list[list] = [[] for _ in COLUMNS]
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # of the open group: doc_id, count, first id kept, ids from there
        self.slices: list[tuple[int, int, int]] = []
        self.held = 0

    def window(self, pieces: list[tuple]) -> None:
        """One sequence of (doc_id, doc_tokens, start, ids) pieces."""
        used, offset = sum(len(p[3]) // 4 for p in pieces), 0
        padding = 0 if used & (used - 1) == 0 else self.capacity - used
        for doc_id, count, start, part in pieces:
            for column, x in zip(self.rows, (doc_id, start, len(part) // 4, zlib.crc32(part), count, self.next, offset, padding), strict=True):
                column.append(x)
            if self.with_ids:
                self.ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            offset += len(part) // 4
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.window([(doc_id, n, start, ids[4 * start : 4 * (start + self.capacity)])])
        if whole < n:
            self.slices += [(len(self.docs), s, min(SLICE, n - s, self.capacity)) for s in range(whole, n, min(SLICE, self.capacity))]
            self.docs.append((doc_id, n, whole, ids[4 * whole :]))
            self.held += n - whole
        if self.held >= GROUP_IDS or len(self.slices) >= GROUP_SLICES:
            self.close()

    def close(self) -> None:
        """Packs the open group."""
        for pieces in pack_slices(self.slices, self.capacity):
            self.window([(self.docs[d][0], self.docs[d][1], s, self.docs[d][3][4 * (s - self.docs[d][2]) : 4 * (s - self.docs[d][2] + n)]) for d, s, n in pieces])
        self.docs, self.slices, self.held = [], [], 0

    def take(self) -> pa.RecordBatch:
        """The rows made so far."""
        columns = [pa.array(c, pa.int64()) for c in self.rows]
        if self.with_ids:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *self.ids]))))
        self.rows, self.ids = [[] for _ in COLUMNS], []
        return pa.RecordBatch.from_arrays(columns, names=[*COLUMNS, "ids"][: len(columns)])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = tokens.END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding
    (of the piece's sequence) and, if asked for, ids.

    A null text is empty: its document is the end id alone. Equal rows are packed one by one, spread over all
    tasks; a null doc_id is kept. An empty table gives no row. Extra columns are ignored. A text is
    tokenized whole by one task, which holds its ids (4 bytes a token) beside one group. Sequence ids are unique,
    not consecutive; they follow the order of (doc_id, a hash of the text) within a task, so a retried task gives them again."""
    path = tokenizer or tokens.default_path()
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    parts = portions(docs, F.length(text_of(text_col)) + ROW_CHARS, PART_CHARS)
    # dealt in turn, not by a key: a third of all rows may be equal
    dealt = own.repartition(parts).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.WordEncoder.of(path), _Packer(TaskContext.get().partitionId(), capacity, with_ids)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, encoder.encode(text.as_py(), end_id))
                if len(packer.rows[0]) >= 4096:
                    yield packer.take()
        packer.close()
        if packer.rows[0]:
            yield packer.take()

    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", ids array<long>" * with_ids
    return dealt.mapInArrow(packed, schema)


def op7_karmarkar_karp_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
