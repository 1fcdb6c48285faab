"""How many members the sets of an Arrow batch share with each of a few given sets: products of 0-1 matrices in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a matrix.
CELLS = 1 << 23


@dataclass
class Block:
    """Given sets of like sizes: their ids and sizes, the members that they have, and who has which (members x sets)."""

    ids: pa.Array
    sizes: np.ndarray
    members: pa.Array
    has: np.ndarray


def _distinct(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and member number of each distinct member of each row, and the members; null members are none."""
    said = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row, code = np.repeat(np.arange(len(lists)), sizes), pc.fill_null(said.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = max(len(said.dictionary), 1)
    key = np.sort((row * wide + code)[code >= 0])
    key = key[np.diff(key, prepend=-1) != 0]
    return key // wide, key % wide, said.dictionary


def blocks(few: pa.Table) -> list[Block]:
    few = few.combine_chunks()
    size = few["members"].combine_chunks().value_lengths().to_numpy()
    order, out, start = np.argsort(size, kind="stable"), [], 0
    while start < len(order):
        # as many sets as fit, counting each one's members as new ones
        n = np.arange(1, len(order) - start + 1)
        stop = start + max(int(np.searchsorted(np.cumsum(size[order[start:]]) * n, CELLS, "right")), 1)
        own = few.take(pa.array(order[start:stop])).combine_chunks()
        row, code, members = _distinct(own["members"].combine_chunks())
        has = np.zeros((len(members), stop - start), np.float32)
        has[code, row] = 1
        out.append(Block(own["id"].combine_chunks(), size[order[start:stop]].astype(np.int64), members, has))
        start = stop
    return out


def similar(blocks: list[Block], batch: pa.RecordBatch, threshold: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(given id, own id, similarity) of the Jaccard threshold or more; rows are the batch's (id, members)."""
    row, code, members = _distinct(batch.column(1))
    size = np.bincount(row, minlength=len(batch))
    start = np.concatenate([[0], np.cumsum(size)])
    for b in blocks:
        number = pc.fill_null(pc.index_in(members, value_set=b.members), -1).to_numpy(zero_copy_only=False)
        fit = np.flatnonzero((size >= threshold * b.sizes[0] - 1e-6) & (size * threshold <= b.sizes[-1] + 1e-6) & (size > 0))
        step = max(CELLS // len(b.members), 1)
        for at in range(0, len(fit), step):
            own = fit[at : at + step]
            taken = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
            line, known = np.repeat(np.arange(len(own)), size[own]), number[code[taken]]
            has = np.zeros((len(own), len(b.members)), np.float32)
            has[line[known >= 0], known[known >= 0]] = 1
            shared = (has @ b.has).astype(np.float64)  # whole numbers, exact
            likeness = shared / (size[own][:, None] + b.sizes[None, :] - shared)
            i, j = np.nonzero(likeness >= threshold)
            if len(i):
                yield b.ids.take(pa.array(j)), batch.column(0).take(pa.array(own[i])), pa.array(likeness[i, j])
