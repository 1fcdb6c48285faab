"""Sets of character n-grams of many texts at once, by sorting whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are sorted at once; a longer text is taken alone.
AT_ONCE = 1 << 20
#: Numbers below this are multiplied without overflow.
WIDE = 1 << 62


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most AT_ONCE characters, or one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + AT_ONCE, "right")), start + 1)
        yield start, stop
        start = stop


def _of_slice(texts: pa.Array, sizes: np.ndarray, n: int) -> pa.Array:
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    if len(codes) == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.string()))
    seen = np.zeros(0x110001, bool)
    seen[codes + 1] = True
    seen[0] = True  # stands for no character, where a text is shorter than n
    alphabet = pa.array(["", *(chr(c - 1) for c in np.flatnonzero(seen)[1:])], pa.string())
    ids = (np.cumsum(seen) - 1)[codes + 1]
    ends = np.cumsum(sizes)
    # a gram starts at each character that n - 1 of its own text follow, and at the first one of a shorter text
    left = np.repeat(ends, sizes) - np.arange(len(codes))
    at = np.flatnonzero((left >= n) | ((left == np.repeat(sizes, sizes)) & (left > 0)))
    row = np.repeat(np.arange(len(texts)), sizes)[at]
    base, padded = len(alphabet), np.append(ids, np.zeros(n, ids.dtype))
    gram, bound, digits, prefix = ids[at].astype(np.int64), base, 1, None
    for k in range(1, n):
        if bound * base * len(texts) >= WIDE:  # from here on a number stands for the gram so far
            known, gram = np.unique(gram, return_inverse=True)
            prefix, digits, bound = _spelled(known, digits, prefix, alphabet), 0, len(known)
        gram, bound, digits = gram * base + np.where(left[at] > k, padded[at + k], 0), bound * base, digits + 1
    own = np.sort(row * bound + gram)
    own = own[np.diff(own, prepend=-1) != 0]
    known, gram = np.unique(own % bound, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own // bound, minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _spelled(known, digits, prefix, alphabet).take(pa.array(gram)))


def _spelled(grams: np.ndarray, digits: int, prefix: pa.Array | None, alphabet: pa.Array) -> pa.Array:
    """The texts of numbers of so many digits, each a character; what stands before them is a place in prefix."""
    parts = []
    for _ in range(digits):
        grams, last = np.divmod(grams, len(alphabet))
        parts.append(alphabet.take(pa.array(last)))
    lead = [] if prefix is None else [prefix.take(pa.array(grams))]
    return pc.binary_join_element_wise(*lead, *parts[::-1], "")


def gram_sets(texts: pa.Array, n: int) -> pa.Array:
    """The distinct n-grams of each text, in no order that is promised; a shorter text is its own, an empty one has none, null
    stays null."""
    null = texts.is_null()
    texts = pc.fill_null(texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    made = [_of_slice(texts.slice(a, b - a), sizes[a:b], n) for a, b in _slices(sizes)]
    out = pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))
    return pc.if_else(null, pa.scalar(None, out.type), out) if pc.any(null).as_py() else out
