"""Signs of personal data in many texts at once: which rules a text's bytes can't rule out. One pass over the bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of rules by name.
BITS = {n: 1 << i for i, n in enumerate(("phone", "email", "id_card", "bank_card", "url", "ip", "wechat", "qq", "address"))}
#: First bytes of characters among which digits beside 0-9 are.
_DIGITS = (0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, *range(0xF0, 0xF5))
_LONG = BITS["phone"] | BITS["id_card"] | BITS["bank_card"]
DIGIT, OTHER, CJK = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[48:58] = DIGIT
_KIND[list(_DIGITS)] = OTHER
_KIND[0xE4:0xEA] = CJK


def marks(texts: pa.Array) -> pa.Array:
    """The bits of the rules that may match each text; those of the others can't. Null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return pa.array(np.zeros(n, np.int32))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, out = ends[:-1] - ends[0], np.zeros(n, np.int32)
    low = data | 0x20  # A-Z as a-z

    def mark(at: np.ndarray, bits: int) -> None:
        if len(at):
            out[np.unique(np.searchsorted(starts, at, "right") - 1)] |= bits

    def after(at: np.ndarray, step: int, values: np.ndarray, *wanted: int) -> np.ndarray:
        """Those places that have one of the wanted bytes so far on; a place over a text's end may stay."""
        at = at[at + step < len(data)]
        own = values[at + step]
        return at[np.isin(own, wanted)] if len(wanted) > 1 else at[own == wanted[0]]

    kind = _KIND[data]
    mark(np.flatnonzero(kind == OTHER), _LONG | BITS["ip"])
    mark(np.flatnonzero(kind == CJK), BITS["address"])
    mark(np.flatnonzero(data == 64), BITS["email"])
    digit = np.flatnonzero(kind == DIGIT)
    # ten digits with at most one character between two
    mark(digit[:-9][digit[9:] - digit[:-9] <= 18], _LONG)
    dot = np.flatnonzero(data == 46)
    led = dot[(dot + 1 < len(data))]
    led = led[kind[led + 1] == DIGIT]
    for step in (2, 3, 4):
        at = after(led, step, data, 46)
        at = at[at + step + 1 < len(data)]
        mark(at[kind[at + step + 1] == DIGIT], BITS["ip"])
    mark(after(after(np.flatnonzero(data == 58), 1, data, 47), 2, data, 47), BITS["url"])
    mark(after(after(after(np.flatnonzero(low == 119), 1, low, 119), 2, low, 119), 3, data, 46), BITS["url"])
    mark(after(np.flatnonzero(low == 118), 1, data, 88, 120, 0xE4), BITS["wechat"])
    mark(after(after(np.flatnonzero(data == 0xE5), 1, data, 0xBE), 2, data, 0xAE), BITS["wechat"])
    mark(after(np.flatnonzero(low == 113), 1, low, 113), BITS["qq"])
    return pa.array(out)
