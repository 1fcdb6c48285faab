"""Large word lists in one pass over a text: a trie with failure links, made once in each Python worker from words that are
sent to it once. Small lists are literals in detect and normalize."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words up to which literals in the plan are used.
FEW = 64
_MADE: dict[str, tuple] = {}


class _Given:
    """Words where no session is active to broadcast them."""

    def __init__(self, value):
        self.value = value


def _sent(value):
    spark = SparkSession.getActiveSession()
    return _Given(value) if spark is None else spark.sparkContext.broadcast(value)


def _machine(key: str, words: Iterable[str]) -> tuple:
    """(automaton whose values are the places of each distinct word, places of the empty word), kept in this worker."""
    import ahocorasick

    if key not in _MADE:
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        empty, machine = places.pop("", []), ahocorasick.Automaton()
        for w, at in places.items():
            machine.add_word(w, at)
        machine.make_automaton()
        if len(_MADE) >= 16:
            _MADE.clear()
        _MADE[key] = (machine if places else None, empty)
    return _MADE[key]


def _places(machine: tuple, text: str) -> set[int]:
    """The places of all words that the text contains."""
    trie, empty = machine
    found = set(empty)
    if trie is not None:
        for at in {id(x): x for _, x in trie.iter(text)}.values():
            found.update(at)
    return found


def found_words(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """For each group of words those that the text contains, in the group's order; null for null text."""
    flat = [w for words in groups for w in words]
    group_of = [k for k, words in enumerate(groups) for _ in words]
    sent, key, n = _sent((flat, group_of)), uuid.uuid4().hex, len(groups)

    @F.arrow_udf("array<array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        words, group = sent.value
        machine, out = _machine(key, words), []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            own = [[] for _ in range(n)]
            for i in sorted(_places(machine, t)):
                own[group[i]].append(words[i])
            out.append(own)
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return scan.asNondeterministic()(text)  # computed once, as a column of its own


def _about(pieces: list[str], put: str, most: int) -> set[str]:
    """The surroundings of each `put` between the pieces, as far as a word of `most` characters over its edge reaches."""
    n, near, run = most - 1, set(), pieces[0][max(len(pieces[0]) - most + 1, 0) :]
    for p in pieces[1:-1]:
        if len(p) > 2 * n:
            near.add(run + put + p[:n])
            run = p[len(p) - n :]
        else:
            run += put + p
    near.add(run + put + pieces[-1][:n])
    return near


def _applied(machine: tuple, pairs, most: int, t: str) -> dict:
    """Only what lies about a replacement is looked through anew: elsewhere no entry comes to stand that wasn't there."""
    ahead, matches, last = list(_places(machine, t)), [], -1
    known = set(ahead)
    heapq.heapify(ahead)
    while ahead:
        at = heapq.heappop(ahead)
        s, to = pairs[at]
        pieces = t.split(s)
        if len(pieces) == 1:  # an earlier entry took it away
            known.discard(at)
            continue
        last = at
        matches.append({"source": s, "target": to, "count": len(pieces) - 1})
        t = to.join(pieces)
        for i in _places(machine, "\n".join(_about(pieces, to, most))):  # a word over a seam is dropped above
            if i > last and i not in known:
                known.add(i)
                heapq.heappush(ahead, i)
    return {"text": t, "matches": matches}


def cascade(text: Column, entries: Sequence[tuple[str, str]], matches: bool = True) -> Column:
    """(text, matches: (source, target, count)), or the text alone: entries applied in order, each to what the ones before made
    of the text. An entry is looked for again only about a replacement; empty sources are no entries. Null text has null text,
    no matches."""
    pairs = [(s, t) for s, t in entries if s]
    sent, key = _sent(pairs), uuid.uuid4().hex
    kind = pa.struct([("text", pa.string()), ("matches", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("count", pa.int32())])))])

    def each(texts: pa.Array) -> list[dict]:
        pairs = sent.value
        machine, most = _machine(key, (s for s, _ in pairs)), max((len(s) for s, _ in pairs), default=1)
        return [{"text": None, "matches": []} if t is None else _applied(machine, pairs, most, t) for t in texts.to_pylist()]

    @F.arrow_udf("struct<text:string,matches:array<struct<source:string,target:string,count:int>>>")
    def replaced(texts: pa.Array) -> pa.Array:
        return pa.array(each(texts), kind)

    @F.arrow_udf("string")
    def replaced_text(texts: pa.Array) -> pa.Array:
        return pa.array([x["text"] for x in each(texts)], pa.string())

    return (replaced if matches else replaced_text).asNondeterministic()(text)
