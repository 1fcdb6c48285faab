"""De-obfuscating normalization of a text column, as Column expressions.

Only NFKC and case folding need Python (one Arrow function each); all other steps are built-ins. Null
stays null in every step.
"""

from __future__ import annotations

import copy
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import FEW, cascade
from .columns import let
from .fixed_values import NO_STEP, NOISE
from .gram_sets import gram_sets


def _kept_apart(udf):
    """Marks a Python function so that the optimizer computes it once, as a column of its own, and never copies it into
    later expressions (where lambdas can't hold it)."""
    return udf.asNondeterministic()


#: (source, target) pairs of a substitution map.
Entries = Sequence[tuple[str, str]]


@_kept_apart
@F.arrow_udf(T.StringType())
def strip_nfkc(texts: pa.Array) -> pa.Array:
    """Unicode-stripped text in compatibility form."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t.strip()) for t in texts.to_pylist()], pa.string())


@_kept_apart
@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@_kept_apart
@F.arrow_udf(T.StringType())
def casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


@_kept_apart
@F.arrow_udf(T.StringType())
def nfkc_casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts.to_pylist()], pa.string())


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", "")


def norm_unicode(text: Column) -> Column:
    """Strip, NFKC, then no control or format characters."""
    return drop_controls(strip_nfkc(text))


def norm_case(text: Column, protected: str = "C++") -> Column:
    """Lower case but for the protected token."""
    parts = lambda t: F.array_join(F.transform(F.split(t, re.sub(r"([^\w])", r"\\\1", protected), -1), F.lower), protected)
    return let(text, lambda t: F.when(F.contains(t, F.lit(protected)), parts(t)).otherwise(F.lower(t)))


def ordered(entries: Entries) -> list[tuple[str, str]]:
    """Longest source first; equal lengths stay in order."""
    return sorted(entries, key=lambda e: -len(e[0]))


def _literal(entries: Entries) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in ordered(entries)])


def norm_map(text: Column, entries: Entries) -> Column:
    """Literal replacement, entry after entry, so that results cascade."""
    if not entries:
        return text
    if len(entries) > FEW:
        return cascade(text, ordered(entries), matches=False)
    return F.aggregate(_literal(entries), text, lambda acc, e: F.replace(acc, e["s"], e["t"]))


def token_pattern(source: str) -> str:
    """An ASCII source with a letter or digit stands alone among ASCII letters and digits."""
    quoted = r"\Q" + source.replace(r"\E", r"\E\\E\Q") + r"\E"
    whole = source.isascii() and any(c.isalnum() for c in source)
    # what stands before is looked at where the source stands, not at each character
    return f"{quoted}(?<![a-zA-Z0-9]{quoted})(?![a-zA-Z0-9])" if whole else quoted


def _quoted_target(target: str) -> str:
    return target.replace("\\", "\\\\").replace("$", "\\$")


def norm_token_map(text: Column, entries: Entries) -> Column:
    """Like N3 with whole tokens; literal patterns, so each is compiled once."""
    one = lambda e: lambda t: F.when(F.contains(t, F.lit(e[0])), F.regexp_replace(t, token_pattern(e[0]), _quoted_target(e[1]))).otherwise(t)
    return reduce(lambda t, e: let(t, one(e)), ordered(entries), text)


_MAIL_CHARS = "A-Za-z0-9._%+-"
_NOISE_SET = "[" + re.sub(r"([\\^\-\]\[&])", r"\\\1", NOISE) + "]"
_TEXT_CHAR = r"[\p{L}\p{N}]"
_CJK = r"[一-鿿]"
#: The @ stands first in a class, as +-@ would be a range that holds , / : ; < = > ? as well.
_MAIL = rf"(?<![@{_MAIL_CHARS}])[{_MAIL_CHARS}]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?![@{_MAIL_CHARS}])"
#: The character itself stands first, so that its neighbours are looked at only where one is.
_DROPPED_NOISE = rf"{_NOISE_SET}(?<={_TEXT_CHAR}{_NOISE_SET})(?={_TEXT_CHAR})"
_DROPPED = rf"{_DROPPED_NOISE}|(?U:\s)(?<={_CJK}(?U:\s))(?={_CJK})"


def norm_noise(text: Column) -> Column:
    """No noise between two letters or digits (e-mail addresses stay), no blank between two CJK
    characters; neighbours are those of the text as it came. Texts without CJK characters or without an @ need only part of that."""

    def plain(t: Column) -> Column:
        addressed = F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, f"({_MAIL})|{_DROPPED_NOISE}", "$1"))
        return F.when(t.rlike(_DROPPED_NOISE), addressed.otherwise(F.regexp_replace(t, _DROPPED_NOISE, ""))).otherwise(t)

    return let(text, lambda t: F.when(t.rlike(_CJK), F.when(t.rlike(_DROPPED), F.regexp_replace(t, f"({_MAIL})|{_DROPPED}", "$1")).otherwise(t)).otherwise(plain(t)))


def norm_repeat(text: Column, most: int = 2) -> Column:
    """Runs of one character are cut to `most`."""
    longer = r"\1" * most + "+" if most > 0 else r"\1*"  # written out, as a count of references is looked at far more slowly
    return F.regexp_replace(text, f"(?s)(.){longer}", "$1" * most)


Step = Callable[[Column], Column]


def user_function(change: Callable[[str], str]) -> Step:
    """A step of a Python function on one text, run on Arrow batches. Null stays null; the function isn't called for it."""

    @F.arrow_udf(T.StringType())
    def changed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else change(t) for t in texts.to_pylist()], pa.string())

    return _kept_apart(changed)


class Maps:
    """What normalization works with: the substitution maps of a rule pack, each a sequence of (source, target); steps of the
    user's own, and the names of steps that are switched off."""

    def __init__(self, emoji: Entries = (), symbol: Entries = (), variant: Entries = (), homophone: Entries = (), pinyin: Entries = (), abbreviation: Entries = ()):
        self.emoji, self.symbol, self.variant = tuple(emoji), tuple(symbol), tuple(variant)
        self.homophone, self.pinyin, self.abbreviation = tuple(homophone), tuple(pinyin), tuple(abbreviation)
        self.own: tuple[tuple[str, Step, str | None], ...] = ()
        self.off: frozenset[str] = frozenset()

    def with_step(self, name: str, step: Step, before: str | None = None) -> Maps:
        """A copy with one more step, a function of a Column (user_function makes one of a Python function), before the first
        step of that name, else last. Steps for one place keep the order in which they were added."""
        names = [n for n, _ in steps(self, every=True)]
        if name in names or (before is not None and before not in names):
            raise ValueError(f"step {name}: the name is taken" if name in names else f"there is no step {before}")
        out = copy.copy(self)
        out.own = (*self.own, (name, step, before))
        return out

    def without(self, *names: str) -> Maps:
        """A copy with these steps switched off, wherever they stand."""
        absent = set(names) - {n for n, _ in steps(self, every=True)}
        if absent:
            raise ValueError(f"there are no steps {sorted(absent)}")
        out = copy.copy(self)
        out.off = self.off | set(names)
        return out


def steps(maps: Maps, every: bool = False) -> list[tuple[str, Step]]:
    """The named steps in their order, each a function of a Column; those switched off only with `every`."""
    made = [
        ("unicode", norm_unicode),
        ("case", norm_case),
        ("emoji", lambda t: norm_map(t, maps.emoji)),
        ("symbol_insertion", lambda t: norm_map(t, maps.symbol)),
        ("noise_char", norm_noise),
        ("repeat_char", norm_repeat),
        ("variant_char", lambda t: norm_map(t, maps.variant)),
        ("homophone", lambda t: norm_map(t, maps.homophone)),
        ("pinyin", lambda t: norm_token_map(t, maps.pinyin)),
        ("abbreviation", lambda t: norm_token_map(t, maps.abbreviation)),
        ("noise_char", norm_noise),
    ]
    for name, step, before in maps.own:
        at = next((i for i, (n, _) in enumerate(made) if n == before), len(made))
        made.insert(at, (name, step))
    return [(n, f) for n, f in made if every or n not in maps.off]


def normalize(text: Column, maps: Maps) -> Column:
    """All steps, composed."""
    return reduce(lambda t, s: s[1](t), steps(maps), text)


def normalize_with_trace(df, text_col: str, maps: Maps, out: str = "normalized", trace: str = "steps"):
    """Adds the normalized text and the array of changed steps (normalizer, before, after)."""
    at, names = F.col(text_col), []
    for i, (name, step) in enumerate(steps(maps)):
        df = df.withColumn(f"_n{i}", step(at))
        names.append((name, f"_n{i}"))
        at = F.col(f"_n{i}")
    before = text_col
    parts = []
    for name, col in names:
        parts.append(F.struct(F.lit(name).alias("normalizer"), F.col(before).alias("before"), F.col(col).alias("after")))
        before = col
    df = df.withColumn(trace, F.filter(F.array(*parts), lambda s: s["before"] != s["after"])).withColumn(out, F.col(before))
    return df.drop(*[c for _, c in names])


def map_match_counts(text: Column, entries: Entries) -> Column:
    """(source, target, count) of entries that fired, counted at their place in the cascade."""
    if len(entries) > FEW:
        return cascade(text, ordered(entries))["matches"]
    start = F.struct(text.alias("text"), F.array().cast("array<struct<source:string,target:string,count:int>>").alias("matches"))

    def step(acc: Column, e: Column) -> Column:
        count = ((F.length(acc["text"]) - F.length(F.replace(acc["text"], e["s"], F.lit("")))) / F.length(e["s"])).cast("int")
        hit = F.array(F.struct(e["s"].alias("source"), e["t"].alias("target"), count.alias("count")))
        return F.struct(F.replace(acc["text"], e["s"], e["t"]).alias("text"), F.when(count > 0, F.concat(acc["matches"], hit)).otherwise(acc["matches"]).alias("matches"))

    return F.aggregate(_literal(entries), start, step, lambda acc: acc["matches"])


def noise_removed(text: Column) -> Column:
    """(char, index) of each character that N5 drops: the pieces between them give their places."""
    marked = F.regexp_replace(text, f"({_MAIL})|({_DROPPED})", "$1\x00$2\x00")
    # pieces alternate kept text and dropped character; an address leaves an empty dropped one
    pieces = F.transform(F.split(marked, "\x00", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char:string,index:int>>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        hit = F.array(F.struct(p["x"].alias("char"), acc["at"].alias("index")))
        found = F.when((p["i"] % 2 == 1) & (F.length(p["x"]) > 0), F.concat(acc["found"], hit)).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(p["x"])).alias("at"), found.alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def text_variants(text: Column) -> Column:
    """Exact, trimmed, casefolded, nfkc (folded) forms."""
    trimmed = trim(text)
    return F.struct(text.alias("exact"), trimmed.alias("trimmed"), casefold(trimmed).alias("casefolded"), nfkc_casefold(trimmed).alias("nfkc"))


def equivalence_keys(text: Column, maps: Maps) -> Column:
    """Exact, nfkc (no strip, no folding) and normalized forms."""
    return F.struct(text.alias("exact"), nfkc(text).alias("nfkc"), normalize(text, maps).alias("text_normalizer"))


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def folded_dense(text: Column) -> Column:
    """NFKC, folded, all white space dropped."""
    return F.regexp_replace(nfkc_casefold(text), r"(?U)\s+", "")


def char_ngrams(dense: Column, n: int = 3) -> Column:
    """The set of n-grams of a dense text; a shorter one is its own; an empty one has none. Null stays null."""

    @F.arrow_udf("array<string>")
    def sets(texts: pa.Array) -> pa.Array:
        return gram_sets(texts, n)

    return _kept_apart(sets)(dense)


def baseline_lower(text: Column) -> Column:
    """N14."""
    return F.lower(text)


def trace_lines(trace: Column, none: str = NO_STEP) -> Column:
    """`name: before -> after` of each changed step, or one fixed line."""
    lines = F.transform(trace, lambda s: F.concat(s["normalizer"], F.lit(": "), s["before"], F.lit(" -> "), s["after"]))
    return F.when(F.size(trace) > 0, lines).otherwise(F.array(F.lit(none)))
