"""Detections of a text column: lexicons, regular expressions, phrases, personal data and class probabilities.

A detection is a struct (category, level, score, reason, source, matches); a row carries an array of them.
Rule packs are arguments. Null text has no detections.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from . import fixed_values as V
from .automaton import FEW, found_words
from .columns import let
from .marks import BITS, marks

DETECTION = "struct<category:string,level:string,score:int,reason:string,source:string,matches:array<string>>"
DETECTIONS = f"array<{DETECTION}>"
#: category -> words, and (category, pattern, level, score, reason) rules.
Lexicons = Mapping[str, Sequence[str]]
Rules = Sequence[tuple[str, str, str, int, str]]


#: A detector of the user's own: text -> array of detections.
Detector = Callable[[Column], Column]


class Pack:
    """A rule pack: lexicons by category (kept in ascending order of category), regex rules, maps, and detectors of the user's own
    by name, which come after the rules in their order; `off` names those that are switched off (keyword and regex too)."""

    def __init__(self, lexicons: Lexicons, rules: Rules, maps=None, detectors: Mapping[str, Detector] | None = None, off: Sequence[str] = ()):
        from .normalize import Maps

        self.lexicons = {c: tuple(lexicons[c]) for c in sorted(lexicons)}
        self.rules, self.maps, self.detectors, self.off = tuple(rules), maps or Maps(), dict(detectors or {}), frozenset(off)
        absent = self.off - {"keyword", "regex", *self.detectors}
        if absent or {"keyword", "regex"} & self.detectors.keys():
            raise ValueError(f"there are no detectors {sorted(absent)}" if absent else "keyword and regex are the pack's own detectors")


def user_detector(find: Callable[[str], list[dict]]) -> Detector:
    """A detector of a Python function from one text to detections, dicts of category, level, score, reason, source and
    matches (absent: null), run on Arrow batches. Null text has none; the function isn't called for it."""
    names = ("category", "level", "score", "reason", "source", "matches")
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
    kind = pa.list_(pa.struct(list(zip(names, kinds, strict=True))))

    @F.arrow_udf(DETECTIONS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[] if t is None else [{n: d.get(n) for n in names} for d in find(t)] for t in texts.to_pylist()], kind)

    return found.asNondeterministic()


def detection(category, level, score, reason, source, matches: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(category).alias("category"), lit(level).alias("level"), lit(score).cast("int").alias("score"), lit(reason).alias("reason"), lit(source).alias("source"), matches.alias("matches"))


def no_detections() -> Column:
    return F.array().cast(DETECTIONS)


def _kept(found: list[Column]) -> Column:
    """Of candidate detections those with a match."""
    if not found:
        return no_detections()
    return F.coalesce(F.filter(F.array(*found), lambda d: F.size(d["matches"]) > 0), no_detections())


def contained(text: Column, words: Sequence[str]) -> Column:
    """The words that the text contains, in their order."""
    if not words:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def each_contained(text: Column, groups: Sequence[Sequence[str]], body: Callable[[list[Column]], Column]) -> Column:
    """body of a column a group: the words of the group that the text contains. Few words are literals, more go through one
    automaton."""
    if sum(map(len, groups)) <= FEW:
        return let(text, lambda t: body([contained(t, words) for words in groups]))
    return let(found_words(text, groups), lambda found: body([F.get(found, F.lit(i)) for i in range(len(groups))]))


def detect_keywords(text: Column, lexicons: Lexicons) -> Column:
    """D1."""
    made = lambda c, found: detection(c, "high" if c in ("porn", "violence") else "medium", 80 if c in ("porn", "violence") else 55, f"matched {c} keyword lexicon", "keyword", found)
    return each_contained(text, list(lexicons.values()), lambda found: _kept([made(c, f) for c, f in zip(lexicons, found, strict=True)]))


def needed_mark(pattern: str) -> str | None:
    """An ASCII mark that every match of the pattern holds, as it stands outside classes and groups and isn't optional; None if
    none is seen or the pattern has rare syntax. Marks have no other case, so flags for case don't matter."""
    depth = classes = at = 0
    found = None
    if "[]" in pattern or "[^]" in pattern or re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None
    while at < len(pattern):
        c, after = pattern[at], pattern[at + 1 : at + 2]
        if c == "\\":
            if after in ("Q", "E", "c", ""):  # quoted text, control characters
                return None
            at += 2
            continue
        if c == "[":
            classes += 1
        elif c == "]":
            classes -= classes > 0
        elif not classes:
            depth += (c in "({") - (c in ")}")
            if c == "|" and depth == 0:
                return None
            if depth == 0 and c in "@%&=~;:,!<>/" and (not after or after not in "?*{"):
                found = found or c
        at += 1
    return found


#: Signs of patterns in common use.
_PATTERN_SIGNS = {p.removeprefix("(?U)"): r"(?U)\.\d{1,3}\.\d" for n, p, _ in V.PRIVACY if n == "ip"}
#: Letters that have one other form only, so that two classes of characters tell them in either case.
_PLAIN = "abcdefghjlmnopqrtuvwxyz"


def needed_start(pattern: str) -> str | None:
    """A pattern, cheap to look for, of the three or more plain letters and blanks that each match starts with; None if it doesn't."""
    head = re.match(rf"(?:\\b)?([{_PLAIN} ]+)(?![?*{{|])", pattern)
    if not head or len(head[1]) < 3 or "|" in pattern or re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None
    return "".join(c if c == " " else f"[{c}{c.upper()}]" for c in head[1])


def _matches(text: Column, pattern: str) -> Column:
    """The distinct matches, letters in either case; texts without the mark or start that a match needs aren't looked through."""
    made = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0)))
    mark, sign = needed_mark(pattern), _PATTERN_SIGNS.get(pattern) or needed_start(pattern)
    seen = F.contains(text, F.lit(mark)) if mark else text.rlike(sign) if sign else None
    return made if seen is None else F.when(seen, made).otherwise(F.array().cast("array<string>"))


def detect_regex(text: Column, rules: Rules) -> Column:
    """Distinct matches in the order seen, letters in either case; what a rule leaves out has a default."""
    return _kept([
        detection(category or "unknown", level or "medium", 60 if score is None else score, reason or V.REGEX_REASON, "regex", _matches(text, pattern))
        for category, pattern, level, score, reason in rules
    ])


def detect_rules(text: Column, pack: Pack) -> Column:
    """D3, and the detectors of the user's own."""
    made = {"keyword": lambda t: detect_keywords(t, pack.lexicons), "regex": lambda t: detect_regex(t, pack.rules), **pack.detectors}
    parts = [find(text) for name, find in made.items() if name not in pack.off]
    return F.concat(*parts) if parts else no_detections()


def detect_high_risk(text: Column, phrases: Mapping[str, Sequence[str]] = V.HIGH_RISK) -> Column:
    """Phrases in the text without white space, lower case."""
    dense = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    first = {w[0] for words in phrases.values() for w in words if w}
    if first and all(c.isalpha() and c.lower() == c == c.upper() for c in first):  # no white space, and no other character becomes one
        sign = f"[\\x{{{ord(min(first)):x}}}-\\x{{{ord(max(first)):x}}}]"
        dense = F.when(~text.rlike(sign), "").otherwise(dense)

    lower = [[w.lower() for w in words] for words in phrases.values()]

    def shown(words: Sequence[str], low: Sequence[str], found: Column) -> Column:
        """The phrases as they are given, of those found in lower case."""
        if list(words) == list(low):
            return found
        table = F.create_map(*[F.lit(x) for pair in zip(low, words, strict=True) for x in pair])
        return F.transform(found, lambda w: table[w])

    made = lambda c, words, low, found: detection(c, "high", 90, "matched output high-risk phrase", "output_high_risk", shown(words, low, found))
    return each_contained(dense, lower, lambda found: _kept([made(*x) for x in zip(phrases, phrases.values(), lower, found, strict=True)]))


#: Cheap tests, one of which a text must pass for the rule of that name and pattern to match: most texts go no further.
_SIGNS = {
    "phone": lambda t: t.rlike(r"(?U)1[3-9]\d{9}"),
    "email": lambda t: F.contains(t, F.lit("@")),
    "id_card": lambda t: t.rlike(r"(?U)\d{17}[\dXx]"),
    "bank_card": lambda t: t.rlike(r"(?U)\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"),
    "url": lambda t: F.contains(t, F.lit("://")) | t.rlike(r"[wW]{3}\."),
    "ip": lambda t: t.rlike(r"(?U)\.\d{1,3}\.\d"),
    "wechat": lambda t: F.contains(t, F.lit("微信")) | t.rlike("[Vv][Xx信]"),
    "qq": lambda t: t.rlike("[Qq][Qq]"),
    "address": lambda t: t.rlike("[一-鿿]") & t.rlike("[省市县区路街巷]|自治"),
}
_SIGN_OF = {(n, p): _SIGNS[n] for n, p, _ in V.PRIVACY}


def _masked(text: Column, name: str, pattern: str, mask: str, seen: Column | None = None) -> Column:
    """A rule's matches in text, a column that costs nothing to read twice, replaced; a literal pattern is compiled once a task.
    seen: the marks of the text as it came."""
    made = F.regexp_replace(text, F.lit(pattern), F.lit(mask))
    sign = _SIGN_OF.get((name, pattern))
    if sign and seen is not None:
        return F.when(seen.bitwiseAND(F.lit(BITS[name])) == 0, text).when(sign(text), made).otherwise(text)
    return F.when(sign(text), made).otherwise(text) if sign else made


@F.arrow_udf(IntegerType())
def _marks(texts: pa.Array) -> pa.Array:
    return marks(texts)


def _with_marks(text: Column, rules: Sequence[tuple[str, str, str]], body: Callable[[Column | None], Column]) -> Column:
    """body of the text's marks, with the rules whose masks bring no mark into a text; other rules have none."""
    return let(_marks.asNondeterministic()(text), body) if tuple(rules) == V.PRIVACY else body(None)


def privacy(text: Column, rules: Sequence[tuple[str, str, str]] = V.PRIVACY) -> Column:
    """(masked, names): each rule's matches replaced by its mask, later rules see earlier masks; and the names of
    the rules that changed the running text. One pass a rule; make it a column before taking both parts."""

    def step(i: int, at: Column, names: list[Column], seen: Column | None) -> Column:
        if i == len(rules):
            return F.struct(at.alias("masked"), F.array_compact(F.array(F.lit(None).cast("string"), *names)).alias("names"))
        name, pattern, mask = rules[i]
        return let(_masked(at, name, pattern, mask, seen), lambda new: step(i + 1, new, [*names, F.when(new != at, F.lit(name))], seen))

    return _with_marks(text, rules, lambda seen: step(0, text, [], seen))


def masked_privacy(text: Column, rules: Sequence[tuple[str, str, str]] = V.PRIVACY) -> Column:
    """The masked text alone."""
    return _with_marks(text, rules, lambda seen: reduce(lambda t, r: let(t, lambda t: _masked(t, *r, seen)), rules, text))


def privacy_names(text: Column, rules: Sequence[tuple[str, str, str]] = V.PRIVACY) -> Column:
    """The names alone."""
    return privacy(text, rules)["names"]


def detect_privacy(names: Column) -> Column:
    """From the names that D5 found."""
    return _kept([detection("privacy", "low", 45, "output contains personal sensitive information", "output_privacy_regex", names)])


def top_class(probs: Column) -> Column:
    """The first (label, p) of the largest p; null for none."""
    start = F.lit(None).cast("struct<label:string,p:double>")
    return F.aggregate(probs, start, lambda acc, x: F.when(acc.isNull() | (x["p"] > acc["p"]), F.struct(x["label"].alias("label"), x["p"].alias("p"))).otherwise(acc))


def semantic_gate(probs: Column, thresholds: Mapping[str, float] = V.GATE_THRESHOLDS, min_margin: float = V.GATE_MARGIN) -> Column:
    """(label, p, normal_p) of a class that passes its threshold and margin, else null. probs: array of (label, p)."""
    top = top_class(probs)
    normal = F.coalesce(F.get(F.filter(probs, lambda x: x["label"] == "normal"), F.lit(0))["p"], F.lit(0.0))
    table = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    least = table[top["label"]]
    passes = (top["label"] != "normal") & least.isNotNull() & (top["p"] >= least) & (top["p"] - normal >= min_margin)
    return F.when(passes, F.struct(top["label"].alias("label"), top["p"].alias("p"), normal.alias("normal_p")))


def semantic_detection(gate: Column) -> Column:
    """The detection of a passed gate, as an array of one or none."""
    p, label = gate["p"], gate["label"]
    base = F.when(label.isin("porn", "violence"), 85).when(label.isin("ad", "sensitive"), 70).when(label == "normal", 10).otherwise(50)
    score = F.when(p > 0.85, F.least(base + 10, F.lit(100))).when(p < 0.6, F.greatest(base - 10, F.lit(0))).otherwise(base).cast("int")
    shown = F.coalesce(F.create_map(*[F.lit(x) for kv in V.CATEGORY_LABELS.items() for x in kv])[label], label)
    reason = F.format_string("语义分类器判定为 %s，置信度 %.2f%%，相对normal差值 %.2f%%", shown, p * 100, (p - gate["normal_p"]) * 100)
    made = detection(label, F.when(score >= 80, "high").otherwise("medium"), score, reason, "semantic_ml", F.array(F.format_string("%s: %.2f%%", label, p * 100)))
    return F.when(gate.isNotNull(), F.array(made)).otherwise(no_detections())


def dedup_detections(found: Column) -> Column:
    """The first per (category, source, matches)."""
    same = lambda a, b: (a["category"] == b["category"]) & (a["source"] == b["source"]) & (a["matches"] == b["matches"])
    return F.aggregate(found, no_detections(), lambda acc, d: F.when(F.exists(acc, lambda x: same(x, d)), acc).otherwise(F.concat(acc, F.array(d))))


def explode_hits(df: DataFrame, found_col: str = "detections") -> DataFrame:
    """One row per match with category, level, score, reason, source and match; other columns stay."""
    keep = [c for c in df.columns if c != found_col]
    one = df.select(*keep, F.explode(found_col).alias("_d"))
    return one.select(*keep, *(F.col(f"_d.{c}").alias(c) for c in ("category", "level", "score", "reason", "source")), F.explode("_d.matches").alias("match"))


def primary_detection(found: Column) -> Column:
    """The first of the largest score; none is normal with score 0."""
    start = F.struct(F.lit("normal").alias("category"), F.lit(-1).alias("score"), F.lit("none").alias("source"))
    top = F.aggregate(found, start, lambda acc, d: F.when(d["score"] > acc["score"], F.struct(d["category"].alias("category"), d["score"].alias("score"), d["source"].alias("source"))).otherwise(acc))
    return F.struct(top["category"].alias("category"), F.greatest(top["score"], F.lit(0)).alias("score"), top["source"].alias("source"))


def validate_requests(df: DataFrame, text_col: str = "message", reply_col: str | None = "raw_reply", most: int = 4096) -> DataFrame:
    """Adds error: invalid_request (null or blank text, blank reply that is given), text_too_long, or null."""
    blank = lambda c: F.regexp_replace(F.col(c), r"(?U)\s+", "") == ""
    bad = F.col(text_col).isNull() | blank(text_col)
    long = F.length(text_col) > most
    if reply_col:
        bad, long = bad | F.coalesce(blank(reply_col), F.lit(False)), long | F.coalesce(F.length(reply_col) > most, F.lit(False))
    return df.withColumn("error", F.when(bad, "invalid_request").when(long, "text_too_long"))


def secret_lines(df: DataFrame, id_col: str, text_col: str, rules: Sequence[tuple[str, str]] = V.SECRET_RULES, most: int = 5 * 1024 * 1024) -> DataFrame:
    """(rule, id, line) of each line that a rule matches, never the value; a text of over `most` bytes is
    reported once as large_file with line 0."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r\n|\r|\n", -1)).alias("pos", "line"))
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in rules]))
    found = lines.select("id", (F.col("pos") + 1).cast("long").alias("line"), F.explode(hit).alias("rule"))
    large = df.where(F.octet_length(text_col) > most).select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("line"), F.lit("large_file").alias("rule"))
    return found.unionByName(large)


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: Column) -> Column:
    """The name of the first rule any of whose words the text contains."""
    out = None
    for name, words in rules:
        out = F.when(_any(text, words), name) if out is None else out.when(_any(text, words), name)
    return out.otherwise(otherwise)


def scenario_of(text: Column, label: Column, rules=V.SCENARIOS) -> Column:
    """D14."""
    return F.when(label != "normal", "direct").otherwise(first_rule(text, rules, F.lit("contextual")))


def resolve_label(text: Column, label: Column, rules=V.LABEL_RULES) -> Column:
    """D15."""
    return first_rule(text, rules, label)


def valid_variant_entry(variant: Column, target: Column, kind: Column, rationale: Column) -> Column:
    """D16."""
    cjk = "^[㐀-䶿一-鿿豈-﫿]+$"
    ok = (
        (F.length(variant) > 0) & (F.length(variant) == F.length(target)) & (variant != target)
        & kind.isin("visual_variant", "variant_character", "glyph_variant") & (F.trim(rationale) != "")
        & F.concat(variant, target).rlike(cjk) & (F.translate(target, V.SIMPLIFIED, V.TRADITIONAL) != variant)
    )
    return F.coalesce(ok, F.lit(False))


def confidence_bucket(confidence: Column) -> Column:
    """A name stays (lower case); a number is high from 0.9, medium from 0.8, else low."""
    number = confidence.try_cast("double")
    return F.when(number.isNull(), F.lower(confidence)).when(number >= 0.9, "high").when(number >= 0.8, "medium").otherwise("low")


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
