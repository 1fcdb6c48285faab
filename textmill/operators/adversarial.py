"""Disguised variants of risky texts, made by rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions import fixed_values as V
from textmill.operators.cleaning import stable_id
from textmill.operators.tables import side, stored

#: An entry of a substitution map: (variant, target, confidence, level, rationale, kind).
Entry = tuple[str, str, float, str, str, str]

CHANGE = "struct<text:string,note:string>"


def _none() -> Column:
    return F.lit(None).cast(CHANGE)


def _change(text: Column, note: Column) -> Column:
    return F.struct(text.alias("text"), note.alias("note"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of old replaced; old must occur."""
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))


def ordered_entries(entries: Sequence[Entry]) -> list[Entry]:
    """Longest target first, then by variant."""
    return sorted((e for e in entries if e[1] and e[0] != e[1]), key=lambda e: (-len(e[1]), e[0]))


def _first_entry(text: Column, entries: Sequence[Entry], note) -> Column:
    """The change by the first entry whose target occurs."""
    own = ordered_entries(entries)
    if not own:
        return _none()
    table = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(t).alias("target"), F.lit(note(e)).alias("note")) for e in own for v, t in [e[:2]]])
    hit = F.get(F.filter(table, lambda e: F.contains(text, e["target"])), F.lit(0))
    return F.when(hit.isNotNull(), _change(replace_first(text, hit["target"], hit["variant"]), hit["note"]))


def map_replace(text: Column, entries: Sequence[Entry], least: float = 0.85) -> Column:
    """G1."""
    return _first_entry(text, [e for e in entries if e[2] >= least], lambda e: f"high-confidence map replacement ({e[2]:.2f})")


def homophone_note(e: Entry) -> str:
    note = f"homophone confidence={e[3]}" + (f"; {e[4].strip()}" if e[4].strip() else "")
    return note + ("; high-priority manual review required" if e[3] == "medium" else "")


def homophone_replace(text: Column, entries: Sequence[Entry]) -> Column:
    """G2."""
    return _first_entry(text, [e for e in entries if e[3] in ("high", "medium")], homophone_note)


def _is_variant(e: Entry) -> bool:
    """D16 for one entry of a pack, on the driver."""
    v, t = e[0], e[1]
    cjk = all(0x3400 <= ord(c) <= 0x4DBF or 0x4E00 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF for c in v + t)
    table = str.maketrans(V.SIMPLIFIED, V.TRADITIONAL)
    return bool(v) and len(v) == len(t) and v != t and e[5] in ("visual_variant", "variant_character", "glyph_variant") and bool(e[4].strip()) and cjk and t.translate(table) != v


def variant_replace(text: Column, entries: Sequence[Entry]) -> Column:
    """G3."""
    return _first_entry(text, [e for e in entries if e[3] in ("high", "medium") and _is_variant(e)], lambda e: f"explicit variant-character replacement; {e[4]}")


def _around(text: Column, pattern: str, new) -> Column:
    """The text with its first match m of the pattern replaced by new(m); null without one."""
    m = F.regexp_extract(text, pattern, 0)
    return F.when(m != "", replace_first_match(text, pattern, m, new(m)))


def replace_first_match(text: Column, pattern: str, match: Column, new: Column) -> Column:
    before = F.get(F.split(text, pattern, 2), F.lit(0))
    return F.concat(before, new, F.substring(text, F.length(before) + F.length(match) + 1, F.length(text)))


def obfuscate_phone(text: Column) -> Column:
    """G4."""
    made = _around(text, r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", lambda m: F.array_join(F.split(m, ""), "-"))
    return F.when(made.isNotNull(), _change(made, F.lit("hyphenate existing phone number")))


def obfuscate_url(text: Column) -> Column:
    """G5."""
    new = lambda m: F.replace(F.regexp_replace(F.regexp_replace(m, "(?i)^https", "hxxps"), "(?i)^http", "hxxp"), F.lit("."), F.lit("[.]"))
    made = _around(text, r"(?iU)(?:https?://|www\.)[^\s，。；、]+", new)
    return F.when(made.isNotNull(), _change(made, F.lit("obfuscate existing URL scheme and dots")))


def _keyword(text: Column, words: Sequence[str], least: int = 1) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: (F.length(w) >= least) & F.contains(text, w)), F.lit(0))


def _label_keyword(text: Column, label: Column, keywords: Mapping[str, Sequence[str]], least: int = 1) -> Column:
    out = None
    for name, words in keywords.items():
        found = _keyword(text, words, least)
        out = F.when(label == name, found) if out is None else out.when(label == name, found)
    return out


def _by_keyword(text: Column, word: Column, new, note: str) -> Column:
    return F.when(word.isNotNull(), _change(replace_first(text, word, new(word)), F.concat(F.lit(f"{note}: "), word)))


def repeat_keyword(text: Column, word: Column, note: str = "repeat character inside risk keyword") -> Column:
    """G6."""
    return _by_keyword(text, word, lambda w: F.concat(F.substring(w, 1, 1), w), note)


def to_traditional(text: Column) -> Column:
    """G7."""
    made = F.translate(text, V.SIMPLIFIED, V.TRADITIONAL)
    return F.when(made != text, _change(made, F.lit("fixed simplified-to-traditional character table")))


def spaced_keyword(text: Column, word: Column, note: str) -> Column:
    """G8."""
    return _by_keyword(text, word, lambda w: F.array_join(F.split(w, ""), " "), note)


def symbol_insert(text: Column, word: Column) -> Column:
    """G9."""
    return _by_keyword(text, word, lambda w: F.concat(F.substring(w, 1, 1), F.lit("@"), F.substring(w, F.lit(2), F.length(w))), "insert symbol inside risk keyword")


def mixed_language(text: Column, pairs: Sequence[tuple[str, str]] = V.MIXED_WORDS) -> Column:
    """G10."""
    out = None
    for a, b in pairs:
        made = _change(replace_first(text, F.lit(a), F.lit(b)), F.lit(f"replace {a} with {b}"))
        out = F.when(F.contains(text, F.lit(a)), made) if out is None else out.when(F.contains(text, F.lit(a)), made)
    return out


class Rules:
    """What the rules work with: the five maps and the keywords of each label."""

    def __init__(self, maps: Mapping[str, Sequence[Entry]] = {}, keywords: Mapping[str, Sequence[str]] = V.CORE_KEYWORDS, mixed: Sequence[tuple[str, str]] = V.MIXED_WORDS):  # noqa: B006
        self.maps, self.keywords, self.mixed = dict(maps), dict(keywords), tuple(mixed)


def perturb(text: Column, label: Column, kind: str, rules: Rules) -> Column:
    """The strict change of one kind as (text, note); null where it doesn't apply."""
    word = _label_keyword(text, label, rules.keywords)
    long_word = _label_keyword(text, label, rules.keywords, 2)
    made = {
        "homophone": lambda: homophone_replace(text, rules.maps.get("homophone", ())),
        "variant_character": lambda: variant_replace(text, rules.maps.get("variant_char", ())),
        "pinyin": lambda: map_replace(text, rules.maps.get("pinyin", ())),
        "abbreviation": lambda: map_replace(text, rules.maps.get("abbreviation", ())),
        "emoji": lambda: (lambda c: F.when(c.isNotNull(), _change(c["text"], F.lit("replace core risk expression with mapped emoji"))))(map_replace(text, rules.maps.get("emoji", ()), 0.70)),
        "phone_obfuscation": lambda: obfuscate_phone(text),
        "url_obfuscation": lambda: obfuscate_url(text),
        "repeat_character": lambda: repeat_keyword(text, word),
        "traditional_simplified": lambda: to_traditional(text),
        "character_split": lambda: spaced_keyword(text, long_word, "split risk keyword"),
        "space_insertion": lambda: spaced_keyword(text, long_word, "insert spaces inside risk keyword"),
        "symbol_insertion": lambda: symbol_insert(text, long_word),
        "mixed_language": lambda: mixed_language(text, rules.mixed),
    }[kind]()
    short = kind in ("character_split", "space_insertion", "symbol_insertion", "mixed_language")
    return F.when(F.length(text) >= 2, made) if short else made


def perturb_loose(text: Column, kind: str, rules: Rules) -> Column:
    """The first version's rules: no confidence, whole texts, keywords of any label."""
    maps = {"homophone": "homophone", "pinyin": "pinyin", "abbreviation": "abbreviation", "variant_character": "variant_char", "emoji": "emoji"}
    if kind in maps:
        return _first_entry(text, rules.maps.get(maps[kind], ()), lambda e: f"reverse replacement from {maps[kind]}_map")
    if kind == "traditional_simplified":
        return to_traditional(text)
    if kind == "phone_obfuscation":
        made = _around(text, r"(?U)1[3-9]\d{9}", lambda m: F.array_join(F.split(m, ""), "-"))
        return F.when(made.isNotNull() & (F.length(text) >= 2), _change(made, F.lit("hyphenate phone digits")))
    if kind == "url_obfuscation":
        before = F.get(F.split(text, r"(?i)https?://|www\.", 2), F.lit(0))
        rest = F.substring(text, F.length(before) + 1, F.length(text))
        return F.when(text.rlike(r"(?i)https?://|www\."), _change(F.concat(before, F.replace(rest, F.lit("."), F.lit("[.]"))), F.lit("replace URL dots with [.]")))
    if kind == "repeat_character":
        word = _keyword(text, [w for words in rules.keywords.values() for w in words])
        return F.when(F.length(text) >= 2, repeat_keyword(text, word, "repeat inside risk keyword"))
    head, tail = F.substring(text, 1, 1), F.substring(text, F.lit(2), F.length(text))
    made = {
        "character_split": lambda: _change(F.concat(head, F.lit(" "), tail), F.lit("split first two characters")),
        "space_insertion": lambda: _change(F.array_join(F.split(text, ""), " "), F.lit("insert spaces between all characters")),
        "symbol_insertion": lambda: _change(F.concat(head, F.lit("@"), tail), F.lit("insert @ after first character")),
        "mixed_language": lambda: F.coalesce(mixed_language(text, rules.mixed), _change(F.concat(text, F.lit(" online")), F.lit("append mixed-language context token"))),
    }[kind]()
    return F.when(F.length(text) >= 2, made)


def variants(seeds: DataFrame, rules: Rules, kinds: Sequence[str] = V.KINDS, text: str = "text", label: str = "label", loose: bool = False) -> DataFrame:
    """Every seed under every kind that applies: the seeds' columns, kind_order, perturbation_type,
    adversarial_text, notes. Seeds stay where they are; nothing is joined."""
    made = [perturb_loose(F.col(text), k, rules) if loose else perturb(F.col(text), F.col(label), k, rules) for k in kinds]
    cells = F.array(*[F.struct(F.lit(i).alias("kind_order"), F.lit(k).alias("kind"), c.alias("c")) for i, (k, c) in enumerate(zip(kinds, made, strict=True))])
    out = seeds.withColumn("_v", F.explode(F.filter(cells, lambda x: x["c"].isNotNull())))
    return out.select(*seeds.columns, F.col("_v.kind_order").alias("kind_order"), F.col("_v.kind").alias("perturbation_type"), F.col("_v.c.text").alias("adversarial_text"), F.col("_v.c.note").alias("notes"))


def _ids(df: DataFrame, text: str, label: str, source: str) -> DataFrame:
    return df.withColumn("pair_id", stable_id(F.col(text), F.col(label), F.lit(source), "pair")).withColumn("sample_id", stable_id(F.col("adversarial_text"), F.col(label), F.concat(F.lit(f"{source}:"), F.col("perturbation_type")), "adv"))


def first_variants(seeds: DataFrame, make: Callable[[DataFrame], DataFrame], by: Sequence[str], order: str, most: int) -> DataFrame:
    """Of make(seeds), variants with the columns `by` and _h, the hash of their text: a stored table of those that may be among the
    first `most` distinct texts of their group in seed order. Only hashes are grouped; texts are made anew of the few seeds that
    give these."""
    first = make(seeds).groupBy(*by, "_h").agg(F.min(order).alias(order))
    # all that share the last place, as their texts decide between them
    near = stored(first.withColumn("_n", F.rank().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= most).drop("_n"), "near")
    own = seeds.join(side(near.select(order).distinct()), order, "left_semi").select(*seeds.columns)
    return stored(make(own).join(side(near), [*by, "_h", order], "left_semi"), "variants")


def build_v1(seeds: DataFrame, rules: Rules, order: str, most: int = 10, text: str = "text", label: str = "label", kinds: Sequence[str] = V.KINDS) -> DataFrame:
    """Of each kind the first `most` distinct variants in seed order."""
    make = lambda df: variants(df, rules, kinds, text, label, loose=True).withColumn("_h", F.sha2("adversarial_text", 256))
    rows = first_variants(seeds, make, ["perturbation_type"], order, most).drop("_h")
    first = rows.groupBy("perturbation_type", "adversarial_text").agg(F.min(F.col(order)).alias(order))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("perturbation_type").orderBy(order, "adversarial_text"))).where(F.col("_n") <= most).drop("_n")
    return _ids(rows.join(F.broadcast(ranked), ["perturbation_type", "adversarial_text", order], "left_semi"), text, label, "adversarial_v1")  # at most kinds x most rows


def build_v2(seeds: DataFrame, rules: Rules, order: str, targets: Mapping[str, int] = V.KIND_TARGETS, text: str = "text", label: str = "label", kinds: Sequence[str] = V.KINDS) -> DataFrame:
    """Strict variants, of each (kind, label) the first in seed order up to the label's quota, every text once
    in all. Blocks of (kind, label) go in order. A block needs at most its quota of rows besides those that
    earlier blocks took, so each block's first quota + (all quotas before it) distinct texts are enough: that bounded table
    of hashes decides. A text that several seeds of a block give comes from the first of them."""
    place = F.array_position(F.array(*map(F.lit, targets)), F.col(label))

    def make(df: DataFrame) -> DataFrame:
        return variants(df, rules, kinds, text, label).withColumns({"_h": F.sha2("adversarial_text", 256), "_block": F.col("kind_order") * len(targets) + place})

    bound = sum(targets.values()) * len(kinds)
    rows = first_variants(seeds.where(F.col(label).isin(*targets)), make, ["_block"], order, bound)
    # a text's hash stands for it from here on
    distinct = rows.groupBy("_block", label, "_h").agg(F.min(F.struct(order, "adversarial_text")).alias("_first"))
    heads = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("_block").orderBy("_first"))).where(F.col("_n") <= bound)
    quota = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])[F.col(label)]
    chosen = stored(greedy_blocks(heads.select("_block", "_n", "_h", F.col(f"_first.{order}").alias(order), quota.alias("_quota"))), "chosen")
    return _ids(rows.join(side(chosen), ["_block", "_h", order], "left_semi").drop("_h", "_block"), text, label, "adversarial_v2")


def greedy_blocks(heads: DataFrame) -> DataFrame:
    """Of (_block, _n: place in it, _h, _quota, …) the rows that blocks take in order, each its first _quota whose _h no earlier
    row took; a block has an _h once.

    Rounds: a row within its block's quota of rows left is taken for sure if no row before it has its _h; rows after it with that
    _h go, and so does all beyond the quota of a block whose rows within it are all sure. The first block that isn't settled
    is settled in every round, and all others that share nothing with blocks before them."""
    left, in_block, of_text = heads, Window.partitionBy("_block"), Window.partitionBy("_h").orderBy("_block", "_n")
    while True:
        placed = left.withColumn("_in", F.row_number().over(in_block.orderBy("_n")) <= F.col("_quota"))
        placed = placed.withColumn("_sure", F.col("_in") & (F.row_number().over(of_text) == 1))
        placed = placed.withColumn("_gone", F.coalesce(F.bool_or("_sure").over(of_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
        placed = placed.withColumn("_settled", F.bool_and(~F.col("_in") | F.col("_sure")).over(in_block))
        left = stored(placed.where(~F.col("_gone") & (F.col("_in") | ~F.col("_settled"))), "heads")
        if not left.where(~F.col("_sure")).limit(1).count():
            return left.drop("_in", "_sure", "_gone", "_settled", "_quota", "_n")
        left = left.drop("_in", "_sure", "_gone", "_settled")


def build_v3(v2: DataFrame, rules: Rules, seeds: DataFrame, order: str, text: str = "text", label: str = "label", dropped: Sequence[str] = V.DEPRECATED_KINDS) -> DataFrame:
    """v2 without dropped kinds; homophones noted anew by exact replay (others go); variant-character rows
    added; all pending."""
    kept = v2.where(~F.col("perturbation_type").isin(*dropped))
    replay = homophone_replace(F.col(text), rules.maps.get("homophone", ()))
    homophones = kept.where("perturbation_type = 'homophone'").withColumn("_r", replay).where(F.col("_r.text") == F.col("adversarial_text")).withColumn("notes", F.col("_r.note")).drop("_r")
    others = kept.where("perturbation_type not in ('homophone', 'variant_character')")
    added = build_v2(seeds, rules, order, text=text, label=label, kinds=("variant_character",)).select(*v2.columns)
    return others.unionByName(homophones).unionByName(added).dropDuplicates(["adversarial_text"]).withColumn("review_status", F.lit("pending"))


def generation_shortfall(made: DataFrame, targets: Mapping[str, int] = V.KIND_TARGETS, label: str = "label", kinds: Sequence[str] = V.KINDS, deprecated: Sequence[str] = V.DEPRECATED_KINDS) -> DataFrame:
    """(label, perturbation_type, target, actual, shortfall, reason) of every cell."""
    spark = made.sparkSession
    cells = [F.struct(F.lit(a).alias("label"), F.lit(k).alias("perturbation_type"), F.lit(t).cast("long").alias("target")) for a, t in targets.items() for k in kinds]
    dim = spark.range(1).select(F.explode(F.array(*cells)).alias("d")).select("d.*")
    got = made.groupBy(F.col(label).alias("label"), "perturbation_type").agg(F.count("*").alias("actual"))
    out = dim.join(F.broadcast(got), ["label", "perturbation_type"], "left").na.fill(0, ["actual"])  # a row a cell
    short = F.greatest(F.lit(0), F.col("target") - F.col("actual"))
    reason = F.when(short == 0, "").when(F.col("perturbation_type").isin(*deprecated), "deprecated").otherwise("insufficient_candidates")
    return out.withColumn("shortfall", short).withColumn("reason", reason)


def variant_diff(old: DataFrame, new: DataFrame, id_col: str = "sample_id", text: str = "text", label: str = "label", carry: Sequence[str] = ("pair_id", "notes")) -> DataFrame:
    """What changed between two sets of variants, a row an id: change_type (removed, added, changed, unchanged), old_id, new_id,
    original_text, the texts and kinds of both (empty where absent), label, reason. A row is unchanged if text, label, kind and the
    columns carried are equal."""
    said = ["adversarial_text", "perturbation_type"]
    own = lambda df: df.select(F.col(id_col).alias("_id"), F.struct(F.col(text).alias("original_text"), F.col(label).alias("label"), *said, *carry).alias("_row"))
    both = own(old).withColumnRenamed("_row", "_old").join(own(new).withColumnRenamed("_row", "_new"), "_id", "full_outer")
    kind = F.col("_old.perturbation_type")
    gone, come = F.col("_new").isNull(), F.col("_old").isNull()
    change = F.when(gone, "removed").when(come, "added").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    removed = F.when(kind == "character_split", "character_split deprecated").when(kind == "variant_character", "invalid symbol-based variant_character").when(kind == "homophone", "low-confidence homophone excluded").otherwise("removed by quality rules")
    at = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(""))
    return both.select(
        change.alias("change_type"), F.when(come, "").otherwise(F.col("_id")).alias("old_id"), F.when(gone, "").otherwise(F.col("_id")).alias("new_id"),
        F.coalesce("_new.original_text", "_old.original_text").alias("original_text"), at("_old", said[0]).alias("old_text"), at("_new", said[0]).alias("new_text"),
        F.coalesce("_new.label", "_old.label").alias("label"), at("_old", said[1]).alias("old_kind"), at("_new", said[1]).alias("new_kind"),
        F.when(gone, removed).when(come, "strict generation").when(change == "changed", "generation metadata updated").otherwise("").alias("reason"),
    )


def coverage_report(made: DataFrame, duplicates: DataFrame, diff: DataFrame, targets: Mapping[str, int] = V.KIND_TARGETS, label: str = "label", kinds: Sequence[str] = V.KINDS) -> DataFrame:
    """The whole report as rows (dimension, kind, label, count): total; by kind; by label; every cell of label and kind, empty ones
    as 0; what each kind and all are short of the targets; candidate pairs of duplicates; changes by type."""
    none = F.lit(None).cast("string")
    row = lambda df, dimension, kind, name, count: df.select(F.lit(dimension).alias("dimension"), kind.alias("kind"), name.alias("label"), count.cast("long").alias("count"))
    kind, name = F.col("perturbation_type"), F.col("label")
    cells = stored(generation_shortfall(made, targets, label, kinds))
    types = made.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("added", "changed", "removed", "unchanged")))).alias("change_type"))
    changes = types.join(F.broadcast(diff.groupBy("change_type").count()), "change_type", "left")  # a row a type
    parts = [
        row(made.agg(F.count("*").alias("n")), "total", none, none, F.col("n")),
        row(made.groupBy("perturbation_type").count(), "kind", kind, none, F.col("count")),
        row(made.groupBy(F.col(label).alias("label")).count(), "label", none, name, F.col("count")),
        row(cells, "label_kind", kind, name, F.col("actual")),
        row(cells.groupBy("perturbation_type").agg(F.sum("shortfall").alias("n")), "shortfall", kind, none, F.col("n")),
        row(cells.agg(F.sum("shortfall").alias("n")), "shortfall_total", none, none, F.coalesce("n", F.lit(0))),
        row(duplicates.agg(F.count("*").alias("n")), "duplicate_pairs", none, none, F.col("n")),
        row(changes, "diff", F.col("change_type"), none, F.coalesce("count", F.lit(0))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adversarial_coverage(made: DataFrame, label: str = "label") -> DataFrame:
    """Counts by kind, label and both, and in all (null: all), with distinct pairs."""
    return made.cube(F.col("perturbation_type").alias("kind"), F.col(label).alias("label")).agg(F.count("*").alias("count"), F.count_distinct("pair_id").alias("pairs"))
