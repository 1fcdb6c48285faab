"""Scores, actions and rewriting of messages, and the guard of replies, as DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fixed_values as V
from .columns import computed_once
from .detect import Pack, dedup_detections, detect_high_risk, detect_privacy, detect_rules, no_detections, primary_detection, privacy
from .normalize import normalize

BLOCK, SANITIZE = 80, 40
#: A scorer: normalized text -> array of detections of the class probabilities; none by default.
Semantic = Callable[[Column], Column]


def no_semantic(text: Column) -> Column:
    return no_detections()


def risk_score(found: Column) -> Column:
    """R1."""
    return F.coalesce(F.array_max(F.transform(found, lambda d: d["score"])), F.lit(0))


def risk_level(score: Column, block: int = BLOCK, sanitize: int = SANITIZE) -> Column:
    """R2."""
    return F.when(score >= block, "high").when(score >= sanitize, "medium").when(score > 0, "low").otherwise("none")


def action_of(score: Column, block: int = BLOCK, sanitize: int = SANITIZE) -> Column:
    """R3."""
    return F.when(score >= block, "block").when(score >= sanitize, "sanitize").otherwise("pass")


def risk_categories(found: Column) -> Column:
    """R4."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: d["category"])))


def _longest_first(words: Column) -> Column:
    return F.array_sort(F.array_distinct(words), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))


def sanitize(text: Column, matches: Column) -> Column:
    """Distinct matches, longest first, replaced by the contact mark or stars."""
    mask = lambda w: F.when(w.isin(*V.CONTACT_CUES), V.CONTACT_MASK).otherwise(V.MATCH_MASK)
    return F.aggregate(F.filter(_longest_first(matches), lambda w: w != ""), text, lambda acc, w: F.replace(acc, w, mask(w)))


def restore_comma(sanitized: Column, original: Column) -> Column:
    """R6."""
    return F.when(F.contains(original, F.lit("，")) & ~F.contains(original, F.lit(",")), F.replace(sanitized, F.lit(","), F.lit("，"))).otherwise(sanitized)


def all_matches(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda d: d["matches"]))


def filter_text(df: DataFrame, text_col: str, pack: Pack, semantic: Semantic = no_semantic, stage: str = "input", block: int = BLOCK, sanitize_at: int = SANITIZE) -> DataFrame:
    """Adds stage, normalized_text, action, risk_score, risk_level, risk_categories, sanitized_text,
    rewrite_recheck (normalized_text, detections), detections. Score and categories are the first pass's."""
    t = F.col(text_col)
    df = df.withColumn("normalized_text", normalize(t, pack.maps))
    df = df.withColumn("_rule", detect_rules(F.col("normalized_text"), pack))
    df = df.withColumn("detections", dedup_detections(F.concat("_rule", semantic(F.col("normalized_text")))))
    df = df.withColumn("risk_score", risk_score(F.col("detections")))
    first = action_of(F.col("risk_score"), block, sanitize_at)
    present = F.filter(all_matches(F.col("_rule")), lambda m: (m != "") & F.contains(F.col("normalized_text"), m))
    # Only rows to be rewritten are scanned anew
    df = df.withColumn("_rewritten", F.when(first == "sanitize", restore_comma(sanitize(F.col("normalized_text"), present), t)))
    df = df.withColumn("_again", F.when(F.col("_rewritten").isNotNull(), normalize(F.col("_rewritten"), pack.maps)))
    df = df.withColumn("_rule2", F.when(F.col("_again").isNotNull(), detect_rules(F.col("_again"), pack)))
    df = df.withColumn("_found2", F.when(F.col("_again").isNotNull(), dedup_detections(F.concat("_rule2", semantic(F.col("_again"))))))
    ad_evidence = F.exists("_rule", lambda d: (d["category"] == "ad") & d["source"].isin("keyword", "regex") & F.exists(d["matches"], lambda m: (m != "") & F.contains(F.col("normalized_text"), m)))
    ad_only = (F.size("_rule2") == 0) & F.forall("_found2", lambda d: (d["source"] == "semantic_ml") & (d["category"] == "ad"))
    failed = F.coalesce((F.size("_found2") > 0) & ~(ad_evidence & ad_only), F.lit(False))
    return (
        df.withColumn("stage", F.lit(stage))
        .withColumn("action", F.when(failed, "block").otherwise(first))
        .withColumn("risk_level", F.when(failed, "high").otherwise(risk_level(F.col("risk_score"), block, sanitize_at)))
        .withColumn("risk_categories", risk_categories(F.col("detections")))
        .withColumn("sanitized_text", F.when(~failed, F.col("_rewritten")))
        .withColumn("rewrite_recheck", F.when(F.col("_again").isNotNull(), F.struct(F.col("_again").alias("normalized_text"), F.col("_found2").alias("detections"))))
        .drop("_rule", "_rewritten", "_again", "_rule2", "_found2")
    )


def detect(df: DataFrame, text_col: str, pack: Pack, semantic: Semantic = no_semantic) -> DataFrame:
    """The verdict's public columns, beside the columns of df."""
    own = df.columns
    return filter_text(df, text_col, pack, semantic, "detect").select(*own, "stage", "normalized_text", "action", "risk_score", "risk_level", "risk_categories", "detections")


def baseline_vs_enhanced(df: DataFrame, text_col: str, pack: Pack, semantic: Semantic = no_semantic) -> DataFrame:
    """Rules on the lower-case text against the full verdict; baseline_action, enhanced_action,
    baseline_missed and note."""
    df = filter_text(df, text_col, pack, semantic, "detect").withColumn("enhanced_action", F.col("action"))
    df = df.withColumn("baseline_action", action_of(risk_score(detect_rules(F.lower(F.col(text_col)), pack))))
    missed = (F.col("baseline_action") == "pass") & (F.col("enhanced_action") != "pass")
    base, full = F.col("baseline_action"), F.col("enhanced_action")
    note = F.when(missed, V.NOTES["recovered"]).when((base != "pass") & (full == "pass"), V.NOTES["relaxed"]).when(base != full, V.NOTES["changed"]).otherwise(V.NOTES["same"])
    return df.withColumn("baseline_missed", missed).withColumn("note", note)


def processing_strategy(action: Column, rechecked: Column) -> Column:
    """R11."""
    return F.when((action == "block") & rechecked, V.STRATEGIES["rejected"]).when(action == "block", V.STRATEGIES["block"]).when(action == "sanitize", V.STRATEGIES["sanitize"]).otherwise(V.STRATEGIES["pass"])


def turn_status(input_action: Column, service_error: Column, output_action: Column) -> Column:
    """R12."""
    return (
        F.when(input_action == "block", V.TURN_STATUS["input"]).when(service_error.isNotNull(), V.TURN_STATUS["error"])
        .when(output_action.isNull(), V.TURN_STATUS["none"]).when(output_action != "pass", V.TURN_STATUS["risky"]).otherwise(V.TURN_STATUS["passed"])
    )


def label_of(category: Column) -> Column:
    """The display label of a category, or the category."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in V.CATEGORY_LABELS.items() for x in kv])[category], category)


def refusal_for(categories: Column) -> Column:
    """O2."""
    table = F.create_map(*[F.lit(x) for kv in V.REFUSALS.items() for x in kv])
    return F.when(F.size(categories) > 1, V.REFUSALS["mixed"]).when(F.size(categories) == 0, V.REFUSAL_GENERIC).otherwise(F.coalesce(table[F.get(categories, F.lit(0))], F.lit(V.REFUSALS["mixed"])))


def sanitize_output(masked: Column, found: Column) -> Column:
    """O3: matches of other than regex sources replaced by their category's mark, detection by detection."""
    names = [n for n, _, _ in V.PRIVACY]

    def step(acc: Column, d: Column) -> Column:
        mark = F.concat(F.lit("[已过滤:"), label_of(d["category"]), F.lit("]"))
        words = F.filter(_longest_first(d["matches"]), lambda m: (m != "") & ~m.isin(*names))
        return F.when(d["source"].endswith("regex"), acc).otherwise(F.aggregate(words, acc, lambda a, m: F.replace(a, m, mark)))

    return F.aggregate(found, masked, step)


def _guard(df: DataFrame, text: str, prefix: str, pack: Pack, semantic: Semantic, block: int, sanitize_at: int) -> DataFrame:
    """O1 on a text column; the result's columns carry the prefix."""
    c = lambda name: F.col(f"{prefix}{name}")
    df = df.withColumn(f"{prefix}raw", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(f"{prefix}norm", normalize(c("raw"), pack.maps))
    df = df.withColumn(f"{prefix}normalized_text", F.when(c("norm") == "", c("raw")).otherwise(c("norm")))
    own = dedup_detections(F.concat(detect_rules(c("norm"), pack), semantic(c("norm"))))
    df = df.withColumn(f"{prefix}pair", privacy(c("raw"))).withColumn(f"{prefix}masked", c("pair")["masked"]).withColumn(f"{prefix}privacy", detect_privacy(c("pair")["names"]))
    df = df.withColumn(f"{prefix}detections", computed_once(F.concat(own, c("privacy"), detect_high_risk(c("normalized_text")))))
    df = df.withColumn(f"{prefix}risk_score", risk_score(c("detections")))
    df = df.withColumn(f"{prefix}risk_categories", F.array_sort(F.array_distinct(F.filter(F.transform(c("detections"), lambda d: d["category"]), lambda x: x != "normal"))))
    action = F.when(c("risk_score") >= block, "block").when((c("risk_score") >= sanitize_at) | (F.size(c("privacy")) > 0), "sanitize").otherwise("pass")
    df = df.withColumn(f"{prefix}action", action)
    df = df.withColumn(f"{prefix}rewrite", F.when(c("action") == "sanitize", sanitize_output(c("masked"), c("detections"))))
    # O4
    safe = F.when((F.regexp_replace(c("rewrite"), r"(?U)\s+", "") == "") | (c("rewrite") == c("raw")), V.REWRITE_GENERIC).otherwise(c("rewrite"))
    final = F.when(c("action") == "block", refusal_for(c("risk_categories"))).when(c("action") == "sanitize", safe).otherwise(c("raw"))
    return df.withColumn(f"{prefix}final_text", final).withColumn(f"{prefix}risk_level", risk_level(c("risk_score"), block, sanitize_at)).drop(f"{prefix}norm", f"{prefix}pair", f"{prefix}privacy", f"{prefix}rewrite")


OUTPUT = ("action", "risk_score", "risk_level", "risk_categories", "final_text", "normalized_text", "detections", "masked")


def guard_output(df: DataFrame, text_col: str, pack: Pack, semantic: Semantic = no_semantic, prefix: str = "", block: int = BLOCK, sanitize_at: int = SANITIZE, recheck: bool = True) -> DataFrame:
    """O1 and, unless switched off, O5: adds action, risk_score, risk_level, risk_categories, final_text,
    normalized_text, detections, masked, rewritten, rechecked_action. Only rewritten texts are scanned anew."""
    own = df.columns
    df = _guard(df, text_col, "_o_", pack, semantic, block, sanitize_at)
    first = F.col("_o_action")
    if not recheck:
        return df.select(*own, *(F.col(f"_o_{n}").alias(f"{prefix}{n}") for n in OUTPUT), (first == "sanitize").alias(f"{prefix}rewritten"), F.lit(None).cast("string").alias(f"{prefix}rechecked_action"))
    df = df.withColumn("_again", F.when(first == "sanitize", F.col("_o_final_text")))
    df = _guard(df, "_again", "_p_", pack, semantic, block, sanitize_at)
    failed = (first == "sanitize") & (F.col("_p_action") != "pass")
    union = F.array_sort(F.array_union("_o_risk_categories", "_p_risk_categories"))
    new = {
        "action": F.when(failed, "block").otherwise(first),
        "risk_level": F.when(failed, "high").otherwise(F.col("_o_risk_level")),
        "risk_categories": F.when(failed, union).otherwise(F.col("_o_risk_categories")),
        "final_text": F.when(failed, refusal_for(union)).otherwise(F.col("_o_final_text")),
    }
    cols = [new.get(n, F.col(f"_o_{n}")).alias(f"{prefix}{n}") for n in OUTPUT]
    return df.select(*own, *cols, (first == "sanitize").alias(f"{prefix}rewritten"), F.when(first == "sanitize", F.col("_p_action")).alias(f"{prefix}rechecked_action"))


def public_output(df: DataFrame, prefix: str = "") -> DataFrame:
    """Unless passed, texts are null and matches redacted."""
    c = lambda n: F.col(f"{prefix}{n}")
    risky = c("action") != "pass"
    hidden = F.transform(c("detections"), lambda d: d.withField("matches", F.when(F.size(d["matches"]) > 0, F.array(F.lit(V.REDACTED))).otherwise(d["matches"])))
    return df.withColumns({f"{prefix}normalized_text": F.when(~risky, c("normalized_text")), f"{prefix}masked": F.when(~risky, c("masked")), f"{prefix}detections": F.when(risky, hidden).otherwise(c("detections"))})


def turn_pairs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, message, reply): each user turn with the assistant turn that follows it, system turns left
    out; without one the reply is null. Conversations are partitions of the only shuffle."""
    order = Window.partitionBy(conv).orderBy(turn)
    spoken = conversations.where(F.col(role) != "system").select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("message"),
        F.lead(role).over(order).alias("next_role"), F.lead(text).over(order).alias("next_text"),
    )
    return spoken.where("role = 'user'").select("conv_id", "turn", "message", F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("reply"))


def moderate_turns(df: DataFrame, pack: Pack, semantic: Semantic = no_semantic, message: str = "message", reply: str = "reply") -> DataFrame:
    """Adds the input verdict (in_*), the output verdict (out_*, null if the reply stage didn't run), and
    allowed, final_reply, safe_input, raw_reply, rewrite_changed, service_error."""
    own = df.columns
    verdict = filter_text(df, message, pack, semantic)
    names = ("action", "risk_score", "risk_level", "risk_categories", "sanitized_text", "detections", "normalized_text")
    df = verdict.select(*own, *(F.col(n).alias(f"in_{n}") for n in names))
    blocked = F.col("in_action") == "block"
    down = ~blocked & F.col(reply).isNull()
    # an empty rewrite counts as none
    safe = F.coalesce(F.when(F.col("in_sanitized_text") != "", F.col("in_sanitized_text")), F.col(message))
    df = df.withColumn("_reply", F.when(~blocked, F.col(reply)))
    df = public_output(guard_output(df, "_reply", pack, semantic, "out_"), "out_")
    run = ~blocked & ~down
    for n in [c for c in df.columns if c.startswith("out_")]:
        df = df.withColumn(n, F.when(run, F.col(n)))
    return (
        df.withColumn("allowed", F.coalesce(F.col("out_action") != "block", F.lit(False)))
        .withColumn("final_reply", F.when(blocked, V.INPUT_BLOCKED).when(down, V.SERVICE_DOWN).otherwise(F.col("out_final_text")))
        .withColumn("safe_input", F.when(~blocked, safe))
        .withColumn("raw_reply", F.when(F.col("out_action") == "pass", F.col("_reply")))
        .withColumn("rewrite_changed", ~blocked & (safe != F.col(message)))
        .withColumn("service_error", F.when(down, "llm_unavailable"))
        .drop("_reply")
    )


def emit_turn_events(turns: DataFrame, time: Column, message: str = "message") -> DataFrame:
    """Two or three events a turn: (conv_id, turn, seq, time, event_stage, input, raw_reply, action, reason,
    allowed, final_reply, result)."""
    kind = "struct<stage:string,action:string,risk_score:int,risk_level:string,risk_categories:array<string>,blocked:boolean,rewritten:boolean,detections:array<struct<category:string,level:string,score:int,reason:string,source:string,matches:array<string>>>>"

    def result(stage: str, p: str, blocked: Column, rewritten: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.col(f"{p}action").alias("action"), F.col(f"{p}risk_score").cast("int").alias("risk_score"), F.col(f"{p}risk_level").alias("risk_level"), F.col(f"{p}risk_categories").alias("risk_categories"), blocked.alias("blocked"), rewritten.alias("rewritten"), F.col(f"{p}detections").alias("detections")).cast(kind)

    none = F.lit(None)
    event = lambda seq, stage, inp, raw, action, reason, allowed, final, res: F.struct(
        F.lit(seq).alias("seq"), F.lit(stage).alias("event_stage"), inp.cast("string").alias("input"), raw.cast("string").alias("raw_reply"), action.cast("string").alias("action"), reason.cast("string").alias("reason"), allowed.cast("boolean").alias("allowed"), final.cast("string").alias("final_reply"), res.cast(kind).alias("result"))
    blocked, down = F.col("in_action") == "block", F.col("service_error").isNotNull()
    first = event(0, "input", F.col(message), none, none, none, none, none, result("input", "in_", none.cast("boolean"), none.cast("boolean")))
    out = event(1, "output", none, F.col("reply"), none, none, none, none, result("output", "out_", F.col("out_action") == "block", F.col("out_rewritten")))
    last = F.when(blocked, event(2, "final", none, none, F.lit("block"), F.lit("input_block"), none, none, none)).when(
        down, event(2, "final", none, none, F.lit("service_error"), F.lit("llm_unavailable"), none, none, none)
    ).otherwise(event(2, "final", none, none, F.col("out_action"), none, F.col("allowed"), F.col("final_reply"), none))
    events = F.array_compact(F.array(first, F.when(~blocked & ~down, out), last))
    return turns.select("conv_id", "turn", time.alias("time"), F.explode(events).alias("_e")).select("conv_id", "turn", "time", "_e.*")


def semantic_summary(found: Column) -> Column:
    """Category and score / 100 of the best semantic detection and the rest as normal; none is normal, 1."""
    own = F.filter(found, lambda d: d["source"].startswith("semantic"))
    top, some = primary_detection(own), F.size(own) > 0
    score = F.when(some, top["score"] / 100.0).otherwise(1.0)
    return F.struct(top["category"].alias("category"), score.alias("score"), F.when(some, F.greatest(F.lit(0.0), 1.0 - score)).otherwise(1.0).alias("normal"))
