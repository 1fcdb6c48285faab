"""Golden pairs of normalization, detection, decision and output guard."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import decide as R
from textmill.functions import detect as D
from textmill.functions import fixed_values as V
from textmill.functions import normalize as N

MAPS = N.Maps(homophone=[("加薇", "加微信")], pinyin=[("jia vx", "加微信")], abbreviation=[("vx", "微信")], emoji=[("🔞", "色情")])
LEX = {"ad": ["加微信", "联系微信"], "porn": ["色情"]}
PACK = D.Pack(LEX, [("ad", r"1[3-9]\d{9}", "medium", 55, "possible phone number")], MAPS)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("text, wanted", [
    ("  ＶＸ  ", "微信"), ("加@薇", "加微信"), ("user_name+tag@example.com", "user_name+tag@example.com"), ("please jia vx", "please 加微信"),
    ("北京-上海高铁", "北京-上海高铁"), ("C++语言", "C++语言"), ("", ""), ("   ", ""), ("a@@b", "a@@b"), ("哈哈哈哈", "哈哈"), ("微 信", "微信"), ("xvxx", "xvxx"), ("a​b\tc", "abc"), (None, None),
])
def test_normalize(spark, text, wanted):
    assert one(spark, text, N.normalize(F.col("text"), MAPS)) == wanted


def test_trace_lists_changed_steps(spark):
    df = N.normalize_with_trace(spark.createDataFrame([("加@薇",), ("好",)], "text string"), "text", MAPS)
    rows = df.select("normalized", F.transform("steps", lambda s: s["normalizer"]).alias("names"), N.trace_lines(F.col("steps")).alias("lines")).collect()
    assert rows[0]["normalized"] == "加微信" and rows[0]["names"] == ["noise_char", "homophone"]
    assert rows[0]["lines"][1] == "homophone: 加薇 -> 加微信" and rows[1]["lines"] == ["文本无需归一化"]


def test_noise_removed_and_match_counts(spark):
    assert [tuple(r) for r in one(spark, "a@b c_d", N.noise_removed(F.col("text")))] == [("@", 1), ("_", 5)]
    found = one(spark, "the tion the", N.map_match_counts(F.col("text"), [("the", "da"), ("da", "x"), ("zz", "y")]))
    assert [(r["source"], r["count"]) for r in found] == [("the", 2), ("da", 2)]


def test_char_ngrams(spark):
    for text, wanted in (("abcd", {"abc", "bcd"}), ("ab", {"ab"}), ("", set()), ("aaaa", {"aaa"}), ("ßa b", {"ssa", "sab"})):
        df = spark.createDataFrame([(text,)], "text string").withColumn("d", N.folded_dense(F.col("text")))
        assert set(df.select(N.char_ngrams(F.col("d")).alias("g")).first()["g"]) == wanted


@pytest.mark.parametrize("pattern, mark", [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"), (r"a@?b", None), (r"a@*b", None), (r"a@{0,2}b", None), (r"a@+b", "@"), (r"(a@)?b", None), (r"a@b|c", None), (r"(a|b)@", "@"), (r"[@[:]]x", None),
    (r"[\]@]x", None), (r"\@b", None), (r"\Qa@b?\E", None), (r"https?://x", ":"), ("", None), (r"[]@]", None), (r"(?x)a # @", None), (r"\p{sc=Han}", None), (r"(?<=@)b", None), (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", None),
])
def test_needed_mark(pattern, mark):
    assert D.needed_mark(pattern) == mark


def test_signs_keep_texts_from_costly_patterns(spark):
    """Each gate is in the plan, and rows that pass or don't pass it give what the patterns alone give."""
    texts = ["a@b.com or C@D.ORG", "no mark", None, "", "约\u3000炮 here", "加 微 信", "plain ascii", "幸福路88号", "x y", "微 信", "a|b", "中 文", "vx: abcde1", "WWW.x.y http://z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", F.lower(F.regexp_replace("text", r"(?U)\s+", "")))
    rule = ("ad", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "low", 1, "mail")
    mail = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?iU){rule[1]}"), F.lit(0)))
    got = df.select("text", D.detect_regex(F.col("text"), [rule]).alias("r"), F.coalesce(mail, F.array().cast("array<string>")).alias("mail"), D.detect_high_risk(F.col("text")).alias("h"), "low", N.norm_noise(F.col("text")).alias("n"), F.regexp_replace("text", f"({N._MAIL})|{N._DROPPED}", "$1").alias("plain"), D.masked_privacy(F.col("text")).alias("masked"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(text" in plan or "contains(text" in plan.lower()
    for r in got.collect():
        assert [m for d in r["r"] for m in d["matches"]] == r["mail"] and r["n"] == r["plain"]
        want = {(c, w) for c, words in V.HIGH_RISK.items() for w in words if r["low"] is not None and w in r["low"]}
        assert {(d["category"], m) for d in r["h"] for m in d["matches"]} == want
        masked = r["text"]
        for _, pattern, mask in V.PRIVACY:
            one = spark.createDataFrame([(masked,)], "t string").select(F.regexp_replace("t", F.lit(pattern), F.lit(mask))).first()[0]
            masked = one
        assert r["masked"] == masked


@pytest.mark.parametrize("n, at_once, wide", [(3, 1 << 20, 1 << 62), (1, 4, 1 << 62), (5, 30, 1 << 62), (4, 1 << 20, 1 << 12)])
def test_gram_sets_of_many_texts(monkeypatch, n, at_once, wide):
    import pyarrow as pa

    from textmill.functions import gram_sets as S

    monkeypatch.setattr(S, "AT_ONCE", at_once)
    monkeypatch.setattr(S, "WIDE", wide)
    texts = ["", "a", None, "ab", "abcabcabc", "\U0001f600\U0001f600x\x00y\x00", "", "漢字漢字漢字", "aaaaaaaaaa", "zß" * 30, None]
    want = [None if t is None else {t[i : i + n] for i in range(max(len(t) - n + 1, 1))} - {""} for t in texts]
    got = S.gram_sets(pa.array(texts, pa.string()), n).to_pylist()
    assert [g if g is None else set(g) for g in got] == want and all(g is None or len(g) == len(set(g)) for g in got)
    assert S.gram_sets(pa.array([], pa.string()), n).to_pylist() == []


@pytest.mark.parametrize("text, masked, names", [
    ("幸福路88号", "[地址]", ["address"]), ("教室聊天室", "教室聊天室", []), ("a@b.com", "[邮箱]", ["email"]), ("电话13812345678", "电话[手机号]", ["phone"]), ("1.2.3.4", "[IP地址]", ["ip"]),
])
def test_privacy(spark, text, masked, names):
    got = one(spark, text, D.privacy(F.col("text")))
    assert (got["masked"], got["names"]) == (masked, names)


def test_filter_text(spark):
    rows = spark.createDataFrame([("联系微信了解详情",), ("色情",), ("你好",), ("",), (None,)], "text string")
    got = {r["text"]: r for r in R.filter_text(rows, "text", PACK).collect()}
    ad = got["联系微信了解详情"]
    assert (ad["action"], ad["sanitized_text"], ad["rewrite_recheck"]["detections"]) == ("sanitize", "[联系方式已隐藏]了解详情", [])
    assert (got["色情"]["action"], got["色情"]["risk_level"], got["色情"]["sanitized_text"]) == ("block", "high", None)
    assert got["你好"]["action"] == got[""]["action"] == "pass"


def semantic(category, score):
    return lambda t: F.when(t != "", F.array(D.detection(category, "medium", score, "r", "semantic_ml", F.array(F.lit(f"{category}: 70.00%"))))).otherwise(D.no_detections())


def test_recheck_exception(spark):
    rows = spark.createDataFrame([("加微信看看",), ("你好",)], "text string")
    got = {r["text"]: r for r in R.filter_text(rows, "text", PACK, semantic("ad", 70)).collect()}
    assert got["加微信看看"]["action"] == "sanitize"  # rule evidence, the rest is semantic ad alone
    assert (got["你好"]["action"], got["你好"]["sanitized_text"], got["你好"]["risk_score"]) == ("block", None, 70)
    got = R.filter_text(rows.limit(1), "text", PACK, semantic("sensitive", 70)).first()
    assert got["action"] == "block"


def test_guard_output(spark):
    rows = spark.createDataFrame([("加微信 13812345678",), ("写信到 a@b.com",), ("早上好",), (None,)], "text string")
    got = {r["text"]: r for r in R.guard_output(rows, "text", PACK).collect()}
    both = got["加微信 13812345678"]
    assert both["action"] == "block" and both["risk_categories"] == ["ad", "privacy"]
    mail = got["写信到 a@b.com"]
    assert mail["action"] == "sanitize" and "[邮箱]" in mail["final_text"] and mail["rechecked_action"] == "pass"
    assert got["早上好"]["final_text"] == "早上好" and got[None]["final_text"] == ""


def test_turns_hide_what_is_risky(spark):
    talk = spark.createDataFrame([(1, 0, "system", "x"), (1, 1, "user", "色情"), (1, 2, "assistant", "ok"), (2, 0, "user", "你好"), (2, 1, "assistant", "约炮"), (3, 0, "user", "你好"), (3, 1, "user", "在吗"), (3, 2, "assistant", "在")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in R.moderate_turns(R.turn_pairs(talk), PACK).collect()}
    assert set(got) == {(1, 1), (2, 0), (3, 0), (3, 1)}
    assert not got[1, 1]["allowed"] and got[1, 1]["out_action"] is None and got[1, 1]["safe_input"] is None
    risky = got[2, 0]
    assert risky["out_action"] == "block" and risky["raw_reply"] is None and risky["out_normalized_text"] is None and all(d["matches"] == ["[REDACTED]"] for d in risky["out_detections"])
    assert got[3, 0]["service_error"] == "llm_unavailable" and got[3, 1]["allowed"] and got[3, 1]["raw_reply"] == "在"
    events = R.emit_turn_events(R.moderate_turns(R.turn_pairs(talk), PACK), F.current_timestamp())
    assert {tuple(r) for r in events.groupBy("conv_id", "turn").count().collect()} == {(1, 1, 2), (2, 0, 3), (3, 0, 2), (3, 1, 3)}


def test_gate(spark):
    probs = lambda **p: F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("p")) for k, v in p.items()])
    gate = lambda p: one(spark, "x", D.semantic_gate(p))
    assert gate(probs(normal=0.4, ad=0.6))["label"] == "ad"
    assert gate(probs(normal=0.6, ad=0.4)) is None and gate(probs(normal=0.49, ad=0.51)) is None and gate(probs(violence=0.5)) is None
    got = one(spark, "x", D.semantic_detection(D.semantic_gate(probs(normal=0.05, porn=0.95))))[0]
    assert (got["score"], got["level"], got["matches"]) == (95, "high", ["porn: 95.00%"])


def test_a_filter_on_the_verdict_copies_no_pattern(spark):
    """Its condition would otherwise hold the whole of normalization and detection again."""
    df = R.guard_output(spark.createDataFrame([("a",)], "text string"), "text", D.Pack({"ad": ["x"]}, []), recheck=False).where("rewritten")
    filters = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("regexp" in line for line in filters)
