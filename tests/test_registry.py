"""Steps and detectors of the user's own, and those switched off."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import decide as R
from textmill.functions import detect as D
from textmill.functions import normalize as N
from textmill.sources import text_sources as S


def test_steps_at_their_places(spark):
    seen = N.user_function(lambda t: t + "!")
    maps = N.Maps(emoji=[("a", "b")]).with_step("bang", seen, before="emoji").with_step("twice", lambda t: F.concat(t, t)).with_step("bang2", seen, before="emoji")
    assert [n for n, _ in N.steps(maps)][2:5] == ["bang", "bang2", "emoji"] and N.steps(maps)[-1][0] == "twice"
    df = spark.createDataFrame([(1, "XaX"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r for r in N.normalize_with_trace(df, "text", maps.without("noise_char", "unicode")).collect()}
    assert got[1]["normalized"] == "xbx!!" * 2 and got[2]["normalized"] is None and got[3]["normalized"] == "!!!!"
    assert [s["normalizer"] for s in got[1]["steps"]] == ["case", "bang", "bang2", "emoji", "twice"]
    assert got[1]["steps"][1]["before"] == "xax" and got[1]["steps"][1]["after"] == "xax!"
    off = N.normalize_with_trace(df, "text", maps.without("noise_char", "unicode", "bang")).where("id = 1").first()
    assert [s["normalizer"] for s in off["steps"]] == ["case", "bang2", "emoji", "twice"]
    plain = df.select(N.normalize(F.col("text"), maps.without("bang", "bang2", "twice")).alias("n")).first()["n"]
    assert plain == "xbx"
    for bad in (lambda: maps.without("nothing"), lambda: maps.with_step("case", seen), lambda: maps.with_step("new", seen, before="nothing")):
        with pytest.raises(ValueError, match="step"):
            bad()


def test_detectors_decide(spark):
    find = lambda t: [{"category": "violence", "level": "high", "score": 90, "source": "rule_own", "matches": ["boo"]}] if "boo" in t else []
    df = spark.createDataFrame([(1, "boo mail@a.com"), (2, "word"), (3, None), (4, "")], "id int, text string")
    rules = [("ad", "[a-z]+@a.com", "medium", 60, "mail")]
    rows = lambda pack: {r["id"]: [d["source"] for d in r["d"] or []] for r in df.select("id", D.detect_rules(F.col("text"), pack).alias("d")).collect()}
    own = {"own": D.user_detector(find)}
    assert rows(D.Pack({"ad": ["word"]}, rules, detectors=own)) == {1: ["regex", "rule_own"], 2: ["keyword"], 3: [], 4: []}
    assert rows(D.Pack({"ad": ["word"]}, rules, detectors=own, off=["own", "keyword"]))[2] == [] and rows(D.Pack({}, [], off=["keyword", "regex"]))[1] == []
    verdict = {r["id"]: r["action"] for r in R.filter_text(df, "text", D.Pack({}, rules, detectors=own)).collect()}
    assert verdict[1] == "block" and verdict[2] == "pass"
    with pytest.raises(ValueError, match="no detectors"):
        D.Pack({}, [], off=["nothing"])


def test_rules_are_checked_in_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "x", "category": "ad", "pattern": "a+", "score": 5}, {"name": "y", "pattern": "("}, {"name": "z", "pattern": ""}, {"name": "n"}]')
    (tmp_path / "b.json").write_text('[{"name": "w", "category": "ad", "pattern": "b"}]')
    got = S.read_regex_rules(spark, str(tmp_path))
    assert sorted(r["name"] for r in got.collect()) == ["w", "x"] and S.read_regex_rules(spark, str(tmp_path / "none")).count() == 0
