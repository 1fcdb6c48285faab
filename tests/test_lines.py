"""Numbers of lines in files that are read by byte ranges."""

import hashlib
import random

from textmill.operators import cleaning as C
from textmill.operators import tables
from textmill.sources import lines as L
from textmill.sources import text_sources as S


def test_numbers_in_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    made = {}
    for k, end in enumerate(("\n", "\r\n", "\r")):
        made[f"f{k}.txt"] = [rng.choice(["", "é漢字", "x" * rng.randrange(40), " # a", "b b"]) for _ in range(300)]
        body = end.join(made[f"f{k}.txt"]) + end
        (tmp_path / f"f{k}.txt").write_bytes((b"\xef\xbb\xbf" if k == 0 else b"") + body.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "last.txt").write_bytes(b"one\n\nthree")
    made["last.txt"] = ["one", "", "three"]
    monkeypatch.setattr(tables, "SENT", 0)  # the merged way
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        assert L.text_lines(spark, str(tmp_path), "*.txt").select("start").distinct().count() > 10
        rows = L.numbered_lines(spark, str(tmp_path), "*.txt").collect()
        profile = {r["path"].rpartition("/")[2]: r for r in C.source_profile(spark, str(tmp_path), "*.txt", most=200).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, want in made.items():
        got = sorted((r["line_number"], r["line"]) for r in rows if r["file"].endswith("/" + name))
        assert got == list(enumerate(want, 1))
        blank = lambda x: not x.strip()
        assert (profile[name]["lines"], profile[name]["nonblank_lines"]) == (len(want), sum(not blank(x) for x in want))
    assert "empty.txt" not in profile and profile["f1.txt"]["sha256"] is None
    assert profile["last.txt"]["sha256"] == hashlib.sha256(b"one\n\nthree").hexdigest() and profile["last.txt"]["bytes"] == 10
    one = S.read_labelled_lines(spark, {"x": str(tmp_path / "last.txt"), "y": str(tmp_path / "empty.txt")}).orderBy("source_line").collect()
    assert [(r["text"], r["label"], r["source_file"], r["source_line"]) for r in one] == [("one", "x", "last.txt", 1), ("three", "x", "last.txt", 3)]
