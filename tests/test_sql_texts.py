"""The SQL of noise and personal data says what the operators do, however close matches stand."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill.functions import normalize as N
from textmill.functions.fixed_values import NOISE
from textmill.plans import registry

PIECES = ["a", "é", "7", "_", "@", ".", "%", "#", "·", "-", "+", " ", "\n", "中", "a_b@c.com", "x.y@d-e.org", ".a@b.de", "4444 5555 ", "1234-5678-1234-5678", "13812345678", "+86", "86-", "86 ", "11010519491231002", "X", "x"]
FIXED = ["a@b.com c@d.com e@f.com", "foo#.a@b.com", "foo#a@b.com#x", "中 文\n字", "a__b a_b_c_d", " ".join(f"{i:04d}" for i in range(1, 12)), "13812345678 13812345678+8613812345678 5+8613812345678", "11010519491231002X 110105194912310021", None, ""]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at, rng = str(tmp_path_factory.mktemp("texts")), random.Random(4)
    texts = FIXED + ["".join(rng.choices(PIECES, k=rng.randrange(1, 14))) for _ in range(6000)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at, texts


@pytest.mark.parametrize("name", ["n5_norm_noise", "d5_mask_privacy"])
def test_noise_and_masks_say_the_same(spark, corpus, name):
    at, texts = corpus
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{at}/documents.parquet/*.parquet')")
    want = {r[0]: r for r in con.execute(registry.oracle_sql()[name]).fetchall()}
    wrong = [texts[r[0]] for r in map(tuple, registry.queries()[name](spark, at).collect()) if want[r[0]] != r and texts[r[0]] is not None]
    assert not wrong, (len(wrong), wrong[:5])


#: Marks that may stand next to an address without being part of it.
BESIDE = [",", ";", ":", "<", "=", ">", "?", "/", "(", "!", "'", '"']
NEXT = [f"{a}a_b@c.com{b}in" for a in ["", *BESIDE] for b in BESIDE] + ["x.69@mail9.example.comin, of", "a@b.com/c@d.org;e@f.de"]


def without_noise(t: str) -> str:
    """The rule, one character after another: an address is a whole run of its characters."""
    held = {i for m in re.finditer(r"[A-Za-z0-9._%+@-]+", t) if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", m[0]) for i in range(*m.span())}
    near = lambda i, test: 0 < i < len(t) - 1 and test(t[i - 1]) and test(t[i + 1])
    drop = lambda i: (t[i] in NOISE and i not in held and near(i, str.isalnum)) or (t[i].isspace() and near(i, lambda c: "一" <= c <= "鿿"))
    return "".join(c for i, c in enumerate(t) if not drop(i))


def test_marks_next_to_an_address(spark, tmp_path):
    rng = random.Random(5)
    texts = NEXT + ["".join(rng.choices(PIECES[:20] + BESIDE + ["a_b@c.com", "x.y@d-e.org"], k=rng.randrange(1, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in df.select("doc_id", N.norm_noise(F.col("text")).alias("n"), F.size(N.noise_removed(F.col("text"))).alias("dropped")).collect()}
    wrong = [(t, got[i]["n"]) for i, t in enumerate(texts) if got[i]["n"] != without_noise(t) or got[i]["dropped"] != len(t) - len(without_noise(t))]
    assert not wrong, (len(wrong), wrong[:5])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("n5_norm_noise", "r9_detect"):
        want = {r[0]: r for r in con.execute(registry.oracle_sql()[name]).fetchall()}
        wrong = [texts[r[0]] for r in map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()) if want[r[0]] != r]
        assert not wrong, (name, len(wrong), wrong[:5])
