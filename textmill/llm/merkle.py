"""Merkle manifest of a table by slot pivot.

Each row is a leaf: the hash of its fields, each as its length and value. Leaves of a tree (here: a language) are numbered in
order; FANOUT consecutive nodes have a parent. Conditional aggregates spread a parent's children into one column a slot; the
columns concatenated make the parent's hash, and all columns but a child's own are its siblings. Levels are made bottom-up
until each tree has one node, its subroot; subroots are the leaves of one more tree, whose last node is the root. Siblings
then go down: a child's are its own and its parent's, so that the rows of the lowest pivot, an eighth of the leaves, take part
in the last join, and leaves come out of their parent's slots.

Texts are read once, for the leaves. Leaves are numbered by ranges of their order, so a language or an id that most rows have
is spread over many tasks; a number is the row's place in its range and the counts of the ranges before it, a row a range
and tree. Each level is a table in the shared folder and has an eighth of the rows below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a range, and the most ranges there are: beyond, ranges grow, and are sorted on disk.
RANGE, RANGES = 16_384, 4096
#: Rows of the table of ranges that are sent to all tasks; a larger one is joined by a shuffle.
SENT = 65_536
PATH = "array<struct<l:string,r:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts concatenated as UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field in a leaf: - if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return digest(*map(field, fields))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0) and cnt of each row within its tree, in ascending order of the columns `order`. Rows equal in them
    are in any order, which must make no difference."""
    own = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    own = written(own, "rows")  # the salt is fixed from here
    ranges = min(own.count() // RANGE + 1, RANGES)
    keys = ["tree", *order, "_salt"]
    dealt = own.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    dealt = written(dealt.drop("_salt"), "ranges")
    spans = dealt.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # a row a range
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select("tree", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("cnt")), "spans")
    side = F.broadcast(spans) if spans.count() <= SENT else spans.hint("merge")
    return dealt.join(side, ["tree", "_range"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "cnt")


def pivoted(nodes: DataFrame, node: Column) -> DataFrame:
    """A row a parent (tree, pos, cnt: nodes of its level in the tree, hash) with its children in columns s0, s1, …: the struct
    `node`, which holds a hash, or null."""
    slot = F.pmod("pos", F.lit(FANOUT))
    slots = [F.max(F.when(slot == i, node)).alias(f"s{i}") for i in range(FANOUT)]
    rows = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos")).agg(*slots, F.expr(f"(max(cnt) + {FANOUT - 1}) div {FANOUT}").alias("cnt"))
    return rows.withColumn("hash", F.sha2(F.concat_ws("", *(F.col(f"s{i}.hash") for i in range(FANOUT))).cast("binary"), 256))


def children(parents: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """A row a child of the parents that hold `path`: tree, pos, node, path (its siblings, left and right of it, then its
    parent's) and the columns `carry`."""
    beside = lambda some: F.concat_ws("", *(F.col(f"s{j}.hash") for j in some))
    one = [
        F.struct(F.lit(i).alias("slot"), F.col(f"s{i}").alias("node"), F.struct(beside(range(i)).alias("l"), beside(range(i + 1, FANOUT)).alias("r")).alias("own"))
        for i in range(FANOUT)
    ]
    each = parents.select("tree", "pos", "path", *carry, F.explode(F.array(*one)).alias("c")).where("c.node is not null")
    return each.select("tree", (F.col("pos") * FANOUT + F.col("c.slot")).alias("pos"), F.col("c.node").alias("node"), F.concat(F.array("c.own"), "path").alias("path"), *carry)


def levels_of(nodes: DataFrame, node: Column) -> tuple[list[DataFrame], DataFrame]:
    """The pivots of all levels, lowest first, each a table, and the subroots: tree, pos (0), hash, cnt (1), level.
    nodes: tree, pos, cnt and what `node` reads. A tree of one node is its own subroot, on level 0."""
    most = nodes.agg(F.max("cnt")).first()[0] or 0
    roots, levels, here, made = nodes.where("cnt = 1").select("tree", "pos", node["hash"].alias("hash"), F.lit(0).alias("level")), [], nodes, node
    while most > 1:
        levels.append(written(pivoted(here.where("cnt > 1"), made), "level"))
        here, made = levels[-1].select("tree", "pos", "cnt", "hash"), F.struct("hash")
        roots = roots.unionByName(here.where("cnt = 1").select("tree", "pos", "hash", F.lit(len(levels)).alias("level")))
        most = -(-most // FANOUT)
    return levels, roots


def paths_down(levels: list[DataFrame], tops: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The children of the lowest pivot with their paths. tops: tree, pos, level, path and `carry` of each subroot."""
    keep = ["tree", "pos", "path", *carry]
    above = tops.where(F.col("level") == len(levels)).select(*keep)
    for at in range(len(levels) - 1, -1, -1):
        # one row a parent on both sides, sorted on disk if need be
        found = children(levels[at].select("tree", "pos", *(f"s{i}" for i in range(FANOUT))).join(above.hint("merge"), ["tree", "pos"]), carry)
        if at == 0:
            return found
        above = written(found.select(*keep).unionByName(tops.where(F.col("level") == at).select(*keep)), "paths")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """id_col, tree_col, leaf, subroot, root, n_siblings, proof_sha256 (of the siblings from the leaf's run up to the root's,
    left to right), folded_root (from the leaf as found now and the original siblings) and verified of each row.

    Within a tree leaves ascend by id (null first), rows with one id by their leaf; trees ascend by tree_col (null first, UTF-8
    bytewise), null being a tree of its own. Rows equal in all fields are leaves of their own with equal hashes; any null field
    counts as such. tampered: a Column that is true where the leaf is found with the text in ASCII lower case (null: false).
    Empty and long texts are fields like others; an empty table gives no row; other columns are not read."""
    tree = F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(tree_col).cast("string")))
    values = {c: F.col(c) for c in fields}
    changed = leaf_hash([lower_ascii(values[c]) if c == text_col else values[c] for c in fields])
    found = F.when(F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False)), changed)
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("_id"), leaf_hash(list(values.values())).alias("leaf"), found.alias("now"))
    leaves = written(numbered(leaves, ["_id", "leaf"]), "leaves")

    # the hash first, so that a node's columns are compared by it
    levels, subroots = levels_of(leaves, F.struct(F.col("leaf").alias("hash"), F.col("_id").alias("id"), F.col("now").alias("now")))
    subroots = written(subroots, "subroots")
    # one tree over all subroots
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", "level"), ["name"])
    tops = written(tops, "tops")
    upper, root = levels_of(tops, F.struct("hash", "name", "level"))
    root = root.select(F.col("hash").alias("root"))  # one row, none for an empty table
    none = F.array().cast(PATH)
    over = F.col("node.name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("node.level").alias("level"), F.col("path"), F.col("node.hash").alias("subroot")
    if upper:
        start = root.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(len(upper)).alias("level"), none.alias("path"), "root")
        tops = written(paths_down(upper, start, ["root"]).select(*over, "root"), "tops")
    else:
        tops = tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "level", none.alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    keep = ["subroot", "root"]
    lone = leaves.where("cnt = 1").select("tree", "pos", F.struct(F.col("leaf").alias("hash"), F.col("_id").alias("id"), F.col("now").alias("now")).alias("node"))
    out = lone.join(tops.where("level = 0").hint("shuffle_hash"), ["tree", "pos"]).select("tree", "pos", "node", "path", *keep)
    if levels:
        out = out.unionByName(paths_down(levels, tops, keep))
    beside = F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "")
    own = F.coalesce("node.now", "node.hash")
    folded = F.aggregate("path", own, lambda at, x: F.sha2(F.concat(x["l"], at, x["r"]).cast("binary"), 256))
    out = out.select(
        F.col("node.id").alias(id_col), F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias(tree_col), F.col("node.hash").alias("leaf"), *keep,
        (F.length(beside) / 64).cast("long").alias("n_siblings"), F.sha2(beside.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_slot_pivot_manifest(spark, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=third).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("lang"), "n_siblings")


def manifest_sql(levels: int = 6) -> str:
    """DuckDB SQL of the query for trees of up to 8 ** levels leaves; a level unrolled each."""
    put = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar)::varchar || ':' || {c}::varchar end"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(map(put, FIELDS))
    sql = [
        f"l as (select *, sha256({leaf}) as leaf, case when {crc_sql('doc_id::varchar')} % 3 = 0 then sha256({leaf.replace(put('text'), put(low))}) end as now from documents)",
        "d as (select *, coalesce('+' || lang, '') as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p0, row_number() over () as rid from l)",
        "n0 as (select tree, p0 as pos, leaf as hash, count(*) over (partition by tree) as cnt from d)",
    ]
    for side, depth in (("n", levels), ("m", levels)):
        if side == "m":
            sql.append(f"m0 as (select '' as tree, row_number() over (order by tree) - 1 as pos, hash, count(*) over () as cnt, tree as name from n{levels})")
        for k in range(depth):
            a, b = f"{side}{k}", f"{side}{k + 1}"
            sql.append(f"{b} as (select tree, case when cnt > 1 then pos // 8 else pos end as pos, case when max(cnt) > 1 then sha256(string_agg(hash, '' order by {a}.pos)) else max(hash) end as hash, max((cnt + 7) // 8) as cnt from {a} group by tree, case when cnt > 1 then pos // 8 else pos end)")
    # each leaf's place, level by level
    n = 0
    sql.append("f0 as (select rid, tree, p0 as pos, '' as proof, coalesce(now, leaf) as fold from d)")
    for side in "nm":
        if side == "m":
            sql.append(f"f{n + 1} as (select rid, '' as tree, m0.pos, proof, fold from f{n} join m0 on m0.name = f{n}.tree)")
            n += 1
        for k in range(levels):
            a = f"{side}{k}"
            near = f"(select tree, case when cnt > 1 then pos // 8 else pos end as up, list(hash order by pos) as hs, max(cnt) as cnt from {a} group by 1, 2)"
            at = "(f.pos % 8)::BIGINT"
            left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
            sql.append(f"f{n + 1} as (select rid, f.tree, case when cnt > 1 then f.pos // 8 else f.pos end as pos, case when cnt > 1 then proof || {left} || {right} else proof end as proof, case when cnt > 1 then sha256({left} || fold || {right}) else fold end as fold from f{n} f join {near} g on g.tree = f.tree and g.up = case when cnt > 1 then f.pos // 8 else f.pos end)")
            n += 1
    return f"""with {', '.join(sql)}
select d.doc_id, d.leaf, s.hash as subroot, r.hash as root, sha256(f.proof) as proof_sha256, f.fold as folded_root, f.fold = r.hash as verified, d.lang, (length(f.proof) // 64)::BIGINT as n_siblings
from d join f{n} f using (rid) join n{levels} s on s.tree = d.tree cross join m{levels} r"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a short text in DuckDB, a byte at a time."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: {_crc_byte('xor(a, b)')}))"


def _crc_byte(v: str) -> str:
    """The register v (its low byte already mixed in) after eight shifts, by a table lookup on its low byte."""
    entries = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        entries.append(c)
    return f"xor(({v}) >> 8, ({entries})[(({v}) & 255) + 1]::BIGINT)"
