"""Merkle manifest of a table: parent-preimage paths.

Every row is a leaf, rows of a source are a tree and the roots of the sources are the leaves of one
more tree. A parent's preimage, the concatenated hashes of its children (at most ``FAN``), is stored
with it. A leaf's proof is the list of its ancestors' preimages with its own slot in each: cutting the
slot's 64 characters out leaves the siblings, putting another hash in and hashing gives the next
node, up to the root.

Leaves get their places by ranges of (source, id, hash), so a source that holds a third of all rows
spreads over many tasks; a parent is an aggregate of at most FAN rows. Levels are written, each a
sixteenth of the one below. Paths are joined from the top down, parents first, so a leaf meets all its
ancestors in one join on its parent. Nothing but the number of sources, the largest source's size and
the root comes to the driver.

Defined results: a null field is ``-`` in its leaf and a null source is a source; rows without an id come
before the others and are never tampered with; rows of equal id are ordered by their leaf's hash, and
repeated rows are leaves of their own, side by side; an empty text is ``0:``; texts are hashed whole; an
empty table has no root and gives no rows. Other columns, whatever their names, are neither read nor hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common

#: Children of a node, and characters of a hash.
FAN, SLOT = 16, 64
#: Sources up to which their table is broadcast; names are a few dozen bytes.
SOURCES = 50_000

FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The hash of fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    named = [x.cast("string") for x in fields]
    return _hash(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in named]))


@dataclass
class Manifest:
    """leaves: (key columns, leaf, tree, pos, n) with n leaves in the tree; levels: (tree, pos, n, preimage,
    hash) of every level above them; tops: (tree, subroot, path to the root); root: None of an empty table."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    root: str | None


def _climb(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The levels above nodes (tree, pos, n, hash), of which a tree has at most ``most``: a parent for every
    FAN consecutive nodes while a tree has several."""
    levels = []
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct("pos", "hash")))
        up = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("at")).agg(F.max("n").alias("n"), F.concat_ws("", F.transform(kids, lambda k: k["hash"])).alias("preimage"))
        nodes = common.written(up.select("tree", F.col("at").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "preimage", _hash(F.col("preimage")).alias("hash")), name)
        levels.append(nodes)
        most = -(-most // FAN)
    return levels


PATH = "array<struct<preimage:string,slot:bigint>>"


def _with_path(nodes: DataFrame, parents: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Adds to nodes (tree, pos, n, ...) their subroot and their path: (preimage, own slot) of each ancestor,
    nearest first. Only a root, one of its level in a tree, takes its path from tops; any other goes by its parent."""
    out = nodes.where("n = 1").join(tops, "tree")
    if parents is None:
        return out
    up = parents.select("tree", F.col("pos").alias("up"), F.col("preimage").alias("above"), F.col("path").alias("rest"), "subroot")
    below = nodes.where("n > 1").withColumn("up", F.expr(f"pos div {FAN}")).join(up, ["tree", "up"])
    step = F.array(F.struct(F.col("above").alias("preimage"), (F.col("pos") % FAN).alias("slot")))
    return out.unionByName(below.withColumn("path", F.concat(step, "rest")).drop("up", "above", "rest"))


def build(rows: DataFrame, group_col: str, order_col: str, keep: list[str], leaf_col: str = "leaf") -> Manifest:
    """The manifest of rows that have their leaf hash. ``keep`` are further columns that leaves carry along."""
    spark = rows.sparkSession
    cols = list(dict.fromkeys([*keep, group_col, order_col, leaf_col]))
    flat = rows.select(*cols)
    laid = common.placed(flat, [group_col, order_col, leaf_col], "leaves", "g")
    groups = common.written(laid.groupBy(F.col(group_col).alias("group")).agg(F.min("g").alias("start"), F.count("*").alias("n")), "sources")
    # leaves lie in the order of their sources, so the places of first leaves order the sources
    groups = common.placed(groups, ["start"], "trees", "tree")
    many, most = groups.agg(F.count("*"), F.max("n")).first()
    if not many:
        none = spark.createDataFrame([], f"tree bigint, subroot string, path {PATH}")
        return Manifest(flat.withColumns({c: F.lit(0).cast("bigint") for c in ("tree", "pos", "n")}), [], none, None)
    side = F.broadcast(groups) if many <= SOURCES else groups
    leaves = laid.join(side, F.col(group_col).eqNullSafe(F.col("group"))).select(*cols, "tree", (F.col("g") - F.col("start")).alias("pos"), "n")
    levels = _climb(leaves.select("tree", "pos", "n", F.col(leaf_col).alias("hash")), most, "level")
    subroots = leaves.where("n = 1").select("tree", F.col(leaf_col).alias("hash"))
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "hash"))
    subroots = common.written(subroots, "subroots")

    # the subroots are the leaves of one more tree
    firsts = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(many).cast("bigint").alias("n"), F.col("hash"))
    upper = _climb(firsts, many, "upper")
    root = upper[-1].first()["hash"] if upper else subroots.first()["hash"]
    end = spark.createDataFrame([(0, root, [])], f"tree bigint, subroot string, path {PATH}")
    paths = None
    for level in [*reversed(upper), firsts]:
        paths = _with_path(level, paths, end)
    tops = paths.select(F.col("pos").alias("tree"), F.col("hash").alias("subroot"), "path")
    return Manifest(leaves, levels, common.written(tops, "tops"), root)


def paths(m: Manifest) -> DataFrame:
    """The leaves with their subroot and their path to the root."""
    above = None
    for level in reversed(m.levels):
        above = _with_path(level, above, m.tops)
    return _with_path(m.leaves, above, m.tops)


def siblings(path: str) -> Column:
    """What is left of the preimages of a path without the own slot, from the leaf up."""
    cut = lambda a: F.concat(_left(a), _right(a))
    return F.concat_ws("", F.transform(path, cut))


def fold(leaf: Column, path: str) -> Column:
    """The root that a leaf gives: put in its slot, hashed, put in that node's slot, and so on."""
    return F.aggregate(path, leaf, lambda h, a: _hash(F.concat(_left(a), h, _right(a))))


def _left(a: Column) -> Column:
    return F.substring(a["preimage"], F.lit(1), (a["slot"] * SLOT).cast("int"))


def _right(a: Column) -> Column:
    return F.substring(a["preimage"], ((a["slot"] + 1) * SLOT + 1).cast("int"), F.lit(FAN * SLOT))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document, with its proof and the root that its leaf, or its tampered leaf, folds to."""
    docs = common.columns(docs, **FIELDS)
    fields = lambda text: [F.col(c) for c in FIELDS if c != "text"] + [text]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("doc_id", "source", leaf_of(fields(F.col("text"))).alias("leaf"), F.when(hit, leaf_of(fields(lower))).alias("tampered"))
    m = build(common.written(rows, "hashed"), "source", "doc_id", ["doc_id", "tampered"])
    root = F.lit(m.root).cast("string")
    proofs = paths(m).select("doc_id", "leaf", "subroot", root.alias("root"), _hash(siblings("path")).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), "path").alias("folded_root"))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 9) -> str:
    """The same rows in SQL, by as many levels as 16^levels rows a tree need: nodes alone in their tree pass through."""
    row = lambda text: "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({x}::VARCHAR), ':', {x}::VARCHAR), '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = common.sql_crc32("doc_id::VARCHAR")
    out = f"""WITH leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {row("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {row(lower)} END AS tampered FROM documents)),
a0 AS (SELECT source AS tree, pos, n, leaf AS hash FROM leaves)"""

    def climb(k: str) -> str:
        more = ""
        for i in range(levels):
            more += f""",
{k}p{i + 1} AS (SELECT tree, pos // 16 AS pos, max(n) AS n, string_agg(hash, '' ORDER BY pos) AS pre FROM {k}{i} GROUP BY 1, 2),
{k}{i + 1} AS (SELECT tree, pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN pre ELSE sha256(pre) END AS hash FROM {k}p{i + 1})"""
        return more

    out += climb("a") + f""",
subroots AS (SELECT tree AS source, hash AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS spot, count(*) OVER () AS many FROM a{levels}),
b0 AS (SELECT 0 AS tree, spot AS pos, many AS n, subroot AS hash FROM subroots)""" + climb("b")
    step = lambda h, pre, pos, n: (f"CASE WHEN {n} = 1 THEN '' ELSE concat(substr({pre}, 1, 64 * ({pos} % 16)), substr({pre}, 64 * ({pos} % 16) + 65)) END", f"CASE WHEN {n} = 1 THEN {h} ELSE sha256(concat(substr({pre}, 1, 64 * ({pos} % 16)), {h}, substr({pre}, 64 * ({pos} % 16) + 65))) END")
    out += """,
w0 AS (SELECT l.doc_id, l.leaf, l.pos, l.source, s.subroot, s.spot, '' AS sib, coalesce(l.tampered, l.leaf) AS h FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source)"""
    for i in range(2 * levels):
        k, j, at = ("a", i, "pos") if i < levels else ("b", i - levels, "spot")
        sib, h = step("w.h", "p.pre", f"(w.{at} // {16**j})", "p.n")
        on = "w.source IS NOT DISTINCT FROM p.tree AND " if k == "a" else ""
        out += f""",
w{i + 1} AS (SELECT w.* REPLACE (concat(w.sib, {sib}) AS sib, {h} AS h) FROM w{i} w JOIN {k}p{j + 1} p ON {on}w.{at} // {16 ** (j + 1)} = p.pos)"""
    return out + f"""
SELECT doc_id, leaf, subroot, r.hash AS root, sha256(sib) AS proof_sha256, h AS folded_root, h = r.hash AS verified FROM w{2 * levels} CROSS JOIN b{levels} r
"""


SQL = _sql(5)
