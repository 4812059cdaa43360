"""Trie of conversations by their turns: preorder-interval encoding.

A node is a distinct sequence of first turns. Nodes are ranked lexicographically, which is their
preorder: a node comes right before its subtree, so the subtree is the interval from the node's place
to a stored end. Leaves and savings of a subtree are then differences of prefix sums over the places,
which are taken in the cluster.

A turn stands for itself by 128 bits of the SHA-256 of its role and text. Nodes are ranked in rounds: a
turn's key is the list of turns from the start of its block of BLOCK up to it, distinct keys are sorted
by ranges and a key's place stands for it; the next round does the same with blocks of blocks, whose full
ones before the own count by one rank each. Places keep the order, so after log16(longest conversation)
rounds the rank is that of the whole sequence. No list is longer than BLOCK, whatever the length of a
conversation, and turns are numbered by ranges of (conversation, turn), so one that holds a third of all
rows spreads over many tasks, as do the members of a common first turn.

A node's list of members that end there is hashed as a stream: SHA-256 has an order, so the ids of one
node pass through one task, in pieces of PIECE ids that are made before, and never lie in memory together.

Defined results: rows without a conversation id are one conversation, which takes over no turns, has no
decimal id for the list of ends and is the smallest member only of nodes that it has alone; turns of equal
number are ordered by the hash of role and text, repeated rows are turns of their own; empty and null
texts are equal, as are roles; very long texts are hashed and counted whole and move no further; an empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm import common

#: Turns of a block, and members' ids of a piece that is hashed at once.
BLOCK, PIECE = 16, 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _words(text: Column) -> Column:
    """The number of words between spaces, tabs and line breaks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def numbered(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (talk, conv_id, d, x, words) and conversations (talk, conv_id, turns). ``talk`` numbers
    conversations, also the one without an id; d counts its turns from 1; x is the turn's digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    x = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = common.columns(talks, conv_id="bigint", turn="bigint", role="string", text="string").select("conv_id", "turn", x.alias("x"), _words(text).alias("words"))
    laid = common.placed(common.written(rows, "turns"), ["conv_id", "turn", "x"], "order", "g")
    convs = common.written(laid.groupBy("conv_id").agg(F.min("g").alias("talk"), F.count("*").alias("turns")), "talks")
    starts = convs.select(F.col("conv_id").alias("own"), "talk")
    turns = laid.join(starts, F.col("conv_id").eqNullSafe(F.col("own"))).select("talk", "conv_id", (F.col("g") - F.col("talk") + 1).alias("d"), "x", "words")
    return common.written(turns, "numbered"), convs


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The turns of every conversation c after it takes its first crc32(c) % 4 from conversation c - c % 20,
    in place of as many of its own. A conversation hands at most three turns to at most twenty."""
    c = F.col("conv_id")
    h = F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0).cast("bigint"))
    plan = convs.select("talk", "conv_id", h.alias("h"), (c - c % 20).alias("base"))
    lengths = convs.where(c % 20 == 0).select(c.alias("base"), "turns")
    plan = common.written(plan.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("turns", F.lit(0).cast("bigint")))), "plan")
    kept = turns.join(plan.select("talk", "h", "m"), "talk").where("d > h").select("talk", "conv_id", (F.col("d") - F.col("h") + F.col("m")).alias("d"), "x", "words")
    heads = turns.where((c % 20 == 0) & (F.col("d") <= 3)).select(c.alias("base"), "d", "x", "words")
    taken = plan.where("m > 0").join(heads, "base").where("d <= m").select("talk", "conv_id", "d", "x", "words")
    return common.written(kept.unionByName(taken), "rebuilt")


def ranked(turns: DataFrame) -> DataFrame:
    """Adds to turns (talk, d, x, ...) the node of their sequence of turns: its place in the lexicographic
    order of all distinct ones, from 1, shorter before longer."""
    longest, size = turns.agg(F.max("d")).first()[0] or 0, 1
    while True:
        block = F.expr(f"(d - 1) div {size * BLOCK}")
        turns = turns.withColumn("block", block)
        full = turns.where(F.col("d") % size == 0).groupBy("talk", "block").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("xs"))
        before = F.when(F.col("xs").isNull(), F.array()).otherwise(F.slice(F.col("xs.x"), F.lit(1), F.expr(f"cast((d - 1) div {size} % {BLOCK} as int)")))
        keyed = common.written(turns.join(full, ["talk", "block"], "left").withColumn("key", F.concat(before, F.array("x"))).drop("xs", "block", "x"), "keyed")
        ranks = common.placed(common.written(keyed.select("key").distinct(), "keys"), ["key"], "ranks", "x")
        turns = common.written(keyed.join(ranks, "key").drop("key"), "ranked")
        size *= BLOCK
        if size >= longest:
            return turns.withColumn("node", F.col("x") + 1).drop("x")


def build(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (talk, conv_id, d, x, words) of all ``convs`` (talk, conv_id):
    node and end (its interval in preorder), depth, parent, conv_id (smallest member), n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. Node 0 is the root."""
    everyone = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    if not everyone["n_convs"]:
        none = "node bigint, end bigint, depth bigint, parent bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
        return convs.sparkSession.createDataFrame([], none)
    turns = ranked(turns)
    last = common.written(turns.groupBy("talk").agg(F.max("node").alias("last")), "last")
    found = turns.join(last, "talk").groupBy("node").agg(
        F.max("last").alias("end"), F.max("d").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("talk").alias("talk")
    )
    found = common.written(found, "nodes")
    # a node's parent is where any one of its members stood a turn before
    above = turns.select("talk", (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
    zero = F.lit(0).cast("bigint")
    found = found.join(above, ["talk", "depth"], "left").withColumn("parent", F.coalesce("parent", zero))
    count = last.agg(F.max("last")).first()[0] or 0
    root = convs.limit(1).select(
        zero.alias("talk"), zero.alias("depth"), zero.alias("node"), F.lit(count).cast("bigint").alias("end"), F.lit(everyone["conv_id"]).cast("bigint").alias("conv_id"),
        F.lit(everyone["n_convs"]).cast("bigint").alias("n_convs"), zero.alias("words"), F.lit(None).cast("bigint").alias("parent"),
    )
    nodes = common.written(found.unionByName(root).drop("talk"), "tree")
    kids = nodes.where("node > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    summed = common.written(common.running(common.written(nodes, "weighed"), "node", ["leaf", "saved"], count + 1), "summed")
    ends = summed.select(F.col("node").alias("end"), F.col("leaf_to").alias("leaf_end"), F.col("saved_to").alias("saved_end"))
    # the root's children are as many as there are first turns: their parent's member is known already
    parents = summed.where("node > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = summed.where("parent > 0").join(parents, "parent")
    flat = summed.where("parent is null or parent = 0").withColumn("parent_conv_id", F.when(F.col("parent") == 0, F.lit(everyone["conv_id"]).cast("bigint")))
    whole = deep.unionByName(flat).join(ends, "end").join(ended(convs, last), "node", "left")
    return whole.select(
        "node", "end", "depth", "parent", "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_end") - F.col("leaf_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which follow each other in order."""
    node, h = None, None
    for b in batches:
        nodes, out = [], []
        for k, ids in zip(b.column("node").to_pylist(), b.column("ids")):
            if k != node:
                if h is not None:
                    nodes.append(node), out.append(h.hexdigest())
                node, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.as_py().encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "ends_sha256": pa.array(out, pa.string())})
    if h is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "ends_sha256": pa.array([h.hexdigest()], pa.string())})


def ended(convs: DataFrame, last: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the comma-joined ascending ids of the members that end at the node."""
    pairs = convs.where("conv_id is not null").join(last, "talk", "left").select(F.coalesce("last", F.lit(0).cast("bigint")).alias("node"), "conv_id")
    pairs = common.placed(common.written(pairs, "ends"), ["node", "conv_id"], "ends", "g").withColumn("piece", F.expr(f"g div {PIECE}"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = pairs.groupBy("node", "piece").agg(ids.alias("ids"))
    spans = pairs.groupBy("node").agg((F.min("piece") < F.max("piece")).alias("several"))
    pieces = common.written(pieces.join(spans, "node"), "pieces")
    one = pieces.where(~F.col("several")).select("node", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    more = pieces.where("several").select("node", "piece", "ids").repartition("node").sortWithinPartitions("node", "piece")
    return one.unionByName(more.select("node", "ids").mapInArrow(_stream, "node bigint, ends_sha256 string"))


def digest(talks: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    turns, convs = numbered(talks)
    return build(rebuilt(turns, convs), convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS d FROM conversations),
c AS (SELECT conv_id, count(*) AS turns, coalesce({common.sql_crc32("conv_id::VARCHAR")} % 4, 0) AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
m AS (SELECT c.*, least(c.h, coalesce(b.turns, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT m.conv_id, t.d - m.h + m.m AS d, t.role, t.text FROM m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id WHERE t.d > m.h
  UNION ALL SELECT m.conv_id, t.d, t.role, t.text FROM m JOIN t ON t.conv_id = m.base WHERE t.d <= m.m),
p AS (SELECT conv_id, d, text, list(sha256(concat(strlen(role), ':', role, text))) OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT m.conv_id, coalesce(q.k, []) AS k FROM m LEFT JOIN (SELECT conv_id, arg_max(k, d) AS k FROM p GROUP BY conv_id) q ON q.conv_id IS NOT DISTINCT FROM m.conv_id) GROUP BY k),
nodes AS (SELECT k, len(k) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS saved FROM p GROUP BY k
  UNION ALL SELECT []::VARCHAR[], 0, min(conv_id), count(*), 0 FROM m HAVING count(*) > 0),
kids AS (SELECT k[1:len(k) - 1] AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
w AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
sums AS (SELECT k[1:i] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS i FROM w) GROUP BY 1)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN sums s USING (k) LEFT JOIN nodes u ON w.depth > 0 AND u.k = w.k[1:w.depth - 1] LEFT JOIN ends e ON e.k = w.k
"""
