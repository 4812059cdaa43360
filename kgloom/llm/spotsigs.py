"""Document fingerprints by SpotSigs.

A spot is an occurrence of a common word (an anchor). Its signature is the anchor with the chain
of the next ``CHAIN`` content words: the words at every ``DISTANCE``-th place after it that are
not common themselves. A text's fingerprint is the set of its signatures, each hashed to 32 bits,
written as sorted hexadecimal. Texts without a complete chain fall back on chains from every
word, and texts shorter than that on the words themselves, so only texts without any word have
the empty fingerprint. Likeness is the Jaccard resemblance of two sets; two empty sets are alike.

``near_duplicates`` joins fingerprints: sets are partitioned by their length into bands so wide
that two sets at the threshold lie in the same or in neighbouring bands. Within a band pair,
candidates share one of the rarest signatures of each (its prefix), the lengths must allow the
threshold, and the Jaccard itself stops as soon as the threshold is out of reach. In a group of
candidates every set meets the group's leader first; sets that are like the same leader are a cluster and
in one class already. Of clusters that meet in a group the leaders are compared, and their members only if the
leaders are neither alike, nor joined by others, nor too far apart for any of them, so a crowd of near copies costs as much as it has
members, whichever set leads a group.

Defined results: a null text is empty; the order is by falling doc_id, null last of all, ties and
repeated rows by the hash of the text; a very long text is read whole; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm import common
from kgloom.llm.simhash import components

CHAIN, DISTANCE, THRESHOLD = 2, 1, 0.8
#: Sets whose signatures are spread at once.
SPREAD = 64
#: Common words of four languages, the anchors.
ANCHORS = frozenset(
    "a an the is are was were be been of to in on at by for from with and or not that this it as he she they have has had do does did can will there which "
    "le la les un une des du de et est sont était dans pour par sur avec qui que ne pas ce cette il elle au aux en "
    "der die das ein eine einer eines dem den des und ist sind war im in von zu zum zur mit auf für nicht als auch es sich "
    "el los las uno una unos unas del al y es son fue en por para con no se lo su como más".split()
)
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_~`^+=@“”‘’«»¿¡…"


def _words(text: str) -> list[str]:
    return [w for w in [w.strip(_EDGES) for w in text.lower().split()] if w]


def signatures(text: str | None, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct 32-bit signatures of the whole text."""
    from xxhash import xxh32_intdigest as h

    words = _words(text or "")
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    body = [words[i] for i in content]
    # the content words after place i start at rank[i]
    rank = np.searchsorted(np.array(content), np.arange(len(words)), "right") if content else np.zeros(len(words), int)
    span = (chain - 1) * distance + 1
    spots = [(words[i], r) for i, r in enumerate(rank.tolist()) if words[i] in ANCHORS and r + span <= len(body)]
    if spots:
        tails = [" ".join(body[i : i + span : distance]) for i in range(len(body) - span + 1)]
        found = {f"{a} {tails[r]}" for a, r in spots}
    else:
        n = min(chain + 1, len(words))
        found = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    return np.unique(np.fromiter((h(x) for x in found), np.uint32, len(found)))


def to_text(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 as soon as it can't reach ``least``: lengths bound it from
    the start, and halves of the value range bound what is still to come."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if len(a) < least * len(b):
        return 0.0
    if least > 0 and len(a) > 64:
        i, j = len(a) // 2, np.searchsorted(b, a[len(a) // 2])
        common_most = np.isin(a[:i], b[:j], assume_unique=True).sum() + min(len(a) - i, len(b) - j)
        if common_most < least * (len(a) + len(b) - common_most):
            return 0.0
    both = int(np.isin(a, b, assume_unique=True).sum())
    out = both / (len(a) + len(b) - both)
    return out if out >= least else 0.0


def band(n: int, threshold: float = THRESHOLD) -> int:
    """Partition of a set by its length: sets of Jaccard >= threshold are at most one band apart."""
    return 0 if n == 0 else 1 + int(math.log(n) / -math.log(threshold) + 1e-9)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, in
    descending order of doc_id; the first document follows the last.

    Whole texts move once, by ranges of doc_id and, within an id that fills several ranges, of the
    text's hash. The document that opens a range is also sent, as a boundary record, to the range
    before it, whose last document needs it; which documents do is found beforehand from ids and
    hashes alone."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("k"), F.xxhash64(text).alias("tie"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    ids = common.written(rows.select("k", "tie"), "ids")
    cuts = Counter(int(x) for x in ids.select(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).collect()[0][0] or []) if n > 1 else {}
    # ranges go down the ids; a range ends after the rows of a cut, and an id that is a cut several
    # times is also cut by hash, evenly, as hashes are
    down = np.array(sorted(k for k, m in cuts.items() for _ in range(m)), np.int64)
    within = {k: np.array([(j << 64) // m - (1 << 63) for j in range(1, m)], np.int64) for k, m in cuts.items() if m > 1}

    @F.pandas_udf("int")
    def range_of(k, tie):
        import pandas as pd

        k, tie = k.to_numpy(np.int64), tie.to_numpy(np.int64)
        out = len(down) - np.searchsorted(down, k, "right")
        for key, ties in within.items():
            at = np.flatnonzero(k == key)
            out[at] += np.searchsorted(ties, tie[at], "right")
        return pd.Series(out.astype(np.int32))

    # the opening row of every range that has rows; one row a range comes to the driver
    opens = ids.groupBy(range_of("k", "tie").alias("r")).agg(F.max(F.struct("k", F.bitwise_not("tie").alias("t"))).alias("first")).collect()
    opens = {x["r"]: (x["first"]["k"], ~x["first"]["t"]) for x in opens}
    order = sorted(opens)
    back = [(*opens[r], order[i - 1]) for i, r in enumerate(order)]  # the first range's opening closes the last
    table = common.driver_table(spark, back, "k bigint, tie bigint, before int")
    placed = rows.withColumn("r", range_of("k", "tie")).join(table, ["k", "tie"], "left")
    home = F.struct(F.col("r").alias("r"), F.lit(0).alias("boundary"))
    copy = F.struct(F.col("before").alias("r"), F.lit(1).alias("boundary"))
    sent = placed.select("k", "tie", "doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, copy))).alias("to"))
    sent = sent.select(F.col("to.r").alias("r"), F.col("to.boundary").alias("boundary"), "k", "tie", "doc_id", "text")
    sent = sent.repartitionById(len(down) + 1, "r").sortWithinPartitions("r", "boundary", F.desc("k"), "tie")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length_band"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]

    def run(batches):
        held = None  # (range, doc_id, text, signatures) of the row before

        def result(this, text, sigs):
            alter = edited(this[2], text)
            esigs = signatures(alter)
            return [this[1], len(this[2]), hashlib.sha256(alter.encode("utf-8", "surrogatepass")).hexdigest(), to_text(this[3]), to_text(esigs), jaccard(this[3], esigs), jaccard(this[3], sigs), band(len(this[3]))]

        for b in batches:
            out = []
            for r, boundary, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                t = t.as_py()
                if boundary and (held is None or held[0] != r):
                    continue  # a further boundary record: ties of the opening document
                sigs = signatures(t)
                if held is not None and held[0] == r:
                    out.append(result(held, t, sigs))
                held = None if boundary else (r, doc, t, sigs)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_band int"
    return sent.select("r", "boundary", "doc_id", "text").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, length_band)"""

    def run(batches):
        for b in batches:
            sigs = [signatures(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(s) for s in sigs]), pa.array([band(len(s)) for s in sigs], pa.int32())], ["doc_id", "fingerprint", "length_band"])

    read = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id bigint, fingerprint string, length_band int")


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, band, n, sig): a row a signature of the sets (s, band, fingerprint)."""
    for batch in batches:
        s, bands = (batch.column(i).to_numpy() for i in (0, 1))
        for at in range(0, len(batch), SPREAD):
            sigs = [from_text(x.as_py()) for x in batch.column(2).slice(at, SPREAD)]
            n = np.array([len(x) for x in sigs], np.int32)
            cols = [np.repeat(s[at : at + SPREAD], n), np.repeat(bands[at : at + SPREAD], n), np.repeat(n, n), np.concatenate(sigs).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["s", "band", "n", "sig"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, class_id (the least doc_id reachable by links of
    Jaccard >= threshold). Equal fingerprints collapse first; the rest meet by rare signatures."""
    prints = common.written(fingerprints(docs, id_col, text_col), "spots")
    sets = common.written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.first("length_band").alias("band")).withColumn("s", F.xxhash64("fingerprint")), "sets")
    n = (F.length("fingerprint") / 8).cast("int")
    flat = sets.where(F.length("fingerprint") > 0).select("s", "band", "fingerprint").mapInArrow(spread, "s bigint, band int, n int, sig bigint")
    # signatures of one set alone come first in it and lead to no other, so they are only counted
    counted = flat.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    w = Window.partitionBy("s")
    ranked = flat.join(counted, "sig").withColumn("rank", F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("df", "sig")))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("s", "band", "n", "sig")
    prefix = common.written(prefix, "prefix")
    # a group: the sets of a band and of the one above that share a rare signature
    member = prefix.select("s", "n", "sig", F.explode(F.array("band", F.col("band") - 1)).alias("group"))
    leader = member.groupBy("sig", "group").agg(F.min("s").alias("leader"), F.count("*").alias("size")).where("size > 1").drop("size")
    member = common.written(member.join(leader, ["sig", "group"]), "members")
    texts = sets.select("s", "fingerprint", n.alias("n"))

    def likeness(pairs: DataFrame) -> DataFrame:
        """(a, b, least, j) of the distinct pairs of (a, b, na, nb, least) whose Jaccard j is ``least`` or more."""
        pairs = pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.col("least")).select("a", "b", "least").distinct()
        full = pairs.join(texts.select(F.col("s").alias("a"), F.col("fingerprint").alias("fa")), "a").join(texts.select(F.col("s").alias("b"), F.col("fingerprint").alias("fb")), "b")
        return common.written(full.select("a", "b", "least", "fa", "fb").mapInArrow(run, "a bigint, b bigint, least double, j double"), "alike")

    def run(batches):
        for batch in batches:
            least = batch.column(2).to_numpy()
            j = np.array([jaccard(from_text(x.as_py()), from_text(y.as_py()), m) for m, x, y in zip(least.tolist(), batch.column(3), batch.column(4))], float)
            keep = pa.array(j >= least)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(keep) for i in range(3)], pa.array(j).filter(keep)], ["a", "b", "least", "j"])

    # first every member against its group's leader; two that are both like one need no look at each other
    lead = lambda c, size: texts.select(F.col("s").alias(c), F.col("n").alias(size))
    first = member.where("s <> leader").join(lead("leader", "nb"), "leader")
    near = likeness(first.select(F.col("s").alias("a"), F.col("leader").alias("b"), F.col("n").alias("na"), "nb", F.lit(threshold).alias("least")))
    # a cluster: the sets whose first leader among those they are like is the same
    mine = near.groupBy(F.col("a").alias("s")).agg(F.min("b").alias("k"))
    member = common.written(member.join(mine, "s", "left").select("sig", "group", "s", "n", F.coalesce("k", "s").alias("k")), "clusters")
    # of clusters that meet in a group, the leaders are compared. Jaccard's distance is a metric, so sets of two
    # clusters can only be alike if their leaders are within a link and the ways to both leaders
    way = mine.groupBy("k").agg(F.lit(1 - threshold).alias("way"))
    cluster = member.select("sig", "group", "k").distinct().join(lead("k", "n"), "k").join(way, "k", "left")
    one = lambda c: cluster.select("sig", "group", F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.coalesce("way", F.lit(0.0)).alias(f"way_{c}"))
    met = one("a").join(one("b"), ["sig", "group"]).where("a > b")
    leaders = likeness(met.select("a", "b", "na", "nb", F.greatest(F.lit(0.0), F.lit(threshold - 1e-9) - F.col("way_a") - F.col("way_b")).alias("least")))
    sure = common.written(near.unionByName(leaders.where(F.col("j") >= threshold)).select("a", "b"), "sure")
    joint = common.written(components(sure), "joint")
    # where that leaves it open, and the clusters aren't one by others in between, the members meet
    side = lambda k, s: member.select("sig", "group", F.col("k").alias(k), F.col("s").alias(s), F.col("n").alias(f"n{s}"))
    rest = leaders.where(F.col("j") < threshold).select(F.col("a").alias("ka"), F.col("b").alias("kb"))
    for k in ("ka", "kb"):
        rest = rest.join(joint.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")), k, "left")
    rest = rest.where(F.coalesce("cka", "ka") != F.coalesce("ckb", "kb")).select("ka", "kb")
    rest = rest.join(side("ka", "a"), "ka").join(side("kb", "b"), ["sig", "group", "kb"])
    others = likeness(rest.select("a", "b", "na", "nb", F.lit(threshold).alias("least")))
    # what is joint is a star by now
    links = joint.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(others.select("a", "b"))
    found = common.written(components(links), "classes")
    named = sets.join(found, sets.s == found.node, "left").select("fingerprint", F.coalesce("component", "s").alias("c"), "least")
    named = common.written(named, "named")
    names = common.written(named.groupBy("c").agg(F.min("least").alias("class_id")), "names")
    table = common.written(named.join(names, "c").select("fingerprint", "class_id"), "table")
    return prints.join(table, "fingerprint").select("doc_id", "fingerprint", "class_id")
