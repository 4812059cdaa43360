"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents stand in a seeded order, cell by cell, where a cell is the part of a
source in one shard (a hash of the document's id, text and source). Their words form one line, cut into blocks of
``BLOCK`` words; only a source's last block is shorter. Seats go to the highest quotients
votes / (2 s + 1). First the words of the mix are dealt so, with the sources' targets as votes: a
source's number of words is its target, rounded. As many whole blocks as fit into it are its seats,
apportioned to its shards by the same rule, with the blocks that start in a shard as votes, so
every (source, shard) has an integer quota.

A cell with b blocks and quota q takes all its blocks q div b times and q mod b of them once more:
a run of neighbours in the seeded order, from a seeded place, wrapping round. As the order of
documents is seeded, a run is a random choice of documents of which only the ends are cut.
Quotas never exceed 2 b. The words that blocks leave (less than a block, and what short blocks
lack) are dealt out again: runs are prolonged where the line is taken least, so a source below a
block has its words too, and each source takes its number of words exactly. No document is taken
more than twice.

Highest quotients over many seats are found by their divisor: the seats of a party are its votes
over a common divisor, rounded; the divisor is bisected until the seats add up. Only the totals of
the sources come to the driver; the about sqrt(rows) / 3 cells of a source are dealt in a task.

Defined results: the size of a null text is 0 and nothing is taken from it; null is a source of its
own, last in the order; a null doc_id orders first; repeated rows are documents of their own; a very
long text is a document like any other, which may be taken in part; an empty table gives no rows;
columns other than id, text and source travel along unchanged in ``materialize``, whatever their
names, but for the number of characters.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kgloom.llm import common

BLOCK, SEED = 64, 17
WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD)
#: Copies of a repeated row that one task makes at a time.
CHUNK = 1000


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Water-filling: ``share`` of all sizes dealt by weight; a source stops at ``most`` times its
    size and what it can't take is dealt again by weight until none is above."""
    left = min(Fraction(sum(sizes)) * share, Fraction(sum(sizes) * most))
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit >= most * sizes[i]}
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else weights[i] * unit
            left -= out[i]
        open_ = open_ - full if full else set()
    return out


def sainte_lague(votes: list[Fraction], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties go to the earlier party, no party gets more than ``most``."""
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def given(price: Fraction) -> list[int]:
        """Seats whose quotient votes / (2 s + 1) is at least price."""
        return [min(m, int((v / price + 1) // 2)) if v > 0 else 0 for v, m in zip(votes, most)]

    high, low = 2 * max(votes), Fraction(1, 1)
    while sum(given(low)) < seats:
        low /= 1 << 16
    for _ in range(200):
        mid = Fraction(float((low + high) / 2))
        if not low < mid < high:
            break
        if sum(given(mid)) >= seats:
            low = mid
        else:
            high = mid
    out, more = given(high), given(low)
    # between two neighbouring prices only equal quotients, or as good as equal, are left
    for i in sorted(range(len(votes)), key=lambda i: (-votes[i] / (2 * out[i] + 1), i)):
        rest = seats - sum(out)
        if rest <= 0:
            break
        out[i] += min(more[i] - out[i], rest)
    return out


def _start(cell: tuple[int, int], blocks: int, seed: int) -> int:
    """Seeded place at which a cell's run begins."""
    x = (cell[0] * 0x9E3779B97F4A7C15 + cell[1] * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & ((1 << 64) - 1)
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & ((1 << 64) - 1)
    return (x ^ (x >> 29)) % blocks


Piece = tuple[int, int, int]  # from, to, times: words on the line of a source and how often they are taken


def _joined(pieces: list[Piece]) -> list[Piece]:
    """Without empty pieces, neighbours taken equally often made one."""
    out: list[Piece] = []
    for a, b, n in pieces:
        if a < b:
            if out and out[-1][2] == n and out[-1][1] == a:
                a = out.pop()[0]
            out.append((a, b, n))
    return out


def _prolonged(line: list[Piece], rest: int) -> list[Piece]:
    """``rest`` more words, from the pieces taken least, where a run ends if there is such a place."""
    while rest > 0:
        least = min(n for _, _, n in line)
        open_ = [i for i, x in enumerate(line) if x[2] == least]
        i = next((i for i in open_ if i and line[i - 1][2] > least), open_[0])
        a, b, n = line[i]
        end = min(b, a + rest)
        rest -= end - a
        line = _joined([*line[:i], (a, end, n + 1), (end, b, n), *line[i + 1 :]])
    return line


def aims(sizes: list[int], weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> tuple[list[Fraction], list[int]]:
    """(targets, words to take) of the sources in their order."""
    aim = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    return aim, sainte_lague(aim, round(sum(aim)), [most * n for n in sizes])


def lay(number: int, own: list[tuple[int, int]], words: int, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> list[tuple[int, int, list[Piece]]]:
    """Quotas of one source's cells. own: (shard, words) by shard. Returns (shard, base, pieces), the
    pieces in order and together all words of the cell."""
    at, starts = 0, []
    for _, n in own:
        starts.append((at, -(-at // block), -(-(at + n) // block) - -(-at // block)))  # base, first block, blocks
        at += n
    size = at
    quota = sainte_lague([Fraction(b) for _, _, b in starts], words // block, [most * b for _, _, b in starts])
    line = []
    for (shard, _), (_, first, b), q in zip(own, starts, quota):
        if b:
            passes, run = divmod(q, b)
            begin = _start((number, shard), b, seed)
            wrapped = max(0, begin + run - b)
            for x, y, n in ((0, wrapped, 1), (wrapped, begin, 0), (begin, begin + run - wrapped, 1), (begin + run - wrapped, b, 0)):
                line.append(((first + x) * block, min((first + y) * block, size), passes + n))
    line = _joined(line)
    line = _prolonged(line, words - sum((b - a) * n for a, b, n in line))
    out, i = [], 0
    for (shard, n), (base, _, _) in zip(own, starts):
        pieces = []
        while n and i < len(line):
            a, b, times = line[i]
            pieces.append((max(a, base), min(b, base + n), times))
            if b > base + n:
                break
            i += 1
            if b == base + n:
                break
        out.append((shard, base, pieces))
    return out


def plan(cells: list[tuple[int, int, int]], weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[list, list]:
    """Quotas of all sources. cells: (source number, shard, words), every source from 0 on present.

    Returns the sources' (number, size, target) and per cell (number, shard, base, pieces)."""
    of: dict[int, list] = {}
    for s, shard, n in sorted(cells):
        of.setdefault(s, []).append((shard, n))
    size = [sum(n for _, n in own) for own in of.values()]
    aim, words = aims(size, weights, share, most)
    sizes = [(s, n, float(x)) for s, n, x in zip(of, size, aim)]
    return sizes, [(s, *x) for (s, own), w in zip(of.items(), words) for x in lay(s, own, w, most, block, seed)]


def tie_of(text_col: str = "text", source_col: str = "source") -> F.Column:
    """A hash of text and source; rows that share it and the id are told apart by nothing in the mix."""
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string")
    return F.xxhash64(text, source, source.isNull(), text.isNull())


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: Fraction = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, tie (a hash of text and source), source, size, source_size, target, taken, passes, spans.

    ``passes`` is how often the whole document is taken; ``spans`` are the (from, to) word ranges
    taken besides, in order. taken = passes * size + the spans' words."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")).alias("size"),
        F.xxhash64(F.lit(seed).cast("bigint"), F.col(f"`{id_col}`").cast("bigint"), tie_of(text_col, source_col)).alias("order"), tie_of(text_col, source_col).alias("tie"),
    )
    base = common.written(base, "mixing")
    shards = max(1, math.ceil(math.sqrt(base.count()) / 3))
    base = base.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    cells = common.written(base.groupBy("source", "shard").agg(F.sum("size").alias("n")), "cells")
    # the driver holds one row a source; the cells of a source meet in a task of their own
    sizes = {r["source"]: r["size"] for r in cells.groupBy("source").agg(F.sum("n").alias("size")).collect()}
    names = sorted(sizes, key=lambda x: (x is None, x))  # by code point, null last
    aim, words = aims([sizes[x] for x in names], weights, share, most)
    kind = "name string, number int, source_size bigint, target double, words bigint"
    sources = common.driver_table(spark, [(x, i, sizes[x], float(aim[i]), words[i]) for i, x in enumerate(names)], kind)

    def laid(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard", kind="stable")
        first = own.iloc[0]
        number = int(first["number"])
        got = lay(number, list(zip(own["shard"].tolist(), own["n"].tolist())), int(first["words"]), most, block, seed)
        pieces = [[{"from": a, "to": b, "times": n} for a, b, n in x[2]] for x in got]
        return pd.DataFrame({"number": number, "shard": [x[0] for x in got], "base": [x[1] for x in got], "pieces": pieces})

    cells = cells.join(sources, cells["source"].eqNullSafe(sources["name"])).select("number", "shard", "n", "words")
    quotas = cells.groupBy("number").applyInPandas(laid, "number int, shard int, base bigint, pieces array<struct<from:bigint,to:bigint,times:bigint>>")
    quotas = common.written(quotas, "quotas")
    numbered = base.join(sources, base["source"].eqNullSafe(sources["name"])).drop("name", "words")
    w = Window.partitionBy("number", "shard").orderBy("order", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    j = numbered.withColumn("end", F.sum("size").over(w)).join(quotas, ["number", "shard"])
    c, b = F.col, F.col("base") + F.col("end")
    j = j.select("doc_id", "tie", "source", "size", "source_size", "target", (b - c("size")).alias("a"), b.alias("b"), "pieces")
    # word ranges on the line of the source
    a, b, zero = c("a"), c("b"), F.lit(0).cast("bigint")
    hit = F.transform(
        F.filter("pieces", lambda x: (x["from"] < b) & (x["to"] > a)),
        lambda x: F.struct((F.greatest(x["from"], a) - a).alias("from"), (F.least(x["to"], b) - a).alias("to"), x["times"].alias("times")),
    )
    j = j.withColumn("hit", hit)
    taken = F.aggregate("hit", zero, lambda n, x: n + (x["to"] - x["from"]) * x["times"])
    j = j.withColumn("taken", taken).withColumn("passes", F.coalesce(F.array_min(F.transform("hit", lambda x: x["times"])), zero))
    spans = F.flatten(F.transform("hit", lambda x: F.array_repeat(F.struct(x["from"].alias("from"), x["to"].alias("to")), (x["times"] - c("passes")).cast("int"))))
    return j.select("doc_id", "tie", "source", "size", "source_size", "target", "taken", "passes", spans.alias("spans"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def cut(text: str, first: int, last: int) -> str:
    """From word ``first`` of the text to the one before ``last``, with what stands between them."""
    start = end = 0
    for i, m in enumerate(islice(_WORDS.finditer(text), last)):
        start, end = (m.start() if i == first else start), m.end()
    return text[start:end]


def materialize(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                source_col: str = "source") -> DataFrame:
    """The mix as rows of ``docs``: one for each pass over the whole document, unchanged, and one for
    each span taken besides, with the text from the span's first word to its last and its own
    length in ``chars_col``, where docs has that column. Documents of which nothing is taken are left out.

    ``mixed`` must come from the same docs; rows are told by id, text and source. Rows that repeat all
    three are settled on their counts: they stand in the order of their hashes, equal ones as one with
    a number, and the takes of the mix, numbered likewise, are laid on them."""
    key = ["none", "k", "tie"]
    named = lambda i: [i.isNull().alias("none"), F.coalesce(i, F.lit(0).cast("bigint")).alias("k")]
    up_to = lambda *by: F.sum("copies").over(Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    takes = mixed.select(*named(F.col("doc_id")), "tie", "passes", "spans").groupBy(*key, "passes", "spans").agg(F.count("*").alias("copies"))
    takes = common.written(takes, "takes")
    repeated = common.written(takes.groupBy(key).agg(F.sum("copies").alias("rows")).where("rows > 1").select(key), "repeated")
    rows = docs.select(*named(F.col(f"`{id_col}`").cast("bigint")), tie_of(text_col, source_col).alias("tie"), F.struct("*").alias("row"))
    if not repeated.isEmpty():
        several = rows.join(repeated, key, "left_semi").groupBy(*key, common.row_hash().alias("variant")).agg(F.any_value("row").alias("row"), F.count("*").alias("copies"))
        several = common.written(several.withColumn("last", up_to("variant")).drop("variant"), "several")
        of = takes.join(repeated, key, "left_semi").withColumn("end", up_to("passes", "spans"))
        laid = F.least("last", "end") - F.greatest(F.col("last") - F.col("r.copies"), F.col("end") - F.col("t.copies"))
        laid = several.drop("row").alias("r").join(of.alias("t"), key).select(*key, "last", "passes", "spans", laid.alias("copies")).where("copies > 0")
        rows = rows.join(repeated, key, "left_anti").withColumn("last", F.lit(0).cast("bigint")).unionByName(several.select(*key, "row", "last"))
        takes = takes.join(repeated, key, "left_anti").withColumn("last", F.lit(0).cast("bigint")).unionByName(laid)
        key = [*key, "last"]
    # at most CHUNK copies a row, so that copies of a row without number are spread
    spread = lambda n: F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"), F.lit(CHUNK).cast("bigint")), lambda i: F.least(n - i, F.lit(CHUNK))))
    again = lambda df: df.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_"), *[c for c in df.columns if c == "span"])
    whole = takes.where("passes > 0").select(*key, spread(F.col("passes") * F.col("copies")).alias("n"))
    whole = again(rows.join(whole, key).select("row", "n")).select("row.*")
    spans = takes.where("size(spans) > 0").select(*key, "copies", F.explode("spans").alias("span")).select(*key, "span", spread(F.col("copies")).alias("n"))
    spans = again(rows.join(spans, key).select("row", "n", "span"))
    fields = ["row.`" + c.replace("`", "``") + "`" for c in docs.columns]
    at = docs.columns.index(text_col)
    others = [i for i, c in enumerate(docs.columns) if c not in (text_col, chars_col)]
    part = spans.select(*[F.col(fields[i]).alias(f"c{i}") for i in others], F.col(fields[at]).cast("string").alias("text"), F.col("span.from").alias("from"), F.col("span.to").alias("to"))
    schema = T.StructType([*part.schema.fields[: len(others)], T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            n = len(others)
            new = [cut(t.as_py() or "", x, y) for t, x, y in zip(b.column(n), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(new, pa.string())], [f"c{i}" for i in others] + ["text"])

    part = part.mapInArrow(run, schema)
    made = {text_col: F.col("text"), chars_col: F.length("text")} | {docs.columns[i]: F.col(f"c{i}") for i in others}
    return whole.unionByName(part.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in docs.schema.fields]))
