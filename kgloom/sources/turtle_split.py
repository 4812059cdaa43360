"""Turtle files in parts: one file is read by many tasks, and cut at lines that end a statement.

Spark's text reader cuts a file into blocks of lines. A line begins in plain text or inside a long string;
short strings, IRIs and comments end with their line. A first pass therefore follows the three states that a
block may begin in to its end, over the lines alone that can change the state or hold a directive; one row a
block comes to the driver, which puts states, prefixes and bases together. In a second pass whole statements
are parsed where they lie; what is cut by a block's edge is sent on and put together with its other part.

Directives must be whole on a line, and no line may end within a short string; other files are read whole.
Generated blank nodes are named by the place of their block and their number in it.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.model import TRIPLES
from kgloom.sources.rdfxml_split import _blocks
from kgloom.sources.turtle import _TOKEN, parsed, resolved
from kgloom.sources.whole import triple_batches

#: States between lines: plain, inside a string of three " or of three '.
PLAIN, DOUBLE, SINGLE = range(3)
_QUOTES = {'"""': DOUBLE, "'''": SINGLE}
_ENDS = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"""', re.DOTALL), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'''", re.DOTALL)}
#: What can change the state or hold a directive, for Python and for the JVM.
_SPECIAL = r"\"\"\"|'''|\\$|[pP][rR][eE][fF][iI][xX]|[bB][aA][sS][eE]"
_special = re.compile(_SPECIAL)
_ABSOLUTE = re.compile(r"<[A-Za-z][A-Za-z0-9+.\-]*:")
#: Terms that may hold a '#' or a dot.
_TERM = re.compile(r"""<[^<>"{}|^`\s]*>|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|\\.""")
#: Characters of whole statements that are parsed at once.
CHUNK = 1 << 18


def step(state: int, line: str) -> tuple[int, bool, list | None]:
    """(state, whether a statement ends, directives as (prefix or None, IRI)) after a line without its end. The
    directives are None where the line holds a part of one, or ends within a short string."""
    if not _special.search(line):
        if state != PLAIN:
            return state, False, []
        if "#" in line:
            line = _TERM.sub("_", line).partition("#")[0]
        line = line.rstrip()
        return PLAIN, line.endswith(".") and not line.endswith("\\."), []
    line += "\n"
    at, tokens = 0, []
    if state != PLAIN:
        m = _ENDS[state].match(line)
        if not m:
            return state, False, []
        at, tokens, state = m.end(), [("str", "")], PLAIN
    whole = True
    while at < len(line):
        opens = _QUOTES.get(line[at : at + 3])
        if opens and not _ENDS[opens].match(line, at + 3):
            state = opens
            break
        m = _TOKEN.match(line, at)
        if not m:  # if it isn't an error, which shows when it is parsed, a short string goes on
            whole = False
            break
        at = m.end()
        if m.lastgroup == "str" and opens is None and "\n" in m[0]:
            whole = False
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
    found = []
    for i, (kind, text) in enumerate(tokens):
        word = text.lower()
        if kind == "word" and word in ("prefix", "base") or kind == "lang" and word in ("@prefix", "@base") and (i == 0 or tokens[i - 1][0] != "str"):
            rest = tokens[i + 1 : i + 4]
            name = rest.pop(0) if word.endswith("prefix") and rest else None
            if not rest or rest[0][0] != "iri" or (name is None) != word.endswith("base") or word[0] == "@" and [x[1] for x in rest[1:2]] != ["."]:
                return state, False, None
            found.append((name and name[1][:-1], rest[0][1]))
    return state, state == PLAIN and tokens[-1:] == [("mark", ".")], found if whole else None


def _applied(env: tuple[dict, str], directives: list) -> tuple[dict, str]:
    """(prefixes, base) after directives."""
    prefixes, base = env
    for name, iri in directives:
        if name is None:
            base = resolved(iri, base)
        else:
            prefixes = prefixes | {name: resolved(iri, base)}
    return prefixes, base


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block that has lines of interest: by the state it begins in, the state at its end and its
    directives, none twice in a row."""
    for (path, block), lines in _blocks(batches):
        now, found, known = [PLAIN, DOUBLE, SINGLE], [[], [], []], [{}, {}, {}]
        for line in lines:
            line = line.lstrip("\ufeff") if block == 0 else line
            steps = {s: step(s, line) for s in set(now)}
            for i, s in enumerate(now):
                now[i], _, directives = steps[s]
                if directives is None:
                    found[i] = None
                for name, iri in directives or () if found[i] is not None else ():
                    if known[i].get(name) == iri and (name is not None or _ABSOLUTE.match(iri)):
                        continue
                    # IRIs of prefixes may depend on the base
                    known[i] = known[i] | {name: iri} if name is not None else {None: iri}
                    found[i].append((name, iri))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([json.dumps([now, found])])], ["path", "block", "ends"])


def _plan(rows: list, base) -> tuple[dict, list[str]]:
    """path -> (starts of blocks, (state, prefixes, base) behind them), and files that can't be cut."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["path"], []).append((r["block"], *json.loads(r["ends"])))
    out, odd = {}, []
    for path, blocks in by.items():
        state, env, starts, behind = PLAIN, ({}, base(path)), [], []
        for block, now, found in sorted(blocks, key=lambda x: x[0]):
            if found[state] is None:
                odd.append(path)
                break
            env, state = _applied(env, found[state]), now[state]
            starts.append(block)
            behind.append((state, *env))
        else:
            out[path] = (starts, behind)
    return out, odd


OUT = TRIPLES.fieldNames()
_KINDS = ", ".join(f"{c} string" for c in OUT)


def read(spark: SparkSession, paths: list[str], whole, graph: str | None = None) -> DataFrame:
    """Triples of Turtle files; ``whole(paths)`` reads files that can't be cut."""
    from kgloom.operators.settle import settled

    plain = lambda p: unquote(re.sub(r"^file:/+", "/", p))
    # the reader of whole files writes paths another way
    given = {plain(p): p for p in paths}
    base = lambda p: given.get(plain(p), p)
    rows = _lines(spark, paths).where(F.col("value").rlike(_SPECIAL)).mapInArrow(_followed, "path string, block bigint, ends string").collect()
    plan, odd = _plan(rows, base)
    known = spark.sparkContext.broadcast((plan, frozenset(odd)))

    def triples(path: str, text: str, prefixes: dict, base: str, fresh: Iterator[str]) -> Iterator[pa.RecordBatch]:
        me = graph or given.get(plain(path), path)
        yield from triple_batches((me, *t) for t in parsed(text, base, prefixes, fresh))

    def with_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.nulls(len(b), k) for k in (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())]], [*OUT, "path", "block", "tail", "env", "text"])

    def edge(path: str, block: int, tail: bool, env: tuple | None, lines: list[str]) -> pa.RecordBatch:
        cells = [*[pa.nulls(1, pa.string())] * len(OUT), pa.array([path]), pa.array([block], pa.int64()), pa.array([tail]), pa.array([env and json.dumps(env)], pa.string()), pa.array(["\n".join(lines)])]
        return pa.RecordBatch.from_arrays(cells, [*OUT, "path", "block", "tail", "env", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, odd = known.value
        for (path, block), lines in _blocks(batches):
            if path in odd:
                continue
            starts, behind = plan.get(path, ([], []))
            i = bisect.bisect_left(starts, block)
            state, *env = behind[i - 1] if i else (PLAIN, {}, given.get(plain(path), path))
            fresh = (f"b{block}_{n}" for n in itertools.count())
            # before the first end of a statement, the lines belong to a block before; block 0 has none
            head, held, size = block > 0, [], 0  # whole statements
            begun, since = [], env  # the one that is open, and what holds where it begins
            first = env
            for line in lines:
                if block == 0 and not held and not begun:
                    line = line.lstrip("\ufeff")
                state, ends, directives = step(state, line)
                begun.append(line)
                if directives:
                    env = _applied(env, directives)
                if not ends:
                    continue
                if head:
                    yield edge(path, block, False, None, begun)
                    head, first = False, env
                else:
                    held += begun
                    size += sum(map(len, begun))
                begun, since = [], env
                if size >= CHUNK:
                    yield from with_edge(triples(path, "\n".join(held), *first, fresh))
                    held, size, first = [], 0, env
            if held:
                yield from with_edge(triples(path, "\n".join(held), *first, fresh))
            yield edge(path, block, not head, None if head else since, begun)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, block, env, text in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("env").to_pylist(), b.column("text")):
                yield from triples(path, text.as_py(), *json.loads(env), (f"b{block}_x{n}" for n in itertools.count()))

    parts = settled(_lines(spark, paths).mapInArrow(cut, _KINDS + ", path string, block bigint, tail boolean, env string, text string"))
    # a statement at an edge: the tail of a block, and all up to the next tail; two rows a block
    order = Window.partitionBy("path").orderBy("block", "tail")
    edges = parts.where("text is not null").withColumn("n", F.sum(F.col("tail").cast("int")).over(order))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("block", "tail", "text"))), lambda x: x["text"])
    edges = edges.groupBy("path", "n").agg(F.min("block").alias("block"), F.max("env").alias("env"), F.array_join(pieces, "\n").alias("text"))
    out = parts.where("text is null").select(*OUT).unionByName(edges.mapInArrow(joined, _KINDS))
    return out.unionByName(whole([base(p) for p in odd])) if odd else out
