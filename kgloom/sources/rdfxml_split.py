"""RDF/XML files in parts: one file is read by many tasks, and cut at its top-level nodes.

Spark's text reader cuts a file into blocks of records that end with '>', from any store it can read. Where
a block begins, a task can't know whether it is inside a comment, a quoted value or an element. A first
pass therefore follows every state that a block may begin in to its end, with the change of depth; one row
a block comes to the driver, which puts the steps together. In a second pass each block knows its state and
depth: whole top-level nodes are parsed where they lie, behind the file's own header; what is cut by a
block's edge is sent on as a fragment and put together with the rest of its node.

Generated blank nodes are named by the place of their block and their number in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.model import TRIPLES

#: States between records: plain, inside a comment, CDATA, a processing instruction, a value in " or in '.
PLAIN, COMMENT, CDATA, INSTRUCTION, DOUBLE, SINGLE = range(6)
_ENDS = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?"}
_QUOTE = {DOUBLE: '"', SINGLE: "'"}
#: Characters of whole nodes that are parsed at once.
CHUNK = 1 << 18


def step(state: int, record: str) -> tuple[int, int]:
    """(state, change of depth) after a record, which is followed by '>'."""
    if state in _ENDS:
        return (PLAIN, 0) if record.endswith(_ENDS[state]) else (state, 0)
    at = 0
    if state == PLAIN:
        at = record.find("<")
        if at < 0:
            return PLAIN, 0
        for mark, kind, least in (("<!--", COMMENT, 6), ("<![CDATA[", CDATA, 11), ("<?", INSTRUCTION, 3)):
            if record.startswith(mark, at):
                return (PLAIN if record.endswith(_ENDS[kind]) and len(record) - at >= least else kind), 0
        if record.startswith("</", at):
            return PLAIN, -1
    quote = _QUOTE.get(state)
    for m in re.finditer("[\"']", record[at:]):
        quote = m[0] if quote is None else None if m[0] == quote else quote
    if quote:
        return (DOUBLE if quote == '"' else SINGLE), 0
    return PLAIN, 0 if record.endswith("/") else 1


def header_of(records: Iterator[str]) -> str | None:
    """What stands before the first top-level node, the root's start tag last; None if there is no such root."""
    taken, state, doctype = [], PLAIN, False
    for r in records:
        taken.append(r)
        if doctype:
            doctype = not r.rstrip().endswith("]")
            continue
        if state == PLAIN and r.lstrip().startswith("<!DOCTYPE"):
            doctype = "[" in r and not r.rstrip().endswith("]")
            continue
        before = state
        state, depth = step(state, r)
        if depth > 0:
            head = ">".join(taken) + ">"
            return re.sub(r"^\s*﻿?\s*<\?xml[^>]*\?>", "", head)
        if before == PLAIN and state == PLAIN and not re.search(r"<[!?]|^\s*$", r):
            return None
    return None


def _root(header: str) -> str:
    return re.findall(r"<([^\s<>!?/]+)", re.sub(r"<!--.*?-->", "", header, flags=re.S))[-1] if header else ""


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", ">").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((path, block), records) of the blocks of a task, which come one after the other; each must be used up."""
    rows = ((key, v) for b in batches for key, v in zip(zip(b.column("path").to_pylist(), b.column("block").to_pylist()), b.column("value").to_pylist()))
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead[0]

        def own() -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[1]
                ahead = next(rows, None)

        records = own()
        yield key, records
        for _ in records:
            pass


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block: its header if it opens a file, and for each state it may begin in the state and depth at its
    end and the least depth in between at which no tag is open."""
    for (path, block), records in _blocks(batches):
        head = header_of(records) if block == 0 else None
        ends = {s: (s, 0, None) for s in range(6)}  # by state at the beginning
        for r in records:
            moves = {s: step(s, r) for s in {x[0] for x in ends.values()}}
            for s, (now, depth, low) in ends.items():
                now, by = moves[now]
                depth += by
                ends[s] = (now, depth, low if now in _QUOTE else depth if low is None else min(low, depth))
        cols = [[path], [block], [head], [[x[0] for x in ends.values()]], [[x[1] for x in ends.values()]], [[x[2] for x in ends.values()]]]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "block", "head", "state", "depth", "low"])


def _plan(rows: list) -> tuple[list[tuple], list[str]]:
    """(path, block, header, state, depth, owner) of every block, and files that can't be cut. The owner is the block
    in which the node began that is open where a block begins."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["path"], []).append(r)
    out, whole = [], []
    for path, blocks in by.items():
        blocks.sort(key=lambda r: r["block"])
        head = blocks[0]["head"]
        if blocks[0]["block"] or head is None or _root(head).rpartition(":")[2] != "RDF" or head.rstrip().endswith("/>"):
            whole.append(path)
            continue
        state, depth, owner = PLAIN, 1, None
        for r in blocks:
            out.append((path, r["block"], head, state, depth, owner))
            low = r["low"][state]
            if owner is None or low is not None and depth + low <= 1:
                owner = r["block"]  # a node that is open at the end began here
            state, depth = r["state"][state], depth + r["depth"][state]
            if depth <= 1 and state not in _QUOTE:
                owner = None
    return out, whole


OUT = TRIPLES.fieldNames()


def read(spark: SparkSession, paths: list[str], parse, whole, graph: str | None = None) -> DataFrame:
    """Triples of RDF/XML files. ``parse(text, base, fresh)`` gives the triples of a document, with names for blank
    nodes; ``whole(paths)`` reads files that can't be cut, such as a root that is itself a node."""
    from kgloom.operators.settle import settled

    table, odd = _plan(_records(spark, paths).mapInArrow(_followed, "path string, block bigint, head string, state array<bigint>, depth array<bigint>, low array<bigint>").collect())
    known = spark.sparkContext.broadcast({(r[0], r[1]): r[2:] for r in table})
    # the reader of whole files writes paths another way
    plain = lambda p: unquote(re.sub(r"^file:/+", "/", p))
    given = {plain(p): p for p in paths}
    odd = [given.get(plain(p), p) for p in odd]

    def triples(path: str, head: str, nodes: str, name: str) -> list[tuple]:
        root, path = _root(head), given.get(plain(path), path)
        fresh = (f"{name}_{i}" for i in range(1 << 62))
        return [(graph or path, *t) for t in parse(f"{head}{nodes}</{root}>", path, fresh)]

    def rows(found: list[tuple], path=None, owner=None, block=None, text=None) -> pa.RecordBatch:
        cols = list(zip(*found)) if found else [[None]] * len(OUT)
        n = len(found) or 1
        return pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.string()) for c in cols], pa.array([path] * n, pa.string()), pa.array([owner] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([text] * n, pa.string())], [*OUT, "path", "owner", "block", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), records in _blocks(batches):
            if (path, block) not in known.value:
                continue
            head, state, depth, owner = known.value[path, block]
            if block == 0:
                header_of(records)
            held, size, node, number = [], 0, [], 0  # whole nodes, and the one that is open
            inside = depth > 1 or state in _QUOTE
            for r in records:
                opened = inside or state == PLAIN and "<" in r
                state, by = step(state, r)
                depth += by
                if not opened or depth < 1 or not inside and state in _ENDS:
                    continue
                still = depth > 1 or state in _QUOTE
                node.append(r + ">")
                if not still:
                    if owner is not None:  # the end of a node that began in an earlier block
                        yield rows([], path, owner, block, "".join(node))
                        owner = None
                    else:
                        held += node
                        size += sum(map(len, node))
                    node = []
                inside = still
                if size >= CHUNK:
                    yield rows(triples(path, head, "".join(held), f"b{block}_{number}"))
                    held, size, number = [], 0, number + 1
            if held and (found := triples(path, head, "".join(held), f"b{block}_{number}")):
                yield rows(found)
            if node:
                yield rows([], path, block if owner is None else owner, block, "".join(node))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, owner, text in zip(b.column("path").to_pylist(), b.column("owner").to_pylist(), b.column("text")):
                if found := triples(path, known.value[path, owner][0], text.as_py(), f"b{owner}_x"):
                    yield rows(found).select(OUT)

    kinds = ", ".join(f"{c} string" for c in OUT)
    parts = settled(_records(spark, paths).mapInArrow(cut, kinds + ", path string, owner bigint, block bigint, text string"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))  # of one node
    edges = parts.where("text is not null").groupBy("path", "owner").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))
    out = parts.where("text is null and s is not null").select(*OUT).unionByName(edges.mapInArrow(joined, kinds))
    return out.unionByName(whole(odd)) if odd else out
