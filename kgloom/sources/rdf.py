"""RDF sources: N-Triples and N-Quads by built-in functions, RDF/XML and Turtle through Python readers."""

from __future__ import annotations

import itertools
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.model import RDF, XSD
from kgloom.sources import rdfxml_split
from kgloom.sources.turtle import read_turtle
from kgloom.sources.whole import WHOLE, read_whole

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"
# the possessive loop over a literal's characters takes no stack, however long the literal is
_SUBJECT = r"^\s*(?:<([^>]*)>|_:(\S+))"
_LINE = _SUBJECT + r"\s+<([^>]*)>\s+(?:<([^>]*)>|_:([^\s.]+(?:\.[^\s.]+)*)|\"((?:[^\"\\]|\\.)*+)\"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$"
_HEAD = r"^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+"
_QUOTED = r"^\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\""
_QUAD = _LINE.replace(r")\s*\.\s*(?:#", r")\s*(?:<([^>]*)>|_:([^\s.]+(?:\.[^\s.]+)*))?\s*\.\s*(?:#")


def _numeric(c):
    """With ``\\uXXXX`` and ``\\UXXXXXXXX`` decoded, on the JVM; what names no character becomes U+FFFD, what is no
    such escape stays. For texts whose doubled backslashes are out of the way."""

    def char(p):
        n = F.when(F.startswith(p, F.lit("u")), 4).otherwise(8)
        code = F.lpad(F.substring(p, F.lit(2), n), 8, "0")
        real = (F.length(p) > n) & F.substring(p, F.lit(2), n).rlike("^[0-9A-Fa-f]+$")
        named = ~code.rlike("^0000[dD][89a-fA-F]") & code.rlike("^00(0[0-9A-Fa-f]|10)")
        text = F.when(named, F.decode(F.unhex(code), "UTF-32")).otherwise(F.lit("\ufffd"))
        # most are four digits of a character by itself
        four = F.concat(F.decode(F.unhex(F.substring(p, 2, 4)), "UTF-16BE"), F.substring(p, F.lit(6), F.length(p)))
        return F.when(p.rlike("^u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}"), four).when(real, F.concat(text, F.substring(p, n + 2, F.length(p)))).otherwise(F.concat(F.lit("\\"), p))

    parts = F.transform(F.split(c, r"\\(?=[uU])"), lambda p, i: F.when(i == 0, p).otherwise(char(p)))
    return F.when(c.rlike(r"\\[uU]"), F.array_join(parts, "")).otherwise(c)


def _unescaped(c):
    """The escapes of N-Triples."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(_numeric(out), F.lit("\x00"), F.lit("\\"))


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None, quads: bool = False) -> DataFrame:
    """Triples of N-Triples files: split by lines, parsed on the JVM, distinct.

    Blank nodes are told apart by the ``graph`` column. Comments and blank lines are left out; a
    line that is no triple raises. Of N-Quads (``quads``) the graph is the one that a line names, else
    as before."""
    line = _QUAD if quads else _LINE
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    # a literal is looked through once, the parts are taken from the line without it
    cut = lines.withColumn("head", F.regexp_extract("value", _HEAD, 0))
    cut = cut.withColumn("quoted", F.regexp_extract(F.substring("value", F.length("head") + 1, F.length("value")), _QUOTED, 0))
    short = F.concat("head", F.lit('""'), F.substring("value", F.length("head") + F.length("quoted") + 1, F.length("value")))
    cut = cut.withColumn("short", F.when((F.col("head") != "") & (F.col("quoted") != ""), short).otherwise(F.col("value")))
    part = lambda i: F.regexp_extract("short", line, i)
    bad = F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))
    o_iri, o_bnode = part(4), part(5)
    literal = F.col("short").rlike(_HEAD + '"')
    some = lambda c: F.when(c != "", c)
    s_is_iri = F.col("short").rlike(r"^\s*<")
    out = cut.select(
        (F.coalesce(some(_numeric(part(9))), some(part(10)), F.lit(graph or path)) if quads else F.lit(graph or path)).alias("graph"), F.when(s_is_iri, _numeric(part(1))).otherwise(part(2)).alias("s"),
        F.when(~F.col("short").rlike(line), bad).when(s_is_iri, "iri").otherwise("bnode").alias("s_kind"), _numeric(part(3)).alias("p"),
        F.when(literal, _unescaped(F.substring("quoted", F.lit(2), F.length("quoted") - 2))).when(o_bnode != "", o_bnode).otherwise(_numeric(o_iri)).alias("o"),
        F.when(literal, "literal").when(o_bnode != "", "bnode").otherwise("iri").alias("o_kind"), some(part(7)).alias("o_lang"), some(_numeric(part(8))).alias("o_dtype"),
    )
    return out.dropDuplicates()


def parse_rdfxml(data: bytes | str, base: str = "", fresh: Iterator[str] | None = None) -> Iterator[tuple]:
    """(s, s_kind, p, o, o_kind, o_lang, o_dtype) of an RDF/XML document.

    Node elements, property elements and attributes; rdf:about, ID, nodeID, resource, datatype,
    parseType Resource, Collection and Literal; rdf:li, containers, reification by rdf:ID of a
    property; xml:base and xml:lang. Generated blank nodes are numbered in document order, or take
    the names that ``fresh`` gives."""
    fresh = fresh or (f"genid{i}" for i in itertools.count(1))
    root = ET.fromstring(data)
    name = lambda tag: tag[1:].replace("}", "", 1)

    def context(e, base, lang):
        return e.get(_XML + "base", base), e.get(_XML + "lang", lang)

    def resolve(base, uri):
        return urljoin(base, uri) if base else uri

    def node(e, base, lang):
        """Yields the triples of a node element, then returns its term."""
        base, lang = context(e, base, lang)
        if e.get(_R + "about") is not None:
            me = (resolve(base, e.get(_R + "about")), "iri")
        elif e.get(_R + "ID") is not None:
            me = (resolve(base, "#" + e.get(_R + "ID")), "iri")
        else:
            me = (e.get(_R + "nodeID") or next(fresh), "bnode")
        if e.tag != _R + "Description":
            yield (*me, RDF + "type", name(e.tag), "iri", None, None)
        yield from attributes(e, me, lang)
        item = 0
        for child in e:
            if not isinstance(child.tag, str):
                continue
            p = name(child.tag)
            if child.tag == _R + "li":
                item += 1
                p = f"{RDF}_{item}"
            yield from prop(child, me, p, base, lang)
        return me

    def attributes(e, me, lang):
        for key, value in e.attrib.items():
            if not key.startswith("{") or key.startswith(_XML):
                continue
            if key == _R + "type":
                yield (*me, RDF + "type", value, "iri", None, None)
            elif key[len(_R) :] not in ("about", "ID", "nodeID", "resource", "datatype", "parseType") or not key.startswith(_R):
                yield (*me, name(key), value, "literal", lang or None, None)

    def prop(e, me, p, base, lang):
        base, lang = context(e, base, lang)
        kids = [c for c in e if isinstance(c.tag, str)]
        kind = e.get(_R + "parseType")
        o = None
        if kind == "Literal":
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            found = (inner, "literal", None, RDF + "XMLLiteral")
        elif kind == "Resource":
            o = (next(fresh), "bnode")
            for c in kids:
                yield from prop(c, o, name(c.tag), base, lang)
        elif kind == "Collection":
            terms = []
            for c in kids:
                terms.append((yield from node(c, base, lang)))
            cells = [(next(fresh), "bnode") for _ in terms]
            for i, (cell, t) in enumerate(zip(cells, terms)):
                yield (*cell, RDF + "first", *t, None, None)
                rest = cells[i + 1] if i + 1 < len(cells) else (RDF + "nil", "iri")
                yield (*cell, RDF + "rest", *rest, None, None)
            o = cells[0] if cells else (RDF + "nil", "iri")
        elif e.get(_R + "resource") is not None:
            o = (resolve(base, e.get(_R + "resource")), "iri")
            yield from attributes(e, o, lang)
        elif e.get(_R + "nodeID") is not None:
            o = (e.get(_R + "nodeID"), "bnode")
        elif kids:
            o = yield from node(kids[0], base, lang)
        elif any(k.startswith("{") and not k.startswith((_R, _XML)) for k in e.attrib):
            o = (next(fresh), "bnode")
            yield from attributes(e, o, lang)
        else:
            dtype = e.get(_R + "datatype")
            found = (e.text or "", "literal", None if dtype else lang or None, resolve(base, dtype) if dtype else None)
        if o is not None:
            found = (*o, None, None)
        yield (*me, p, *found)
        if e.get(_R + "ID") is not None:
            it = (resolve(base, "#" + e.get(_R + "ID")), "iri")
            yield (*it, RDF + "type", RDF + "Statement", "iri", None, None)
            yield (*it, RDF + "subject", *me, None, None)
            yield (*it, RDF + "predicate", p, "iri", None, None)
            yield (*it, RDF + "object", *found)

    base = root.get(_XML + "base", base)
    lang = root.get(_XML + "lang")
    if root.tag == _R + "RDF":
        for e in root:
            if isinstance(e.tag, str):
                yield from node(e, base, lang)
    else:
        yield from node(root, base, lang)


def read_rdfxml(spark: SparkSession, path: str, graph: str | None = None, whole: int = WHOLE) -> DataFrame:
    """Triples of RDF/XML files: small ones each in a task, those of more than ``whole`` bytes in parts by many."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > whole).collect()]
    if not large:
        return _read_whole(spark, path, graph)
    read = rdfxml_split.read(spark, large, parse_rdfxml, lambda odd: _read_whole(spark, odd, graph), graph)
    small = [r["path"] for r in sizes.where(F.col("length") <= whole).collect()]
    return (read.unionByName(_read_whole(spark, small, graph)) if small else read).dropDuplicates()


def _read_whole(spark: SparkSession, path: str | list[str], graph: str | None) -> DataFrame:
    """One task per file."""
    return read_whole(spark, path, parse_rdfxml, graph).dropDuplicates()


def read_graph(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Triples of a file by its ending: .nt N-Triples, .nq N-Quads, .ttl or .turtle Turtle, else RDF/XML."""
    if re.search(r"\.nq(\.gz|\.bz2)?/?$", path):
        return read_ntriples(spark, path, graph, quads=True)
    if re.search(r"\.nt(\.gz|\.bz2)?/?$", path):
        return read_ntriples(spark, path, graph)
    return (read_turtle if re.search(r"\.(ttl|turtle)/?$", path) else read_rdfxml)(spark, path, graph)


def write_ntriples(triples: DataFrame, path: str) -> None:
    from kgloom.operators.graph import term

    line = F.concat(
        term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dtype")), F.lit(" .")
    )
    triples.select(line.alias("value")).write.text(path)


STRING_TYPE = XSD + "string"
