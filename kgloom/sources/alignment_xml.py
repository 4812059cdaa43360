"""Alignment XML: reader and writer."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from io import BytesIO
from itertools import islice
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.model import ALIGN, ALIGNMENT, RDF, alignment
from kgloom.sinks.documents import write_documents
from kgloom.sinks.single import write_single

_A, _R = "{" + ALIGN + "}", "{" + RDF + "}"
_KNOWN = {"map", "Cell", "entity1", "entity2", "relation", "measure", "onto1", "onto2", "Ontology", "location", "formalism", "Formalism", "xml", "level", "type", "Alignment"}
_CELLS = T.StructType([*ALIGNMENT.fields[:3], T.StructField("measure", T.StringType()), *ALIGNMENT.fields[4:]])


@dataclass
class Header:
    """What a file says besides its cells: [id, location, formalism name, formalism URI] of both ontologies."""

    onto1: list[str] = field(default_factory=list)
    onto2: list[str] = field(default_factory=list)
    extension: dict[str, str] = field(default_factory=dict)


def _plain(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _cell(e: ET.Element) -> tuple:
    """(source, target, relation, measure, extensions); texts trimmed, a missing measure is ''."""
    source = target = None
    relation, measure, ext = "", "", {}
    for c in e:
        tag, text = c.tag, (c.text or "").strip()
        if tag == _A + "entity1":
            source = c.get(_R + "resource")
        elif tag == _A + "entity2":
            target = c.get(_R + "resource")
        elif tag == _A + "relation":
            relation = text
        elif tag == _A + "measure":
            measure = text
        else:
            ext[_plain(tag)] = text
    return source, target, relation, measure, ext


def _ontology(e: ET.Element) -> list[str]:
    """id and location; a plain text is the id. Nothing is carried over from the other ontology."""
    o = e.find(_A + "Ontology")
    if o is None:
        return [(e.text or "").strip()] if (e.text or "").strip() else []
    out = [o.get(_R + "about") or ""]
    loc = o.find(_A + "location")
    if loc is not None:
        out.append((loc.text or "").strip())
    f = next(iter(o.iter(_A + "Formalism")), None)
    if f is not None and len(out) == 2:
        pick = lambda n: f.get(_A + n) or f.get(n) or ""
        out += [pick("name"), pick("uri")]
    return out


def elements(data: bytes | str) -> Iterator[tuple | Header]:
    """The cells of a document one after another, then its header. What has been read is dropped from
    the tree, so memory does not grow with the cells."""
    head, stack = Header(), []
    for event, e in ET.iterparse(BytesIO(data if isinstance(data, bytes) else data.encode()), ("start", "end")):
        if event == "start":
            stack.append(e)
            continue
        stack.pop()
        inside = stack[-1].tag if stack else None
        if e.tag == _A + "Cell":
            yield _cell(e)
        elif e.tag in (_A + "onto1", _A + "onto2"):
            setattr(head, _local(e.tag), _ontology(e))
        elif inside == _A + "Alignment" and _local(e.tag) not in _KNOWN:
            head.extension[_plain(e.tag)] = (e.text or "").strip()
        if inside == _A + "Alignment":  # <map> and the like, with all below
            stack[-1].remove(e)
    yield head


def parse(data: bytes | str) -> tuple[list[tuple], Header]:
    """Cells and header of a document."""
    *cells, head = elements(data)
    return cells, head


def _frame(spark: SparkSession, rows: DataFrame, keep_extensions: bool) -> DataFrame:
    out = rows.withColumnRenamed("measure", "confidence")
    return alignment(out if keep_extensions else out.withColumn("extensions", F.lit(None).cast("map<string,string>")))


def read_cells(spark: SparkSession, path: str | list[str], keep_extensions: bool = False) -> DataFrame:
    """Rows of alignment files as written, one task per file. A cell without a measure makes the
    read fail: the measure is cast strictly."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                cells = ((*c, i) for i, c in enumerate(elements(bytes(data))) if not isinstance(c, Header))
                while rows := list(islice(cells, 10_000)):
                    yield pd.DataFrame(rows, columns=_CELLS.names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return _frame(spark, files.mapInPandas(run, _CELLS), keep_extensions)


def read_large(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of very large files without extensions: Spark splits the file at its cells."""
    schema = "entity1 struct<`_rdf:resource`:string>, entity2 struct<`_rdf:resource`:string>, relation string, measure struct<_VALUE:string>"
    rows = spark.read.format("xml").option("rowTag", "Cell").option("mode", "FAILFAST").schema(schema).load(path)
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return alignment(
        rows.select(
            F.col("entity1.`_rdf:resource`").alias("source"), F.col("entity2.`_rdf:resource`").alias("target"), trim(F.col("relation")).alias("relation"), trim(F.col("measure._VALUE")).alias("confidence")
        )
    )


#: Bytes of a file up to which one task reads it whole.
WHOLE = 16 << 20


def _plain_head(spark: SparkSession, path: str) -> bool:
    """Whether a file names its elements as they are written here: cells without a prefix, resources with ``rdf``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        root = re.search(rb"<rdf:RDF\b([^>]*)>", bytes(stream.readNBytes(1 << 16)))
    finally:
        stream.close()
    return root is not None and all(re.search(f"\\s{name}\\s*=\\s*[\"']{re.escape(uri)}#?[\"']".encode(), root[1]) for name, uri in (("xmlns", ALIGN), ("xmlns:rdf", RDF)))


def read_alignment(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """A file or a folder as an alignment: extensions dropped, keys made unique with their highest confidence.

    Small files are read each in a task; those of more than ``whole`` bytes are split at their cells, whatever their
    size, unless they use other prefixes. Cells of split files have no ``seq``."""
    from kgloom.operators.alignments import upsert

    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > whole).collect()]
    large = [p for p in large if _plain_head(spark, p)]
    if not large:
        return upsert(read_cells(spark, path))
    rows = read_large(spark, large)
    small = [r["path"] for r in sizes.collect() if r["path"] not in set(large)]
    return upsert(rows.unionByName(read_cells(spark, small)) if small else rows)


def parse_string(spark: SparkSession, text: str, keep_extensions: bool = False) -> tuple[DataFrame, Header]:
    cells, head = parse(text)
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(cells)], _CELLS)
    return _frame(spark, rows, keep_extensions), head


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        return parse(f.read())[1]


# --- writing ------------------------------------------------------------------------------------


def split_tag(key: str) -> tuple[str, str]:
    """(label, namespace) of an extension key: cut after the last '#', else after the last '/'; a key
    without either, or with it in front, is both."""
    spaces = [key[: key.rfind(mark) + 1] for mark in "#/" if key.rfind(mark) > 0]
    return (key[len(spaces[0]) :], spaces[0]) if spaces else (key, key)


def _text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _attribute(c: Column) -> Column:
    c = _text(c)
    for a, b in (("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def cell_xml() -> Column:
    """The <map> element of an alignment row, made on the JVM."""
    last = lambda k, mark: F.length(k) - F.length(F.substring_index(k, mark, -1))  # place of the last mark, 0 for none
    label = lambda k: F.when(last(k, "#") > 1, F.substring_index(k, "#", -1)).when(last(k, "/") > 1, F.substring_index(k, "/", -1)).otherwise(k)
    space = lambda k: F.when(label(k) == k, k).otherwise(F.substring(k, F.lit(1), F.length(k) - F.length(label(k))))
    tag = lambda k: F.concat(F.lit("alignapilocalns:"), _text(label(k)))
    one = lambda x: F.concat(F.lit("      <"), tag(x["key"]), F.lit(" xmlns:alignapilocalns="), _attribute(space(x["key"])), F.lit(">"), _text(x["value"]), F.lit("</"), tag(x["key"]), F.lit(">\n"))
    ext = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("extensions", F.create_map().cast("map<string,string>")))), one), "")
    return F.concat(
        F.lit("  <map>\n    <Cell>\n      <entity1 rdf:resource="), _attribute(F.col("source")), F.lit("/>\n      <entity2 rdf:resource="), _attribute(F.col("target")),
        F.lit("/>\n      <relation>"), _text(F.col("relation")), F.lit('</relation>\n      <measure rdf:datatype="xsd:float">'), F.col("confidence").cast("string"), F.lit("</measure>\n"),
        ext, F.lit("    </Cell>\n  </map>"),
    )


def _element(depth: int, tag: str, attributes: dict[str, str], *inner: str) -> str:
    """An element on lines of its own; its inner parts are lines already, or one text."""
    pad, head = "  " * depth, "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items())
    if not inner:
        return f"{pad}<{tag}{head}/>\n"
    if len(inner) == 1 and not inner[0].endswith("\n"):
        return f"{pad}<{tag}{head}>{escape(inner[0])}</{tag}>\n"
    return f"{pad}<{tag}{head}>\n{''.join(inner)}{pad}</{tag}>\n"


def _ontology_xml(onto: list[str], name: str) -> str:
    """[id, location, formalism name, formalism URI], as far as it goes."""
    if not onto:
        return ""
    parts = [_element(3, "location", {}, x) if x else "      <location></location>\n" for x in onto[1:2]]
    for formalism in [onto[2:4]] if len(onto) > 3 else []:
        about = dict(zip(("align:name", "align:uri", "xmlns:align"), (*formalism, ALIGN)))
        parts.append(_element(3, "formalism", {}, _element(4, "Formalism", about)))
    inside = _element(2, "Ontology", {"rdf:about": onto[0]}, *parts) if parts else f"    <Ontology rdf:about={quoteattr(onto[0])}>\n    </Ontology>\n"
    return _element(1, name, {}, inside)


def intro(head: Header | None = None) -> str:
    """Everything before the cells; values are escaped."""
    head = head or Header()
    out = '<?xml version="1.0" encoding="utf-8"?>\n' f'<rdf:RDF xmlns="{ALIGN}"\n  xmlns:rdf="{RDF}"\n  xmlns:xsd="http://www.w3.org/2001/XMLSchema#">\n'
    out += "<Alignment>\n  <xml>yes</xml>\n  <level>0</level>\n  <type>??</type>\n"
    for key, value in head.extension.items():
        label, space = split_tag(key)
        out += f"  <ext:{label} xmlns:ext={quoteattr(space)}>{escape(value)}</ext:{label}>\n" if label != key else f"  <{escape(key)}>{escape(value)}</{escape(key)}>\n"
    return out + _ontology_xml(head.onto1, "onto1") + _ontology_xml(head.onto2, "onto2")


OUTRO = "</Alignment>\n</rdf:RDF>\n"


def write_alignment(a: DataFrame, path: str, head: Header | None = None) -> str:
    """Writes one XML file, UTF-8. Cells are rendered and written by the executors, and joined."""
    return write_single(a.select(cell_xml().alias("value")), path, intro(head), OUTRO)


def write_alignments(a: DataFrame, path: str, head: Header | None = None) -> str:
    """Writes a folder of XML files, a whole document a partition, for alignments too long for one."""
    return write_documents(a, cell_xml(), path, intro(head), OUTRO)


def write_temporary(a: DataFrame, head: Header | None = None) -> str:
    """Writes to a temporary file of the driver; returns its file URL."""
    import tempfile
    from pathlib import Path

    with tempfile.NamedTemporaryFile("w", suffix=".rdf", delete=False) as f:
        pass
    return Path(write_alignment(a, f.name, head)).as_uri()
