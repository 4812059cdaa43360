"""Turtle: a reader of documents. Small files are read whole by a task, large ones in parts by many."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.model import RDF, XSD
from kgloom.sources.whole import WHOLE, read_whole

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<name>(?:[^\W\d_][\w\-]*(?:\.[\w\-]+)*)?:(?:(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:\.*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))*)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def resolved(iri: str, base: str) -> str:
    """The IRI that a token in angle brackets says."""
    value = _unescaped(iri[1:-1])
    return urljoin(base, value) if base else value


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"no Turtle at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]
    yield "end", ""


class _Parser:
    """Terms are (value, kind, language, data type); a statement's triples collect in ``out``."""

    def __init__(self, text: str, base: str, prefixes: dict, fresh: Iterator[str]):
        self.stream, self.base, self.prefixes, self.out, self.fresh = _tokens(text), base, dict(prefixes), [], fresh
        self.kind, self.text = next(self.stream)

    def step(self) -> str:
        was = self.text
        self.kind, self.text = next(self.stream)
        return was

    def need(self, text: str) -> None:
        if self.text != text:
            raise SyntaxError(f"expected {text!r}, found {self.text!r}")
        self.step()

    def iri(self) -> str:
        if self.kind == "iri":
            return resolved(self.step(), self.base)
        if self.kind == "name":
            prefix, _, rest = self.step().partition(":")
            if prefix not in self.prefixes:
                raise SyntaxError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)
        raise SyntaxError(f"expected an IRI, found {self.text!r}")

    def document(self) -> Iterator[tuple]:
        while self.kind != "end":
            head = self.text.lower()
            if head in ("@prefix", "@base", "prefix", "base"):
                self.step()
                if head.endswith("prefix"):
                    name = self.step()
                    if not name.endswith(":"):
                        raise SyntaxError(f"expected a prefix, found {name!r}")
                    self.prefixes[name[:-1]] = self.iri()
                else:
                    self.base = self.iri()
                if head.startswith("@"):
                    self.need(".")
                continue
            bare = self.text == "["
            subject = self.term()
            if not (bare and self.text == "."):
                self.predicates(subject)
            self.need(".")
            yield from self.out
            self.out.clear()

    def predicates(self, subject: tuple) -> None:
        while True:
            if self.kind == "word" and self.text == "a":
                self.step()
                p = RDF + "type"
            else:
                p = self.iri()
            while True:
                o = self.term()
                self.out.append((*subject[:2], p, *o))
                if self.text != ",":
                    break
                self.step()
            if self.text != ";":
                return
            while self.text == ";":
                self.step()
            if self.text in (".", "]"):
                return

    def term(self) -> tuple:
        kind, text = self.kind, self.text
        if kind == "str":
            return self.literal()
        if kind == "num":
            self.step()
            dtype = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return text, "literal", None, XSD + dtype
        if kind == "word" and text in ("true", "false"):
            self.step()
            return text, "literal", None, XSD + "boolean"
        if kind == "blank":
            return self.step()[2:], "bnode", None, None
        if text == "[":
            self.step()
            me = (next(self.fresh), "bnode", None, None)
            if self.text != "]":
                self.predicates(me)
            self.need("]")
            return me
        if text == "(":
            self.step()
            items = []
            while self.text != ")":
                items.append(self.term())
            self.step()
            tail = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                cell = (next(self.fresh), "bnode", None, None)
                self.out += [(*cell[:2], RDF + "first", *item), (*cell[:2], RDF + "rest", *tail)]
                tail = cell
            return tail
        return self.iri(), "iri", None, None

    def literal(self) -> tuple:
        text = self.step()
        quote = 3 if text[:3] in ('"""', "'''") else 1
        value, lang, dtype = _unescaped(text[quote:-quote]), None, None
        if self.kind == "lang":
            lang = self.step()[1:]
        elif self.kind == "type":
            self.step()
            dtype = self.iri()
        return value, "literal", lang, dtype


def parsed(data: bytes | str, base: str = "", prefixes: dict | None = None, fresh: Iterator[str] | None = None) -> Iterator[tuple]:
    """As parse_turtle, a statement at a time, with prefixes that hold already and names for blank nodes."""
    fresh = fresh or (f"genid{i}" for i in itertools.count(1))
    return _Parser(data if isinstance(data, str) else data.decode("utf-8-sig"), base, prefixes or {}, fresh).document()


def parse_turtle(data: bytes | str, base: str = "") -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_lang, o_dtype) of a document: prefixes and bases in both notations,
    lists of predicates and objects, blank nodes, collections, all literals. What is none raises."""
    return list(parsed(data, base))


def read_turtle(spark: SparkSession, path: str, graph: str | None = None, whole: int = WHOLE) -> DataFrame:
    """Triples of Turtle files: small ones each in a task, those of more than ``whole`` bytes in parts by many."""
    from kgloom.sources import turtle_split

    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > whole).collect()]
    if not large:
        return read_whole(spark, path, parsed, graph).dropDuplicates()
    read = turtle_split.read(spark, large, lambda odd: read_whole(spark, odd, parsed, graph), graph)
    small = [r["path"] for r in sizes.where(F.col("length") <= whole).collect()]
    return (read.unionByName(read_whole(spark, small, parsed, graph)) if small else read).dropDuplicates()
