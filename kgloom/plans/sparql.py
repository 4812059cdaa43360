"""A declared subset of SPARQL, compiled to DataFrame operations.

SELECT [DISTINCT] vars, * or (aggregate AS ?v); ASK; CONSTRUCT; DESCRIBE <iri>. Patterns: triples
with ';' and ',', 'a', path steps p+ and p*; OPTIONAL, UNION, MINUS, FILTER. Then GROUP BY,
ORDER BY, LIMIT, OFFSET. Every triple pattern is a filtered scan, patterns join on shared
variables, and Catalyst orders and picks the joins. Anything else raises SyntaxError, which
``query_text`` returns as text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom import model as M
from kgloom.operators.graph import closure, term

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z-]+)|(?P<num>[+-]?\d+(?:\.\d+)?)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,*+=<>!/])|(?P<pname>[A-Za-z_][\w-]*:[\w.-]*[\w-]|[A-Za-z_][\w-]*:|:[\w-]+)|(?P<blank>_:\w+)|(?P<word>[A-Za-z_]\w*)""",
    re.X,
)
PREFIXES = {"rdf": M.RDF, "rdfs": M.RDFS, "owl": M.OWL, "xsd": M.XSD, "skos": M.SKOS}
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


class _Query:
    """A recursive-descent compiler. A term is ('var', name), ('iri', uri) or ('lit', text); a
    variable ?x is the columns x (its value) and x__k (its kind)."""

    def __init__(self, text: str, triples: DataFrame):
        self.toks, self.i, self.triples, self.prefixes = _tokens(text), 0, triples, dict(PREFIXES)
        self.loose: set[str] = set()  # variables that may be unbound

    # tokens
    def peek(self, *words: str) -> bool:
        kind, t = self.toks[self.i]
        return (t.upper() if kind == "word" else t) in words

    def take(self) -> tuple[str, str]:
        self.i += 1
        return self.toks[self.i - 1]

    def accept(self, *words: str) -> bool:
        hit = self.peek(*words)
        self.i += hit
        return hit

    def need(self, word: str) -> None:
        if not self.accept(word):
            raise SyntaxError(f"expected {word!r}, found {self.toks[self.i][1]!r}")

    def term(self) -> tuple[str, str]:
        kind, t = self.take()
        if kind == "var":
            return "var", t[1:]
        if kind == "iri":
            return "iri", t[1:-1]
        if kind == "pname":
            p, _, rest = t.partition(":")
            if p not in self.prefixes:
                raise SyntaxError(f"unknown prefix {p!r}")
            return "iri", self.prefixes[p] + rest
        if kind == "blank":
            return "var", "bnode__" + t[2:]
        if kind == "word" and t == "a":
            return "iri", M.TYPE
        if kind == "str":
            if self.toks[self.i][0] == "lang":
                self.take()
            elif self.accept("^^"):
                self.term()
            return "lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), t[1:-1])
        if kind == "num":
            return "lit", t
        raise SyntaxError(f"unexpected {t!r}")

    # patterns
    def scan(self, s, p, o, path: str = "") -> DataFrame:
        df = self.triples
        if path:
            if p[0] != "iri":
                raise SyntaxError("a path needs an IRI")
            edges = df.where((F.col("p") == p[1]) & (F.col("o_kind") != "literal"))
            pairs = edges.select(F.col("o").alias("parent"), F.col("s").alias("child"))
            found = closure(pairs)
            rings = found.members.join(found.sizes().where("size > 1"), "comp").select("node").unionByName(pairs.where("parent = child").select(F.col("child").alias("node")))
            far = found.expanded().select("descendant", "ancestor").unionByName(rings.select(F.col("node").alias("descendant"), F.col("node").alias("ancestor")).distinct())
            kinds = df.select(F.col("s").alias("n"), F.col("s_kind").alias("k")).unionByName(df.select(F.col("o"), F.col("o_kind")).toDF("n", "k")).where("k <> 'literal'").distinct()
            if path == "*":
                far = far.unionByName(kinds.select(F.col("n").alias("descendant"), F.col("n").alias("ancestor"))).distinct()
            df = far.join(kinds.toDF("descendant", "s_kind"), "descendant").join(kinds.toDF("ancestor", "o_kind"), "ancestor")
            df = df.select(F.col("descendant").alias("s"), "s_kind", F.lit(p[1]).alias("p"), F.col("ancestor").alias("o"), "o_kind")
            p = None
        cols: dict[str, Column] = {}
        for x, c, k in ((s, "s", F.col("s_kind")), (p, "p", F.lit("iri")), (o, "o", F.col("o_kind"))):
            if x is None:
                continue
            if x[0] == "var":
                if x[1] in cols:
                    df = df.where(F.col(c) == cols[x[1]])
                else:
                    cols[x[1]], cols[x[1] + "__k"] = F.col(c), k
            else:
                df = df.where(F.col(c) == x[1])
                if c != "p":
                    df = df.where((k == "literal") == F.lit(x[0] == "lit"))
        out = [v.alias(n) for n, v in cols.items()] or [F.lit(1).alias("unit__")]
        return df.select(*out).distinct()

    def join(self, a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
        """Solutions that agree on the variables they share. One that may be unbound, behind OPTIONAL or
        in a part of a UNION, agrees with any value; then the others must carry the join."""
        if a is None:
            return b
        shared = [c for c in a.columns if c in b.columns and not c.endswith("__k") and c != "unit__"]
        loose = [c for c in shared if c in self.loose]
        on = [c for c in shared if c not in loose]
        if loose and not on:
            raise SyntaxError("a join on nothing but variables that may be unbound: " + ", ".join("?" + c for c in loose))
        if not loose:
            b = b.drop(*[c for c in b.columns if c in a.columns and c not in on])
            if on:
                return a.join(b, on, how)
            # a pattern without variables has one solution at most; any other pair would be a cross product
            if not any({c for c in x.columns if not c.endswith("__k")} <= {"unit__"} for x in (a, b)):
                raise SyntaxError("parts of a group that share no variable")
            return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
        x, y = a.alias("x"), b.alias("y")
        either = lambda c: F.coalesce(F.col(f"x.`{c}`"), F.col(f"y.`{c}`")).alias(c)
        agree = reduce(lambda p, q: p & q, [F.col(f"x.`{c}`") == F.col(f"y.`{c}`") for c in on])
        for c in loose:
            left, right = F.col(f"x.`{c}`"), F.col(f"y.`{c}`")
            agree = agree & (left.isNull() | right.isNull() | (left == right))
        cols = [either(c) if c in b.columns and (c in loose or c.removesuffix("__k") in loose) else F.col(f"x.`{c}`").alias(c) for c in a.columns]
        return x.join(y, agree, how).select(*cols, *[F.col(f"y.`{c}`").alias(c) for c in b.columns if c not in a.columns])

    def optional(self, out: DataFrame | None) -> DataFrame:
        """A group's solutions where it has any; at the start of a group, one solution that binds nothing where it has none."""
        before = set(out.columns) if out is not None else set()
        inner = self.group()
        made = self.join(self.triples.sparkSession.createDataFrame([(1,)], "unit__ int") if out is None else out, inner, "left")
        self.loose |= {c for c in inner.columns if c not in before and not c.endswith("__k") and c != "unit__"}
        return made

    def triples_block(self) -> list[DataFrame]:
        s, scans = self.term(), []
        while True:
            p = self.term()
            path = next((x for x in "+*" if self.accept(x)), "")
            while True:
                scans.append(self.scan(s, p, self.term(), path))
                if not self.accept(","):
                    break
            if not self.accept(";") or self.peek(".", "}"):
                return scans

    def connected(self, out: DataFrame | None, scans: list[DataFrame]) -> DataFrame | None:
        """Joins patterns so that each shares a variable with those before, whatever their order in the text."""
        names = lambda df: {c for c in df.columns if not c.endswith("__k") and c != "unit__"}
        while scans:
            i = next((i for i, x in enumerate(scans) if out is None or not names(x) or names(x) & names(out)), 0)
            out = self.join(out, scans.pop(i))
        return out

    def group(self) -> DataFrame:
        self.need("{")
        out, filters, scans = None, [], []
        while not self.accept("}"):
            if self.peek("OPTIONAL", "MINUS", "{"):
                out = self.connected(out, scans)
            if self.accept("OPTIONAL"):
                out = self.optional(out)
            elif self.accept("MINUS"):
                other = self.group()
                on = [c for c in out.columns if c in other.columns and not c.endswith("__k")] if out is not None else []
                out = out.join(other, on, "left_anti") if on else out
            elif self.accept("FILTER"):
                filters.append(self.delayed())
            elif self.peek("{"):
                sub = self.group()
                while self.accept("UNION"):
                    other = self.group()
                    self.loose |= {c for c in set(sub.columns) ^ set(other.columns) if not c.endswith("__k") and c != "unit__"}
                    sub = sub.unionByName(other, allowMissingColumns=True)
                out = self.join(out, sub)
            elif self.toks[self.i][0] == "end":
                raise SyntaxError("the group is not closed")
            else:
                scans += self.triples_block()
            self.accept(".")
        out = self.connected(out, scans)
        if out is None:
            raise SyntaxError("an empty group")
        for f in filters:
            out = out.where(f(out))
        return out

    # filters: parsed at once, resolved against the whole group
    def delayed(self):
        if self.peek("("):
            self.need("(")
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self):
        e = self.conjunction()
        while self.accept("||"):
            a, b = e, self.conjunction()
            e = lambda df, a=a, b=b: a(df) | b(df)
        return e

    def conjunction(self):
        e = self.comparison()
        while self.accept("&&"):
            a, b = e, self.comparison()
            e = lambda df, a=a, b=b: a(df) & b(df)
        return e

    def comparison(self):
        a = self.primary()
        for op in ("!=", "<=", ">=", "=", "<", ">"):
            if self.accept(op):
                b = self.primary()

                def run(df, a=a, b=b, op=op):
                    x, y = a(df), b(df)
                    m, n = x.try_cast("double"), y.try_cast("double")
                    both = m.isNotNull() & n.isNotNull()
                    ops = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}
                    return F.when(both, ops[op](m, n)).otherwise(ops[op](x, y))

                return run
        return a

    def primary(self):
        if self.accept("!"):
            e = self.primary()
            return lambda df: ~e(df)
        if self.accept("("):
            e = self.expression()
            self.need(")")
            return e
        kind, t = self.toks[self.i]
        if kind == "word" and t != "a":
            self.take()
            name = t.upper()
            self.need("(")
            args = []
            while not self.accept(")"):
                args.append((self.toks[self.i], self.expression()))
                self.accept(",")
            return self.function(name, args)
        x = self.term()
        if x[0] == "var":

            def value(df, v=x[1]):
                if v not in df.columns:
                    raise SyntaxError(f"?{v} is not bound")
                return F.col(v)

            return value
        return lambda df: F.lit(x[1])

    def function(self, name, args):
        var = args[0][0][1][1:] if args and args[0][0][0] == "var" else ""
        e = [a for _, a in args]
        kinds = {"ISIRI": "iri", "ISURI": "iri", "ISBLANK": "bnode", "ISLITERAL": "literal"}
        if name == "BOUND":
            return lambda df: F.col(var).isNotNull() if var in df.columns else F.lit(False)
        if name in kinds:
            return lambda df: F.col(var + "__k") == kinds[name]
        if name == "STR":
            return e[0]
        if name in ("LCASE", "UCASE", "STRLEN"):
            f = {"LCASE": F.lower, "UCASE": F.upper, "STRLEN": lambda c: F.length(c).cast("string")}[name]
            return lambda df: f(e[0](df))
        if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
            f = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name]
            return lambda df: f(e[0](df), e[1](df))
        if name == "REGEX":
            flags = args[2][0][1].strip("\"'") if len(args) > 2 else ""
            return lambda df: F.rlike(e[0](df), F.concat(F.lit("(?i)" if "i" in flags else ""), e[1](df)))
        raise SyntaxError(f"unknown function {name}")

    # query forms
    def run(self):
        while self.accept("PREFIX"):
            _, name = self.take()
            kind, uri = self.take()
            if kind != "iri":
                raise SyntaxError("a prefix needs an IRI")
            self.prefixes[name.rstrip(":")] = uri[1:-1]
        form = self.take()[1].upper()
        if form == "SELECT":
            out = "select", self.select()
        elif form == "ASK":
            self.accept("WHERE")
            out = "ask", self.group()
        elif form == "CONSTRUCT":
            out = "graph", self.construct()
        elif form == "DESCRIBE":
            kind, uri = self.term()
            if kind != "iri":
                raise SyntaxError("DESCRIBE takes an IRI")
            out = "graph", self.triples.where((F.col("s") == uri) & (F.col("s_kind") == "iri"))
        else:
            raise SyntaxError(f"unknown query form {form}")
        if self.toks[self.i][0] != "end":
            raise SyntaxError(f"unexpected {self.toks[self.i][1]!r}")
        return out

    def select(self) -> DataFrame:
        distinct = self.accept("DISTINCT")
        items: list[tuple[str, object]] = []
        if self.accept("*"):
            pass
        else:
            while self.toks[self.i][0] == "var" or self.peek("("):
                if self.accept("("):
                    f = self.take()[1].upper()
                    if f not in _AGGREGATES:
                        raise SyntaxError(f"unknown aggregate {f}")
                    self.need("(")
                    d = self.accept("DISTINCT")
                    arg = None if self.accept("*") else self.term()[1]
                    self.need(")")
                    self.need("AS")
                    items.append((self.term()[1], (f, d, arg)))
                    self.need(")")
                else:
                    items.append((self.term()[1], None))
        self.accept("WHERE")
        df = self.group()
        names = [n for n, _ in items] or [c for c in df.columns if not c.endswith("__k") and not c.startswith(("bnode__", "unit__"))]
        keys = []
        if self.accept("GROUP"):
            self.need("BY")
            while self.toks[self.i][0] == "var":
                keys.append(self.term()[1])
        if keys or any(a for _, a in items):
            df = df.groupBy(*keys).agg(*[self.aggregate(*a).alias(n) for n, a in items if a])
        missing = [n for n in names if n not in df.columns]
        df = df.select("*", *[F.lit(None).cast("string").alias(n) for n in missing])
        order = []
        if self.accept("ORDER"):
            self.need("BY")
            while self.toks[self.i][0] == "var" or self.peek("ASC", "DESC"):
                down = self.accept("DESC")
                paren = (down or self.accept("ASC")) and self.accept("(")
                order.append((self.term()[1], down))
                if paren:
                    self.need(")")
        if distinct:
            df = df.select(*names).distinct()
        if order:
            df = df.orderBy(*[F.desc(n) if d else F.asc(n) for n, d in order])
        df = df.select(*names)
        limit = offset = None
        while self.peek("LIMIT", "OFFSET"):
            if self.take()[1].upper() == "LIMIT":
                limit = int(self.take()[1])
            else:
                offset = int(self.take()[1])
        df = df.offset(offset) if offset else df
        return df if limit is None else df.limit(limit)

    @staticmethod
    def aggregate(f, distinct, arg) -> Column:
        if f == "COUNT":
            return F.count("*") if arg is None else F.count_distinct(F.col(arg)) if distinct else F.count(arg)
        c = F.col(arg)
        n = c.try_cast("double")
        return {"SUM": F.sum(n), "AVG": F.avg(n), "MIN": F.min(c), "MAX": F.max(c), "SAMPLE": F.min(c), "GROUP_CONCAT": F.array_join(F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)), " ")}[f]

    def construct(self) -> DataFrame:
        self.need("{")
        parts = []
        while not self.accept("}"):
            parts.append((self.term(), self.term(), self.term()))
            self.accept(".")
        self.need("WHERE")
        df = self.group()
        value = lambda x: F.col(x[1]) if x[0] == "var" else F.lit(x[1])
        kind = lambda x: F.col(x[1] + "__k") if x[0] == "var" else F.lit("iri" if x[0] == "iri" else "literal")
        made = [df.select(*M.triple("query", value(s), value(p), value(o), kind(o), kind(s))) for s, p, o in parts]
        return reduce(DataFrame.unionByName, made).dropna(subset=["s", "p", "o"]).distinct()


def compile_query(text: str, triples: DataFrame) -> tuple[str, DataFrame]:
    """('select' | 'ask' | 'graph', DataFrame); SyntaxError outside the subset."""
    return _Query(text, triples).run()


def text_table(names: list[str], rows: list[tuple]) -> str:
    """Columns padded to their widest cell, ' | ' between them, a rule under the head."""
    cells = [names, *[["" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(names))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, width)) for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:]])


def _more(df: DataFrame, seen: int, most: int) -> str:
    return f"\n({most} of {df.count()} rows; LIMIT and OFFSET give others)" if seen > most else ""


#: Rows of an answer that one text holds.
PAGE = 10_000


def query_text(text: str, triples: DataFrame, most: int = PAGE) -> str:
    """The answer as text: a table, 'No results.', True or False, or a graph's lines. Errors are text too.

    A text is read by one reader and made in one place, so it holds at most ``most`` rows; of a longer answer it
    tells the number and how to ask for the rest. ``compile_query`` gives answers of any size as a table."""
    try:
        kind, df = compile_query(text, triples)
        if kind == "ask":
            return str(not df.isEmpty())
        if kind == "graph":
            line = F.concat(term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dtype")), F.lit(" ."))
            lines = df.select(line.alias("x")).distinct()
            rows = [r.x for r in lines.orderBy("x").take(most + 1)]
            return "\n".join(rows[:most]) + _more(lines, len(rows), most)
        rows = [tuple(r) for r in df.take(most + 1)]
        return text_table(df.columns, rows[:most]) + _more(df, len(rows), most) if rows else "No results."
    except Exception as e:  # an agent reads the text and tries again
        return f"Error: {e}"
