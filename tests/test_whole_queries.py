"""Queries over the whole of what their operators take, with no subset of ids or lines."""

import pytest

from kgloom import model as M
from kgloom.functions import text as X
from kgloom.operators import graph as G
from kgloom.operators import matchers as MA
from kgloom.plans import catalog
from kgloom.plans import derived as D
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["two_outgoing", "three_outgoing", "two_outgoing_blank", "one_gen", "basic", "text"])
def test_every_class_is_described(name, spark, sf_dir):
    t = D.kg(spark, sf_dir)
    own = {r.uri for r in G.classes(t).collect()}
    if name not in ("text",):  # a class with no triple of its own (a type, a brand) has nothing to describe
        p = ["http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#comment"]
        with_triples = t.where(F.col("p").isin(p)) if name == "basic" else t
        own &= {r.s for r in with_triples.select("s").distinct().collect()}
    got = {r.entity for r in catalog.queries()[f"describe_{name}_all"](spark, sf_dir).select("entity").distinct().collect()}
    assert got == own
    assert {u.split(":")[1] for u in got} >= {"customer", "region", "supplier", "nation", "part"}


def test_every_line_is_normalized(spark, sf_dir):
    lines = {x for r in D.table(spark, sf_dir, "documents").select("text").collect() if r.text is not None for x in r.text.split("\n")}
    got = {r.label for r in catalog.queries()["label_normalize_all"](spark, sf_dir).collect()}
    assert lines <= got


def test_all_stop_words(spark):
    assert len(set(X.STOPWORDS)) == len(X.STOPWORDS) == 258 and {"towards", "therein", "fire", "mill", "co"} <= set(X.STOPWORDS)
    side = lambda uri, label: spark.createDataFrame([(uri, label)], "uri string, label string")
    s, t = side("a", "Fire station"), side("b", "Station")
    assert [(r.source, r.target) for r in MA.lexical(s, t).collect()] == [("a", "b")]
    assert MA.lexical(s, t, stopwords=["the"]).count() == 0
    graph = lambda uri, label: spark.createDataFrame([("g", uri, "iri", p, o, k, None, None) for p, o, k in ((M.TYPE, M.OWL + "Class", "iri"), (M.LABEL, label, "literal"))], M.TRIPLES)
    assert MA.LexicalMatcher().match(graph("a", "Fire station"), graph("b", "Station")).count() == 1
    assert MA.LexicalMatcher(("the",)).match(graph("a", "Fire station"), graph("b", "Station")).count() == 0
