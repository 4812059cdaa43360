import random

from kgloom import model as M
from kgloom.operators import graph as G
from kgloom.plans import sparql

EX = "http://x#"


def graph(spark, triples):
    rows = []
    for s, p, o in triples:
        kind = lambda x: "bnode" if x.startswith("_:") else "literal" if x.startswith('"') else "iri"
        full = lambda x: x[2:] if x.startswith("_:") else x[1:] if x.startswith('"') else x if ":" in x else EX + x
        rows.append(("g", full(s), kind(s), full(p), full(o), kind(o), None, None))
    return spark.createDataFrame(rows, M.TRIPLES)


def uris(df):
    return {r.uri.removeprefix(EX) for r in df.collect()}


def ents(spark, *names):
    return spark.createDataFrame([(EX + n,) for n in names], "uri string")


def test_classes_and_labels(spark):
    t = graph(spark, [("A", M.TYPE, M.OWL + "Class"), ("B", M.SUBCLASS, "C"), ("D", M.SUBCLASS, M.THING), ("_:b", M.SUBCLASS, "E"), ("F", M.SUBCLASS, M.RDFS + "Class"), ("A", M.LABEL, '"one'), ("A", M.SKOS + "altLabel", '"two'), ("12", M.TYPE, M.OWL + "Class")])
    assert uris(G.classes(t)) == {"A", "B", "C", "D", "E", "F", "12", M.RDFS + "Class"}
    got = {(r.uri.removeprefix(EX), r.label) for r in G.labels(t, G.classes(t)).collect()}
    assert {("A", "one"), ("A", "two"), ("B", "B")} <= got and not any(u == "12" for u, _ in got)
    one = {r.uri.removeprefix(EX): r.label for r in G.one_label(t, G.classes(t)).collect()}
    assert one["A"] == "one" and one["12"] == ""


BNODES = [("e", "p", "_:1"), ("_:1", "q", "_:2"), ("_:2", "q", "_:3"), ("_:3", "q", "deep"), ("e", "r", "i"), ("i", M.LABEL, '"eye'), ("i", M.TYPE, "T"), ("i", "s", "far"), ("far", "s", "further"), ("_:1", "s", "j"), ("j", M.LABEL, '"jay'), ("j", "s", "k")]


def test_descriptions_with_blank_nodes(spark):
    t = graph(spark, BNODES)
    e = ents(spark, "e")

    def got(name):
        return {(r.s.removeprefix(EX), r.o.removeprefix(EX)) for r in G.describe(name, t, e).collect()}

    hop1 = {("e", "1"), ("e", "i")}
    two = hop1 | {("1", "2"), ("1", "j"), ("i", "eye"), ("i", "T"), ("i", "far")}
    assert got("description_two_outgoing") == two
    assert got("description_two_outgoing_blank") == two | {("2", "3"), ("j", "jay"), ("j", "k")}
    assert got("description_three_outgoing") == two | {("2", "3"), ("j", "jay"), ("j", "k"), ("far", "further")}
    one = hop1 | {("1", "2"), ("1", "j"), ("i", "eye"), ("i", "T")}
    assert got("description_one_gen") == one
    assert got("description_two_gen") == one | {("2", "3"), ("j", "jay")}
    assert got("description_three_gen") == one | {("2", "3"), ("j", "jay"), ("3", "deep")}
    text = G.serialize(G.describe("description_one_gen", t, e)).collect()[0].text
    assert f"<{EX}e> <{EX}p> _:1 ." in text and '"eye" .' in text


def test_description_text(spark):
    t = graph(spark, [("e", M.LABEL, '"L2'), ("e", M.LABEL, '"L1'), ("e", M.RDFS + "comment", '"about'), ("e", M.TYPE, "T"), ("T", M.LABEL, '"Tee'), ("e", M.TYPE, "U")])
    got = {r.entity.removeprefix(EX): r.text for r in G.describe_text(t, ents(spark, "e", "none")).collect()}
    assert got == {"e": "Label: L1\nLabel: L2\nDescription: about\nType: Tee\n", "none": ""}
    assert G.serialize(G.describe_text(t, ents(spark, "e"))).count() == 1


def closure(edges):
    out = set()
    for start in {p for _, p in edges}:
        todo, seen = [start], set()
        while todo:
            x = todo.pop()
            for c, p in edges:
                if p == x and c not in seen:
                    seen.add(c)
                    todo.append(c)
        out |= {(start, c) for c in seen if c != start}
    return out


def test_closure_on_random_graphs_with_cycles(spark):
    rng = random.Random(9)
    for _ in range(3):
        edges = {(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for _ in range(14)}
        df = spark.createDataFrame(list(edges), "child string, parent string")
        assert {(r.ancestor, r.descendant) for r in G.descendants(df).collect()} == closure(edges)


def test_closure_rounds_grow_with_the_logarithm_of_depth(spark):
    """A chain of 250 classes and a ring behind a chain: counts and pairs are exact."""
    chain = [(f"c{i + 1:04}", f"c{i:04}") for i in range(250)]
    df = spark.createDataFrame(chain, "child string, parent string")
    got = G.closure(df)
    assert got.rounds <= 9
    assert {r.uri: r.n_descendants for r in got.counts().collect()} == {f"c{i:04}": 250 - i for i in range(250)}
    ring = [(f"r{(i + 1) % 20:03}", f"r{i:03}") for i in range(20)] + [(f"t{i + 1}", f"t{i}") for i in range(9)] + [("r000", "t9"), ("low", "r010"), ("low", "low")]
    got = G.closure(spark.createDataFrame(ring, "child string, parent string"))
    assert got.members.select("comp").distinct().count() == 12 and got.rounds <= 7
    assert {r.uri: r.n_descendants for r in got.counts().collect()} == {f"r{i:03}": 20 for i in range(20)} | {f"t{i}": 30 - i for i in range(10)}
    assert {(r.ancestor, r.descendant) for r in got.expanded().collect()} == closure(set(ring))


def test_roots(spark):
    t = graph(spark, [("b", M.SUBCLASS, "a"), ("c", M.SUBCLASS, "b"), ("d", M.SUBCLASS, "b"), ("y", M.SUBCLASS, "x"), ("alone", M.TYPE, M.OWL + "Class"), ("p", M.SUBCLASS, "q"), ("q", M.SUBCLASS, "p"), ("top", M.SUBCLASS, M.THING), ("r", M.TYPE, M.RESTRICTION), ("z", M.SUBCLASS, "r")])
    roots = {r.uri.removeprefix(EX): r.n_descendants for r in G.root_classes(t).collect()}
    assert roots == {"a": 3, "x": 1}
    assert [r.uri.removeprefix(EX) for r in G.root_classes(t, 3).collect()] == ["a", "b", "x"]
    assert [r.uri.removeprefix(EX) for r in G.root_classes(t, 1).collect()] == ["a"]


def test_sparql(spark):
    t = graph(spark, [("b", M.SUBCLASS, "a"), ("c", M.SUBCLASS, "b"), ("a", M.LABEL, '"Alpha'), ("b", M.LABEL, '"Beta'), ("c", "age", '"7')])
    q = lambda text: sparql.query_text(f"PREFIX ex: <{EX}> {text}", t)
    assert q("SELECT ?l WHERE { ?x rdfs:label ?l } ORDER BY DESC(?l) LIMIT 1") == "l   \n----\nBeta"
    assert q("ASK { ex:c rdfs:subClassOf+ ex:a }") == "True" and q("ASK { ex:a rdfs:subClassOf ex:c }") == "False"
    assert q("SELECT ?x WHERE { ?x rdfs:label 'none' }") == "No results."
    assert q("SELECT ?x WHERE { ?x ex:age ?n FILTER(?n > 6 && REGEX(STR(?x), 'C$', 'i')) }").endswith(EX + "c")
    assert "Alpha" in q("SELECT ?x ?l WHERE { ?x rdfs:subClassOf* ex:a OPTIONAL { ?x rdfs:label ?l } } ORDER BY ?x")
    assert q("SELECT (COUNT(*) AS ?n) WHERE { { ?x rdfs:label ?l } UNION { ?x ex:age ?l } }").split("\n")[-1].strip() == "3"
    assert q("SELECT ?x WHERE { ?x rdfs:label ?l MINUS { ?x rdfs:subClassOf ?y } }").endswith(EX + "a")
    assert q("CONSTRUCT { ?x ex:named ?l } WHERE { ?x rdfs:label ?l }") == f'<{EX}a> <{EX}named> "Alpha" .\n<{EX}b> <{EX}named> "Beta" .'
    assert q("DESCRIBE ex:c").count("\n") == 1
    assert sparql.query_text("SELECT ?x WHERE { ?x ?p ?y } ORDER BY ?x", t, 2).endswith("\n(2 of 5 rows; LIMIT and OFFSET give others)")
    # the first two patterns meet only through the third; parts that never meet are refused
    assert q("SELECT ?l ?n WHERE { ?x ex:age ?n . ?y rdfs:label ?l . ?x rdfs:subClassOf ?y }").split("\n")[-1].split(" | ") == ["Beta", "7"]
    assert "share no variable" in q("SELECT ?l ?n WHERE { ?x ex:age ?n . ?y rdfs:label ?l }")
    for bad in ("SELECT ?x WHERE { ?x", "SELECT ?x WHERE { SERVICE <x> { ?x ?y ?z } }", "nonsense", "SELECT ?x WHERE { ?x nope:y ?z }"):
        assert q(bad).startswith("Error: ")


def test_context(spark):
    t = graph(spark, [("o", M.TYPE, M.ONTOLOGY), ("b", M.SUBCLASS, "a"), ("i", M.TYPE, "a"), ("p", M.TYPE, M.OBJECT_PROPERTY), ("x", "y", "z"), ("a", M.LABEL, '"A')])
    assert {r.s.removeprefix(EX) for r in G.ontology_context(t).collect()} == {"o", "a", "i", "p"}
