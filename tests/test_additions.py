"""Turtle, percent-decoding, pooling by name, batches, completions, local scorers, suites, smoke runs."""

import json
import math
import random
from urllib.parse import unquote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom import model as M
from kgloom.functions import text as X
from kgloom.operators import alignments as A
from kgloom.operators import graph as G
from kgloom.operators import matchers as MA
from kgloom.operators import scoring as SC
from kgloom.operators import vectors as V
from kgloom.plans import sparql
from kgloom.sources import layout, rdf
from kgloom.sources.turtle import parse_turtle


def test_turtle():
    got = parse_turtle(
        """@prefix : <http://x/> . PREFIX r: <http://r#>
@base <http://b/d/> .
:a a r:C ; r:l "x\\n\\u00e9"@en , 'y'^^r:t, 3, 4.5, 1e3, true ; .   # a comment
<e> r:p [ r:q ( 1 _:z ) ] . [] r:k \"\"\"a "q" b\"\"\" ."""
    )
    lit = {(t[3], t[5], t[6]) for t in got if t[0] == "http://x/a" and t[4] == "literal"}
    assert lit == {("x\né", "en", None), ("y", None, "http://r#t"), ("3", None, M.XSD + "integer"), ("4.5", None, M.XSD + "decimal"), ("1e3", None, M.XSD + "double"), ("true", None, M.XSD + "boolean")}
    assert ("http://x/a", "iri", M.TYPE, "http://r#C", "iri", None, None) in got and len(got) == 7 + 1 + 1 + 4 + 1
    assert any(t[0] == "http://b/d/e" and t[4] == "bnode" for t in got) and any(t[3] == 'a "q" b' for t in got)
    for bad in (":a :b :c .", "<a> <b> .", '<a> <b> "x', "<a> <b> <c>"):
        with pytest.raises(SyntaxError):
            parse_turtle(bad)


def test_graph_by_its_ending(spark, tmp_path):
    (tmp_path / "g.ttl").write_text("@prefix x: <urn:x#> . x:a x:b x:c, 'd' .")
    (tmp_path / "g.nt").write_text('<urn:x#a> <urn:x#b> <urn:x#c> .\n<urn:x#a> <urn:x#b> "d" .\n')
    a, b = (sorted(map(str, rdf.read_graph(spark, str(tmp_path / n), "g").collect())) for n in ("g.ttl", "g.nt"))
    assert a == b and len(a) == 2


@pytest.fixture(scope="module")
def decoded(spark):
    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.x for r in df.select("i", X.percent_decode(F.col("t")).alias("x")).orderBy("i").collect()]

    return run


def test_percent_decoding_equals_unquote(decoded):
    rng, parts = random.Random(1), ["%", "%41", "%c3%a9", "%C3", "%A9", "%zz", "%e4%b8%ad", "%4", "a", "é", "+", " ", "%%", "%F0%9F%99%82", "%ff"]
    texts = ["", "%41bc", "100%", "a+b", "%", "no escape"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    assert decoded(texts) == [unquote(t) for t in texts]
    assert decoded([None]) == [None]


def test_decoding_stays_on_the_jvm(spark):
    df = spark.createDataFrame([("a%20b",)], "label string").select(X.token_set(F.col("label")).alias("w"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert df.collect()[0].w == ["a b"]  # a space that an escape hides stays inside the word


def brute_cap(rows, n):
    seen, out = {}, []
    for c, s, t, r in sorted((-c, s, t, r) for s, t, r, c in rows):
        for u in (s, t):
            seen[u] = seen.get(u, 0) + 1
        if max(seen[s], seen[t]) <= n:
            out.append((s, t, r))
    return sorted(out)


def test_rank_cap_with_a_hub(spark):
    rng = random.Random(7)
    rows = {(f"s{rng.randrange(40)}" if i % 3 else "hub", f"t{rng.randrange(300)}" if i % 5 else "hub", rng.choice("=<>")): rng.choice([0.5, 0.7, 0.9]) for i in range(900)}
    a = M.alignment(spark.createDataFrame([(*k, c) for k, c in rows.items()], "source string, target string, relation string, confidence double")).repartition(5)
    for n in (1, 3, 40, 250):
        assert sorted((r.source, r.target, r.relation) for r in A.rank_cap(a, n).collect()) == brute_cap([(*k, c) for k, c in rows.items()], n)


def test_both_directions_in_one_pass(spark):
    rng = random.Random(3)
    side = lambda name, n: V.unit(spark.createDataFrame([(f"{name}{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)], "id string, v array<double>"))
    s, t = side("s", 37), side("t", 23)
    s, t = (spark.createDataFrame(df.collect(), df.schema) for df in (s, t))
    forward, back = plain(s, t, 3), {(b, a, c) for a, b, c in plain(t, s, 3)}
    for side_, block in ((1 << 20, 2048), (0, 5)):
        assert {tuple(r) for r in V.top_k(s, t, 3, block, side_).select("source", "target", "confidence").collect()} == forward
        assert {tuple(r) for r in V.top_k_both(s, t, 3, block, side_).select("source", "target", "confidence").collect()} == forward | back


def plain(s, t, k):
    """The top k by every product, in plain Python."""
    out = set()
    for a in s.collect():
        scored = sorted((-(round(sum(x * y for x, y in zip(a.v, b.v)), V.DIGITS) + 0.0), b.id) for b in t.collect())
        out |= {(a.id, b, -x + 0.0) for x, b in scored[:k]}
    return out


def test_pruned_search_in_clusters(spark):
    """Two hundred and forty vectors around eight directions, some equal, a few not of unit length: the same as every
    product, of which far fewer are taken; no nested loop, and only ids and numbers in pairs of blocks."""
    rng = random.Random(5)
    tops = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(8)]
    def vector(i):
        v = [x + rng.gauss(0, 0.02) for x in tops[i % 8]]
        n = math.hypot(*v) / (2 if i % 60 == 0 else 1)
        return [round(x / n, 3) if i % 9 == 0 else x / n for x in v]
    rows = [(f"s{i:03}", vector(i)) for i in range(240)]
    rows += [(f"t{i:03}", rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(4)
    s, t = df.where("id < 's120'"), df.where("id >= 's120'")
    got = V.search(s, t, 4, block=8)
    assert {tuple(r) for r in got.found.select("source", "target", "confidence").collect()} == plain(s, t, 4)
    assert got.taken < got.pairs / 2
    assert "NestedLoop" not in got.found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got.found._jdf.queryExecution().executedPlan().toString()
    assert V.search(s, t.limit(0), 4).found.count() == 0 and V.search(s.limit(0), t, 4).found.count() == 0


def test_pooling_by_name(spark):
    rows = [("a", [9, 5, 6, 1, 5, 6, 2], [5, 6], [[float(i), 1.0] for i in range(7)]), ("b", [1, 2], [7], [[1.0, 0.0], [0.0, 1.0]]), ("c", [], [1], [])]
    df = spark.createDataFrame(rows, "id string, tokens array<int>, focus array<int>, vectors array<array<double>>")
    special = {"special": [9, 2], "cls": [9], "sep": [2]}

    def unit(v):
        n = math.hypot(*v)
        return [x / n for x in v]

    want = {"sentence": [3, 1], "cls": [0, 1], "firstmean": [1.5, 1], "allmean": [3, 1], "firstmax": [2, 1], "allmax": [5, 1], "firstmeanspecial": [9 / 4, 1], "allmeancls": [12 / 5, 1], "allmeanclssep": [3, 1]}
    for name, v in want.items():
        got = {r.id: r.v for r in V.pooled(df, name, special).collect()}
        assert got["a"] == pytest.approx(unit(v)), name
    assert {r.id: r.v for r in V.pooled(df, "firstmean").collect()}["b"] == pytest.approx(unit([0.5, 0.5]))  # not found: all tokens
    with pytest.raises(ValueError):
        V.pooled(df, "lastmean")
    with pytest.raises(ValueError):
        MA.CandidateMatcher(pooling="allmean")._encoded(df)


class Service:
    """A batch service that needs two looks, and loses the requests it is told to."""

    def __init__(self, status="completed", lose=()):
        self.status, self.lose, self.looks, self.lines = status, lose, 0, []

    def __call__(self, method, path, body):
        if path == "/v1/files":
            self.lines = [json.loads(x) for x in body.decode().splitlines()]
            return {"id": "in"}
        if path.endswith("/content"):
            if "err" in path:
                return "\n".join(json.dumps({"custom_id": i, "error": "lost"}) for i in self.lose)
            top = [{"token": "Yes", "logprob": math.log(0.6)}, {"token": "no", "logprob": math.log(0.2)}]
            reply = {"choices": [{"logprobs": {"content": [{"top_logprobs": top}]}}]}
            return "\n".join(json.dumps({"custom_id": x["custom_id"], "response": {"body": reply}}) for x in reversed(self.lines) if x["custom_id"] not in self.lose)
        self.looks += method == "GET"
        return {"id": "b", "status": self.status if self.looks > 1 else "in_progress", "output_file_id": "out", "error_file_id": "err"}


def test_batches(spark):
    ask = SC.batch_scorer(SC.BatchEndpoint(Service(), wait=0), "m").load()
    assert [round(SC.confidence_of(x), 6) for x in ask(["p", "q"])] == [0.75, 0.75] and ask([]) == []
    with pytest.raises(RuntimeError, match="req-1.*lost"):
        SC.batch_scorer(SC.BatchEndpoint(Service(lose=["req-1"]), wait=0), "m").load()(["p", "q"])
    with pytest.raises(RuntimeError, match="expired"):
        SC.BatchEndpoint(Service("expired"), wait=0).run(['{"custom_id": "a"}'])


def test_completions(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, prompt string")
    got = SC.complete(df, lambda: lambda texts, most: [t.upper()[:most] for t in texts], 2).collect()
    assert sorted((r.id, r.completion) for r in got) == [(1, "AB"), (2, "")]

    def fails():
        def write(texts, most):
            raise OSError("down")

        return write

    assert [r.completion for r in SC.complete(df, fails).collect()] == [None, None]


def test_answers_of_a_vocabulary():
    assert SC.answer_tokens(["Yes", "x", "no", " true"]) == ([0, 3], [2])
    words = ["y", "es", "n", "o", "ĠYes", "ĠNo"]
    encode = lambda w: [words.index(p) for p in {"yes": ["y", "es"], "no": ["n", "o"]}.get(w, [])]
    assert SC.answer_tokens(words[:4], encode=encode) == ([0, 1], [2, 3])
    with pytest.raises(ValueError):
        SC.answer_tokens(["a", "b"])
    ask = SC.next_token_scores(lambda p: list(range(len(p))), lambda ids: [-1.0, -2.0, -0.5, -3.0 - len(ids)], ["yes", "Yes", "no", "b"], most=4)
    assert ask(["long prompt"]) == [{"yes": -1.0, "no": -0.5}]
    try:
        import transformers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="torch|transformers"):
            SC.local_scorer("nowhere").load()


def test_suite_download(spark, tmp_path):
    suite = f"""<rdf:RDF xmlns:rdf="{M.RDF}" xmlns:s="http://www.seals-project.eu/ontologies/SEALSMetadata.owl#" xmlns:d="http://purl.org/dc/terms/"><s:Suite>
<s:hasSuiteItem><s:Item><d:identifier>b c</d:identifier></s:Item></s:hasSuiteItem><s:hasSuiteItem><s:Item><d:identifier>a</d:identifier></s:Item></s:hasSuiteItem></s:Suite></rdf:RDF>"""
    asked = []

    def get(url, to):
        asked.append(url)
        if to is None:
            return suite.encode()
        if "/b%20c/component/target" in url or "evaluationexclusion" in url:
            return None
        layout.Path(to).parent.mkdir(parents=True, exist_ok=True)
        layout.Path(to).write_bytes(b"x")
        return b"x"

    cache = str(tmp_path / "t")
    assert layout.download_suite(spark, "http://h/suite/", cache, get) == ["a"]
    assert "http://h/suite/b%20c/component/source/" in asked and (tmp_path / "t/a/parameters.rdf").exists() and not (tmp_path / "t/b c").exists()
    n = len(asked)
    assert layout.download_suite(spark, "http://h/suite/", cache, get) == ["a"] and len(asked) == n


def test_optional_at_the_start_and_loose_joins(spark):
    rows = [("urn:a", "urn:p", "urn:b", "iri"), ("urn:b", "urn:q", "x", "literal")]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string").select(*M.triple("g", F.col("s"), F.col("p"), F.col("o"), F.col("o_kind")))
    ask = lambda q: sparql.compile_query(q, t)[1].collect()
    assert [r.x for r in ask("SELECT ?x WHERE { OPTIONAL { ?x <urn:p> ?y } }")] == ["urn:a"]
    assert [r.x for r in ask("SELECT ?x WHERE { OPTIONAL { ?x <urn:none> ?y } }")] == [None]
    with pytest.raises(SyntaxError, match="unbound"):
        ask("SELECT ?x WHERE { OPTIONAL { ?x <urn:none> ?y } ?x <urn:p> ?z }")
    got = ask("SELECT ?x ?y WHERE { ?x <urn:p> ?z OPTIONAL { ?z <urn:none> ?y } ?z <urn:q> ?y }")
    assert [(r.x, r.y) for r in got] == [("urn:a", "x")]


def test_only_classes(spark):
    rows = [("urn:a", M.SUBCLASS, "urn:b", "iri"), ("urn:b", M.SUBCLASS, "urn:c", "iri"), ("urn:d", M.TYPE, M.OWL + "Class", "iri"), ("urn:d", M.LABEL, "d", "literal")]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string").select(*M.triple("g", F.col("s"), F.col("p"), F.col("o"), F.col("o_kind")))
    cut = G.only_classes(t, G.first_classes(t, 2))
    assert sorted(r.uri for r in G.classes(cut).collect()) == ["urn:a", "urn:b"] and cut.where("o = 'd'").count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "#", "/", "b:c"]), min_size=1, max_size=7).map("".join))
def test_split_tag_loses_nothing(key):
    from kgloom.sources.alignment_xml import split_tag

    label, space = split_tag(key)
    assert space + label == key or label == space == key


def test_tracked_runs(spark, tmp_path):
    from kgloom.plans import runner
    from kgloom.sinks.tracking import FileTracker

    graph = lambda n: spark.createDataFrame([(f"urn:{n}{i}", f"name {i}") for i in range(6)], "u string, l string")
    side = lambda n: M.union_graphs(graph(n).select(*M.triple("g", F.col("u"), M.TYPE, M.OWL + "Class")), graph(n).select(*M.triple("g", F.col("u"), M.LABEL, F.col("l"), "literal")))
    gold = M.alignment(spark.createDataFrame([(f"urn:a{i}", f"urn:b{i}", "=", 1.0) for i in range(6)], "source string, target string, relation string, confidence double"))
    case = runner.TestCase(side("a"), side("b"), gold.limit(0), gold, {}, "case", "track")
    tracker = FileTracker(str(tmp_path / "runs"))
    m = runner.run_retrieval(case, MA.RetrievalMatcher(k=2, description="description_text"), str(tmp_path / "out"), top_k=2, variant="symmetric", smoke=3, tracker=tracker)
    assert m["predictions"] == 6 and set(m["probe"]) == {"urn:a0", "urn:a1", "urn:a2"} and m["n_total"] == 6
    lines = [json.loads(x) for x in open(tracker.path)]
    assert [x["event"] for x in lines] == ["begin", "log", "end"] and lines[0]["config"]["smoke"] == 3 and lines[2]["failed"] is None
    assert lines[1]["metrics"]["predictions"] == 6 and any(f.endswith("predictions.tsv") for f in lines[1]["files"])
    with pytest.raises(AttributeError):
        runner.run_retrieval(case, object(), str(tmp_path / "bad"), tracker=tracker)
    assert json.loads(open(tracker.path).read().splitlines()[-1])["failed"].startswith("AttributeError")
