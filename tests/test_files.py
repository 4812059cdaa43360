import json
import os
import shutil
import zipfile

import pytest

from kgloom import model as M
from kgloom.operators import alignments as A
from kgloom.operators import matchers as MA
from kgloom.operators import scoring as SC
from kgloom.operators import vectors as V
from kgloom.plans import runner
from kgloom.sinks import tables
from kgloom.sources import alignment_xml as X
from kgloom.sources import layout, rdf
from kgloom.streaming.incremental import AlignmentTable, maintain

XML = f"""<?xml version="1.0"?><rdf:RDF xmlns="{M.ALIGN}" xmlns:rdf="{M.RDF}" xmlns:x="http://e.org/ns#"><Alignment><xml>yes</xml><level>0</level><type>??</type><x:tool>mine</x:tool>
<onto1><Ontology rdf:about="http://one"><location>file:one</location></Ontology></onto1><onto2>http://two</onto2>
<map><Cell><entity1 rdf:resource="http://a#A&amp;B"/><entity2 rdf:resource="http://b#1"/><relation> = </relation><measure rdf:datatype="x"> 0.5 </measure><x:note>why &lt; not</x:note></Cell></map>
<map><Cell><entity1 rdf:resource="http://a#A&amp;B"/><entity2 rdf:resource="http://b#1"/><relation>=</relation><measure>0.75</measure></Cell></map></Alignment></rdf:RDF>"""


def test_alignment_xml(spark, tmp_path):
    path = tmp_path / "a.rdf"
    path.write_text(XML)
    rows, head = X.parse_string(spark, XML, keep_extensions=True)
    got = rows.orderBy("seq").collect()
    assert [(r.source, r.relation, r.confidence) for r in got] == [("http://a#A&B", "=", 0.5), ("http://a#A&B", "=", 0.75)]
    assert got[0].extensions == {"http://e.org/ns#note": "why < not"}
    assert (head.onto1, head.onto2, head.extension) == (["http://one", "file:one"], ["http://two"], {"http://e.org/ns#tool": "mine"})
    one = X.read_alignment(spark, str(path)).collect()
    assert len(one) == 1 and one[0].confidence == 0.75 and one[0].extensions is None
    assert X.read_large(spark, str(path)).count() == 2
    X.write_alignment(rows, str(tmp_path / "b.rdf"), head)
    back, head2 = X.parse_string(spark, (tmp_path / "b.rdf").read_text(), keep_extensions=True)
    assert head2 == head and sorted(map(str, back.drop("seq").collect())) == sorted(map(str, rows.drop("seq").collect()))
    assert X.write_temporary(one and rows).startswith("file:///")
    with pytest.raises(Exception):
        X.parse_string(spark, XML.replace("<measure>0.75</measure>", ""))[0].collect()
    assert [X.split_tag(k) for k in ("http://a#b", "http://a/b", "#b", "b")] == [("b", "http://a#"), ("b", "http://a/"), ("#b", "#b"), ("b", "b")]


RDFXML = f"""<rdf:RDF xmlns:rdf="{M.RDF}" xmlns:rdfs="{M.RDFS}" xmlns:owl="{M.OWL}" xml:base="http://x" xml:lang="en">
<owl:Class rdf:about="#A" rdfs:comment="attr"><rdfs:label>Label A</rdfs:label><rdfs:subClassOf rdf:resource="#B"/>
<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#p"/><owl:minCardinality rdf:datatype="{M.XSD}int">1</owl:minCardinality></owl:Restriction></rdfs:subClassOf>
<owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="#C"/><rdf:Description rdf:about="#D"/></owl:unionOf></owl:Class>
<rdf:Description rdf:ID="B"><rdfs:label xml:lang="de">B de</rdfs:label><rdfs:seeAlso rdf:parseType="Resource"><rdfs:label>inner</rdfs:label></rdfs:seeAlso></rdf:Description></rdf:RDF>"""


def test_rdf(spark, tmp_path):
    (tmp_path / "s.rdf").write_text(RDFXML)
    t = rdf.read_graph(spark, str(tmp_path / "s.rdf"), "g")
    rows = {(r.s, r.p, r.o, r.o_kind, r.o_lang, r.o_dtype) for r in t.collect()}
    assert ("http://x#A", M.SUBCLASS, "http://x#B", "iri", None, None) in rows and ("http://x#A", M.LABEL, "Label A", "literal", "en", None) in rows
    assert ("http://x#A", M.RDFS + "comment", "attr", "literal", "en", None) in rows and ("http://x#B", M.LABEL, "B de", "literal", "de", None) in rows
    assert any(r[1] == M.OWL + "minCardinality" and r[2] == "1" and r[5] == M.XSD + "int" for r in rows)
    assert sum(r[1] == M.RDF + "first" for r in rows) == 2 and sum(r[1] == M.RDF + "rest" for r in rows) == 2 and sum(r[2] == M.RDF + "nil" for r in rows) == 1
    assert len(rows) == 17
    rdf.write_ntriples(t, str(tmp_path / "o.nt"))
    back = rdf.read_ntriples(spark, str(tmp_path / "o.nt"), "g")
    assert {(r.s, r.p, r.o, r.o_kind, r.o_lang, r.o_dtype) for r in back.collect()} == rows
    (tmp_path / "e.nt").write_text('# note\n\n<a> <b> "x\\"y\\\\n\\n" .\n_:b1 <p> "" .\n<a> <b> <> .\n')
    got = {(r.s, r.s_kind, r.o, r.o_kind) for r in rdf.read_graph(spark, str(tmp_path / "e.nt")).collect()}
    assert got == {("a", "iri", 'x"y\\n\n', "literal"), ("b1", "bnode", "", "literal"), ("a", "iri", "", "iri")}
    (tmp_path / "bad.nt").write_text("no triple\n")
    with pytest.raises(Exception, match="not a triple"):
        rdf.read_graph(spark, str(tmp_path / "bad.nt")).collect()
    assert M.union_graphs(t, t).count() == t.count() and M.empty_graph(spark).count() == 0


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", 0.5, True, None), (None, 1.0, False, 3)], "s string, d double, b boolean, i int")
    assert open(tables.write_tsv(df, str(tmp_path / "t.tsv"))).read() == "s\td\tb\ti\na b\t0.500000\tTrue\t\n\t1.000000\tFalse\t3\n"
    for _ in range(2):
        tables.append_result(str(tmp_path / "r.csv"), "t", "c", "m", dict(precision=1, recall=1, f1=1, tp=1, fp=0, fn=0), 3_723_000_000_000)
    assert open(tmp_path / "r.csv").read().count("Track") == 1 and "01:02:03" in open(tmp_path / "r.csv").read()


def test_one_file_from_many_tasks(spark, tmp_path):
    from kgloom.sinks.single import write_single

    df = spark.range(1000).repartition(7).orderBy("id").selectExpr("concat('é', id) AS value")
    path = str(tmp_path / "out.txt")
    for head in ("first\n", ""):  # the second time over the first
        assert write_single(df, path, head, "end\n") == path
        assert open(path, encoding="utf-8").read() == head + "".join(f"é{i}\n" for i in range(1000)) + "end\n"
    assert os.listdir(tmp_path) == ["out.txt"]
    write_single(df.limit(0), path)
    assert open(path).read() == ""


def test_layout(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        for f in layout.FILES:
            z.writestr(f"benchmark/g1-web/{f}", "x")
        z.writestr("benchmark/odd/source.rdf", "x")
        z.writestr("__MACOSX/x", "x")
        z.writestr("benchmark/g1-web/._source.rdf", "x")
    root = layout.extract(str(tmp_path / "d.zip"), str(tmp_path / "cache"))
    assert not (root / "__MACOSX").exists() and layout.sub_datasets(root) == ["g1-web", "odd"]
    assert len(layout.validate(root)) == 3 and layout.sub_dataset(root, "g1-web")[0].endswith("source.rdf")
    with pytest.raises(ValueError):
        layout.sub_dataset(root, "none")
    with pytest.raises(FileNotFoundError):
        layout.sub_dataset(root, "odd")
    (tmp_path / "p.rdf").write_text("[1]")
    assert layout.read_parameters(str(tmp_path / "p.rdf")) == {"value": [1]} and layout.read_parameters("/none") == {} and layout.read_parameters(None) == {}
    got = layout.download_track("http://t", ["a", "b"], str(tmp_path / "track"), get=lambda url, to: None if "/b/component/target" in url else b"")
    assert got == ["a"]


ONTO = f"""<rdf:RDF xmlns:rdf="{M.RDF}" xmlns:rdfs="{M.RDFS}" xmlns:owl="{M.OWL}">""" + "{}</rdf:RDF>"
CLASS = '<owl:Class rdf:about="http://{o}#{i}"><rdfs:label>{l}</rdfs:label></owl:Class>'


def track(tmp_path):
    d = tmp_path / "track" / "case"
    d.mkdir(parents=True)
    names = ["Heart Valve", "Lung", "Left Ventricle"]
    for o in ("source", "target"):
        (d / f"{o}.rdf").write_text(ONTO.format("".join(CLASS.format(o=o, i=i, l=x if o == "source" else x.replace(" ", "_").lower()) for i, x in enumerate(names))))
    cell = '<map><Cell><entity1 rdf:resource="http://source#{0}"/><entity2 rdf:resource="http://target#{0}"/><relation>=</relation><measure>1.0</measure></Cell></map>'
    (d / "reference.rdf").write_text(f'<rdf:RDF xmlns="{M.ALIGN}" xmlns:rdf="{M.RDF}"><Alignment>' + "".join(cell.format(i) for i in range(3)) + "</Alignment></rdf:RDF>")
    (tmp_path / "track" / "no-gold").mkdir()
    return str(tmp_path / "track")


def test_a_track_in_one_plan_equals_a_run_a_case(spark, tmp_path):
    """Three testcases that share URIs: a full match, a partial one, one without any."""
    from kgloom.plans import together

    folder = track(tmp_path)
    for name, labels in (("other", ["lung", "Hand", "the of"]), ("nothing", ["the", "日本", ""])):
        d = tmp_path / "track" / name
        shutil.copytree(tmp_path / "track" / "case", d)
        (d / "target.rdf").write_text(ONTO.format("".join(CLASS.format(o="target", i=i, l=x) for i, x in enumerate(labels))))
    want = {r["testcase"]: r for r in runner.run_tracks(spark, [MA.LexicalMatcher()], {"t": folder}, str(tmp_path / "out"))}
    got = together.run_lexical(spark, {n: tuple(f"{folder}/{n}/{x}.rdf" for x in ("source", "target", "reference")) for n in want}).collect()
    assert {r.case for r in got} == set(want) == {"case", "other", "nothing"}
    for r in got:
        assert all(r[c] == want[r.case][c] for c in ("size", "precision", "recall", "f1", "tp", "fp", "fn")), r
    assert {r.case: r.size for r in got} == {"case": 3, "other": 1, "nothing": 0}


def test_end_to_end(spark, tmp_path):
    folder = track(tmp_path)
    scorer = SC.table_scorer({"source#1": 0.9}, 0.3)
    systems = [MA.LexicalMatcher(), MA.Sequential([MA.CandidateMatcher(k=2), MA.RankCapMatcher(4), MA.Reranker(scorer)])]
    got = runner.run_tracks(spark, systems, {"t": folder}, str(tmp_path / "out"))
    assert [r["f1"] for r in got[:1]] == [1.0] and len(got) == 2
    assert got[1]["size"] >= 1 and got[1]["tp"] == 1
    info = str(next((tmp_path / "out").rglob("run_info.json")))
    assert json.loads(open(info).read())["testcase_name"] == "case"
    again = runner.run_on_top(spark, [info], [MA.RankCapMatcher(1), MA.RankCapMatcher(0)], str(tmp_path / "top"), chain=True)
    assert [r["size"] for r in again] == [3, 0]
    case = runner.load(spark, f"{folder}/case/source.rdf", f"{folder}/case/target.rdf", f"{folder}/case/reference.rdf", "case", "t")
    m = runner.run_retrieval(case, MA.AsymmetricMatcher(k=2), str(tmp_path / "r"), top_k=2)
    assert m["n_total"] == 3 and "recall_at_k_lax/all/k=1" in m and (tmp_path / "r" / "per_source_long.tsv").exists()
    loaded = MA.FileLoader(f"{folder}/case/reference.rdf").match(case.source, None)
    assert loaded.count() == 3 and MA.empty(spark).count() == 0


def test_vectors(spark):
    assert V.pooling_parts("allmeanclssep") == ("mean", True, "clssep") and V.pooling_parts("firstmax") == ("max", False, "")
    with pytest.raises(ValueError):
        V.pooling_parts("median")
    rows = [("d", i, i > 0, v) for i, v in enumerate([[9.0, 9.0], [3.0, 0.0], [0.0, 1.0]])]
    df = spark.createDataFrame(rows, "id string, position int, masked boolean, v array<double>")
    r = {m: V.pool(df, m).collect()[0].v for m in ("mean", "max", "cls")}
    assert abs(r["mean"][0] / r["mean"][1] - 3) < 1e-9 and abs(r["max"][0] / r["max"][1] - 3) < 1e-9 and abs(r["cls"][0] - r["cls"][1]) < 1e-12
    a = V.encode(spark.createDataFrame([("1", "heart valve"), ("2", None)], "id string, text string"), V.hash_encoder(8))
    assert sorted(map(len, (r.v for r in a.collect()))) == [8, 8]
    empty = V.top_k(a.limit(0), a.limit(0), 3)
    assert empty.count() == 0


def test_scoring(spark):
    rows = [("a", "Yes", -0.1), ("a", " yes.", -2.0), ("a", "no", -3.0), ("b", "maybe", -0.1), ("c", "true", -1.0)]
    got = {r.id: r.confidence for r in SC.first_token_confidence(spark.createDataFrame(rows, "id string, token string, logprob double")).collect()}
    import math

    assert abs(got["a"] - math.exp(-0.1) / (math.exp(-0.1) + math.exp(-3.0))) < 1e-12 and got["b"] == 0.5 and got["c"] == 1.0
    assert SC.answer_tokens(["yes", "no", "x"]) == ([0], [1])
    with pytest.raises(ValueError):
        SC.answer_tokens(["x"])
    df = spark.createDataFrame([("s", "t", "=", "about s")], "source string, target string, relation string, prompt string")

    def broken():
        raise OSError("down")

    assert SC.Scorer(lambda: lambda p: broken()).score(df).collect()[0].confidence == 0.5
    assert json.loads(SC.batch_requests(df.withColumnRenamed("source", "id"), "m").collect()[0].value)["body"]["messages"][0]["content"] == "about s"
    assert SC.token_count([{"role": "user", "content": "a b"}], lambda s: len(s.split())) == 9


def test_tool_loop():
    add = SC.Tool("add", "adds", {"type": "object", "title": "T", "properties": {"a": {"type": "integer", "title": "A"}, "title": {"type": "string"}}, "required": ["a"]}, lambda a, title="": a + 1)
    assert add.schema()["function"]["parameters"] == {"type": "object", "properties": {"a": {"type": "integer"}, "title": {"type": "string"}}, "required": ["a"]}
    assert add.invoke({}) == "Error: a is missing" and add.invoke({"a": "x"}).startswith("Error") and add.invoke({"a": 1}) == "2"
    turns = iter([[{"tool_calls": [{"id": "1", "function": {"name": "add", "arguments": '{"a": 4}'}}, {"id": "2", "function": {"name": "no"}}]}], [{}], [{"content": "done"}]])
    seen = []
    loop = SC.ToolLoop(lambda talks, tools: next(turns), lambda talks: seen.extend(talks) or [0.7], [add])
    start = [[{"role": "user", "content": "q"}]]
    scores, talks = loop.run(start)
    assert scores == [0.7] and [m["content"] for m in talks[0] if m["role"] == "tool"] == ["5", "Error: unknown tool no"] and len(start[0]) == 1
    assert talks[0][-1]["content"] == SC.FINAL_QUESTION


def test_stream(spark, tmp_path):
    schema = "source string, target string, relation string, confidence double"
    for i, rows in enumerate(([("a", "b", "=", 0.2)], [("a", "b", "=", 0.9), ("c", "d", "<", 0.1)])):
        spark.createDataFrame(rows, schema).write.json(str(tmp_path / f"in/{i}"))
        table = AlignmentTable(spark, str(tmp_path / "table"))
        q = maintain(spark.readStream.schema(schema).json(str(tmp_path / "in/*")), table, str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert {(r.source, r.confidence) for r in table.read().collect()} == {("a", 0.9), ("c", 0.1)}
    assert len(table.versions()) == 2


def test_upsert_of_xml_rows_is_stable(spark):
    rows, _ = X.parse_string(spark, XML, keep_extensions=True)
    assert A.upsert(rows).collect()[0].extensions == {"http://e.org/ns#note": "why < not"}
