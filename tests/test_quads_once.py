import pytest

from kgloom.plans import round_trips
from kgloom.sources import rdf


def test_a_literal_is_looked_through_once(spark, tmp_path):
    lines = [
        r'<u:a> <u:p> "say \"x\" \\" <u:g> . # "c" <u:no> .', '<u:b> <u:p> ""@en .', "_:c <u:p> <> _:g.1 .", '<u:d> <u:p> "<u:x> . # " .', r'<u:e>  <u:p> "\u00e9\\"^^<u:t> <u:g>.', "# none", "", '<u:f> <u:p> _:o."x"',
    ]
    (tmp_path / "a.nq").write_text("\n".join(lines[:-1]))
    read = rdf.read_graph(spark, str(tmp_path / "a.nq"), "u:")
    got = {(r.graph, r.s, r.s_kind, r.o, r.o_kind, r.o_lang, r.o_dtype) for r in read.collect()}
    assert got == {
        ("u:g", "u:a", "iri", 'say "x" \\', "literal", None, None), ("u:", "u:b", "iri", "", "literal", "en", None), ("g.1", "c", "bnode", "", "iri", None, None),
        ("u:", "u:d", "iri", "<u:x> . # ", "literal", None, None), ("u:g", "u:e", "iri", "é\\", "literal", None, "u:t"),
    }
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(value#") == 1 and plan.count("regexp_extract(substring(value#") == 1
    for bad in (lines[-1], '<u:a> <u:p> "open .', '<u:a> <u:p> "x" "y" .'):
        (tmp_path / "b.nq").write_text(bad)
        with pytest.raises(Exception, match="not a triple"):
            rdf.read_graph(spark, str(tmp_path / "b.nq")).select("s").collect()


def test_lines_of_documents_are_escaped_by_runs(spark, tmp_path):
    texts = ["", "plain", "é", "aé日\u007f🙂b🙂🙂 \"q\"\\u0041\n\\é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    code = lambda c: c if ord(c) <= 0x7E else f"\\u{ord(c):04X}" if ord(c) <= 0xFFFF else f"\\U{ord(c):08X}"
    plain = [t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for t in texts]
    df = round_trips._document_lines(spark, str(tmp_path), round_trips.F.lit(""))
    want = {f'<urn:doc:{i}> <urn:te\\u0078t> "{"".join(map(code, t))}" .' for i, t in enumerate(plain)}
    assert {r.value for r in df.collect()} == want
    assert "format_string" not in df._jdf.queryExecution().optimizedPlan().toString()
