import random

import pytest

from kgloom.sources import rdf, rdfxml_split

HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a > b, <rdf:RDF> in a comment -->
<!DOCTYPE rdf:RDF [ <!ENTITY ex "http://x.org/ns#"> <!ENTITY gt2 "&#62;"> ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs='http://www.w3.org/2000/01/rdf-schema#'
  xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:e="http://x.org/ns#" xml:base="http://x.org/base" xml:lang="en" e:odd="a > b">
"""


def document(n, seed=1):
    rnd, out = random.Random(seed), [HEAD]
    for i in range(n):
        text = rnd.choice(["plain", "don't \"quote\"", "<![CDATA[a <b> ]] > c]]>", "naïve 日本 🙂", "x" * rnd.choice([1, 50, 400]), "a &gt; b &ex;"])
        kind = rnd.randrange(7)
        if kind == 0:
            out.append(f'<owl:Class rdf:about="#c{i}"><rdfs:label>{text}</rdfs:label><rdfs:subClassOf><owl:Class rdf:about="&ex;n{i}"><rdfs:comment xml:lang="fr">{text}</rdfs:comment></owl:Class></rdfs:subClassOf></owl:Class>')
        elif kind == 1:
            out.append(f"<owl:Class rdf:ID='i{i}' e:note='a > b \" {i}' />\n\n")
        elif kind == 2:
            out.append(f'<!-- <owl:Class rdf:about="no{i}"> ' + "> - >" * rnd.choice([0, 3, 40]) + " -->")
        elif kind == 3:
            out.append(f'<rdf:Description rdf:nodeID="n{i % 5}"><e:p rdf:parseType="Collection"><rdf:Description rdf:about="#m{i}"/><rdf:Description rdf:about="#k{i}"/></e:p></rdf:Description>')
        elif kind == 4:
            out.append(f'<e:Thing\n  rdf:about="#t{i}"\n  e:q="{"v > w " * rnd.choice([1, 30])}"><e:inner rdf:parseType="Resource"><e:z>{i}</e:z><!-- > --></e:inner></e:Thing  >')
        elif kind == 5:
            out.append(f"<?go {i} > on ?>" + f'<e:Deep rdf:about="#d{i}">' + "".join(f'<e:has><e:Deep rdf:about="#d{i}_{j}">' for j in range(12)) + "</e:Deep></e:has>" * 12 + "</e:Deep>")
        else:
            out.append(f'<rdf:Description rdf:about="#l{i}"><e:lit rdf:parseType="Literal"><b a="1">x</b></e:lit><rdf:type rdf:resource="&ex;T"/></rdf:Description>')
    return "".join(out) + "\n</rdf:RDF>\n"


def shape(rows):
    """Triples with generated nodes told by nothing but that they are such; named nodes keep their names."""
    blank = lambda x, kind: "_" if kind == "bnode" and not x.startswith("n") else x
    return sorted((blank(r.s, r.s_kind), r.p, blank(r.o, r.o_kind), r.o_kind, str(r.o_lang), str(r.o_dtype), r.graph) for r in rows)


@pytest.mark.parametrize("size", [900, 4001])
def test_a_file_in_parts_equals_the_whole_file(spark, tmp_path, size):
    path = tmp_path / "some file.rdf"
    path.write_text(document(250), encoding="utf-8")
    whole = rdf.read_rdfxml(spark, str(path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = rdf.read_rdfxml(spark, str(path), whole=0).collect()
        blocks = rdfxml_split._records(spark, [str(path)]).select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 10
    assert len(got) == len({tuple(r) for r in got}) and shape(got) == shape(whole)


def test_files_that_cannot_be_cut(spark, tmp_path):
    a, b, c = tmp_path / "a.rdf", tmp_path / "b.rdf", tmp_path / "c.rdf"
    a.write_text('<owl:Class xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:about="http://x/a"/>')
    b.write_text(HEAD.replace("?>", "?>", 1) + '<owl:Class rdf:about="http://x/b"/></rdf:RDF>')
    c.write_text(HEAD.rstrip()[:-1] + "/>")
    got = {r.s for r in rdf.read_rdfxml(spark, str(tmp_path), whole=0).collect()}
    assert got == {r.s for r in rdf.read_rdfxml(spark, str(tmp_path)).collect()} and {"http://x/a", "http://x/b"} <= got


def test_escapes_and_quads(spark, tmp_path):
    lines = [
        r'<http://x/café> <http://x/p> "café \U0001F642 \\u0041 \\A \b\f\n\' \uD800 \uZZ" .', r'<http://x/a> <http://x/p1> <http://x/\U0000006f> .', r'_:b <http://x/p> "x"^^<http://x/t> .',
    ]
    (tmp_path / "a.nt").write_text("\n".join(lines), encoding="utf-8")
    got = {(r.s, r.p, r.o, r.o_dtype) for r in rdf.read_graph(spark, str(tmp_path / "a.nt")).collect()}
    assert got == {("http://x/café", "http://x/p", "café 🙂 \\u0041 \\A \b\f\n' � \\uZZ", None), ("http://x/a", "http://x/p1", "http://x/o", None), ("b", "http://x/p", "x", "http://x/t")}
    (tmp_path / "a.nq").write_text('<http://x/a> <http://x/p> "v"@en <http://x/g> .\n<http://x/a> <http://x/p> <http://x/o> _:g1 . # c\n_:a <http://x/p> _:o .\n')
    got = {(r.graph.split("/")[-1], r.s, r.o, r.o_kind, r.o_lang) for r in rdf.read_graph(spark, str(tmp_path / "a.nq")).collect()}
    assert got == {("g", "http://x/a", "v", "literal", "en"), ("g1", "http://x/a", "http://x/o", "iri", None), ("a.nq", "a", "o", "bnode", None)}
