import random

import pytest

from kgloom.sources import rdf, turtle, turtle_split

HEAD = """\ufeff# a prefix: in a comment, \"\"\" too
@prefix e: <http://x.org/ns#> . PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
@base <http://x.org/base/> .
"""


def document(n, seed=1):
    rnd, out = random.Random(seed), [HEAD]
    for i in range(n):
        text = rnd.choice(["plain", "a # b .", "prefix base", "naïve 日本 🙂", "x" * rnd.choice([1, 50, 400]), r"q \" \\"])
        out.append(
            rnd.choice(
                [
                    f'e:a{i} a e:T ; rdfs:label "{text}"@en .',
                    f'<r{i}> e:p """{text}\n@prefix e: <http://wrong/> .\n\'\'\' # "" .\nend\\"""" , 1.5 , -2 .',
                    f"e:b{i} e:q '''{text}\n\"\"\"\ne:no e:no e:no .\n''' ; e:r true . # it's <a> \"comment .",
                    f"e:c{i}\n  e:p [ e:q ( <#x{i}> \"{text}\" 3 ) ;\n e:r _:n{i % 5} ]\n .",
                    f"@prefix f: <sub{i % 3}/> .\nf:d{i} e:p f:o .",
                    f"@base <http://x.org/other{i % 2}/> .",
                    f"@base <deep/> .\nPREFIX f: <#{i}> f:d{i} e:p f:o\\. .\n",
                    f"# {text} .\r\n<http://y#k{i}> a <http://y#T> .\r",
                    "e:l e:p " + ",\n".join(f'"""{text}\n{j}"""' for j in range(rnd.choice([2, 60]))) + " .",
                ]
            )
        )
    return "\n".join(out)


def shape(rows):
    """Triples with generated nodes told by nothing but that they are such; named nodes keep their names."""
    blank = lambda x, kind: "_" if kind == "bnode" and not x.startswith("n") else x
    return sorted((blank(r.s, r.s_kind), r.p, blank(r.o, r.o_kind), r.o_kind, str(r.o_lang), str(r.o_dtype), r.graph) for r in rows)


@pytest.mark.parametrize(("size", "seed"), [(700, 1), (4001, 2)])
def test_a_file_in_parts_equals_the_whole_file(spark, tmp_path, size, seed):
    path = tmp_path / "some file.ttl"
    path.write_bytes(document(300, seed).encode())
    whole = rdf.read_graph(spark, str(path)).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = turtle.read_turtle(spark, str(path), whole=0).collect()
        blocks = turtle_split._lines(spark, [str(path)]).select("block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert blocks > 10 and len(whole) > 900
    assert len(got) == len({tuple(r) for r in got}) and shape(got) == shape(whole)


def test_files_that_cannot_be_cut_and_errors(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix\n e: <http://x/> .\ne:a e:p e:o .\n")
    (tmp_path / "b.ttl").write_text('<http://x/b> <http://x/p> "a\\\nb" .')
    (tmp_path / "c.ttl").write_text("<c> <p> <o> .")
    got = turtle.read_turtle(spark, str(tmp_path), whole=0).collect()
    assert shape(got) == shape(turtle.read_turtle(spark, str(tmp_path)).collect()) and len(got) == 3
    (tmp_path / "d.ttl").write_text("<a> <b> <c> .\n<a> <b> .\n")
    with pytest.raises(Exception, match="found"):
        turtle.read_turtle(spark, str(tmp_path / "d.ttl"), whole=0).collect()


def test_triples_leave_a_task_while_the_file_is_read():
    found = turtle.parsed("<a> <b> <c> .\n" * 3 + "no Turtle")
    assert [next(found)[3] for _ in range(3)] == ["c"] * 3
    with pytest.raises(SyntaxError):
        next(found)
