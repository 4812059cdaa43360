import re
from urllib.parse import unquote

import numpy as np
import pytest

from kgloom.functions import prompts as PR
from kgloom.functions import text as X
from pyspark.sql import functions as F

LABELS = ["Crohn's disease", "HeartValve", "%41bc", "a+b", "100%", "tab\tinside", "the of and", "crème Brûlée", "", "  padded  ", "XMLHttpRequest", "x_y__z", "Ünïcode Straße", "\xa0nbsp\xa0", "a:b c", "ABC Def", '"Quoted Name"', "caf%C3%A9", "%zz bad"]


def slow(label):
    x = re.sub(r'(?<!^)(?<!\s|")(?=[A-Z][a-z])', "_", label.strip()).replace(" ", "_").lower()
    x = re.sub(r"_+", "_", re.sub(r"[^a-z0-9\s:_]", "_", unquote(x)))
    return sorted(set(x.split("_")) - set(X.STOPWORDS) - {""})


def test_token_set(spark):
    got = spark.createDataFrame([(x,) for x in LABELS], "label string").select("label", X.token_set(F.col("label")).alias("t")).collect()
    assert {r.label: r.t for r in got} == {x: slow(x) for x in LABELS}
    assert slow("Crohn's disease") == ["crohn", "disease", "s"]
    assert spark.range(1).select(X.token_set(F.lit(None).cast("string")).alias("t")).collect()[0].t is None


@pytest.mark.parametrize(
    ("uri", "frag", "digits"),
    [("http://x/a#b", "b", False), ("http://x/a/12", "12", True), ("plain", "plain", False), ("http://x/", "", True), ("u#a1", "a1", True), ("u#ab1", "ab1", False), ("a#b#c", "c", False)],
)
def test_fragment(spark, uri, frag, digits):
    r = spark.createDataFrame([(uri,)], "u string").select(X.fragment(F.col("u")).alias("f"), X.mostly_numbers(X.fragment(F.col("u"))).alias("m")).collect()[0]
    assert (r.f, r.m) == (frag, digits)


def test_truth_tokens(spark):
    want = {"Yes.": (True, False), "yesterday": (False, False), "true": (True, False), "nothing": (False, False), "no": (False, True), " FALSE": (False, True), "«yes»": (True, False)}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", X.is_positive(F.col("t")).alias("p"), X.is_negative(F.col("t")).alias("n")).collect()
    assert {r.t: (r.p, r.n) for r in got} == want


def test_vectors_and_sublists(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(X.l2_normalized(F.col("a")).alias("a"), X.l2_normalized(F.col("z")).alias("z"), X.dot(F.col("a"), F.col("a")).alias("d")).collect()[0]
    assert np.allclose(r.a, [0.6, 0.8]) and r.z == [0.0, 0.0] and r.d == 25.0
    df = spark.createDataFrame([([1, 2, 1, 2, 9], [1, 2], [9]), ([5], [], [7]), ([], [1], [1])], "f array<int>, s array<int>, x array<int>")
    got = df.select(X.sublist_positions(F.col("f"), F.col("s"), also=F.col("x")).alias("p"), X.sublist_positions(F.col("f"), F.col("s"), first_only=True).alias("q")).collect()
    assert [(r.p, r.q) for r in got] == [([0, 1, 2, 3, 4], [0, 1]), ([], []), ([], [])]


def test_relations(spark):
    rows = ["=", "≡", " < ", "⊑", "≥", "~", "", None]
    got = spark.createDataFrame([(x,) for x in rows], "r string").select(X.normalized_relation(F.col("r")).alias("n")).collect()
    assert [r.n for r in got] == ["=", "=", "<", "<", ">", None, None, None]
    assert spark.range(1).select(X.duration(F.lit(3_661_000_000_000)).alias("d")).collect()[0].d == "01:01:01"


def test_prompts(spark, tmp_path):
    p = PR.reranking("stwo_c")
    assert [m["role"] for m in p.messages] == ["system", "user"] and p.has_placeholder("source_kg")
    assert PR.build("Just text", {}).messages[0]["content"] == "Just text"
    with pytest.raises(ValueError):
        PR.build("", {})
    assert PR.raw("match {source_url}").format(source_url="u_1").to_text() == "match u_1"
    assert PR.with_instruction("e5-mistral", "I", "T") == "Instruct: I\nQuery: T" and PR.with_instruction("auto", "I", "T") == "I\nT" and PR.with_instruction("none", "", "T") == "T"
    with pytest.raises(KeyError):
        PR.with_instruction("unknown", "I", "T")
    with pytest.raises(KeyError):
        PR.instruction("sym_v9")
    assert PR.instruction(None) == "" and PR.family("x/Qwen3-Embedding-8B") == "qwen3-embedding" and PR.family("other") == "auto"
    assert PR.run_name("org/My Model:1") == "My_Model-1" and PR.model_id("sbert").endswith("MiniLM-L6-v2") and PR.loader_options("sbert") == {}
    df = spark.createDataFrame([("s", None)], "a string, b string")
    assert df.select(PR.template("<{x}> and {y}!", x=F.col("a"), y=F.col("b")).alias("t")).collect()[0].t == "<s> and !"
    p.write(str(tmp_path / "p.json"))
    assert "system" in (tmp_path / "p.json").read_text()
