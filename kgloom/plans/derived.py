"""Inputs of the registered queries, derived from the star-schema, documents and embeddings tables."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import model as M
from kgloom.operators import graph as G
from kgloom.operators import vectors as V
from kgloom.operators.settle import settled


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"urn:{kind}:"), key.cast("string"))


_kgs: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived graph, written once per session and folder: a graph is a stored table to the
    operators, which read it several times, not a union of scans."""
    known = _kgs.setdefault(spark, {})
    if sf_dir not in known:
        known[sf_dir] = settled(_kg(spark, sf_dir))
    return known[sf_dir]


def _kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples: every region, nation, supplier, customer and part is a class with a label; their
    keys and part types and brands make the taxonomy. Suppliers are instances of their nation,
    nations carry a comment, brands, types and regions each give a property of one kind."""
    t = lambda n: table(spark, sf_dir, n)
    c = F.col
    parts = []

    def entity(df, kind, key, label, *parents):
        me = _iri(kind, c(key))
        parts.append(df.select(*M.triple("kg", me, M.TYPE, M.OWL + "Class")))
        parts.append(df.select(*M.triple("kg", me, M.LABEL, c(label), "literal")))
        parts.extend(df.select(*M.triple("kg", me, M.SUBCLASS, p)) for p in parents)

    region, nation, supplier, part = t("region"), t("nation"), t("supplier"), t("part")
    entity(region, "region", "r_regionkey", "r_name")
    entity(nation, "nation", "n_nationkey", "n_name", _iri("region", c("n_regionkey")))
    entity(supplier, "supplier", "s_suppkey", "s_name", _iri("nation", c("s_nationkey")))
    entity(t("customer"), "customer", "c_custkey", "c_name", _iri("nation", c("c_nationkey")))
    entity(part, "part", "p_partkey", "p_name", _iri("ptype", c("p_type")), _iri("pbrand", c("p_brand")))
    parts.append(supplier.select(*M.triple("kg", _iri("supplier", c("s_suppkey")), M.TYPE, _iri("nation", c("s_nationkey")))))
    parts.append(nation.select(*M.triple("kg", _iri("nation", c("n_nationkey")), M.RDFS + "comment", F.concat(F.lit("nation of region "), c("n_regionkey").cast("string")), "literal")))
    for df, col, kind, of in ((part, "p_brand", "brand", M.OBJECT_PROPERTY), (part, "p_type", "type", M.DATATYPE_PROPERTY), (region, "r_name", "region", M.RDF_PROPERTY)):
        parts.append(df.select(col).distinct().select(*M.triple("kg", _iri("prop:" + kind, c(col)), M.TYPE, of)))
    return M.union_graphs(*parts)


def kg_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph with blank nodes: every supplier is a subclass of a restriction on its nation, a blank
    node, behind which lies another one with the supplier's name."""
    c, s = F.col, table(spark, sf_dir, "supplier")
    me, rest, more = _iri("supplier", c("s_suppkey")), F.concat(F.lit("r"), c("s_suppkey").cast("string")), F.concat(F.lit("q"), c("s_suppkey").cast("string"))
    blank = lambda *t, o="iri": s.select(*M.triple("kg", *t, o, "bnode"))
    return M.union_graphs(
        _kg(spark, sf_dir), s.select(*M.triple("kg", me, M.RDFS + "seeAlso", rest, "bnode")), blank(rest, M.TYPE, M.RESTRICTION),
        blank(rest, M.OWL + "someValuesFrom", _iri("nation", c("s_nationkey"))), blank(rest, M.RDFS + "seeAlso", more, o="bnode"),
        blank(more, M.LABEL, c("s_name"), o="literal"), blank(more, M.RDFS + "isDefinedBy", _iri("nation", c("s_nationkey"))),
    )


KG_SQL = f"""
kg AS (
  WITH e AS (
    SELECT 'urn:region:' || r_regionkey AS s, r_name AS label FROM region
    UNION ALL SELECT 'urn:nation:' || n_nationkey, n_name FROM nation
    UNION ALL SELECT 'urn:supplier:' || s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'urn:customer:' || c_custkey, c_name FROM customer
    UNION ALL SELECT 'urn:part:' || p_partkey, p_name FROM part),
  up AS (
    SELECT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation
    UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier
    UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey FROM customer
    UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:ptype:' || p_type FROM part
    UNION ALL SELECT 'urn:part:' || p_partkey, 'urn:pbrand:' || p_brand FROM part)
  SELECT s, '{M.TYPE}' AS p, '{M.OWL}Class' AS o, 'iri' AS o_kind FROM e
  UNION SELECT s, '{M.LABEL}', label, 'literal' FROM e
  UNION SELECT s, '{M.SUBCLASS}', o, 'iri' FROM up
  UNION SELECT 'urn:supplier:' || s_suppkey, '{M.TYPE}', 'urn:nation:' || s_nationkey, 'iri' FROM supplier
  UNION SELECT 'urn:nation:' || n_nationkey, '{M.RDFS}comment', 'nation of region ' || n_regionkey, 'literal' FROM nation
  UNION SELECT 'urn:prop:brand:' || p_brand, '{M.TYPE}', '{M.OBJECT_PROPERTY}', 'iri' FROM part
  UNION SELECT 'urn:prop:type:' || p_type, '{M.TYPE}', '{M.DATATYPE_PROPERTY}', 'iri' FROM part
  UNION SELECT 'urn:prop:region:' || r_name, '{M.TYPE}', '{M.RDF_PROPERTY}', 'iri' FROM region)"""


KG_BLANK_SQL = KG_SQL.strip().removesuffix(")") + f""")
, kgb AS (SELECT s, p, o, o_kind FROM kg
  UNION SELECT 'urn:supplier:' || s_suppkey, '{M.RDFS}seeAlso', 'r' || s_suppkey, 'bnode' FROM supplier
  UNION SELECT 'r' || s_suppkey, '{M.TYPE}', '{M.RESTRICTION}', 'iri' FROM supplier
  UNION SELECT 'r' || s_suppkey, '{M.OWL}someValuesFrom', 'urn:nation:' || s_nationkey, 'iri' FROM supplier
  UNION SELECT 'r' || s_suppkey, '{M.RDFS}seeAlso', 'q' || s_suppkey, 'bnode' FROM supplier
  UNION SELECT 'q' || s_suppkey, '{M.LABEL}', s_name, 'literal' FROM supplier
  UNION SELECT 'q' || s_suppkey, '{M.RDFS}isDefinedBy', 'urn:nation:' || s_nationkey, 'iri' FROM supplier)"""


def part_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(uri, label) of parts with even keys and with odd ones."""
    p = table(spark, sf_dir, "part")
    rows = p.select(_iri("part", F.col("p_partkey")).alias("uri"), F.col("p_name").alias("label"), (F.col("p_partkey") % 2).alias("side"))
    return tuple(rows.where(F.col("side") == i).select("uri", "label") for i in (0, 1))


def same_label(source: DataFrame, target: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entities with a label in common, as '=' rows. (by, uri, label) in."""
    s, t = source.withColumnRenamed("uri", "source"), target.withColumnRenamed("uri", "target")
    return s.join(t, [*by, "label"]).select(*by, "source", "target", F.lit("=").alias("relation"))


def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as an alignment with repeated keys, self pairs and shared entities.

    Entities are part and supplier keys taken modulo 997; the relation follows the return flag,
    the confidence the discount and tax."""
    li = table(spark, sf_dir, "lineitem")
    rel = F.when(F.col("l_returnflag") == "A", "=").when(F.col("l_returnflag") == "N", "<").otherwise(">")
    return li.select(
        F.concat(F.lit("urn:n:"), (F.col("l_partkey") % 997).cast("string")).alias("source"), F.concat(F.lit("urn:n:"), (F.col("l_suppkey") % 997).cast("string")).alias("target"),
        rel.alias("relation"), F.round(F.col("l_discount") + F.col("l_tax") * 0.1, 6).alias("confidence"),
    )


LINE_SQL = """
li AS (
  SELECT 'urn:n:' || (l_partkey % 997) AS source, 'urn:n:' || (l_suppkey % 997) AS target,
         CASE l_returnflag WHEN 'A' THEN '=' WHEN 'N' THEN '<' ELSE '>' END AS relation,
         round(l_discount + l_tax * 0.1, 6) AS confidence
  FROM lineitem),
al AS (SELECT source, target, relation, max(confidence) AS confidence FROM li GROUP BY ALL)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, v): unit vectors with even ids, and with odd ones."""
    e = table(spark, sf_dir, "embeddings")
    return tuple(V.unit(e.where(F.col("vec_id") % 2 == i), "vec_id", "embedding") for i in (0, 1))


def directed(vectors: DataFrame, half: int) -> DataFrame:
    """A stand-in for an instruction: one half of the dimensions counts double."""
    n = F.size("v") / 2
    return vectors.select("id", F.transform("v", lambda x, i: F.when((i < n) == F.lit(half == 0), x * 2).otherwise(x)).alias("v"))


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_encoder():
    """A stand-in for a sentence encoder that SQL can express: how often each letter and digit occurs."""
    import numpy as np

    return lambda texts: np.array([[t.lower().count(c) for c in LETTERS] for t in texts], float).reshape(len(texts), len(LETTERS))


def part_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two graphs: classes of even parts with their names as labels, and those of odd ones."""
    graph = lambda df: M.union_graphs(df.select(*M.triple("g", F.col("uri"), M.TYPE, M.OWL + "Class")), df.select(*M.triple("g", F.col("uri"), M.LABEL, F.col("label"), "literal")))
    return tuple(graph(df) for df in part_labels(spark, sf_dir))


def letters_sql(k: int, instruction: str = "") -> str:
    """(source, target, confidence) as top_k, and top_b the other way round, of part texts by letters; sources after an instruction."""
    before = instruction.replace("'", "''") + "\n" if instruction else ""
    score = "round(list_inner_product(s.v, t.v), 6)"
    return f"""txt AS (SELECT 'urn:part:' || p_partkey AS id, p_partkey % 2 AS side, lower(CASE WHEN p_partkey % 2 = 0 THEN '{before}' ELSE '' END || 'Label: ' || p_name || chr(10)) AS x FROM part),
cnt AS (SELECT id, side, list_transform(string_split('{LETTERS}', ''), lambda c: (length(x) - length(replace(x, c, '')))::DOUBLE) AS w FROM txt),
vec AS (SELECT id, side, list_transform(w, lambda y: y / sqrt(list_inner_product(w, w))) AS v FROM cnt),
prod AS (SELECT s.id AS source, t.id AS target, {score} AS confidence FROM vec s JOIN vec t ON s.side = 0 AND t.side = 1),
top_k AS (SELECT * FROM prod QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) <= {k}),
top_b AS (SELECT * FROM prod QUALIFY row_number() OVER (PARTITION BY target ORDER BY confidence DESC, source) <= {k})"""


def predictions(spark: SparkSession, sf_dir: str, variant: str = "asymmetric", k: int = 20) -> DataFrame:
    s, t = sides(spark, sf_dir)
    if variant == "symmetric":
        return V.top_k(s, t, k).withColumn("relation", F.lit("=")).select("source", "target", "relation", "confidence")
    runs = [V.top_k(directed(s, h), t, k).withColumn("relation", F.lit(r)) for h, r in ((0, "<"), (1, ">"))]
    return runs[0].unionByName(runs[1]).select("source", "target", "relation", "confidence")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (2i, 2i+1) and (2i, 2i+3), related by their labels, in several spellings of the relation
    and some relations that evaluation drops."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = e.where("vec_id % 2 = 0").select("vec_id", F.col("label").alias("la"), F.explode(F.array(F.lit(1), F.lit(3))).alias("step"))
    b = e.select((F.col("vec_id")).alias("other"), F.col("label").alias("lb"))
    j = a.join(b, F.col("other") == F.col("vec_id") + F.col("step"))
    odd = F.col("vec_id") % 4 == 0
    rel = F.when(F.col("vec_id") % 22 == 0, F.lit("~")).when(F.col("vec_id") % 26 == 0, F.lit(" PartOf "))
    rel = rel.when(F.col("la") == F.col("lb"), F.when(odd, "≡").otherwise("=")).when(F.col("la") < F.col("lb"), F.when(odd, " < ").otherwise("⊑")).otherwise(F.when(odd, "≥").otherwise(">"))
    return j.select(F.col("vec_id").cast("string").alias("source"), F.col("other").cast("string").alias("target"), rel.alias("relation"))


def vector_sql(k: int = 20) -> str:
    score = lambda a: f"round(list_inner_product({a}, t.v), 6)"
    pick = lambda name, run, rel: f"""
{name} AS (
  SELECT source, target, '{rel}' AS relation, confidence FROM (
    SELECT s.id AS source, t.id AS target, {score("s." + run)} AS confidence FROM sv s, tv t)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) <= {k})"""  # noqa: E731
    return (
        """
uv AS (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) AS v
  FROM (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings)),
sv AS (
  SELECT id, v, list_transform(v, lambda x, i: CASE WHEN i <= len(v) / 2 THEN x * 2 ELSE x END) AS lo,
         list_transform(v, lambda x, i: CASE WHEN i <= len(v) / 2 THEN x ELSE x * 2 END) AS hi
  FROM uv WHERE vec_id % 2 = 0),
tv AS (SELECT id, v FROM uv WHERE vec_id % 2 = 1),"""
        + pick("sym", "v", "=") + "," + pick("broader", "lo", "<") + "," + pick("narrower", "hi", ">")
        + ",\nasym AS (SELECT * FROM broader UNION ALL SELECT * FROM narrower)"
    )


GOLD_SQL = """
gold AS (
  SELECT CAST(a.vec_id AS VARCHAR) AS source, CAST(b.vec_id AS VARCHAR) AS target,
    CASE WHEN a.vec_id % 22 = 0 THEN '~' WHEN a.vec_id % 26 = 0 THEN ' PartOf '
         WHEN a.label = b.label THEN CASE WHEN a.vec_id % 4 = 0 THEN '≡' ELSE '=' END
         WHEN a.label < b.label THEN CASE WHEN a.vec_id % 4 = 0 THEN ' < ' ELSE '⊑' END
         ELSE CASE WHEN a.vec_id % 4 = 0 THEN '≥' ELSE '>' END END AS relation
  FROM embeddings a JOIN embeddings b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 3) WHERE a.vec_id % 2 = 0),
norm AS (
  SELECT source, target, relation, CASE trim(relation) WHEN '=' THEN '=' WHEN '≡' THEN '=' WHEN '>' THEN '>' WHEN '≥' THEN '>'
         WHEN '⊒' THEN '>' WHEN '<' THEN '<' WHEN '≤' THEN '<' WHEN '⊑' THEN '<' END AS norm
  FROM gold),
g AS (
  SELECT *, CASE norm WHEN '=' THEN 'equivalence' WHEN '<' THEN 'subclass' ELSE 'superclass' END AS label
  FROM norm WHERE norm IS NOT NULL),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target, relation) AS rank,
         row_number() OVER (PARTITION BY source, relation ORDER BY confidence DESC, target) AS relation_rank
  FROM asym),
gr AS (
  SELECT g.*, s.rank AS strict, l.rank AS lax, CASE WHEN g.norm <> '=' THEN s.relation_rank END AS per_relation_strict
  FROM g LEFT JOIN rk s ON s.source = g.source AND s.target = g.target AND s.relation = g.norm
  LEFT JOIN (SELECT source, target, min(rank) AS rank FROM rk GROUP BY ALL) l ON l.source = g.source AND l.target = g.target),
bm AS (
  SELECT 'strict' AS mode, label, strict AS rank FROM gr UNION ALL SELECT 'strict', 'all', strict FROM gr
  UNION ALL SELECT 'lax', label, lax FROM gr UNION ALL SELECT 'lax', 'all', lax FROM gr
  UNION ALL SELECT 'per_relation_strict', label, per_relation_strict FROM gr WHERE norm <> '='),
cells AS (
  SELECT m.mode, l.label FROM (VALUES ('strict'), ('lax')) m(mode), (VALUES ('equivalence'), ('subclass'), ('superclass'), ('all')) l(label)
  UNION ALL SELECT 'per_relation_strict', l.label FROM (VALUES ('subclass'), ('superclass')) l(label))"""


def entities(triples: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Classes of some tables."""
    return G.classes(triples).where(F.substring_index(F.col("uri"), ":", 2).isin([f"urn:{k}" for k in kinds]))


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, logprob): every space-separated word of every document as a candidate token
    with a pseudo log probability, every 7th word replaced by an answer word."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    words = F.array(*[F.lit(x) for x in (" Yes", "no", "True.", "FALSE", "yesterday", "nothing", "«yes»", "No,")])
    token = F.when(F.col("i") % 7 == 0, F.element_at(words, ((F.col("doc_id") + F.col("i")) % 8 + 1).cast("int"))).otherwise(F.col("word"))
    return d.select("doc_id", token.alias("token"), (-((F.col("doc_id") * 31 + F.col("i") * 17) % 1000) / 100.0).alias("logprob"))


LOGPROB_SQL = """
lp AS (
  SELECT doc_id, CASE WHEN i % 7 = 0 THEN ([' Yes', 'no', 'True.', 'FALSE', 'yesterday', 'nothing', '«yes»', 'No,'])[(doc_id + i) % 8 + 1] ELSE word END AS token,
         -((doc_id * 31 + i * 17) % 1000) / 100.0::DOUBLE AS logprob
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)))"""
