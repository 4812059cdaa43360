"""Schemas and vocabulary of the triples, alignment and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _d = T.StringType(), T.DoubleType()

TRIPLES = T.StructType([T.StructField(c, _s) for c in ("graph", "s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dtype")])
ALIGNMENT = T.StructType(
    [
        T.StructField("source", _s),
        T.StructField("target", _s),
        T.StructField("relation", _s),
        T.StructField("confidence", _d),
        T.StructField("extensions", T.MapType(_s, _s)),
        T.StructField("seq", T.LongType()),
    ]
)
KEY = ["source", "target", "relation"]

# Namespaces and the predicates that carry meaning, labels in order of preference.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DCTERMS = "http://purl.org/dc/terms/"
FOAF = "http://xmlns.com/foaf/0.1/"
SCHEMA = "http://schema.org/"
ALIGN = "http://knowledgeweb.semanticweb.org/heterogeneity/alignment"

TYPE, LABEL, SUBCLASS = RDF + "type", RDFS + "label", RDFS + "subClassOf"
CLASS_TYPES = [RDFS + "Class", OWL + "Class"]
THING, RESTRICTION, ONTOLOGY = OWL + "Thing", OWL + "Restriction", OWL + "Ontology"
OBJECT_PROPERTY, DATATYPE_PROPERTY, RDF_PROPERTY = OWL + "ObjectProperty", OWL + "DatatypeProperty", RDF + "Property"
LABEL_PREDICATES = [
    LABEL,
    SKOS + "prefLabel",
    SCHEMA + "name",
    FOAF + "name",
    SKOS + "altLabel",
    SCHEMA + "alternateName",
    SCHEMA + "additionalName",
    SKOS + "hiddenLabel",
]
DESCRIPTION_PREDICATES = [RDFS + "comment", DCTERMS + "description", SCHEMA + "description"]


def empty_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLES)


def union_graphs(*graphs: DataFrame) -> DataFrame:
    """Set union of graphs; the ``graph`` column keeps blank nodes of different files apart."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.dropDuplicates()


def triple(graph, s, p, o, o_kind="iri", s_kind="iri", lang=None, dtype=None) -> list[F.Column]:
    """Columns of a triple from column expressions or literals."""
    lit = lambda x: x if isinstance(x, F.Column) else F.lit(x)
    values = zip(TRIPLES.names, (graph, s, s_kind, p, o, o_kind, lang, dtype))
    return [lit(v).cast("string").alias(n) for n, v in values]


def alignment(df: DataFrame) -> DataFrame:
    """Casts any frame with the four columns to the alignment schema.

    The confidence is cast strictly: a text that is no number raises, as a file with a missing
    measure should. NaN is refused, since it has no place in an order by confidence."""
    conf = F.col("confidence").cast("double")
    conf = F.when(F.isnan(conf), F.raise_error(F.lit("confidence is NaN"))).otherwise(conf)
    ext = F.col("extensions") if "extensions" in df.columns else F.lit(None).cast("map<string,string>")
    seq = F.col("seq") if "seq" in df.columns else F.lit(None).cast("bigint")
    return df.select(*[F.col(c).cast("string").alias(c) for c in KEY], conf.alias("confidence"), ext.alias("extensions"), seq.cast("bigint").alias("seq"))
