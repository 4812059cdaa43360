"""Operators over triples: classes, properties, labels, descriptions, taxonomy.

Every operator is one batch job over all entities. ``triples`` has the schema of
``kgloom.model.TRIPLES``; layouts clustered by ``p`` let the predicate filters prune row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom import model as M
from kgloom.functions.text import fragment, mostly_numbers
from kgloom.operators.settle import settled

_T = ["s", "s_kind", "p", "o", "o_kind", "o_lang", "o_dtype"]


def classes(triples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(uri): IRIs typed as a class, or on either side of subClassOf; owl:Thing is none. With ``by``, columns that
    tell graphs in one table apart, the classes of each."""
    iri_s, iri_o = F.col("s_kind") == "iri", F.col("o_kind") == "iri"
    sub = triples.where(F.col("p") == M.SUBCLASS)
    typed = triples.where((F.col("p") == M.TYPE) & F.col("o").isin(M.CLASS_TYPES) & iri_s).select(*by, F.col("s").alias("uri"))
    both = sub.where(iri_s).select(*by, F.col("s").alias("uri")).unionByName(sub.where(iri_o).select(*by, F.col("o").alias("uri")))
    return typed.unionByName(both).where(F.col("uri") != M.THING).distinct()


def _typed(triples: DataFrame, *types: str) -> DataFrame:
    return triples.where((F.col("p") == M.TYPE) & F.col("o").isin(*types)).select(F.col("s").alias("uri")).distinct()


def object_properties(triples: DataFrame) -> DataFrame:
    return _typed(triples, M.OBJECT_PROPERTY)


def datatype_properties(triples: DataFrame) -> DataFrame:
    return _typed(triples, M.DATATYPE_PROPERTY)


def rdf_properties(triples: DataFrame) -> DataFrame:
    return _typed(triples, M.RDF_PROPERTY)


def all_properties(triples: DataFrame) -> DataFrame:
    return _typed(triples, M.OBJECT_PROPERTY, M.DATATYPE_PROPERTY, M.RDF_PROPERTY)


def instances(triples: DataFrame, of: DataFrame, sample: int | None = None) -> DataFrame:
    """(class, uri) of the classes in ``of`` (uri); a sample takes the first URIs in order."""
    typed = triples.where(F.col("p") == M.TYPE).select(F.col("o").alias("class"), F.col("s").alias("uri")).distinct()
    out = typed.join(of.select(F.col("uri").alias("class")).distinct(), "class", "left_semi")
    if sample is None:
        return out
    w = Window.partitionBy("class").orderBy("uri")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).drop("_r")


def labels(triples: DataFrame, entities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(uri, label): every distinct label; an entity without one gets its URI's fragment, unless
    that is mostly digits. ``by`` as in ``classes``."""
    key = [*by, "uri"]
    wanted = entities.select(*key).distinct()
    found = triples.where(F.col("p").isin(M.LABEL_PREDICATES)).select(*by, F.col("s").alias("uri"), F.col("o").alias("label")).distinct()
    found = found.join(wanted, key, "left_semi")
    bare = wanted.join(found, key, "left_anti").withColumn("label", fragment(F.col("uri")))
    return found.unionByName(bare.where(~mostly_numbers(F.col("label"))))


def one_label(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(uri, label) with one label per entity, the least one, '' for none."""
    best = labels(triples, entities).groupBy("uri").agg(F.min("label").alias("label"))
    return entities.select("uri").distinct().join(best, "uri", "left").select("uri", F.coalesce("label", F.lit("")).alias("label"))


def first_classes(triples: DataFrame, n: int = 3) -> DataFrame:
    """The first n class URIs in order, for smoke runs."""
    return classes(triples).orderBy("uri").limit(n)


def only_classes(triples: DataFrame, keep: DataFrame) -> DataFrame:
    """A graph whose classes are those of ``keep`` (uri) alone: what makes another entity a class is
    left out, all else about it stays, so descriptions still reach it."""
    gone = classes(triples).join(keep.select("uri"), "uri", "left_anti")
    typed = (F.col("p") == M.TYPE) & F.col("o").isin(M.CLASS_TYPES)
    makes = F.when(typed | (F.col("p") == M.SUBCLASS), F.col("s"))
    left = triples.withColumn("uri", makes).join(gone, "uri", "left_anti").drop("uri")
    # a kept class's parents would be classes by being one
    up = F.when(F.col("p") == M.SUBCLASS, F.col("o"))
    return left.withColumn("uri", up).join(gone, "uri", "left_anti").drop("uri").select(*triples.columns)


# --- descriptions: (entity, s, s_kind, p, o, o_kind, o_lang, o_dtype), distinct -----------------
#
# What an entity reaches is found first, as pairs (entity, node) over the bare edges; triples join once, at
# the end. So however many hops lead to a node of very many triples, they move once, and neither edges nor
# pairs carry literals. As pairs are distinct and triples are, the result is, without a look at its rows.


def _own(triples: DataFrame, reach: DataFrame) -> DataFrame:
    """Triples of the nodes that are reached; reach is (entity, node), distinct."""
    known = triples.select(*_T).distinct().withColumnRenamed("s", "node")
    return reach.join(known, "node").select("entity", F.col("node").alias("s"), *_T[1:])


def _edges(triples: DataFrame, kinds: tuple[str, ...] = ("iri", "bnode")) -> DataFrame:
    """(node, next): subjects and their objects of some kinds."""
    return triples.where(F.col("o_kind").isin(*kinds)).select(F.col("s").alias("node"), F.col("o").alias("next")).distinct()


def _next(reach: DataFrame, edges: DataFrame) -> DataFrame:
    return reach.join(edges, "node").select("entity", F.col("next").alias("node")).distinct()


def _start(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("uri").alias("entity"), F.col("uri").alias("node")).distinct()


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def describe_outgoing(triples: DataFrame, entities: DataFrame, hops: int = 2) -> DataFrame:
    """Triples within so many hops along objects of any kind."""
    reach = [_start(entities)]
    for _ in range(hops - 1):
        reach.append(_next(reach[-1], _edges(triples)))
    return _own(triples, _all(*reach))


def describe_outgoing_blank(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Hop 1; two further hops behind a blank node, one behind anything else."""
    start, edges = _start(entities), _edges(triples)
    behind = _next(_next(start, _edges(triples, ("bnode",))), edges)
    return _own(triples, _all(start, _next(start, edges), behind))


def describe_depth(triples: DataFrame, entities: DataFrame, depth: int = 1) -> DataFrame:
    """Triples of the entity; below ``depth`` a blank object is entered, an IRI object adds its label
    and types alone. At ``depth`` nothing is entered, blank nodes included."""
    reach = [_start(entities)]
    for _ in range(depth):
        reach.append(_next(reach[-1], _edges(triples, ("bnode",))))
    whole = _all(*reach)
    if not depth:
        return _own(triples, whole)
    named = _next(_all(*reach[:-1]), _edges(triples, ("iri",))).join(whole, ["entity", "node"], "left_anti")
    return _own(triples, whole).unionByName(_own(triples.where(F.col("p").isin(M.LABEL, M.TYPE)), named))


def describe_basic(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Label, description and type triples, with the rdfs:label of each type."""
    own = _own(triples.where(F.col("p").isin(*M.LABEL_PREDICATES, *M.DESCRIPTION_PREDICATES, M.TYPE)), _start(entities))
    types = own.where(F.col("p") == M.TYPE).select("entity", F.col("o").alias("node")).distinct()
    # an entity that is its own type has its label already
    return own.unionByName(_own(triples.where(F.col("p") == M.LABEL), types.where("entity <> node")))


def describe_text(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, text): lines 'Label: ', 'Description: ', 'Type: ' in predicate order, values in
    order inside a predicate; '' for an entity with none."""
    order = [*[(p, "Label: ") for p in M.LABEL_PREDICATES], *[(p, "Description: ") for p in M.DESCRIPTION_PREDICATES]]
    rank, head = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (p, h) in enumerate(order):
        rank, head = F.when(F.col("p") == p, i).otherwise(rank), F.when(F.col("p") == p, h).otherwise(head)
    own = _own(triples, _start(entities)).where(F.col("p").isin([p for p, _ in order]))
    lines = own.select("entity", rank.alias("rank"), F.concat(head, F.col("o")).alias("line"))
    typed = _own(triples.where(F.col("p") == M.TYPE), _start(entities)).select("entity", F.col("o").alias("node"))
    named = typed.join(triples.where(F.col("p") == M.LABEL).select(F.col("s").alias("node"), F.col("o").alias("name")), "node")
    lines = lines.unionByName(named.select("entity", F.lit(len(order)).alias("rank"), F.concat(F.lit("Type: "), "name").alias("line"))).distinct()
    text = lines.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    body = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    every = entities.select(F.col("uri").alias("entity")).distinct()
    return every.join(text, "entity", "left").select("entity", F.when(F.col("lines").isNull(), "").otherwise(body).alias("text"))


DESCRIPTIONS = {
    "description_two_outgoing": lambda t, e: describe_outgoing(t, e, 2),
    "description_three_outgoing": lambda t, e: describe_outgoing(t, e, 3),
    "description_two_outgoing_blank": describe_outgoing_blank,
    "description_one_gen": lambda t, e: describe_depth(t, e, 1),
    "description_two_gen": lambda t, e: describe_depth(t, e, 2),
    "description_three_gen": lambda t, e: describe_depth(t, e, 3),
    "description_basic": describe_basic,
    "description_text": describe_text,
}


def describe(name: str, triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Description by its name; an unknown name is refused before anything runs."""
    if name not in DESCRIPTIONS:
        raise ValueError(f"unknown description {name!r}, not one of {sorted(DESCRIPTIONS)}")
    return DESCRIPTIONS[name](triples, entities)


def term(value: Column, kind: Column, lang: Column | None = None, dtype: Column | None = None) -> Column:
    """A term in N-Triples notation."""
    text = F.concat(F.lit('"'), _escaped(value), F.lit('"'))
    if lang is not None:
        text = F.when(F.coalesce(lang, F.lit("")) != "", F.concat(text, F.lit("@"), lang)).when(F.coalesce(dtype, F.lit("")) != "", F.concat(text, F.lit("^^<"), dtype, F.lit(">"))).otherwise(text)
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(text)


def _escaped(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def serialize(description: DataFrame) -> DataFrame:
    """(entity, text) of a description: its triples as sorted canonical lines. Text passes through."""
    if "text" in description.columns:
        return description.select("entity", "text")
    line = F.concat(term(F.col("s"), F.col("s_kind")), F.lit(" <"), F.col("p"), F.lit("> "), term(F.col("o"), F.col("o_kind"), F.col("o_lang"), F.col("o_dtype")), F.lit(" ."))
    lines = description.groupBy("entity").agg(F.array_sort(F.collect_set(line)).alias("lines"))
    return lines.select("entity", F.array_join("lines", "\n").alias("text"))


# --- taxonomy -----------------------------------------------------------------------------------


def taxonomy(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (uri), edges (child, parent)) of the class taxonomy.

    Builtin superclasses add their child as a node alone; restrictions are no nodes."""
    sub = triples.where(F.col("p") == M.SUBCLASS).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    restricted = triples.where((F.col("p") == M.TYPE) & (F.col("o") == M.RESTRICTION)).select(F.col("s").alias("uri")).distinct()
    builtin = F.col("parent").isin(M.THING, *M.CLASS_TYPES)
    edges = sub.where(~builtin)
    for end in ("child", "parent"):
        edges = edges.join(restricted.withColumnRenamed("uri", end), end, "left_anti")
    nodes = _typed(triples, *M.CLASS_TYPES).unionByName(sub.select(F.col("child").alias("uri"))).unionByName(sub.where(~builtin).select(F.col("parent").alias("uri")))
    return nodes.distinct().join(restricted, "uri", "left_anti"), edges.select("child", "parent").distinct()


@dataclass
class Closure:
    """Reachability over contracted cycles: members (node, comp), comp being the least node of a strongly
    connected component; pairs (up, low) of different components, low below up; the rounds it took."""

    members: DataFrame
    pairs: DataFrame
    rounds: int

    def sizes(self) -> DataFrame:
        return self.members.groupBy("comp").agg(F.count("*").alias("size"))

    def counts(self) -> DataFrame:
        """(uri, n_descendants) of the nodes that have a descendant other than themselves: sizes are added up
        over components, pairs of nodes are not made."""
        sizes = settled(self.sizes())
        below = self.pairs.join(sizes.select(F.col("comp").alias("low"), "size"), "low").groupBy(F.col("up").alias("comp")).agg(F.sum("size").alias("below"))
        total = sizes.join(below, "comp", "left").withColumn("n_descendants", F.col("size") - 1 + F.coalesce("below", F.lit(0).cast("bigint")))
        return self.members.join(total.where("n_descendants > 0"), "comp").select(F.col("node").alias("uri"), "n_descendants")

    def expanded(self) -> DataFrame:
        """(ancestor, descendant): every pair of different nodes."""
        side = lambda comp, name: self.members.select(F.col("comp").alias(comp), F.col("node").alias(name))
        between = self.pairs.join(side("up", "ancestor"), "up").join(side("low", "descendant"), "low").select("ancestor", "descendant")
        several = self.sizes().where("size > 1").select("comp")
        ring = self.members.join(several, "comp")
        inside = ring.select("comp", F.col("node").alias("ancestor")).join(ring.select("comp", F.col("node").alias("descendant")), "comp").where("ancestor <> descendant")
        return between.unionByName(inside.select("ancestor", "descendant"))


def closure(edges: DataFrame) -> Closure:
    """Closure of (child, parent) by contraction and path doubling.

    Two sets double together: the pairs a path of exactly 2^k steps joins, and those that at most 2^k steps
    do. Exact steps after the known pairs give what lies up to 2^(k+1) steps apart, so rounds grow with
    the logarithm of the longest shortest path, and a chain finds every pair once. Pairs found both ways are
    one component and are contracted as soon as they are found: a ring of m nodes costs m pairs a round until
    then, and none after. A round that finds nothing ends it: the nearest pair still missing would lie
    between one and two times as far as the last round looked. Each round is written."""
    ends = edges.select(F.col("parent").alias("up"), F.col("child").alias("low")).distinct()
    exact = settled(ends)
    members = exact.select(F.col("up").alias("node")).unionByName(exact.select(F.col("low").alias("node"))).distinct()
    members = settled(members.withColumn("comp", F.col("node")))
    known, new, rounds = exact.where("up <> low"), exact.where("up <> low"), 0
    step = lambda a, b: a.select("up", F.col("low").alias("mid")).join(b.select(F.col("up").alias("mid"), "low"), "mid").select("up", "low")
    while True:
        least = _rings(new, known)
        if not least.isEmpty():
            members = settled(_renamed(members, least, "comp"))
            exact = settled(_renamed(_renamed(exact, least, "up"), least, "low").distinct())
            known = settled(_renamed(_renamed(known, least, "up"), least, "low").where("up <> low").distinct())
        rounds += 1
        far = step(exact, known).where("up <> low").distinct()
        new = settled(far.join(known, ["up", "low"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        exact = settled(step(exact, exact).distinct())
    while True:  # contraction can make older pairs mutual
        least = _rings(known, known)
        if least.isEmpty():
            return Closure(members, known, rounds)
        members = settled(_renamed(members, least, "comp"))
        known = settled(_renamed(_renamed(known, least, "up"), least, "low").where("up <> low").distinct())


def _rings(new: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): the least component b below a that a is found both above and below of."""
    both = new.join(known.select(F.col("low").alias("up"), F.col("up").alias("low")), ["up", "low"], "left_semi")
    ends = both.select(F.col("up").alias("a"), F.col("low").alias("b")).unionByName(both.select(F.col("low").alias("a"), F.col("up").alias("b")))
    return settled(ends.groupBy("a").agg(F.min("b").alias("b")).where("b < a"))


def _renamed(df: DataFrame, least: DataFrame, col: str) -> DataFrame:
    """With ``col`` contracted: a component that has a lesser one in its ring takes that one's name."""
    to = least.select(F.col("a").alias(col), F.col("b").alias("_to"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).select(*df.columns)


def descendants(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant): transitive closure over (child, parent), self pairs left out."""
    return closure(edges).expanded()


def class_descendants(triples: DataFrame) -> DataFrame:
    """(uri, n_descendants) of every taxonomy node."""
    nodes, edges = taxonomy(triples)
    return nodes.join(closure(edges).counts(), "uri", "left").select("uri", F.coalesce("n_descendants", F.lit(0).cast("bigint")).alias("n_descendants"))


def root_classes(triples: DataFrame, top_n: int | None = None) -> DataFrame:
    """(uri, n_descendants): classes without parents that have a descendant, most descendants first.

    If there are fewer than ``top_n``, descendants of theirs that have children fill up. Ties go to
    the lesser URI."""
    _, edges = taxonomy(triples)
    found = closure(edges)
    counts = settled(found.counts())
    # a class that is only its own parent still has an outgoing edge
    roots = counts.join(edges.select(F.col("child").alias("uri")).distinct(), "uri", "left_anti")
    if top_n is None:
        return roots
    if roots.count() < top_n:
        # a root is on no cycle, so it is its own component
        below = found.pairs.join(roots.select(F.col("uri").alias("up")), "up", "left_semi").select(F.col("low").alias("comp")).distinct()
        below = found.members.join(below, "comp", "left_semi").select(F.col("node").alias("uri"))
        roots = roots.unionByName(counts.join(below, "uri", "left_semi").join(roots.select("uri"), "uri", "left_anti"))
    return roots.orderBy(F.desc("n_descendants"), "uri").limit(top_n)


def ontology_context(triples: DataFrame, roots: int = 20, per_root: int = 2, properties: int = 20) -> DataFrame:
    """Triples of the ontology headers, the first roots, instances of each and the first properties."""
    head = triples.where((F.col("p") == M.TYPE) & (F.col("o") == M.ONTOLOGY)).select(F.col("s").alias("uri"))
    top = settled(root_classes(triples, roots).select("uri"))
    some = instances(triples, top, per_root).select("uri")
    props = all_properties(triples).orderBy("uri").limit(properties)
    wanted = head.unionByName(top).unionByName(some).unionByName(props).distinct()
    return triples.join(wanted.withColumnRenamed("uri", "s"), "s", "left_semi")
