"""Triples: building them from ontology tables, pattern access, validation and inference.

A triple is ``(s, p, o, o_kind, o_dtype)``; ``o_kind`` is 'iri' or 'literal'. Written tables are best
partitioned by ``p``, since all access is by predicate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import bounded_broadcast, cut, cut_counted, stack, strip_name
from ..functions.text import readable, uri_fragment
from .closure import closure

EX = "http://kb.example/ontology#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
DOMAIN = "http://www.w3.org/2000/01/rdf-schema#domain"
RANGE = "http://www.w3.org/2000/01/rdf-schema#range"
OWL = "http://www.w3.org/2002/07/owl#"
CLASS, INDIVIDUAL = OWL + "Class", OWL + "NamedIndividual"
OBJECT_PROPERTY, DATA_PROPERTY, ANNOTATION_PROPERTY = OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty"
EQUIVALENT, SAME_AS = OWL + "equivalentClass", OWL + "sameAs"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Names of the XML Schema types that a literal may carry (fixed values).
XSD_TYPES = ("string", "boolean", "integer", "decimal", "date", "dateTime", "time", "float", "double", "int", "long", "short", "byte", "anyURI", "duration", "gYear", "gYearMonth")
COLUMNS = ("s", "p", "o", "o_kind", "o_dtype")


def iri(name: Column) -> Column:
    return F.concat(F.lit(EX), uri_fragment(name))


def _triple(s: Column, p: Column | str, o: Column, dtype: Column | str | None = None, kind: str = "literal") -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    d = F.lit(dtype).cast("string") if dtype is None or isinstance(dtype, str) else dtype
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), d.alias("o_dtype"))


def _link(s: Column, p: Column | str, o: Column) -> Column:
    return _triple(s, p, o, kind="iri")


def _names(x: Column) -> Column:
    """The names of an array, stripped; an empty array for a null one."""
    return F.transform(F.coalesce(x, F.array().cast("array<string>")), strip_name)


def _emit(rows: DataFrame, triples: Column) -> DataFrame:
    """The triples of an array of each row, without those that lack a part: one scan of the table."""
    whole = F.filter(triples, lambda t: t["s"].isNotNull() & t["p"].isNotNull() & t["o"].isNotNull())
    return rows.select(F.inline(whole))


def typed_literal(value: Column, datatype: Column) -> Column:
    """``struct(o, o_dtype)``: lexical form and type. Booleans are true for 'true' in any case and else
    false; integers and decimals that cannot be read, and unknown types, stay plain texts without type."""
    kind = F.substring_index(datatype, ":", -1)
    number = F.regexp_like(F.trim(value), F.lit(r"^[-+]?\d+$"))
    real = F.regexp_like(F.trim(value), F.lit(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"))
    whole = F.regexp_replace(F.regexp_replace(F.trim(value), r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    plain = F.struct(value.alias("o"), F.lit(None).cast("string").alias("o_dtype"))
    typed = lambda v, t: F.struct(v.alias("o"), F.concat(F.lit(XSD), t).alias("o_dtype"))
    return (
        F.when(value.isNull() | kind.isNull(), plain)
        .when(kind == "boolean", typed(F.when(F.lower(value) == "true", "true").otherwise("false"), kind))
        .when((kind == "integer") & number, typed(whole, kind))
        .when((kind == "decimal") & real, typed(F.trim(value), kind))
        .when(kind.isin("integer", "decimal"), plain)
        .when(kind.isin(*XSD_TYPES), typed(value, kind))
        .otherwise(plain)
    )


def class_triples(classes: DataFrame) -> DataFrame:
    """``classes(class, description[, parents])``: type, label, comment and subclass links."""
    has = "parents" in classes.columns
    c = classes.select(strip_name("class").alias("c"), "description", (_names(F.col("parents")) if has else _names(F.lit(None))).alias("parents")).where("c is not null")
    s = iri(F.col("c"))
    own = F.array(_link(s, RDF_TYPE, F.lit(CLASS)), _triple(s, LABEL, F.col("c")), _triple(s, COMMENT, F.col("description")))
    return _emit(c, F.concat(own, F.transform("parents", lambda x: _link(s, SUBCLASS, iri(x)))))


def axiom_triples(axioms: DataFrame) -> DataFrame:
    """Base properties, subclass links, equivalences, data and object properties.

    An axiom with a description that is no equivalence declares the base property of its type; else its
    type decides; without a type, a datatype makes it a data property. Equivalences link the first names
    on either side. Rows whose names are null or blank on one side give what the other side gives.
    """
    a = axioms.select(*[strip_name(c).alias(c) for c in ("type", "subclass", "superclass", "domain", "property", "range", "datatype")], "description", _names(F.col("domains")).alias("domains"), _names(F.col("ranges")).alias("ranges"))
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    kind, prop, is_data = iri(F.col("type")), iri(F.col("property")), F.col("datatype").isNotNull()
    base = F.concat(
        F.array(_link(kind, RDF_TYPE, F.lit(OBJECT_PROPERTY)), _triple(kind, LABEL, F.col("type")), _triple(kind, COMMENT, F.col("description"))),
        F.transform("domains", lambda x: _link(kind, DOMAIN, iri(x))), F.transform("ranges", lambda x: _link(kind, RANGE, iri(x))))
    target = F.when(is_data, F.concat(F.lit(XSD), F.substring_index("datatype", ":", -1))).otherwise(iri(F.col("range")))
    own = F.array(
        _link(prop, RDF_TYPE, F.when(is_data, DATA_PROPERTY).otherwise(OBJECT_PROPERTY)), _triple(prop, LABEL, F.col("property")),
        _link(prop, DOMAIN, iri(F.col("domain"))), _link(prop, RANGE, target))
    return _emit(a, (
        F.when(F.col("type") == "SubClassOf", F.array(_link(iri(F.col("subclass")), SUBCLASS, iri(F.col("superclass")))))
        .when(F.col("type") == "equivalentClass", F.array(_link(iri(F.get("domains", F.lit(0))), EQUIVALENT, iri(F.get("ranges", F.lit(0))))))
        .when(F.col("type").isNotNull() & described, base).when(F.col("type").isNull(), own)))


def _pairs_of(individuals: Column) -> Column:
    """Ordered pairs of different names of an array, both directions."""
    names = F.array_distinct(F.filter(_names(individuals), lambda x: x.isNotNull()))
    return F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b != a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def same_pairs(abox: DataFrame) -> DataFrame:
    """Ordered pairs ``(a, b)`` of different names in one SameIndividual array, both directions."""
    return abox.where("type = 'SameIndividual'").select(F.inline(_pairs_of(F.col("individuals")))).distinct()


def assertion_triples(abox: DataFrame) -> DataFrame:
    """Declarations, types, links and values, each with its chunk as provenance of the subject."""
    names = ("id", "individual", "class", "subject", "property", "object")
    a = abox.select("type", *[strip_name(c).alias(c) for c in names], "value", "datatype", "chunk_id", "individuals")
    a = a.withColumn("l", typed_literal(F.col("value"), F.col("datatype")))
    chunk = lambda s: _triple(s, EX + "chunk_id", F.col("chunk_id"), XSD + "integer")
    kind, subject = F.col("type"), iri(F.col("subject"))
    dec, ind = iri(F.col("id")), iri(F.col("individual"))
    return _emit(a, (
        F.when(kind == "DeclareIndividual", F.array(_link(dec, RDF_TYPE, F.lit(INDIVIDUAL)), chunk(dec)))
        .when(kind == "ClassAssertion", F.array(_link(ind, RDF_TYPE, iri(F.col("class"))), chunk(ind)))
        .when(kind == "ObjectPropertyAssertion", F.array(_link(subject, iri(F.col("property")), iri(F.col("object"))), chunk(subject)))
        .when(kind == "DataPropertyAssertion", F.array(_triple(subject, iri(F.col("property")), F.col("l.o"), F.col("l.o_dtype")), chunk(subject)))
        .when(kind == "SameIndividual", F.transform(_pairs_of(F.col("individuals")), lambda x: _link(iri(x["a"]), SAME_AS, iri(x["b"]))))))


def from_ontology(classes: DataFrame, axioms: DataFrame, abox: DataFrame) -> DataFrame:
    """The distinct triples of the three tables of an ontology; each table is read once."""
    return class_triples(classes).unionByName(axiom_triples(axioms)).unionByName(assertion_triples(abox)).distinct()


# ------------------------------------------------------------------ access

def match(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that fit the given positions; the predicates reach the scan."""
    for col, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            t = t.where(F.col(col) == v)
    return t


def exists(rows: DataFrame, t: DataFrame, on: dict[str, str], **fixed: str) -> DataFrame:
    """Rows for which a triple exists; ``on`` maps columns of ``rows`` to positions."""
    m = match(t, **fixed).select(*[F.col(v).alias(f"_{v}") for v in on.values()]).distinct()
    cond = reduce(lambda a, b: a & b, [rows[k] == m[f"_{v}"] for k, v in on.items()])
    return rows.join(m, cond, "left_semi")


def node_kinds(t: DataFrame) -> DataFrame:
    """``(node, kind)`` for classes, individuals, object and data properties."""
    kinds = {CLASS: "class", INDIVIDUAL: "individual", OBJECT_PROPERTY: "object_property", DATA_PROPERTY: "datatype_property"}
    rows = t.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*kinds))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("o"))
    return rows.select(F.col("s").alias("node"), name.alias("kind")).distinct()


def labels(t: DataFrame, nodes: DataFrame, col: str = "s") -> DataFrame:
    """``nodes`` with ``label``: the smallest rdfs:label, else the decoded fragment."""
    l = t.where(F.col("p") == LABEL).groupBy(F.col("s").alias("_n")).agg(F.min("o").alias("label"))
    return nodes.join(l, F.col(col) == F.col("_n"), "left").withColumn("label", F.coalesce("label", readable(F.col(col)))).drop("_n")


def stats(t: DataFrame) -> DataFrame:
    """One row of counts: triples and nodes of each kind."""
    is_type = F.col("p") == RDF_TYPE
    one = lambda k, n: F.count_if(is_type & (F.col("o") == k)).alias(n)
    return t.agg(F.count(F.lit(1)).alias("triples"), one(CLASS, "classes"), one(INDIVIDUAL, "individuals"), one(OBJECT_PROPERTY, "object_properties"), one(DATA_PROPERTY, "datatype_properties"))


def loose_classes(t: DataFrame) -> DataFrame:
    """Classes without subclass links in either direction and without instances."""
    c = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == CLASS)).select("s").distinct()
    sub = t.where(F.col("p") == SUBCLASS)
    used = sub.select(F.col("s").alias("x")).union(sub.select("o")).union(t.where(F.col("p") == RDF_TYPE).select("o")).distinct()
    return c.join(used, c["s"] == used["x"], "left_anti")


def entity_axioms(t: DataFrame, entities: DataFrame) -> DataFrame:
    """``(s, category, p, o)`` for each entity: class axioms, object and data assertions, annotations."""
    kinds = node_kinds(t).where("kind in ('object_property', 'datatype_property')")
    rows = t.join(entities.select("s").distinct(), "s", "left_semi")
    k = kinds.groupBy(F.col("node").alias("p")).agg(F.max(F.when(F.col("kind") == "object_property", 1)).alias("is_obj"), F.max(F.when(F.col("kind") == "datatype_property", 1)).alias("is_data"))
    rows = rows.join(k, "p", "left")
    cat = F.filter(F.array(
        F.when(F.col("p").isin(SUBCLASS, EQUIVALENT) | ((F.col("p") == RDF_TYPE) & (F.col("o") != INDIVIDUAL)), "ClassAxiom"),
        F.when(F.col("is_obj") == 1, "ObjectPropertyAssertion"), F.when(F.col("is_data") == 1, "DataPropertyAssertion"),
        F.when(F.col("p").isin(LABEL, COMMENT), "AnnotationProperty")), lambda x: x.isNotNull())
    return rows.select("s", F.explode(cat).alias("category"), "p", "o").distinct()


def filter_axioms(axioms: DataFrame, base_axiom: str, category: str) -> DataFrame:
    """Axioms of one category whose name after '#' is ``base_axiom`` in any case; annotations all."""
    rows = axioms.where(F.col("category") == category)
    if category == "AnnotationProperty":
        return rows
    return rows.where(F.lower(F.substring_index("p", "#", -1)) == base_axiom.lower())


def diff(after: DataFrame, before: DataFrame) -> DataFrame:
    """Triples in ``after`` but not in ``before``."""
    return after.select(*COLUMNS).exceptAll(before.select(*COLUMNS)).distinct()


# ------------------------------------------------------------------ validation and inference

def invalid_links(t: DataFrame) -> DataFrame:
    """Object-property links whose subject has none of the property's domains among its asserted types, or
    whose object has none of its ranges. A property without domains (ranges) accepts every subject (object)."""
    props = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == OBJECT_PROPERTY)).select(F.col("s").alias("p")).distinct()
    links = t.where("o_kind = 'iri'").join(props, "p", "left_semi").select("s", "p", "o").distinct()
    types = t.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")).select(F.col("s").alias("x"), F.col("o").alias("cls")).distinct()

    def bad(end: str, schema: str) -> DataFrame:
        allowed = t.where((F.col("p") == schema) & (F.col("o_kind") == "iri")).select(F.col("s").alias("p"), F.col("o").alias("cls")).distinct()
        bound = links.join(allowed.select("p").distinct(), "p", "left_semi")
        ok = bound.select("p", F.col(end).alias("x")).distinct().join(types, "x").join(allowed, ["p", "cls"], "left_semi").select("p", "x").distinct()
        return bound.join(ok.withColumnRenamed("x", end), ["p", end], "left_anti").select("s", "p", "o")

    return bad("s", DOMAIN).union(bad("o", RANGE)).distinct()


def validate(t: DataFrame) -> DataFrame:
    """The triples without invalid links."""
    gone = invalid_links(t).withColumn("o_kind", F.lit("iri"))
    return t.join(gone, ["s", "p", "o", "o_kind"], "left_anti").select(*COLUMNS)


def type_links(t: DataFrame) -> DataFrame:
    """``(s, o)`` of all type links."""
    return t.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "iri")).select("s", "o").distinct()


def types_by_subclass(t: DataFrame, types: DataFrame | None = None, sub: DataFrame | None = None) -> DataFrame:
    """Missing ``(s, o)``: x has type C and C leads to D by subclass links, so x has type D.

    Types are joined once to the closure of the class graph instead of running rounds over all types. ``types``
    and ``sub`` are the type links and the closure if they are at hand.
    """
    sub = subclass_closure(t) if sub is None else sub
    types = type_links(t) if types is None else types
    more = types.join(sub, types["o"] == sub["src"]).select("s", F.col("dst").alias("o")).distinct()
    return more.join(types, ["s", "o"], "left_anti")


def types_by_equivalence(t: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Missing ``(s, o)`` by equivalence links in both directions, to the fixpoint."""
    from .components import star_components

    eq = t.where((F.col("p") == EQUIVALENT) & (F.col("o_kind") == "iri")).select(F.col("s").alias("u"), F.col("o").alias("v"))
    comp = cut(star_components(eq), "equivalents")
    types = type_links(t) if types is None else types
    has = types.join(comp, types["o"] == comp["node"]).select("s", "component").distinct()
    more = has.join(comp.withColumnRenamed("node", "o"), "component").select("s", "o")
    return more.join(types, ["s", "o"], "left_anti").distinct()


def types_by_schema(t: DataFrame, schema: str, types: DataFrame | None = None) -> DataFrame:
    """Missing ``(s, o)`` by domains (of subjects) or ranges (of IRI objects); off by default in ``infer``.

    The pairs grow with nodes times classes, so they are made where they are asked for and never shuffled: a node
    travels with its properties and types, and of its properties that declare a class only the least gives the pair.
    """
    decl = t.where((F.col("p") == schema) & (F.col("o_kind") == "iri")).select(F.col("s").alias("p"), F.col("o").alias("cls")).distinct()
    by = decl.groupBy("cls").agg(F.array_sort(F.collect_set("p")).alias("by"))
    decl = decl.join(by, "cls").select("p", "cls", F.filter("by", lambda x: x < F.col("p")).alias("before"))
    decl = bounded_broadcast(cut(decl.select("p", "cls", F.when(F.size("before") > 0, F.col("before")).alias("before")), "declared"))
    node = F.col("s") if schema == DOMAIN else F.col("o")
    links = t if schema == DOMAIN else t.where("o_kind = 'iri'")
    types = type_links(t) if types is None else types
    uses = links.join(decl.select("p").distinct(), "p", "left_semi").select(node.alias("s"), "p", F.lit(None).cast("string").alias("o"))
    nodes = uses.unionByName(types.select("s", F.lit(None).cast("string").alias("p"), "o")).groupBy("s").agg(F.collect_set("p").alias("ps"), F.collect_set("o").alias("known"))
    pairs = nodes.where("size(ps) > 0").select("s", "ps", "known", F.explode("ps").alias("p")).join(decl, "p")
    first = F.col("before").isNull() | ~F.arrays_overlap("ps", "before")
    return pairs.where(first & ~F.array_contains("known", F.col("cls"))).select("s", F.col("cls").alias("o"))


#: Properties with a known inverse; inferred in this direction only.
INVERSES = {EX + "hasPart": EX + "isPartOf"}


def inverse_links(t: DataFrame, inverses: dict[str, str] = INVERSES) -> DataFrame:
    """Missing ``(s, p, o)``: the inverses of links between IRIs."""
    rows = t.where(F.col("p").isin(*inverses) & (F.col("o_kind") == "iri"))
    q = F.element_at(F.create_map(*[F.lit(x) for kv in inverses.items() for x in kv]), F.col("p"))
    more = rows.select(F.col("o").alias("s"), q.alias("p"), F.col("s").alias("o")).distinct()
    return more.join(t.where("o_kind = 'iri'").select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def _as_types(pairs: DataFrame) -> DataFrame:
    return pairs.select("s", F.lit(RDF_TYPE).alias("p"), "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"))


def inferred(t: DataFrame, saturate: bool = False, domains: bool = False, ranges: bool = False, inverses: dict[str, str] = INVERSES) -> DataFrame:
    """The triples that inference adds: subclass types, then equivalence types, then inverses.

    The steps run once in this order, so types that equivalence adds are not followed up the class graph
    again; ``saturate`` repeats the type steps until nothing is new. Only added types are written, and the
    class graph is closed once.
    """
    sub = cut(subclass_closure(t).select("src", "dst"), "closure")
    known = [cut(type_links(t), "types")]
    steps = [lambda ts: types_by_subclass(t, ts, sub), lambda ts: types_by_equivalence(t, ts)]
    steps += [lambda ts, k=k: types_by_schema(t, k, ts) for on, k in ((domains, DOMAIN), (ranges, RANGE)) if on]
    while True:
        new = 0
        for step in steps:
            more, n = cut_counted(step(stack(known)), "added-types")
            known += [more] if n else []
            new += n
        if not saturate or not new:
            break
    inv = inverse_links(t, inverses).select("s", "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype"))
    return _as_types(stack(known[1:])).unionByName(inv) if known[1:] else inv


def infer(t: DataFrame, **how: bool | dict[str, str]) -> DataFrame:
    """All triples with the ``inferred`` ones."""
    t = cut(t.select(*COLUMNS), "asserted")
    return t.unionByName(inferred(t, **how))


def subclass_closure(t: DataFrame) -> DataFrame:
    return closure(t.where((F.col("p") == SUBCLASS) & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst")))


def direct_types(t: DataFrame, compat: bool = False, above: DataFrame | None = None) -> DataFrame:
    """``(s, o)``: the most specific types of each node. A type goes if another type of the node lies
    strictly below it. Types of one cycle are as specific as each other; with ``compat`` they remove
    each other. ``above`` is the closure of the class graph if it is at hand."""
    types = type_links(t)
    c = cut((subclass_closure(t) if above is None else above).where("src <> dst").select("src", "dst"), "closure")
    if not compat:
        c = c.join(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    lower = types.select("s", F.col("o").alias("src"))
    higher = lower.join(c, "src").select("s", F.col("dst").alias("o")).distinct()
    return types.join(higher, ["s", "o"], "left_anti")


def same_as_sets(t: DataFrame) -> DataFrame:
    """``(node, component)``: nodes linked by sameAs, in either direction, over any number of steps."""
    from .components import star_components

    return star_components(t.where((F.col("p") == SAME_AS) & (F.col("o_kind") == "iri")).select(F.col("s").alias("u"), F.col("o").alias("v")))


def schema_classes(t: DataFrame) -> DataFrame:
    """Labelled classes with definition and labelled parents ``(class, description, parents)``."""
    c = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == CLASS)).select("s").distinct()
    lab = t.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("class"))
    com = t.where(F.col("p") == COMMENT).groupBy("s").agg(F.min("o").alias("description"))
    par = t.where(F.col("p") == SUBCLASS).select("s", F.col("o").alias("par")).join(lab.select(F.col("s").alias("par"), F.col("class").alias("pl")), "par").groupBy("s").agg(F.array_sort(F.collect_set("pl")).alias("parents"))
    out = c.join(lab, "s").join(com, "s", "left").join(par, "s", "left")
    return out.select("class", F.coalesce("description", F.lit("No definition available.")).alias("description"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def schema_properties(t: DataFrame) -> DataFrame:
    """Labelled object properties with domains and ranges, and one row for the subclass relation itself."""
    prop = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == OBJECT_PROPERTY)).select("s").distinct()
    lab = t.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("type"))
    com = t.where(F.col("p") == COMMENT).groupBy("s").agg(F.min("o").alias("description"))
    names = lambda schema, n: t.where(F.col("p") == schema).groupBy("s").agg(F.array_sort(F.collect_set(readable(F.col("o")))).alias(n))
    out = prop.join(lab, "s").join(com, "s", "left").join(names(DOMAIN, "domains"), "s", "left").join(names(RANGE, "ranges"), "s", "left")
    none = F.array().cast("array<string>")
    out = out.select("type", F.coalesce("domains", none).alias("domains"), F.coalesce("ranges", none).alias("ranges"), "description")
    first = t.sparkSession.range(1).select(F.lit("subClassOf").alias("type"), none.alias("domains"), none.alias("ranges"), F.lit("The first class is a kind of the second.").alias("description"))
    return first.unionByName(out)
