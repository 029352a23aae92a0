"""Questions: relations, answer forms, null objects, labels, gold values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They name what a question may ask for and must agree with recorded data sets.

#: Relation of each question type.
RELATIONS = {
    "definition": "be", "taxonomic": "be subtype of", "property": "have property", "membership": "have member", "capability": "have capability",
    "comparative": "compare", "quantification": "count", "existential": "exist", "unknown": "unknown",
}
#: Answer forms that a question type allows; the first is the standard one.
ANSWER_FORMS = {
    "definition": ["value"], "taxonomic": ["list", "assertion"], "property": ["value", "list", "assertion"], "membership": ["list"],
    "capability": ["assertion", "value"], "comparative": ["assertion", "value"], "quantification": ["value"], "unknown": ["assertion", "value", "list"],
}
#: Relation in words to the kind of axiom that holds it.
AXIOM_KINDS = {
    "ClassAxiom": ["be subtype of", "be superclass of"],
    "ObjectPropertyAssertion": [
        "has member", "is member of", "has part", "is part of", "include", "contain", "participate in", "has participant", "located in", "has location",
        "has component", "is component of", "precede", "follow", "has role", "express", "has precondition", "has postcondition", "execute task", "act through", "satisfy",
    ],
    "DataPropertyAssertion": ["have property", "measure", "have value"],
    "AnnotationProperty": ["be"],
}
#: Relation in words to the base property, in the order in which parts of a relation are tried.
BASE_PROPERTIES = [
    ("be subtype of", "subClassOf"), ("be superclass of", "subClassOf"), ("has member", "hasMember"), ("is member of", "isMemberOf"), ("include", "hasMember"),
    ("contain", "hasPart"), ("has part", "hasPart"), ("is part of", "isPartOf"), ("consist of", "hasComponent"), ("have property", "hasQuality"),
    ("has quality", "hasQuality"), ("measure", "hasDataValue"), ("have value", "hasDataValue"), ("participate in", "participatesIn"),
    ("has participant", "hasParticipant"), ("located in", "hasLocation"), ("has location", "hasLocation"), ("happen at", "hasTime"), ("occur at", "hasTime"),
    ("be about", "isAbout"), ("has component", "hasComponent"), ("is component of", "isComponentOf"), ("precede", "precedes"), ("follow", "follows"),
    ("has role", "hasRole"), ("express", "expresses"), ("has precondition", "hasPrecondition"), ("has postcondition", "hasPostcondition"),
    ("execute task", "executesTask"), ("act through", "actsThrough"), ("satisfy", "satisfies"), ("be", "isAbout"),
]
#: Fields of an entity's context by question type; the core fields belong to all.
CORE_FIELDS = ("scope_note", "label", "types", "superclasses", "equivalent_classes")
CONTEXT_FIELDS = {
    "definition": ("annotations", "class_descriptions"), "taxonomic": ("class_descriptions",), "capability": ("properties_by_type",),
    "property": ("properties_by_type",), "existential": ("properties_by_type",), "membership": ("properties_by_type", "annotations", "members"),
    "comparative": ("properties_by_type", "chunk_id"), "quantification": ("properties_by_type", "members", "chunk_id"),
}


def _map(d: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def relation_of(question_type: Column) -> Column:
    return F.coalesce(_map(RELATIONS, question_type), F.lit("unknown"))


def axiom_kind(relation: Column) -> Column:
    names = {r: k for k, v in AXIOM_KINDS.items() for r in v}
    return F.coalesce(_map(names, F.trim(F.lower(relation))), F.lit("Unknown"))


def base_property(relation: Column) -> Column:
    """The property of the relation or of the first known relation that is part of it."""
    r = F.trim(F.lower(relation))
    part = F.coalesce(*[F.when(F.contains(r, F.lit(k)), F.lit(v)) for k, v in BASE_PROPERTIES])
    return F.when(r.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(_map(dict(BASE_PROPERTIES), r), part, F.lit("unknown")))


def allowed_forms(question_type: Column) -> Column:
    m = F.create_map(*[x for k, v in ANSWER_FORMS.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    return F.coalesce(F.element_at(m, question_type), F.element_at(m, F.lit("unknown")))


def known_type(question_type: Column) -> Column:
    t = F.trim(F.lower(question_type))
    return F.when(t.isin(*ANSWER_FORMS), t).otherwise("unknown")


def known_form(question_type: Column, answer_form: Column) -> Column:
    """The form if the type allows it, else the type's first."""
    f, forms = F.trim(F.lower(answer_form)), allowed_forms(known_type(question_type))
    return F.when(F.array_contains(forms, F.coalesce(f, F.lit(""))), f).otherwise(F.get(forms, F.lit(0)))


def form_is_given(question_type: Column) -> Column:
    """The only form that the type allows, else null."""
    forms = allowed_forms(question_type)
    return F.when(F.size(forms) == 1, F.get(forms, F.lit(0)))


def object_is_null(question_type: Column, answer_form: Column) -> Column:
    """No object is asked for: by type, for lists, and for values of a capability."""
    t, f = F.coalesce(question_type, F.lit("unknown")), F.coalesce(answer_form, F.lit(""))
    return t.isin("definition", "unknown", "quantification") | (f == "list") | ((t == "capability") & (f == "value"))


def normalize_labels(rows: DataFrame) -> DataFrame:
    """Canonical type, form, relation and object of ``rows(question_type, answer_form, object_value)``."""
    out = rows.withColumn("question_type", known_type(F.col("question_type")))
    out = out.withColumn("answer_form", known_form(F.col("question_type"), F.col("answer_form"))).withColumn("relation", relation_of(F.col("question_type")))
    return out.withColumn("object_value", F.when(~object_is_null(F.col("question_type"), F.col("answer_form")), F.col("object_value")))


def abstains(answer: Column) -> Column:
    """The answer says that it cannot be given; a null or blank one gives none either."""
    a = F.lower(F.replace(F.coalesce(answer, F.lit("")), F.lit("’"), F.lit("'")))
    return F.contains(a, F.lit("can't answer")) | (F.trim(a) == "")


def category_of_number(question_id: Column) -> Column:
    """The category of 'q1' to 'q49', seven each in this order; null for other ids."""
    order = ["definition", "taxonomic", "capability", "property", "membership", "comparative", "quantification"]
    n = F.regexp_extract(question_id, r"^\D(\d+)$", 1).try_cast("int")
    return F.when(n.between(1, 49), F.get(F.array(*[F.lit(c) for c in order]), F.floor((n - 1) / 7).cast("int")))


def category_of_prefix(case_id: Column) -> Column:
    """The category that the id starts with."""
    return F.coalesce(*[F.when(F.startswith(case_id, F.lit(c)), F.lit(c)) for c in CONTEXT_FIELDS])


def tier_of(case_id: Column) -> Column:
    return F.when(F.endswith(case_id, F.lit("_1")), "canonical").when(F.endswith(case_id, F.lit("_2")), "paraphrased").when(F.endswith(case_id, F.lit("_3")), "typo").otherwise("unknown")


def compare_gold(left: Column, right: Column, left_name: Column, right_name: Column) -> tuple[Column, Column]:
    """The name with the larger count (left on ties) and the absolute difference."""
    return F.when(left >= right, left_name).otherwise(right_name), F.abs(left - right)


def keep_fields(context: DataFrame, question_type: str = "question_type") -> DataFrame:
    """Null all context columns that the question type does not need; ``status`` tells unknown types."""
    t, out = F.col(question_type), context
    fields = {f for v in CONTEXT_FIELDS.values() for f in v}
    for f in sorted(fields & set(context.columns)):
        types = [k for k, v in CONTEXT_FIELDS.items() if f in v]
        out = out.withColumn(f, F.when(t.isin(*types), F.col(f)))
    return out.withColumn("status", F.when(t.isin(*CONTEXT_FIELDS), "ok").otherwise("unknown question type"))


def sample_per_group(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group: a sampling operator."""
    from pyspark.sql import Window as W

    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def blind_order(rows: DataFrame, question: str, system: str, seed: int = 42) -> DataFrame:
    """``place`` of each system per question in an order that is random but fixed by the seed."""
    from pyspark.sql import Window as W

    return rows.withColumn("place", F.row_number().over(W.partitionBy(question).orderBy(F.xxhash64(F.lit(seed), question, system), system)))
