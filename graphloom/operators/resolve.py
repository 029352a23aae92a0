"""Cleaning a knowledge base: equivalence sets, name collisions, cascading prune, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import strip_name
from ..functions.text import name_key
from .components import star_components

#: Columns that name the individuals an assertion stands or falls with.
_KEYS = {"ClassAssertion": ("individual",), "DeclareIndividual": ("id",), "DataPropertyAssertion": ("subject",), "ObjectPropertyAssertion": ("subject", "object")}


def scoped_classes(classes: DataFrame, below_chunk: int | None = None) -> DataFrame:
    """Classes that come from chunks, so no upper classes; with ``below_chunk``, whose first chunk is below it."""
    rows = classes.where(F.size(F.coalesce("chunk_ids", F.array())) > 0)
    return rows if below_chunk is None else rows.where(F.get("chunk_ids", F.lit(0)) < below_chunk)


def equivalence_sets(axioms: DataFrame, skip: str = "Entity") -> DataFrame:
    """``(class, class_set)``: each class of an equivalence with its whole set, sorted. The first names on
    either side are linked; pairs that touch ``skip`` are left out."""
    e = axioms.where("type = 'equivalentClass'").select(strip_name(F.get("domains", F.lit(0))).alias("u"), strip_name(F.get("ranges", F.lit(0))).alias("v"))
    e = e.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != skip) & (F.col("v") != skip))
    comp = star_components(e)
    sets = comp.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("class_set"))
    return comp.join(sets, "component").select(F.col("node").alias("class"), "class_set")


def expand_classes(rows: DataFrame, sets: DataFrame, col: str = "class") -> DataFrame:
    """``rows`` with ``class_set``: the equivalence set, or the class alone."""
    s = sets.withColumnRenamed("class", "_c")
    return rows.join(s, F.col(col) == F.col("_c"), "left").drop("_c").withColumn("class_set", F.coalesce("class_set", F.array(F.col(col))))


def name_groups(abox: DataFrame, sets: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """``(name_key, class, names)``: individuals by normalised name and by each class of their set."""
    rows = abox.where("type = 'ClassAssertion'").select(strip_name("individual").alias("name"), strip_name("class").alias("class")).dropna().distinct()
    rows = expand_classes(rows, sets).select("name", F.explode("class_set").alias("class")) if sets is not None else rows
    rows = rows.withColumn("name_key", name_key(F.col("name"), ascii_only)).where("name_key <> ''")
    return rows.groupBy("name_key", "class").agg(F.array_sort(F.collect_set("name")).alias("names"))


def same_name_individuals(groups: DataFrame) -> DataFrame:
    """Groups with two or more spellings: one SameIndividual each ``(name_key, class, individuals)``."""
    return groups.where("size(names) > 1").withColumnRenamed("names", "individuals")


def polysemy_candidates(groups: DataFrame) -> DataFrame:
    """Normalised names with two or more classes ``(name_key, classes)``."""
    return groups.groupBy("name_key").agg(F.array_sort(F.collect_set("class")).alias("classes")).where("size(classes) > 1")


def rejected_nodes(abox: DataFrame, actions: DataFrame, sets: DataFrame) -> DataFrame:
    """``(name, chunk_id)`` of class assertions of which any class in the set is rejected.

    ``actions(name, class, action)``.
    """
    rows = abox.where("type = 'ClassAssertion'").select(strip_name("individual").alias("name"), strip_name("class").alias("class"), "chunk_id")
    rows = expand_classes(rows, sets).select("name", "chunk_id", F.explode("class_set").alias("class"))
    bad = actions.where("action = 'reject'").select("name", "class").distinct()
    return rows.join(bad, ["name", "class"], "left_semi").select("name", "chunk_id").distinct()


def prune(abox: DataFrame, nodes: DataFrame, key: str = "assertion_id") -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)`` after removing all assertions about ``nodes(name, chunk_id)``.

    A class assertion falls with its individual, a declaration with its id, a data property with its
    subject, an object property with its subject or object, each in the same chunk; chunks compare
    null-safely, names without surrounding white space. SameIndividual rows stay.
    """
    ends = F.when(F.lit(False), F.array(F.lit("")))
    for kind, cols in _KEYS.items():
        ends = ends.when(F.col("type") == kind, F.array(*[strip_name(c) for c in cols]))
    gone = abox.select(key, "chunk_id", F.explode(ends).alias("name")).where("name is not null")
    n = nodes.select(F.col("name").alias("_n"), F.col("chunk_id").alias("_c")).distinct()
    gone = gone.join(n, (F.col("name") == F.col("_n")) & F.col("chunk_id").eqNullSafe(F.col("_c")), "left_semi").select(key).distinct()
    return abox.join(gone, key, "left_anti"), abox.join(gone, key, "left_semi")


def log_pruned(pruned: DataFrame | None, removed: DataFrame, phase: str) -> DataFrame:
    """The log of removed assertions with those of one more phase."""
    rows = removed.withColumn("phase", F.lit(phase))
    return rows if pruned is None else pruned.unionByName(rows, allowMissingColumns=True)


def surviving_groups(same: DataFrame, actions: DataFrame, sets: DataFrame) -> DataFrame:
    """SameIndividual groups without rejected members; groups left with one member go.

    ``same(name_key, class, individuals)``. A name that any class of a set rejects is rejected in all of them, so
    rejections are kept once per name and set, under the set's first class.
    """
    first = F.element_at("class_set", 1)
    rejected = actions.where("action = 'reject'").select("name", "class").dropna()
    bad = expand_classes(rejected, sets).select("name", first.alias("first")).distinct()
    rows = expand_classes(same, sets).select("name_key", "class", first.alias("first"), F.explode("individuals").alias("name"))
    kept = rows.join(bad, ["name", "first"], "left_anti")
    return kept.groupBy("name_key", "class").agg(F.array_sort(F.collect_set("name")).alias("individuals")).where("size(individuals) > 1")


def individual_details(abox: DataFrame, by_chunk: bool = False) -> DataFrame:
    """``(name[, chunk_id], class, properties)``: the last class by name and all 'property: value' texts."""
    keys = ["name", "chunk_id"] if by_chunk else ["name"]
    cls = abox.where("type = 'ClassAssertion'").select(strip_name("individual").alias("name"), "chunk_id", strip_name("class").alias("class")).where("name is not null")
    cls = cls.groupBy(*keys).agg(F.max("class").alias("class"))
    prop = abox.where("type in ('DataPropertyAssertion', 'ObjectPropertyAssertion')").select(
        strip_name("subject").alias("name"), "chunk_id", F.concat_ws(": ", strip_name("property"), F.when(F.col("type") == "DataPropertyAssertion", F.col("value")).otherwise(strip_name("object"))).alias("text"))
    prop = prop.where("name is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("text")).alias("properties"))
    if by_chunk:
        prop = prop.withColumnRenamed("name", "_n").withColumnRenamed("chunk_id", "_c")
        out = cls.join(prop, (F.col("name") == F.col("_n")) & F.col("chunk_id").eqNullSafe(F.col("_c")), "left").drop("_n", "_c")
    else:
        out = cls.join(prop, "name", "left")
    return out.withColumn("properties", F.coalesce("properties", F.array().cast("array<string>")))


def apply_equivalences(axioms: DataFrame, decisions: DataFrame) -> DataFrame:
    """Axioms with an equivalence for each decision 'equivalent' with a target; the first ones bring a row
    that declares the relation on the top class."""
    hits = decisions.where("action = 'equivalent' and target_id is not null").groupBy("original_id").agg(F.max("target_id").alias("target_id"))
    new = hits.select(
        F.lit("equivalentClass").alias("type"), F.array("original_id").alias("domains"), F.array("target_id").alias("ranges"),
        F.concat(F.lit("Merged: '"), "original_id", F.lit("' and '"), "target_id", F.lit("' name the same class.")).alias("description"))
    has = axioms.where("type = 'equivalentClass'").select(F.lit(1).alias("one")).limit(1)  # existence test
    seed = hits.limit(1).select(F.lit(1).alias("one")).join(has, "one", "left_anti").select(
        F.lit("equivalentClass").alias("type"), F.array(F.lit("Entity")).alias("domains"), F.array(F.lit("Entity")).alias("ranges"),
        F.lit("Two classes are the same and have the same members.").alias("description"))
    return axioms.unionByName(seed, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


def merged_individuals(decisions: DataFrame) -> DataFrame:
    """``(individuals)``: per target, the target and all originals found equivalent to it, sorted."""
    hits = decisions.where("action = 'equivalent' and target_id is not null and original_id is not null and original_id <> target_id")
    return hits.groupBy("target_id").agg(F.array_sort(F.collect_set("original_id")).alias("o")).select(F.array_sort(F.array_distinct(F.concat(F.array("target_id"), "o"))).alias("individuals"))


def accumulate_classes(found: DataFrame) -> DataFrame:
    """``found(class, description, chunk)`` over all chunks: the first chunk's description, all chunk numbers."""
    return found.groupBy("class").agg(F.min_by("description", F.struct("chunk", "description")).alias("description"), F.array_sort(F.collect_set("chunk")).alias("chunk_ids"))


def cleanup_counts(classes: DataFrame, axioms: DataFrame, abox: DataFrame, pruned: DataFrame) -> DataFrame:
    """One row of counts and the number of pruned assertions by phase."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    phases = pruned.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_pruned"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce("phase", F.lit("-")), F.col("n").cast("string")))), ";").alias("phases"))
    return one(classes, "num_classes").crossJoin(one(axioms, "num_axioms")).crossJoin(one(abox, "num_instances")).crossJoin(phases)  # one row each
