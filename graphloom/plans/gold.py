"""Question sets with gold answers, made from a knowledge base itself, and their unanswerable mirrors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import readable, replace_in_order
from ..operators.questions import compare_gold
from ..operators.triples import CLASS, COMMENT, DOMAIN, EQUIVALENT, EX, INDIVIDUAL, LABEL, RANGE, RDF_TYPE, SAME_AS, SUBCLASS

#: Predicates that hold the graph together and say nothing about an entity.
STRUCTURAL = (RDF_TYPE, LABEL, COMMENT, SUBCLASS, DOMAIN, RANGE, EQUIVALENT, SAME_AS, EX + "chunk_id")


def described_properties(t: DataFrame) -> DataFrame:
    """``(s, property, vals)``: the distinct values of each subject's own properties, sorted."""
    rows = t.where(~F.col("p").isin(*STRUCTURAL)).select("s", readable(F.col("p")).alias("property"), F.when(F.col("o_kind") == "iri", readable(F.col("o"))).otherwise(F.col("o")).alias("v"))
    return rows.groupBy("s", "property").agg(F.array_sort(F.collect_set("v")).alias("vals"))


def fill(template: str, **names: str) -> F.Column:
    """A template with its names in braces replaced in order, each on the result of the last."""
    pairs = F.array(*[F.struct(F.lit("{" + k + "}").alias("old"), F.col(v).alias("new")) for k, v in names.items()])
    return replace_in_order(F.lit(template), pairs)


def gold_questions(t: DataFrame, per_type: int = 10) -> DataFrame:
    """``(case_id, question, question_type, answer_form, entity, object, gold, presence)``: the first
    ``per_type`` questions of each type in the order of names, and as many about things that do not exist."""
    is_class = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == CLASS)).select("s").distinct()
    people = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == INDIVIDUAL)).select("s").distinct()
    name = readable(F.col("s")).alias("entity")
    none = F.lit(None).cast("string")
    own = described_properties(t.join(people, "s", "left_semi"))
    links = t.where(~F.col("p").isin(*STRUCTURAL) & (F.col("o_kind") == "iri")).join(people, "s", "left_semi").groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    members = t.where(F.col("p") == RDF_TYPE).select("s", "o").join(people, "s", "left_semi").select(F.col("o").alias("c"), F.col("s").alias("m")).join(is_class.select(F.col("s").alias("c")), "c", "left_semi")
    members = members.groupBy(F.col("c").alias("s")).agg(F.array_sort(F.collect_set(readable(F.col("m")))).alias("g"))
    text = t.where(F.col("p") == COMMENT).join(is_class, "s", "left_semi").groupBy("s").agg(F.min("o").alias("g"))
    above = t.where(F.col("p") == SUBCLASS).join(is_class, "s", "left_semi").groupBy("s").agg(F.array_sort(F.collect_set(readable(F.col("o")))).alias("g"))
    row = lambda df, kind, form, template, gold, obj=none: df.select(
        F.lit(kind).alias("question_type"), F.lit(form).alias("answer_form"), "entity", obj.alias("object"), fill(template, E="entity").alias("question"), gold.alias("gold"))
    ranked = links.withColumn("entity", readable(F.col("s")))
    pair = ranked.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "entity"))).where(F.col("place") <= 2 * per_type)  # top-k of a report
    left, right = pair.where("place % 2 = 1"), pair.where("place % 2 = 0").select((F.col("place") - 1).alias("place"), F.col("entity").alias("object"), F.col("n").alias("rn"))
    more, _ = compare_gold(F.col("n"), F.col("rn"), F.col("entity"), F.col("object"))
    both = left.join(right, "place").withColumn("gold", F.array(more))
    parts = [
        row(text.select(name, "g"), "definition", "value", "What is {E}?", F.array("g")),
        row(above.select(name, "g"), "taxonomic", "list", "What kinds of things is {E} a kind of?", F.col("g")),
        row(members.select(name, "g"), "membership", "list", "Which members does {E} have?", F.col("g")),
        row(members.select(name, "g"), "quantification", "value", "How many members does {E} have?", F.array(F.size("g").cast("string"))),
        own.select(name, "property", "vals").select(F.lit("property").alias("question_type"), F.lit("value").alias("answer_form"), "entity", none.alias("object"), fill("What is the {P} of {E}?", P="property", E="entity").alias("question"), F.col("vals").alias("gold")),
        row(own.select(name, "property").where(F.startswith("property", F.lit("has"))), "capability", "assertion", "Can {E} have properties?", F.array(F.lit("yes"))),
        both.select(F.lit("comparative").alias("question_type"), F.lit("value").alias("answer_form"), "entity", "object", fill("Which has more links, {E} or {O}?", E="entity", O="object").alias("question"), "gold"),
    ]
    rows = reduce(DataFrame.unionByName, parts).distinct()
    place = F.row_number().over(W.partitionBy("question_type").orderBy("entity", "question", "gold"))
    rows = rows.withColumn("n", place).where(F.col("n") <= per_type).withColumn("presence", F.lit("present"))
    fake = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("Imaginary "), F.col(c)))
    swap = F.array(F.struct(F.col("entity").alias("old"), fake("entity").alias("new")), F.struct(F.coalesce("object", F.lit("\u0000")).alias("old"), F.coalesce(fake("object"), F.lit("")).alias("new")))
    absent = rows.withColumn("question", replace_in_order("question", swap)).withColumn("entity", fake("entity")).withColumn("object", fake("object")).withColumn("gold", F.array().cast("array<string>")).withColumn("presence", F.lit("absent"))
    out = rows.unionByName(absent)
    return out.select(F.concat_ws("_", "question_type", F.when(F.col("presence") == "absent", "unanswerable"), F.col("n").cast("string")).alias("case_id"), "question", "question_type", "answer_form", "entity", "object", "gold", "presence")
