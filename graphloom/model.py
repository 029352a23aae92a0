"""The model stage: constrained outputs of named operators from a provider.

A provider answers ``predict(rows, operator)`` with one JSON text per row. Rows that a rule decides never
reach it. ``Recorded`` joins stored decisions, ``Rules`` applies deterministic fallbacks, ``Remote`` calls a
function in Arrow batches. All outputs are parsed with the operator's schema and held to the values that the row
allows; members that an output leaves out get the operator's default. Outputs that are missing or cannot be read
are marked as failed and take the fallback, so no row is lost unseen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import repaired_json
from .operators.questions import ANSWER_FORMS, form_is_given, object_is_null, relation_of


@dataclass(frozen=True)
class Operator:
    """Name, output schema, the rule that decides rows without a model (null: the model is asked), the output for
    rows that failed, and what completes a result: what is not allowed goes, what is left out gets its default."""

    name: str
    schema: str
    decided: Callable[[], Column] | None = None
    fallback: Callable[[], Column] | None = None
    complete: Callable[[Column], Column] | None = None


def _js(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))


_none = lambda: F.lit(None).cast("string")
_few = lambda col, n, out: (lambda: F.when(F.size(F.coalesce(F.col(col), F.array())) < n, F.lit(out)))


def _only(field: str, **allowed: str) -> Callable[[Column], Column]:
    """Items of the result's list whose fields stand in the row's lists of allowed values."""
    def run(r: Column) -> Column:
        keep = lambda x: reduce(lambda p, q: p & q, [F.array_contains(F.col(c), x[f]) for f, c in allowed.items()])
        return F.struct(F.filter(r[field], keep).alias(field))

    return run


def _decided(members: str, id_field: str, default: str, target: str | None = None, acting: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """Decisions on the row's members only, the first of each; ``acting`` ones whose target is no other member, and
    members that are left out, get ``default``."""
    def run(r: Column) -> Column:
        known = F.filter(r["decisions"], lambda d: F.array_contains(F.col(members), d[id_field]))

        def of(m: Column) -> Column:
            d = F.get(F.filter(known, lambda x: x[id_field] == m), F.lit(0))
            ok = d.isNotNull() & d["action"].isNotNull()
            if target:
                ok = ok & (~d["action"].isin(*acting) | (F.array_contains(F.col(members), d[target]) & (d[target] != m)))
            other = [F.lit(None).cast("string").alias(target)] if target else []
            fields = [m.alias(id_field), d["action"].alias("action"), *([d[target].alias(target)] if target else [])]
            return F.when(ok, F.struct(*fields)).otherwise(F.struct(m.alias(id_field), F.lit(default).alias("action"), *other))

        return F.struct(F.transform(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>"))), of).alias("decisions"))

    return run


OPERATORS = {o.name: o for o in (
    Operator("class_extraction", "classes array<struct<class:string,description:string>>", fallback=lambda: F.lit('{"classes":[]}')),
    Operator("base_grounding", "axioms array<struct<subclass:string,superclass:string>>", _few("classes", 1, '{"axioms":[]}'), lambda: F.lit('{"axioms":[]}'), _only("axioms", subclass="classes", superclass="base_classes")),
    Operator("local_subclassing", "axioms array<struct<subclass:string,superclass:string>>", _few("classes", 2, '{"axioms":[]}'), lambda: F.lit('{"axioms":[]}'), _only("axioms", subclass="classes", superclass="classes")),
    Operator("object_axioms", "axioms array<struct<domain:string,property:string,range:string>>", _few("classes", 1, '{"axioms":[]}'), lambda: F.lit('{"axioms":[]}')),
    Operator("data_axioms", "axioms array<struct<domain:string,property:string,datatype:string>>", _few("classes", 1, '{"axioms":[]}'), lambda: F.lit('{"axioms":[]}')),
    Operator("instances", "instances array<struct<id:string,class:string>>", _few("classes", 1, '{"instances":[]}'), lambda: F.lit('{"instances":[]}'), _only("instances", **{"class": "classes"})),
    Operator("instance_links", "links array<struct<subject:string,property:string,object:string>>", _few("individuals", 2, '{"links":[]}'), lambda: F.lit('{"links":[]}')),
    Operator("instance_values", "values array<struct<subject:string,property:string,value:string,datatype:string>>", _few("properties", 1, '{"values":[]}'), lambda: F.lit('{"values":[]}')),
    # left out members are kept; a lone class is kept
    Operator("class_equivalence", "decisions array<struct<original_id:string,action:string,target_id:string>>", _few("members", 2, '{"decisions":[]}'), lambda: F.lit('{"decisions":[]}'),
             _decided("members", "original_id", "keep_distinct", "target_id", ("equivalent",))),
    # left out classes are rejected; a lone class is merged
    Operator("polysemy", "decisions array<struct<class:string,action:string>>", lambda: F.when(
        F.size("classes") == 1, F.to_json(F.struct(F.transform("classes", lambda c: F.struct(c.alias("class"), F.lit("merge").alias("action"))).alias("decisions")))),
        lambda: F.lit('{"decisions":[]}'), _decided("classes", "class", "reject")),
    Operator("semantic_cluster", "decisions array<struct<original_id:string,action:string,target_id:string>>", _few("members", 2, '{"decisions":[]}'), lambda: F.lit('{"decisions":[]}'),
             _decided("members", "original_id", "keep_distinct", "target_id", ("equivalent",))),
    Operator("instance_cleanup", "action string", None, lambda: F.lit('{"action":"keep"}')),
    Operator("question_type", "reasoning string, question_type string", None, lambda: _js(reasoning=F.lit("by first words"), question_type=guess_type(F.col("question")))),
    Operator("answer_form", "reasoning string, answer_form string", lambda: F.when(form_is_given(F.col("question_type")).isNotNull(), _js(reasoning=F.lit("only form of the type"), answer_form=form_is_given(F.col("question_type")))),
             lambda: _js(reasoning=F.lit("first form of the type"), answer_form=F.get(F.element_at(F.create_map(*[x for k, v in ANSWER_FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("question_type")), F.lit(0)))),
    Operator("entity", "reasoning string, primary_entity string", None, lambda: _js(reasoning=F.lit("longest run of capitals or quoted text"), primary_entity=guess_entity(F.col("question")))),
    Operator("relation", "relation string", lambda: _js(relation=relation_of(F.col("question_type")))),
    Operator("object", "reasoning string, object string", lambda: F.when(object_is_null(F.col("question_type"), F.col("answer_form")), _js(reasoning=F.lit("no object is asked for"), object=_none())),
             lambda: _js(reasoning=F.lit("second named thing"), object=guess_object(F.col("question")))),
    Operator("entity_choice", "selected_label string", lambda: F.when((F.size("labels") == 1) | (F.col("best_score") == 1.0), _js(selected_label=F.get("labels", F.lit(0)))), lambda: _js(selected_label=F.get("labels", F.lit(0)))),
    Operator("answer", "reasoning string, answer string", None, lambda: _js(reasoning=F.lit("no model"), answer=F.lit("I can't answer the question"))),
    Operator("answer_check", "decision string", None, lambda: F.when(F.size("triples") > 0, F.lit('{"decision":"accept"}')).otherwise('{"decision":"reject"}')),
)}


def guess_type(q: Column) -> Column:
    """A question type from the first words; 'unknown' where none fits."""
    s = F.trim(F.lower(q))
    rules = (
        (r"^(how many|how much|count|number of)", "quantification"), (r"^compare|\b(difference between|more .* than|fewer .* than|versus|vs\.?)\b", "comparative"),
        (r"^(which|what|list|name)\b.*\b(members?|instances?|examples?)\b", "membership"), (r"\b(kinds?|types?|subtypes?|subclass(es)?|superclass(es)?) of\b|^is .* an? ", "taxonomic"),
        (r"^(can|could|is .* able|does .* (support|allow))\b", "capability"), (r"^(what (is|are)|define|who is)\b(?!.*\b(of|for)\b)", "definition"), (r"^(what|which|where|when|who|does|do|has|have)\b", "property"),
    )
    return F.coalesce(*[F.when(F.regexp_like(s, F.lit(p)), F.lit(t)) for p, t in rules], F.lit("unknown"))


def _named(q: Column) -> Column:
    body = F.regexp_replace(q, r"^\s*[\p{L}']+\s+", "")
    return F.concat(F.regexp_extract_all(q, F.lit(r"[\"“]([^\"”]+)[\"”]"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"(?:\p{Lu}[\p{L}\p{N}_-]*)(?:\s+(?:[\p{L}_-]+\s+)?\d[\p{N}]*|\s+\p{Lu}[\p{L}\p{N}_-]*)*"), F.lit(0)))


def guess_entity(q: Column) -> Column:
    """The first quoted or capitalised name after the first word."""
    return F.get(_named(q), F.lit(0))


def guess_object(q: Column) -> Column:
    return F.get(_named(q), F.lit(1))


class Rules:
    """Deterministic fallbacks only."""

    def predict(self, rows: DataFrame, op: Operator) -> DataFrame:
        return rows.withColumn("output", op.fallback() if op.fallback else _none())


class Recorded:
    """Stored outputs ``(operator, key, output)``, one per key; rows without one take the fallback."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def predict(self, rows: DataFrame, op: Operator) -> DataFrame:
        t = self.table.where(F.col("operator") == op.name).groupBy(F.col("key").alias("_k")).agg(F.max("output").alias("output"))
        out = rows.join(t, F.col("key") == F.col("_k"), "left").drop("_k")
        return out.withColumn("output", F.coalesce("output", op.fallback() if op.fallback else _none()))


class Remote:
    """``call(operator, list of row JSON texts) -> list of JSON texts``, in Arrow batches on ``parallel`` tasks;
    failures of a batch are tried again and then leave nulls."""

    def __init__(self, call: Callable[[str, list[str]], list[str | None]], parallel: int = 4, tries: int = 3) -> None:
        self.call, self.parallel, self.tries = call, parallel, tries

    def predict(self, rows: DataFrame, op: Operator) -> DataFrame:
        call, name, tries = self.call, op.name, self.tries

        @F.pandas_udf("string")
        def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                for left in range(tries, 0, -1):
                    try:
                        yield pd.Series(call(name, b.tolist()), dtype=object)
                        break
                    except Exception:  # noqa: BLE001
                        if left == 1:
                            yield pd.Series([None] * len(b), dtype=object)

        return rows.repartition(self.parallel).withColumn("output", ask(F.to_json(F.struct(*rows.columns))))


def predict(rows: DataFrame, operator: str, provider: Rules | Recorded | Remote) -> DataFrame:
    """``rows`` (with a ``key``) and ``result``, the parsed and completed output, and ``by``: 'rule', 'model', or 'failed'
    where the provider gave nothing that can be read and the fallback holds."""
    op = OPERATORS[operator]
    known = rows.withColumn("_d", op.decided() if op.decided else _none())
    ruled = known.where("_d is not null").withColumn("output", F.col("_d")).withColumn("by", F.lit("rule"))
    asked = provider.predict(known.where("_d is null"), op).withColumn("by", F.lit("model"))
    both = ruled.select(*rows.columns, "output", "by").unionByName(asked.select(*rows.columns, "output", "by"))
    read = both.withColumn("result", F.from_json(repaired_json("output"), op.schema))
    # JSON of another shape reads as a row of nulls
    lost = F.col("result").isNull() | F.coalesce(F.to_json("result") == "{}", F.lit(False))
    spare = F.from_json(op.fallback(), op.schema) if op.fallback else F.lit(None)
    read = read.withColumn("_lost", lost & (F.col("by") == "model"))
    read = read.withColumn("by", F.when(F.col("_lost"), "failed").otherwise(F.col("by"))).withColumn("result", F.when(F.col("_lost"), F.coalesce(spare, F.col("result"))).otherwise(F.col("result")))
    return (read.withColumn("result", op.complete(F.col("result"))) if op.complete else read).drop("output", "_lost")


def failures(predicted: DataFrame, operator: str, key: str = "key") -> DataFrame:
    """``(operator, key)`` of the rows for which the provider failed."""
    return predicted.where("by = 'failed'").select(F.lit(operator).alias("operator"), F.col(key).cast("string").alias("key"))
