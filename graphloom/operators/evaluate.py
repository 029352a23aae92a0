"""Evaluation: pass rates over many levels, category metrics, classification histograms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .questions import tier_of


def percent(part: Column, base: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, base), F.lit(0.0)), 2)


def check_rows(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per check ``(keys, check, passed)`` from ``results(keys, checks ARRAY<STRUCT<name, passed>>)``."""
    rows = results.select(*keys, F.explode("checks").alias("c"))
    return rows.select(*keys, F.col("c.name").alias("check"), F.coalesce(F.col("c.passed"), F.lit(False)).alias("passed"))


def pass_rates(checks: DataFrame) -> DataFrame:
    """Pass rates by domain, tier and check, with the domain's, the tiers' and the grand totals.

    ``checks(domain, tier, check, passed)``; checks that only test for presence ('has_') do not count.
    Rolled-up levels carry '(all)'. One pass with grouping sets.
    """
    rows = checks.where(~F.startswith("check", F.lit("has_")))
    rows = rows.select(F.coalesce("domain", F.lit("(none)")).alias("domain"), F.coalesce("tier", F.lit("(none)")).alias("tier"), "check", "passed")
    sets = [[F.col("domain"), F.col("tier"), F.col("check")], [F.col("domain"), F.col("check")], [F.col("tier"), F.col("check")], [F.col("check")]]
    out = rows.groupingSets(sets, "domain", "tier", "check").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    return out.select(F.coalesce("domain", F.lit("(all)")).alias("domain"), F.coalesce("tier", F.lit("(all)")).alias("tier"), "check", "passed", "total", percent(F.col("passed"), F.col("total")).alias("pct"))


def resolution_rates(checks: DataFrame) -> DataFrame:
    """``(side, tier, check, passed, total, pct)`` of entity resolution from ``checks(case_id, check, passed)``.

    Unresolvable cases count their failures to resolve; resolvable ones success and correctness by tier and
    over all tiers.
    """
    un = F.startswith("case_id", F.lit("unresolvable"))
    rows = checks.withColumn("side", F.when(un, "unresolvable").otherwise("resolvable")).withColumn("tier", F.when(un, "overall").otherwise(tier_of(F.col("case_id"))))
    rows = rows.where((un & (F.col("check") == "resolution_failure")) | (~un & F.col("check").isin("resolution_success", "correct_resolved_entity") & (F.col("tier") != "unknown")))
    rows = rows.select("side", "check", "passed", F.explode(F.when(F.col("side") == "resolvable", F.array("tier", F.lit("overall"))).otherwise(F.array("tier"))).alias("tier"))
    out = rows.groupBy("side", "tier", "check").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("pct", percent(F.col("passed"), F.col("total")))


#: Simple counters and the checks behind them.
_EXTRACTION = {
    "correct_question_type": "correct_question_type", "correct_answer_form": "correct_answer_form", "correct_entity": "correct_extracted_entity",
    "correct_relation": "correct_relation_extraction", "correct_object": "correct_object_extraction",
}


def grounding_flags(cases: DataFrame) -> DataFrame:
    """Boolean columns per case, each with the precedence that decides whether it is reached.

    ``cases(category, answerable, passed ARRAY<STRING>, entity_resolved, object_resolved, entity_subset,
    object_subset)``; ``passed`` names the checks that passed, the subset columns tell whether the grounding
    lies within the fetched context.
    """
    has = lambda c: F.array_contains("passed", F.lit(c))
    out = cases
    for name, check in _EXTRACTION.items():
        out = out.withColumn(name, has(check))
    ans, comp = F.col("answerable"), F.col("category") == "comparative"
    ent, obj = F.col("entity_resolved"), F.col("object_resolved")
    abstained = ~ans & has("abstain_expected")
    reach_object = comp & ent & ~abstained
    mapped = ent & ~abstained & (~comp | obj)
    ok_ent, ok_obj = has("correct_entity_resolution"), has("correct_object_resolution")
    preferred = has("grounding_preferred")
    within = F.when(ans & comp, F.col("entity_subset") & ok_ent & F.col("object_subset") & ok_obj).when(ans, F.col("entity_subset") & ok_ent).when(comp, F.col("entity_subset") & F.col("object_subset")).otherwise(F.col("entity_subset"))
    return (
        out.withColumn("correctly_abstained", abstained)
        .withColumn("entity_resolved_n", ent)
        .withColumn("correct_entity_resolution", ok_ent & (ent | ~ans))
        .withColumn("object_resolved_n", reach_object & obj)
        .withColumn("correct_object_resolution", reach_object & obj & ok_obj)
        .withColumn("preferred_grounding_match", preferred & F.when(ans, mapped).otherwise(ent & ~abstained))
        .withColumn("acceptable_grounding", mapped & (preferred | within))
        .withColumn("unacceptable_grounding", mapped & ~(preferred | within))
        .withColumn("no_mapping_performed", ~mapped)
    )


_METRICS = [*_EXTRACTION, "correctly_abstained", "entity_resolved_n", "correct_entity_resolution", "object_resolved_n", "correct_object_resolution", "preferred_grounding_match", "acceptable_grounding", "unacceptable_grounding", "no_mapping_performed"]


def grounding_metrics(cases: DataFrame) -> DataFrame:
    """``(category, answerable, metric, n, base, pct)``, with category '(all)' over all categories.

    Correct resolutions are shares of the resolved, resolved objects of the expected ones, all else of all.
    """
    flags = grounding_flags(cases)
    agg = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("category") == "comparative").alias("object_expected")] + [F.count_if(F.coalesce(F.col(m), F.lit(False))).alias(m) for m in _METRICS]
    wide = flags.rollup("answerable", "category").agg(*agg).where("answerable is not null")
    base = lambda m: {"correct_object_resolution": "object_resolved_n", "correct_entity_resolution": "entity_resolved_n", "object_resolved_n": "object_expected"}.get(m, "total")
    items = F.array(*[F.struct(F.lit(m.removesuffix("_n")).alias("metric"), F.col(m).alias("n"), F.col(base(m)).alias("base")) for m in _METRICS])
    out = wide.select(F.coalesce("category", F.lit("(all)")).alias("category"), "answerable", F.inline(items))
    return out.withColumn("pct", percent(F.col("n"), F.col("base")))


#: Labels of the manual evaluation and the base of their share.
LABELS = {
    "Correct (Ground Truth)": "answerable", "Incomplete": "answerable", "Unprecise": "answerable", "Incorrect (false information)": "total",
    "Incorrect (vague information)": "total", "Incorrect Abstain": "answerable", "Correct Abstain": "unanswerable",
}
UNANSWERABLE = "I can't answer the question"


def label_shares(rows: DataFrame) -> DataFrame:
    """``(system, category, label, n, base, pct)`` of manual labels, category '(all)' over all.

    ``rows(system, category, classification, gold_answer)``. Every label has a row, also with 0.
    """
    un = F.trim(F.coalesce("gold_answer", F.lit(""))) == UNANSWERABLE
    agg = [F.count(F.lit(1)).alias("total"), F.count_if(un).alias("unanswerable"), F.count_if(~un).alias("answerable")] + [F.count_if(F.col("classification") == l).alias(f"l{i}") for i, l in enumerate(LABELS)]
    wide = rows.rollup("system", "category").agg(*agg).where("system is not null")
    items = F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"l{i}").alias("n"), F.col(b).alias("base")) for i, (l, b) in enumerate(LABELS.items())])
    out = wide.select("system", F.coalesce("category", F.lit("(all)")).alias("category"), F.inline(items))
    return out.withColumn("pct", percent(F.col("n"), F.col("base")))


def label_pivot(rows: DataFrame) -> DataFrame:
    """Counts of labels as columns by system and category."""
    return rows.groupBy("system", "category").pivot("classification", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0)


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Results of two systems by question; a question that the right side lacks raises an error when read."""
    r = right.select(F.col(key).alias("_k"), *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key])
    rows = left.join(r, F.col(key) == F.col("_k"), "left")
    ok = F.when(F.col("_k").isNotNull(), F.col("_k")).otherwise(F.raise_error(F.concat(F.lit("no result of the other system for "), F.col(key).cast("string"))))
    return rows.withColumn("_k", ok).where("_k is not null").drop("_k")


def flat_tokens(facets: list[Column]) -> Column:
    """Distinct lower-cased texts of several arrays."""
    return F.array_distinct(F.transform(F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in facets])), F.lower))


def _leaves(x: object) -> Iterator[str]:
    if isinstance(x, dict):
        for k, v in x.items():
            yield str(k).lower()
            yield from _leaves(v)
    elif isinstance(x, list):
        for v in x:
            yield from _leaves(v)
    elif x is not None:
        yield str(x).lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_tokens(s: pd.Series) -> pd.Series:
    """Distinct lower-cased keys and values of nested JSON, sorted; in Arrow batches, as the depth is not known.
    An empty list for null and for what is no JSON."""
    def one(t: str | None) -> list[str]:
        try:
            return [] if t is None else sorted(set(_leaves(json.loads(t))))
        except ValueError:
            return []

    return s.map(one)


def within(predicted: Column, context: Column) -> Column:
    """All predicted tokens, of which there is at least one, stand in the context."""
    return (F.size(predicted) > 0) & (F.size(F.array_except(predicted, context)) == 0)


def facets_hold(expected: list[Column], actual: list[Column]) -> Column:
    """Every expected facet is a subset of the actual one."""
    out = F.lit(True)
    for e, a in zip(expected, actual):
        none = F.array().cast("array<string>")
        out = out & (F.size(F.array_except(F.coalesce(e, none), F.coalesce(a, none))) == 0)
    return out
