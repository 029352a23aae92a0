"""References to names that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import bounded_broadcast, cut


def existence_intervals(events: DataFrame) -> DataFrame:
    """``events(name, at, ends BOOLEAN)`` into ``(name, from_at, to_at)``: the name exists from a
    declaration (``ends`` false) until the next end at or after it; ``to_at`` null: it still exists.

    The next end is looked for among the events of the name's day, then among the first ends of its later days,
    so a name that holds a third of all events is ordered by days and not as a whole. A declaration at the very
    time of an end gives an empty interval and is dropped: the name is back only with a later one. Repeated
    events count once; events with a null name or time are ignored.
    """
    e = events.where("name is not null and at is not null").distinct().withColumn("day", F.to_date("at"))
    rest = W.partitionBy("name", "day").orderBy("at", "ends").rowsBetween(0, W.unboundedFollowing)
    end = F.when(F.col("ends"), F.col("at"))
    spans = e.withColumn("same_day", F.min(end).over(rest)).where(~F.col("ends"))
    spans = spans.groupBy("name", "day", "same_day").agg(F.min("at").alias("from_at"))
    days = e.groupBy("name", "day").agg(F.min(end).alias("first_end"))
    later = W.partitionBy("name").orderBy("day").rowsBetween(1, W.unboundedFollowing)
    days = days.select("name", "day", F.min("first_end").over(later).alias("next_end"))
    spans = spans.join(days, ["name", "day"]).select("name", "from_at", F.coalesce("same_day", "next_end").alias("to_at"))
    spans = spans.groupBy("name", "to_at").agg(F.min("from_at").alias("from_at"))
    return spans.where("to_at is null or from_at < to_at").select("name", "from_at", "to_at")


def orphan_references(refs: DataFrame, events: DataFrame, heavy_share: float = 0.001, weight: str | None = None) -> DataFrame:
    """The rows of ``refs(name, at, period, ...)`` whose name does not exist at ``at``.

    Skew-aware split: references are first counted per name and period (combined before the shuffle).
    Names that hold ``heavy_share`` or more of all references, of which there are at most
    ``1 / heavy_share``, are checked against their broadcast intervals, so no task receives a heavy name
    whole; the rest goes through a shuffled anti-join; both results are united. The column ``weight``, if given,
    says how many references a row stands for. Rows with a null name refer to nothing and those with a null time
    to no time: they are no orphans. Ties: a reference at the time of a declaration finds the name, one at the
    time of an end does not.
    """
    refs = refs.where("name is not null and at is not null")
    each = F.sum(weight) if weight else F.count(F.lit(1))
    counts = refs.groupBy("name", "period").agg(each.alias("n")).groupBy("name").agg(F.sum("n").alias("n"))
    counts = cut(counts, "ref-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") >= max(2, total * heavy_share)).select("name")
    spans = cut(existence_intervals(events), "intervals")
    heavy_names = cut(heavy, "heavy")  # at most 1 / heavy_share rows
    heavy_spans = cut(spans.join(F.broadcast(heavy_names), "name", "left_semi"), "heavy-intervals")

    def orphans(r: DataFrame, s: DataFrame) -> DataFrame:
        s = s.withColumnRenamed("name", "span_name")
        inside = (r["at"] >= s["from_at"]) & (s["to_at"].isNull() | (r["at"] < s["to_at"]))
        return r.join(s, (r["name"] == s["span_name"]) & inside, "left_anti")

    hot = orphans(refs.join(F.broadcast(heavy_names), "name", "left_semi"), bounded_broadcast(heavy_spans))
    cold = orphans(refs.join(F.broadcast(heavy_names), "name", "left_anti"), spans)
    return hot.unionByName(cold)


def orphan_counts(refs: DataFrame, events: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """Orphan references and distinct missing names by ``keys``, for ``refs(name, at, period, *identity)``.

    References are counted per name, time and period first, and only these counts go through the split anti-join.
    Rows that agree in ``identity`` are deliveries of one reference.
    """
    once = refs.where("name is not null and at is not null").select("name", "at", "period", *identity).distinct()
    counted = cut(once.groupBy("name", "at", "period", *[k for k in keys if k != "period"]).agg(F.count(F.lit(1)).alias("n")), "reference-counts")
    return orphan_report(orphan_references(counted, events, weight="n"), keys, weight="n")


def orphan_report(orphans: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Orphan references and distinct missing names by ``keys``."""
    return (
        orphans.groupBy(*keys, "name").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
        .groupBy(*keys).agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("missing_names"))
    )
