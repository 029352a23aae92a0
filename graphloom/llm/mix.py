"""Mixing sources to target weights with a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import bounded_broadcast, cut
from .tokens import token_counts

#: Rows of a bucket of the two-level running sum.
BUCKET_ROWS = 100_000

#: Weight of a source at equally spaced times from start to end of training, relative to its mean.
#: Sources that have to be repeated come late, the others give way in proportion.
LATE = (0.5, 1.0, 1.5)


def demand(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Tokens that each source gives: ``(source, target_share, max_repeats, size, tokens)``.

    ``targets(source, target_share, max_repeats)``, ``sizes(source, size)``. The mixture holds ``total``
    tokens, by default the sum of the sources' sizes. A source gives its share of it but at most
    ``max_repeats`` times its size; what it cannot give is spread over the sources that still can, in
    proportion to their shares, until the total is met or all are exhausted. Null or negative shares and
    repeats count as 0; repeated rows of a source count once; a source without documents gives nothing.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(sizes, "source", "left").select(
        "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"), F.coalesce("size", F.lit(0)).alias("size"))
    rows = t.withColumn("cap", F.col("size") * F.col("max_repeats"))
    # water level: sources in the order in which they run dry; level = tokens per unit of share
    dry = W.orderBy(F.col("need_level"), "source")
    before, after = dry.rowsBetween(W.unboundedPreceding, -1), dry.rowsBetween(0, W.unboundedFollowing)
    goal = F.lit(total).cast("double") if total is not None else F.sum("size").over(W.partitionBy(F.lit(1)))
    rows = rows.withColumn("goal", goal.cast("double")).withColumn("need_level", F.when(F.col("target_share") > 0, F.col("cap") / F.col("target_share")))
    live = rows.where("need_level is not null")
    live = live.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("share_left", F.sum("target_share").over(after))
    live = live.withColumn("level", (F.col("goal") - F.col("spent")) / F.col("share_left"))
    # the level of the first source that does not run dry holds for it and all after it
    level = live.where("need_level >= level").agg(F.min(F.struct("need_level", "source", "level")).alias("m")).select(F.col("m.level").alias("final"))
    live = live.crossJoin(F.broadcast(level))  # one row
    given = F.when(F.col("final").isNull() | (F.col("need_level") < F.col("final")), F.col("cap")).otherwise(F.least(F.col("cap"), F.round(F.col("final") * F.col("target_share"))))
    out = live.select("source", given.cast("bigint").alias("tokens"))
    return rows.join(out, "source", "left").select("source", "target_share", "max_repeats", "size", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def running_tokens(docs: DataFrame, seed: int) -> DataFrame:
    """``before``: tokens of the source's documents that precede each one in a random order.

    A source may hold a third of all rows, so the order is cut into buckets of about ``BUCKET_ROWS``
    rows: sums by bucket are accumulated over the few buckets, then over the rows within each.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n")).first()[0] or 1
    buckets = max(1, -(-most // BUCKET_ROWS))
    order = F.xxhash64(F.lit(seed), "doc_id")
    docs = docs.withColumn("o", order).withColumn("bucket", F.floor((F.col("o") / 2.0**64 + 0.5) * buckets))
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    prior = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("s").over(prior), F.lit(0)).alias("base"))
    inner = W.partitionBy("source", "bucket").orderBy("o", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    return docs.join(sums, ["source", "bucket"]).withColumn("before", F.col("base") + F.col("inner")).drop("o", "bucket", "base", "inner")


def _resampled(values: tuple[float, ...] | list[float], knots: int) -> Column:
    """Weights at equally spaced times as ``knots`` weights, linear in between."""
    out = []
    for k in range(knots):
        pos = k / (knots - 1) * (len(values) - 1)
        i = min(int(pos), len(values) - 2)
        out.append(F.lit(float(values[i] + (values[i + 1] - values[i]) * (pos - i))))
    return F.array(*out)


def schedule_table(plan: DataFrame, schedules: dict[str, list[float]] | None) -> DataFrame:
    """``(source, area, segments)``: each source's schedule as segments with start, length, weights at both ends and
    integral at the start.

    ``schedules`` gives relative weights at equally spaced times; sources without one rise by ``LATE`` if
    they are repeated. At each time the other sources' weights are scaled so that all weights sum to 1, for which
    one row of sums, one for each knot, is made of all sources.
    """
    given = schedules or {}
    knots = max([len(LATE), *(len(v) for v in given.values())])
    own = F.when(F.col("tokens") > F.col("size"), _resampled(LATE, knots))
    for source, weights in given.items():
        own = F.when(F.col("source") == source, _resampled(weights, knots)).otherwise(own)
    rows = plan.where("tokens > 0").select("source", "tokens", own.alias("own"))
    held = F.col("own").isNotNull()
    sums = rows.agg(F.sum("tokens").alias("total"), F.coalesce(F.sum(F.when(~held, F.col("tokens"))), F.lit(0)).alias("rest"), F.array(*[F.coalesce(F.sum(F.col("tokens") * F.get("own", F.lit(k))), F.lit(0.0)) for k in range(knots)]).alias("taken"))
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    scaled = F.transform("taken", lambda x: F.greatest(F.lit(0.0), 1 - x / F.col("total")) * F.try_divide("tokens", "rest"))
    rows = rows.select("source", F.when(held, F.transform("own", lambda w: F.col("tokens") / F.col("total") * w)).otherwise(scaled).alias("w"))
    dt = 1.0 / (knots - 1)
    ends = lambda k: (F.get("w", k).alias("w0"), F.get("w", k + 1).alias("w1"))
    rows = rows.withColumn("areas", F.transform(F.sequence(F.lit(0), F.lit(knots - 2)), lambda k: (F.get("w", k) + F.get("w", k + 1)) / 2 * dt))
    upto = lambda k: F.aggregate(F.slice("areas", F.lit(1), k), F.lit(0.0), lambda acc, x: acc + x)
    segments = F.transform(F.sequence(F.lit(0), F.lit(knots - 2)), lambda k: F.struct((k * dt).alias("t"), F.lit(dt).alias("dt"), *ends(k), upto(k).alias("c")))
    return rows.select("source", upto(F.size("areas")).alias("area"), segments.alias("segments"))


def invert(demand_share: Column, segments: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``demand_share``: the segment is found by
    its start, then the quadratic of a linear weight is solved in the form that is stable for slope 0."""
    seg = F.filter(segments, lambda s: s["c"] <= demand_share)
    s = F.when(F.size(seg) > 0, F.element_at(seg, -1)).otherwise(segments[0])
    q = F.greatest(demand_share - s["c"], F.lit(0.0))
    slope = (s["w1"] - s["w0"]) / s["dt"]
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * q, F.lit(0.0)))
    return s["t"] + F.least(F.coalesce(F.try_divide(2 * q, s["w0"] + root), F.lit(0.0)), s["dt"])


def mixture(docs: DataFrame, targets: DataFrame, file: str | None = None, total: int | None = None, schedules: dict[str, list[float]] | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, source, text)`` as one training order, and the shares reached.

    The first result has ``(position, doc_id, source, repeat, tokens)``, ``position`` in [0, 1) and rows
    range-sorted by it: one row for each use of a document. Each source's demand is met by whole passes
    over its documents in a random but fixed order, then by a part of one more pass; a document belongs
    to a pass if its middle does. So a source misses its demand by at most half a document, and no
    document is used more than ``max_repeats`` times. The second result has one row per source of the
    targets: ``(source, target_share, actual_share, max_repeats, passes, size, wanted, tokens, documents)``.

    Sizes are tokens of a public tokenizer. Documents of other sources, with null source or without
    tokens are left out; repeated rows of a doc_id count once.
    """
    sized = docs.join(targets.select("source").distinct(), "source", "left_semi")
    counted = token_counts(sized, "doc_id", "text", file).groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")
    sized = sized.groupBy("doc_id").agg(F.min("source").alias("source")).join(counted, "doc_id")
    sized = cut(sized.select("doc_id", "source", "tokens"), "sized")
    plan = cut(demand(sized.groupBy("source").agg(F.sum("tokens").alias("size")), targets, total), "plan")
    table = cut(schedule_table(plan, schedules), "schedule")

    ordered = running_tokens(sized, seed).join(plan.where("tokens > 0").select("source", "size", "max_repeats", F.col("tokens").alias("wanted")), "source")
    passes = F.greatest(F.lit(0), F.least(F.col("max_repeats"), F.ceil((F.col("wanted") - F.col("before") - F.col("tokens") / 2) / F.col("size")).cast("int")))
    uses = ordered.withColumn("passes", passes).where("passes > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    uses = uses.join(bounded_broadcast(table), "source")  # one row per source
    share = (F.col("repeat") * F.col("size") + F.col("before")) / F.col("wanted") * F.col("area")
    placed = uses.select(invert(share, F.col("segments")).alias("position"), "doc_id", "source", "repeat", "tokens")
    placed = cut(placed.repartitionByRange("position", "doc_id", "repeat").sortWithinPartitions("position", "doc_id", "repeat"), "mixture")

    used = placed.groupBy("source").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("documents"), (F.max("repeat") + 1).alias("passes"))
    total_used = placed.agg(F.sum("tokens").alias("all_tokens"))
    shares = plan.join(used, "source", "left").crossJoin(F.broadcast(total_used)).select(
        "source", "target_share", F.coalesce(F.try_divide("used", "all_tokens"), F.lit(0.0)).alias("actual_share"), "max_repeats",
        F.coalesce("passes", F.lit(0)).alias("passes"), "size", F.col("tokens").alias("wanted"), F.coalesce("used", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return placed, shares
