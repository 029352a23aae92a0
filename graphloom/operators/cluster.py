"""Similarity graphs and average-linkage clustering.

Average linkage with cosine distance, cut at a threshold, never leaves the connected components of the
graph of pairs below the threshold. So pairs are found by a sparse join, components by star contraction,
and the exact clustering runs per component. The mean cosine between two clusters is the dot product of
their mean unit vectors, so a task keeps one vector per cluster and no matrix of distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import broadcast_blocks, cut
from .components import star_components


def word_terms(x: Column) -> Column:
    """Words and pairs of neighbouring words of the lower-cased text."""
    w = F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0))
    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, two)


def char_terms(x: Column) -> Column:
    """Character runs of 3 and 4 within words padded by blanks; a word too short for a run gives itself once."""
    w = F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != "")
    padded = F.transform(w, lambda t: F.concat(F.lit(" "), t, F.lit(" ")))

    def runs(t: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))

    none = F.array().cast("array<string>")
    return F.flatten(F.transform(padded, lambda t: F.concat(
        F.when(F.length(t) > 3, runs(t, 3)).otherwise(F.array(t)), F.when(F.length(t) > 4, runs(t, 4)).when(F.length(t) == 4, F.array(t)).otherwise(none))))


def tfidf(items: DataFrame, key: str, blocks: dict[str, tuple[Column, float]]) -> DataFrame:
    """``(key, term, w, df)``: unit vectors of weighted tf-idf blocks, each block L2-normalised first.

    ``blocks`` maps a name to its array of terms and its weight. Inverse frequencies are smoothed,
    ``ln((1 + n) / (1 + df)) + 1``. Items without terms give no rows; keys are distinct.
    """
    items = items.dropDuplicates([key])
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    rows = reduce(DataFrame.unionByName, [items.select(key, F.lit(b).alias("block"), F.lit(wt).alias("wt"), F.explode(terms).alias("t")) for b, (terms, wt) in blocks.items()])
    tf = rows.groupBy(key, "block", "wt", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("block", "t").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # one row
    raw = tf.join(df, ["block", "t"]).withColumn("x", F.col("tf") * (F.log((1 + F.col("n_items")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key, "block")))
    scaled = raw.withColumn("w", F.col("x") / norm * F.col("wt"))
    whole = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))
    return scaled.withColumn("w", F.col("w") / whole).select(key, F.concat_ws(":", "block", "t").alias("term"), "w", "df")


def cosine_pairs(vectors: DataFrame, key: str, least: float) -> DataFrame:
    """``(a, b, cos)``, a < b, of all pairs whose cosine is above ``least``; exact.

    Prefix filter: terms are ordered from rare to frequent, and only those are joined after which the
    rest of a unit vector is at least ``least`` long; two vectors without a common term there cannot
    reach it. Frequent terms come last, so they hardly ever meet.
    """
    v = cut(vectors, "vectors")
    order = W.partitionBy(key).orderBy("df", "term")
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(0, W.unboundedFollowing))
    prefix = v.withColumn("rest", F.sqrt(rest)).where(F.col("rest") >= least - 1e-9).select(key, "term")
    cand = prefix.select(F.col(key).alias("a"), "term").join(prefix.select(F.col(key).alias("b"), "term"), "term").where("a < b").select("a", "b").distinct()
    whole = v.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    rows = cand.join(whole.select(F.col(key).alias("a"), F.col("m").alias("ma")), "a").join(whole.select(F.col(key).alias("b"), F.col("m").alias("mb")), "b")
    dot = F.aggregate(F.array_intersect(F.map_keys("ma"), F.map_keys("mb")), F.lit(0.0), lambda acc, t: acc + F.element_at("ma", t) * F.element_at("mb", t))
    return rows.select("a", "b", dot.alias("cos")).where(F.col("cos") > least)


def unit(x: Column) -> Column:
    """The array scaled to length 1; null for a null or zero array."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.when(norm > 0, F.transform(x, lambda v: v.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def vector_pairs(items: DataFrame, key: str, vec: str, least: float, block_rows: int = 2000) -> DataFrame:
    """``(a, b, cos)``, a < b, of all pairs of dense vectors whose cosine is above ``least``; exact.

    Rows are put in blocks of about ``block_rows``; each task multiplies one pair of blocks and emits
    only the hits. Meant for sets of classes; the work grows with the square of their number.
    """
    base = cut(items.select(F.col(key).alias("k"), unit(F.col(vec)).alias("v")).where("v is not null"), "unit")
    blocks = max(1, -(-base.count() // block_rows))
    keyed = base.withColumn("blk", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    left = keyed.select("k", "v", F.col("blk").alias("i"), F.explode(F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("j"))
    right = keyed.select("k", "v", F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"))
    kind = items.schema[key].dataType.simpleString()

    def hits(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "cos": []})
        m = np.stack(l["v"].to_numpy()) @ np.stack(r["v"].to_numpy()).T
        x, y = np.nonzero(m > least)
        out = pd.DataFrame({"a": l["k"].to_numpy()[x], "b": r["k"].to_numpy()[y], "cos": m[x, y]})
        out = out[out["a"] != out["b"]]
        swap = out["a"] > out["b"]
        out.loc[swap, ["a", "b"]] = out.loc[swap, ["b", "a"]].to_numpy()
        return out.drop_duplicates(["a", "b"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(hits, f"a {kind}, b {kind}, cos double")


def average_linkage(keys: list, vectors: np.ndarray, most: float) -> list[int]:
    """Cluster numbers of unit vectors by average linkage on cosine distance, merged below ``most``.

    The closest pair merges first; ties go to the pair with the smallest members.
    """
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    sums = {c: vectors[i].astype(float) for c, i in enumerate(order)}
    members = {c: [i] for c, i in enumerate(order)}
    while len(sums) > 1:
        ids = sorted(sums)
        mean = np.stack([sums[c] / len(members[c]) for c in ids])
        best = (-2.0, 0, 0)
        for r in range(0, len(ids), 512):
            m = mean[r : r + 512] @ mean.T
            for k in range(m.shape[0]):
                m[k, : r + k + 1] = -2.0
            f = int(np.argmax(np.round(m, 12)))
            x, y = divmod(f, m.shape[1])
            if round(float(m[x, y]), 12) > best[0]:
                best = (round(float(m[x, y]), 12), ids[r + x], ids[y])
        if 1 - best[0] >= most:
            break
        _, a, b = best
        sums[a] += sums.pop(b)
        members[a] += members.pop(b)
    out = [0] * len(keys)
    for c, mem in members.items():
        for i in mem:
            out[i] = c
    return out


def cluster_pairs(pairs: DataFrame, vectors: DataFrame, most: float) -> DataFrame:
    """``(cluster, key)`` of all clusters with two or more members; ``vectors(key, terms MAP)``.

    The cluster is named by its smallest key. ``pairs(a, b)`` are all pairs nearer than ``most``.
    """
    comp = star_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rows = comp.join(vectors, comp["node"] == vectors["key"]).select("component", "key", "terms")
    kind = vectors.schema["key"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].tolist()
        terms = [dict(t) for t in pdf["terms"]]
        index = {t: i for i, t in enumerate(sorted({t for m in terms for t in m}))}
        mat = np.zeros((len(keys), len(index)))
        for i, m in enumerate(terms):
            for t, w in m.items():
                mat[i, index[t]] = w
        labels = pd.Series(average_linkage(keys, mat, most))
        out = pd.DataFrame({"key": keys, "c": labels})
        out = out[out.groupby("c")["key"].transform("size") > 1]
        return pd.DataFrame({"cluster": out.groupby("c")["key"].transform("min"), "key": out["key"]})

    return rows.groupBy("component").applyInPandas(run, f"cluster {kind}, key {kind}")


def fuzzy_name_clusters(names: DataFrame, key: str, most: float = 0.4, word_weight: float = 20.0, char_weight: float = 5.0) -> DataFrame:
    """``(cluster, key)``: names that average linkage on weighted word and character tf-idf puts together."""
    v = cut(tfidf(names.select(key).where(F.col(key).isNotNull()), key, {"w": (word_terms(F.col(key)), word_weight), "c": (char_terms(F.col(key)), char_weight)}), "name-vectors")
    pairs = cut(cosine_pairs(v, key, 1 - most), "name-pairs")
    vectors = v.groupBy(F.col(key).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("terms"))
    return cluster_pairs(pairs, vectors, most)


def vector_clusters(items: DataFrame, key: str, vec: str, most: float = 0.3) -> DataFrame:
    """``(cluster, key)`` by average linkage on given dense vectors."""
    pairs = cut(vector_pairs(items, key, vec, 1 - most), "vector-pairs")
    terms = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("u") - 1), lambda i: F.lpad(i.cast("string"), 6, "0")), F.col("u"))
    vectors = items.select(F.col(key).alias("key"), unit(F.col(vec)).alias("u")).where("u is not null").select("key", terms.alias("terms"))
    return cluster_pairs(pairs, vectors, most)


def nearest(queries: DataFrame, items: DataFrame, q: str, key: str, vec: str, k: int = 3) -> DataFrame:
    """``(query, item, score, rank)``: the ``k`` items of highest cosine for each query; ties by key.

    The queries are a stated set. They go to all tasks in blocks of bounded size; a task multiplies each of its
    batches of items with a block and keeps the best ``k`` of the batch for each query, so few rows are shuffled.
    Null and zero vectors take no part.
    """
    qs = cut(queries.select(F.col(q).alias("query"), unit(F.col(vec)).alias("v")).where("v is not null"), "queries")
    rows = items.select(F.col(key).alias("item"), unit(F.col(vec)).alias("v")).where("v is not null")
    layout = f"query {queries.schema[q].dataType.simpleString()}, item {items.schema[key].dataType.simpleString()}, score double"

    def best(block: DataFrame) -> DataFrame:
        held = block.toPandas()  # a block of bounded size
        shared = queries.sparkSession.sparkContext.broadcast((held["query"].to_numpy(), np.stack(held["v"].to_numpy()) if len(held) else np.zeros((0, 1))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, own = shared.value
            for b in batches:
                if not len(b) or not len(names):
                    continue
                scores, ids = own @ np.stack(b["v"].to_numpy()).T, b["item"].to_numpy()
                keyed = np.round(scores, 6)
                at, of = [], []
                for n, row in enumerate(keyed):
                    near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    near = near[np.lexsort((ids[near], -row[near]))][:k]
                    at.append(near)
                    of.append(np.full(len(near), n))
                at, of = np.concatenate(at), np.concatenate(of)
                yield pd.DataFrame({"query": names[of], "item": ids[at], "score": scores[of, at]})

        return rows.mapInPandas(run, layout)

    scored = reduce(DataFrame.unionByName, map(best, broadcast_blocks(qs))).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "item"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """``(size, clusters, members)`` of ``clusters(cluster, key)``: how many clusters have each size."""
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return n.groupBy("size").agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("members"))


def resolution_ratios(decisions: DataFrame) -> DataFrame:
    """``(action, n, share)`` of ``decisions(action, ...)``: how many members were merged, kept or rejected."""
    n = decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(decisions.agg(F.count(F.lit(1)).alias("total")))).select("action", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row
