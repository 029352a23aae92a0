"""Entity retrieval and entity context."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import bounded_broadcast, broadcast_blocks, cut, cut_counted
from ..functions.similarity import ALPHABET, counted, long_tokens, overlap_share
from ..functions.text import entity_key, letter_tokens, readable
from .triples import (
    ANNOTATION_PROPERTY, CLASS, COMMENT, DATA_PROPERTY, DOMAIN, EQUIVALENT, EX, INDIVIDUAL, LABEL, OBJECT_PROPERTY, RANGE, RDF_TYPE, SUBCLASS,
    direct_types, labels, same_as_sets, subclass_closure,
)

KEEP = 0.5


def entity_labels(t: DataFrame) -> DataFrame:
    """``(uri, label, fragment)`` of classes and individuals; the decoded fragment where there is no label."""
    nodes = t.where((F.col("p") == RDF_TYPE) & F.col("o").isin(CLASS, INDIVIDUAL)).select(F.col("s").alias("uri")).distinct()
    lab = t.where(F.col("p") == LABEL).select(F.col("s").alias("_s"), F.col("o").alias("label")).distinct()
    return nodes.join(lab, F.col("uri") == F.col("_s"), "left").select("uri", F.coalesce("label", readable(F.col("uri"))).alias("label"), readable(F.col("uri")).alias("fragment"))


def _keyed(entities: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and distinct names as tables, with normal forms and sorted distinct tokens; names with equal tokens score alike."""
    e = entities.select("entity").where("entity is not null").distinct().withColumn("ek", entity_key("entity"))
    e = cut(e.withColumn("et", F.array_sort(F.array_distinct(letter_tokens(F.col("ek"))))), "query-entities")
    n = names.select("uri", "label", entity_key("label").alias("lk"), entity_key("fragment").alias("fk"))
    n = n.select("*", F.array_sort(long_tokens(F.col("lk"))).alias("lt"), F.count(F.lit(1)).over(W.partitionBy("uri")).alias("of_uri"))
    return e, cut(n, "names")


def _share_tokens(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``names(lt, ...)`` with rows of ``asked(et, ...)``, a table made by ``cut``, that share a token, and the token
    part of the ``score``. Each pair is made once, at the least token it shares, so nothing is made distinct."""
    by_token = bounded_broadcast(cut(asked.select("*", F.explode("et").alias("tok")), "asked-tokens"))
    both = names.select("*", F.explode("lt").alias("tok")).join(by_token, "tok").where(F.col("tok") == F.array_min(F.array_intersect("et", "lt")))
    return both.withColumn("score", F.round(0.15 * overlap_share(F.col("et"), F.col("lt")) + 0.05, 6)).drop("tok")


def _spread(df: DataFrame) -> DataFrame:
    """Few bytes, many pairs: more tasks than the size asks for."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // 10_000))


def _exact(e: DataFrame, n: DataFrame) -> DataFrame:
    """``(entity, uri, label)``: names whose label or fragment equals the entity's normal form."""
    by_label = e.join(n, F.col("ek") == F.col("lk"))
    by_fragment = e.join(n.where(~F.col("lk").eqNullSafe(F.col("fk"))), F.col("ek") == F.col("fk"))
    return by_label.select("entity", "uri", "label").unionByName(by_fragment.select("entity", "uri", "label"))


def _best_label(rows: DataFrame) -> DataFrame:
    return rows.groupBy("entity", "uri").agg(F.max("score").alias("score"), F.max_by("label", F.struct("score", F.col("label"))).alias("label")).select("entity", "uri", "label", "score")


def token_scores(entities: DataFrame, names: DataFrame) -> DataFrame:
    """``(entity, uri, label, score)``: the token part of the score, for pairs that share a long token, and 1
    for equal names.

    Sets of tokens are scored once, however many names have them. The pairs are many: they are made where they are asked
    for, and only those of uris with several names are compared with each other.
    """
    e, n = _keyed(entities, names)
    sets = bounded_broadcast(cut(_share_tokens(n.select("lt").distinct(), cut(e.select("et").distinct(), "asked")).select("et", "lt", "score"), "token-sets"))
    near = _spread(n).join(sets, "lt").join(bounded_broadcast(e), "et")
    same = (F.col("ek") == F.col("lk")) | F.coalesce(F.col("ek") == F.col("fk"), F.lit(False))
    near = near.where(~same).select("entity", "uri", "label", "score", "of_uri")
    exact = _exact(e, n.where("of_uri = 1")).withColumn("score", F.lit(1.0))
    several = near.where("of_uri > 1").drop("of_uri").unionByName(_exact(e, n.where("of_uri > 1")).withColumn("score", F.lit(1.0)))
    return near.where("of_uri = 1").drop("of_uri").unionByName(exact).unionByName(_best_label(several))


def best_by_tokens(entities: DataFrame, names: DataFrame, top: int = 3) -> DataFrame:
    """The first ``top`` of ``token_scores`` of each entity, by score and uri, with their rank.

    Of the names with one set of tokens, which score alike, only the first ``top`` uris can be among the first of an entity,
    and of the sets only the first ``top`` by score and first uri, so the pairs of entities and names are not made. An equal
    name scores 1 wherever it stands. Uris with several names may be in several sets: they are compared by uri.
    """
    e, n = _keyed(entities, names)
    x = cut(e.select("et").distinct().withColumn("eid", F.monotonically_increasing_id()), "asked")

    def first(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("k") <= top).drop("k")

    high = F.col("score").desc()
    one = n.where("of_uri = 1 and size(lt) > 0")
    # numbered in the order of their first uris
    sets = cut(one.groupBy("lt").agg(F.min("uri").alias("head")).orderBy("head").withColumn("lid", F.monotonically_increasing_id()), "token-sets")
    taken = first(_share_tokens(_spread(sets), x).select("eid", "lid", "score"), "eid", high, "lid")
    heads = first(one.select("lt", "uri", "label"), "lt", "uri").join(sets.select("lt", "lid"), "lt").select("lid", "uri", "label")
    near = first(taken.join(heads, "lid").select("eid", "uri", "label", "score"), "eid", high, "uri")
    several = _share_tokens(n.where("of_uri > 1"), x).groupBy("eid", "uri").agg(F.max(F.struct("score", "label")).alias("m")).select("eid", "uri", "m.label", "m.score")
    near = near.unionByName(first(several, "eid", high, "uri")).join(x, "eid").join(e, "et").select("entity", "uri", "label", "score")
    rows = _best_label(near.unionByName(_exact(e, n).withColumn("score", F.lit(1.0))))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(high, "uri"))).where(F.col("rank") <= top)


def _best_of(batch: pd.DataFrame, entities: pd.DataFrame, best: list[dict], top: int, keep: float) -> None:
    """Bring ``best``, for each entity the scored ``{uri: (score, label)}``, up to date with the names of a batch.

    Names are looked at by falling upper bounds of their score and only while they could still be among the first
    ``top`` of the entity; counts of characters bound the ratio, and all token points are exact.
    """
    lk, fk, uri, label, cf = (batch[c].tolist() for c in ("lk", "fk", "uri", "label", "cf"))
    ln, fn, weight = batch["ln"].to_numpy(), batch["fn"].to_numpy(), batch["cf"].to_numpy()
    kind = np.uint16 if max(batch["ln"].max(), entities["en"].max()) < 1 << 16 else np.uint32
    chars = range(len(ALPHABET) + 1)
    have, asked = [batch[f"l{c}"].to_numpy().astype(kind) for c in chars], entities[[f"e{c}" for c in chars]].to_numpy().astype(kind)
    at: dict[str, list[int]] = {}
    equal: dict[str, set[int]] = {}
    for i, ts in enumerate(batch["lt"]):
        equal.setdefault(lk[i], set()).add(i)
        equal.setdefault(fk[i], set()).add(i)
        for t in ts:
            at.setdefault(t, []).append(i)
    rows = {t: np.array(x) for t, x in at.items()}
    match = SequenceMatcher(None)

    def ratio(x: str, y: str) -> float:
        match.set_seqs(x, y)
        return match.ratio()

    for found, ek, en, et, need in zip(best, entities["ek"], entities["en"], entities["et"], asked):
        common, shared = np.zeros(len(lk), kind), np.zeros(len(lk))
        for c in np.flatnonzero(need):
            common += np.minimum(have[c], need[c])
        tokens = set(et)
        for t in tokens & rows.keys():
            shared[rows[t]] += 1
        native = 0.15 * (shared / max(len(tokens), 1)) + 0.05 * (shared > 0)
        bound = weight * np.where(en + ln == 0, 1.0, 2.0 * common / np.maximum(en + ln, 1)) + native
        bound += np.where(weight < 0.8, 0.35 * np.where(en + fn == 0, 1.0, 2.0 * np.minimum(en, fn) / np.maximum(en + fn, 1)), 0.0)
        exact = equal.get(ek, ())
        for i in exact:
            bound[i] = 2.0
        least = heapq.nlargest(top, (x for x, _ in found.values()))[-1] if len(found) >= top else keep
        near = np.flatnonzero(bound >= least - 1e-9)
        for i in near[np.argsort(-bound[near], kind="stable")].tolist():
            if bound[i] < least - 1e-9:
                break
            if i in exact:
                score = 1.0
            else:
                r1 = ratio(ek, lk[i])
                score = 0.45 * r1 + 0.35 * (r1 if lk[i] == fk[i] else ratio(ek, fk[i])) + native[i]
            if score >= keep and (uri[i] not in found or found[uri[i]] < (score, label[i])):
                found[uri[i]] = (float(score), label[i])
                least = heapq.nlargest(top, (x for x, _ in found.values()))[-1] if len(found) >= top else keep
        if len(found) > top:  # ties go by uri
            kept = sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:top]
            found.clear()
            found.update(kept)


def candidates(entities: DataFrame, names: DataFrame, top: int = 10, keep: float = KEEP) -> DataFrame:
    """``(entity, uri, label, score, rank)``: the best names for each entity text.

    Score: 1 for equal normal forms of the label or the fragment; else 0.45 of the matching-block ratio to
    the label, 0.35 of that to the fragment, 0.15 of the share of the entity's tokens among the label's long
    tokens, 0.05 if any is. The entities are a stated query set: they are sent to all tasks in blocks of bounded
    size and compared with every name. Each task keeps the first ``top`` uris of each entity, and upper bounds of the
    score leave only names that could still be among them to the ratio. Ties go by uri.
    """
    e = entities.select("entity").where("entity is not null").distinct().withColumn("ek", entity_key("entity"))
    e = cut(e.select("entity", "ek", F.length("ek").alias("en"), letter_tokens(F.col("ek")).alias("et"), *counted("ek", "e")), "query-entities")
    n = names.select("uri", "label", entity_key("label").alias("lk"), entity_key("fragment").alias("fk"))
    n, rows = cut_counted(n.select("*", F.length("lk").alias("ln"), F.length("fk").alias("fn"), F.when(F.col("lk") == F.col("fk"), 0.8).otherwise(0.45).alias("cf"), long_tokens(F.col("lk")).alias("lt"), *counted("lk", "l")), "names")
    n = n.repartition(max(n.sparkSession.sparkContext.defaultParallelism, rows // 100_000))  # few bytes, much work

    def first(block: DataFrame) -> DataFrame:
        asked = n.sparkSession.sparkContext.broadcast(block.toPandas())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            es = asked.value
            best: list[dict] = [{} for _ in range(len(es))]
            for batch in batches:
                if len(batch) and len(es):
                    _best_of(batch, es, best, top, keep)
            out = [(x, u, l, s) for x, found in zip(es["entity"], best) for u, (s, l) in found.items()]
            yield pd.DataFrame(out, columns=["entity", "uri", "label", "score"])

        return n.mapInPandas(run, "entity string, uri string, label string, score double")

    scored = reduce(DataFrame.unionByName, [first(b) for b in broadcast_blocks(e)])
    best = scored.groupBy("entity", "uri").agg(F.max(F.struct("score", "label")).alias("m")).select("entity", "uri", "m.label", "m.score")
    rank = F.row_number().over(W.partitionBy("entity").orderBy(F.col("score").desc(), "uri"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


def enrich(cands: DataFrame, t: DataFrame, compat: bool = False) -> DataFrame:
    """Candidates with entity type, types, superclasses, object and data properties and annotations.

    Properties are maps from decoded name to sorted values. With ``compat`` the three maps stay empty, as in
    recorded logs.
    """
    uris = cands.select("uri").distinct()
    own = t.join(uris, t["s"] == uris["uri"], "left_semi")
    kind = t.where((F.col("p") == RDF_TYPE) & F.col("o").isin(OBJECT_PROPERTY, DATA_PROPERTY)).groupBy(F.col("s").alias("p")).agg(F.max(F.col("o") == OBJECT_PROPERTY).alias("is_obj"), F.max(F.col("o") == DATA_PROPERTY).alias("is_data"))
    name, typ = readable(F.col("o")), F.col("p") == RDF_TYPE
    head = own.groupBy(F.col("s").alias("uri")).agg(
        F.when(F.max(typ & (F.col("o") == CLASS)), "Class").when(F.max(typ & (F.col("o") == INDIVIDUAL)), "NamedIndividual").alias("entity_type"),
        F.array_sort(F.collect_set(F.when(typ & ~F.col("o").isin(CLASS, INDIVIDUAL), name))).alias("types"),
        F.array_sort(F.collect_set(F.when(F.col("p") == SUBCLASS, name))).alias("superclasses"))
    out = cands.join(head, "uri", "left")
    none = F.create_map().cast("map<string,array<string>>")
    for col, rows in (
        ("object_properties", own.join(kind.where("is_obj"), "p")), ("data_properties", own.join(kind.where("is_data"), "p")), ("annotations", own.where(F.col("p").isin(LABEL, COMMENT))),
    ):
        if compat:
            out = out.withColumn(col, none)
            continue
        value = name if col == "object_properties" else F.col("o")
        m = rows.groupBy(F.col("s").alias("uri"), readable(F.col("p")).alias("pn")).agg(F.array_sort(F.collect_set(value)).alias("v"))
        m = m.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pn", "v")))).alias(col))
        out = out.join(m, "uri", "left").withColumn(col, F.coalesce(col, none))
    return out


def choose(cands: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """``(entity, uri, label, score, status)``: a lone or perfect first candidate is taken; of several, the one
    that ``decisions(entity, selected_label)`` names, else, and for 'unknown', none. Without decisions the
    first is taken. Entities without candidates do not occur here; see ``resolve``."""
    c = cands.where("rank <= 3")
    n = c.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    rows = c.join(n, "entity")
    sure = (F.col("n") == 1) | (F.col("best") == 1.0)
    if decisions is None:
        return rows.where("rank = 1").select("entity", "uri", "label", "score", F.when(sure, "sure").otherwise("first of several").alias("status"))
    d = decisions.select("entity", "selected_label").dropDuplicates(["entity"])
    rows = rows.join(d, "entity", "left").withColumn("sure", sure)
    taken = rows.where((F.col("sure") & (F.col("rank") == 1)) | (~F.col("sure") & (F.col("label") == F.col("selected_label"))))
    return taken.groupBy("entity").agg(F.min_by(F.struct("uri", "label", "score", F.when(F.col("sure"), "sure").otherwise("chosen").alias("status")), "rank").alias("x")).select("entity", "x.*")


def resolve(entities: DataFrame, names: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Every entity with its resolution; ``status`` is 'no entity', 'no candidates' or 'unresolved' if it has none."""
    e = entities.select("entity").distinct()
    c = cut(candidates(e, names, top=3), "candidates")
    got = choose(c, decisions)
    has = c.select("entity").distinct().withColumn("_has", F.lit(True))
    out = e.join(has, "entity", "left").join(got, "entity", "left")
    status = F.when(F.col("entity").isNull() | (F.trim("entity") == ""), "no entity").when(F.col("_has").isNull(), "no candidates").when(F.col("uri").isNull(), "unresolved").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_has")


# ------------------------------------------------------------------ context

@dataclass
class Graph:
    """A graph with what every context needs of it, computed once: names of entities, closure of the class graph, direct
    types, and sets of individuals that are the same."""

    triples: DataFrame
    names: DataFrame
    above: DataFrame
    direct: DataFrame
    same: DataFrame


def prepared(t: DataFrame) -> Graph:
    above = cut(subclass_closure(t), "closure")
    return Graph(t, cut(entity_labels(t), "labels"), above, cut(direct_types(t, above=above), "direct-types"), cut(same_as_sets(t), "same-as"))


def twins_of(t: DataFrame, entities: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """``(uri, twin)``: each entity with itself and all that is the same as it."""
    same = cut(same_as_sets(t), "same-as") if same is None else same
    e = entities.select("uri").distinct()
    group = e.join(same.select(F.col("node").alias("uri"), "component"), "uri")
    more = group.join(same.select(F.col("node").alias("twin"), "component"), "component").select("uri", "twin")
    return cut(more.unionByName(e.select("uri", F.col("uri").alias("twin"))).distinct(), "twins")


def applicable(t: DataFrame, entities: DataFrame, twins: DataFrame | None = None, sup: DataFrame | None = None, dt: DataFrame | None = None) -> DataFrame:
    """``(uri, type, direction, property, other, other_kind, dtype)``: statements about each entity and those the
    same as it, under every direct type that lies at or below a domain of the property.

    A property without a domain applies to no type. ``direction`` is out_object, out_data or in_object. Twins,
    class closure and direct types are computed unless they are at hand.
    """
    e = entities.select("uri").distinct()
    alias = twins_of(t, e) if twins is None else twins
    sup = cut(subclass_closure(t), "closure") if sup is None else sup
    dt = direct_types(t, above=sup).join(e, F.col("s") == F.col("uri")).select("uri", F.col("o").alias("type")) if dt is None else dt
    sup = sup.select(F.col("src").alias("type"), F.col("dst").alias("dom"))
    dom = t.where(F.col("p") == DOMAIN).select(F.col("s").alias("property"), F.col("o").alias("dom")).distinct()
    own = dt.select("type").distinct()
    fits = own.join(sup, "type").unionByName(own.select("type", F.col("type").alias("dom"))).distinct().join(dom, "dom").select("type", "property").distinct()
    out = alias.join(t, F.col("twin") == F.col("s")).select("uri", F.when(F.col("o_kind") == "iri", "out_object").otherwise("out_data").alias("direction"), F.col("p").alias("property"), F.col("o").alias("other"), F.col("o_dtype").alias("dtype"))
    inc = alias.join(t.where("o_kind = 'iri'"), F.col("twin") == F.col("o")).select("uri", F.lit("in_object").alias("direction"), F.col("p").alias("property"), F.col("s").alias("other"), F.lit(None).cast("string").alias("dtype"))
    return out.unionByName(inc).distinct().join(dt, "uri").join(fits, ["type", "property"]).select("uri", "type", "direction", "property", "other", "dtype")


def property_descriptions(t: DataFrame, about: DataFrame) -> DataFrame:
    """``(uri, p, description, domain, range)``: the object properties that ``about(uri, p)`` speaks of, decoded sorted
    names. The lists grow with the classes and are the same for all nodes, so they join last and are not shuffled with them."""
    none = F.array().cast("array<string>")
    obj = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == OBJECT_PROPERTY)).select(F.col("s").alias("p")).distinct()
    com = t.where(F.col("p") == COMMENT).groupBy(F.col("s").alias("p")).agg(F.min("o").alias("description"))
    ends = lambda schema, c: t.where(F.col("p") == schema).groupBy(F.col("s").alias("p")).agg(F.array_sort(F.collect_set(readable(F.col("o")))).alias(c))
    d = obj.join(com, "p", "left").join(ends(DOMAIN, "domain"), "p", "left").join(ends(RANGE, "range"), "p", "left")
    d = cut(d.select("p", "description", F.coalesce("domain", none).alias("domain"), F.coalesce("range", none).alias("range")), "properties")
    d = bounded_broadcast(d)
    return about.join(d.select("p"), "p", "left_semi").select("uri", "p").distinct().join(d, "p").select("uri", "p", "description", "domain", "range")


def context(t: DataFrame, entities: DataFrame, scope: str = "entity", graph: Graph | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row per entity with the twelve fields of its context; decoded names, sorted. ``graph`` is ``prepared(t)`` if it is
    at hand, as for a stream of questions on one graph. With ``fields`` only these are made, and only what they need is joined.

    ``properties_by_type`` maps a direct type to arrays of structs for outgoing object and data and incoming
    object properties.
    """
    e = entities.select("uri").distinct()
    want = lambda *names: fields is None or bool(set(names) & set(fields))
    parts: list[DataFrame] = []
    name = readable(F.col("o"))
    none = F.array().cast("array<string>")
    is_class = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == CLASS)).select(F.col("s").alias("uri")).distinct()
    by_twins = want("equivalent_classes", "chunk_id", "annotations", "class_descriptions", "object_property_descriptions")
    twins = twins_of(t, e, graph.same if graph else None) if by_twins or want("properties_by_type") else None
    if by_twins:
        about = cut(twins.join(t, F.col("twin") == F.col("s")).select("uri", "twin", "p", "o", "o_kind", "o_dtype"), "about")
    if want("types", "superclasses", "properties_by_type"):
        sup = graph.above if graph else cut(subclass_closure(t), "closure")
        dt = cut((graph.direct if graph else direct_types(t, above=sup)).join(e, F.col("s") == F.col("uri")).select("uri", F.col("o").alias("type")), "direct-types")
    if want("types"):
        parts.append(dt.groupBy("uri").agg(F.array_sort(F.collect_set(readable(F.col("type")))).alias("types")))
    if want("superclasses"):
        above = dt.join(sup, F.col("type") == F.col("src")).groupBy("uri", readable(F.col("type")).alias("k")).agg(F.array_sort(F.collect_set(readable(F.col("dst")))).alias("v"))
        direct = t.where(F.col("p") == SUBCLASS).join(e.join(is_class, "uri", "left_semi"), F.col("s") == F.col("uri")).groupBy("uri", readable(F.col("uri")).alias("k")).agg(F.array_sort(F.collect_set(name)).alias("v"))
        supers = above.join(direct.select("uri", "k"), ["uri", "k"], "left_anti").unionByName(direct).groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("superclasses"))
        parts.append(supers)
    if want("equivalent_classes", "chunk_id"):
        simple = about.groupBy("uri").agg(
            F.array_sort(F.collect_set(F.when(F.col("p") == EQUIVALENT, name))).alias("equivalent_classes"),
            F.array_sort(F.collect_set(F.when(F.col("p") == EX + "chunk_id", F.col("o")))).alias("chunk_id"))
        parts.append(simple)
    if want("annotations"):
        ann_props = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == ANNOTATION_PROPERTY)).select(F.col("s").alias("p")).distinct()
        ann = about.where(F.col("p").isin(LABEL, COMMENT)).unionByName(about.where(~F.col("p").isin(LABEL, COMMENT)).join(ann_props, "p", "left_semi").select(*about.columns))
        ann = ann.groupBy("uri", readable(F.col("p")).alias("k")).agg(F.max_by("o", F.struct("twin", "o")).alias("v")).groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("annotations"))
        parts.append(ann)
    com = t.where(F.col("p") == COMMENT).groupBy(F.col("s").alias("x")).agg(F.min("o").alias("c"))
    if want("class_descriptions"):
        desc = about.where(F.col("p") == RDF_TYPE).select("uri", F.col("o").alias("x")).distinct().join(com, "x", "left").groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(readable(F.col("x")).alias("k"), F.col("c").alias("v"))))).alias("class_descriptions"))
        parts.append(desc)
    if want("object_property_descriptions"):
        pd_ = property_descriptions(t, about)
        pd_ = pd_.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(readable(F.col("p")).alias("k"), F.struct("description", "domain", "range").alias("v"))))).alias("object_property_descriptions"))
        parts.append(pd_)
    if want("properties_by_type"):
        app = applicable(t, e, twins, sup, dt)
        side = lambda d, other: F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.struct(readable(F.col("property")).alias("property"), other))))
        props = app.groupBy("uri", readable(F.col("type")).alias("k")).agg(F.struct(
            side("out_object", readable(F.col("other")).alias("object")).alias("outgoing_object_properties"),
            F.array_sort(F.collect_set(F.when(F.col("direction") == "out_data", F.struct(readable(F.col("property")).alias("property"), F.col("other").alias("value"), F.col("dtype").alias("datatype"))))).alias("outgoing_data_properties"),
            side("in_object", readable(F.col("other")).alias("subject")).alias("incoming_object_properties")).alias("v"))
        props = props.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties_by_type"))
        parts.append(props)
    if want("members"):
        members = t.where(F.col("p") == RDF_TYPE).join(e.join(is_class, "uri", "left_semi"), F.col("o") == F.col("uri")).groupBy("uri").agg(F.array_sort(F.collect_set(readable(F.col("s")))).alias("members"))
        parts.append(members)
    note = F.lit(f"All facts here are about the resolved {scope} of the question.")
    out = labels(t, e, "uri").withColumn("scope_note", note)
    out = reduce(lambda a, b: a.join(b, "uri", "left"), parts, out)
    for c in {"types", "equivalent_classes", "chunk_id", "members"} & set(out.columns):
        out = out.withColumn(c, F.coalesce(c, none))
    return out if fields is None else out.select("uri", "label", "scope_note", *fields)


def readable_values(x: Column, iris_only: bool = True) -> Column:
    """Decoded fragments of an array of texts. Literals stay as they are unless ``iris_only`` is off, which
    treats every text like an IRI, as recorded logs do."""
    if not iris_only:
        return F.transform(x, readable)
    return F.transform(x, lambda v: F.when(F.regexp_like(v, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*#")), readable(v)).otherwise(v))


def _cleaned(x: object, iris_only: bool) -> object:
    if isinstance(x, dict):
        return {_cleaned(k, iris_only): _cleaned(v, iris_only) for k, v in x.items()}
    if isinstance(x, list):
        return [_cleaned(v, iris_only) for v in x]
    if isinstance(x, str) and (not iris_only or _IRI.match(x)):
        return unquote(x.rsplit("#", 1)[-1])
    return x


_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:\S*#")


def readable_json(x: Column, iris_only: bool = True) -> Column:
    """A nested context as JSON with all texts, keys included, as by ``readable_values``; null if it is no JSON."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(_cleaned(json.loads(t), iris_only), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one)

    return run(x)


#: The fields whose sizes ``context_counts`` gives.
COUNTED = ("types", "superclasses", "equivalent_classes", "properties_by_type", "chunk_id", "members")


def context_counts(ctx: DataFrame) -> DataFrame:
    """Sizes of the fields of each context."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    return ctx.select("uri", "label", *[n(c) for c in COUNTED])
