"""Encoding and decoding of a corpus with a public tokenizer through a table of distinct words."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import bounded_broadcast, cut, cut_counted

#: Splits a text before the merges of the byte-level vocabularies (fixed values, public pattern).
#: Alternatives in order: contractions, letters, numbers, other signs, white space.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: At most so many words, the most frequent ones, stand in the table that every task holds, and none of them is
#: longer than so many bytes: at most 200,000 x (48 + 4 x 48 bytes) = 48 MB.
NEAR_WORDS, NEAR_BYTES = 200_000, 48


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _split(text: Column) -> Column:
    """The words of a text in order; an empty list for empty and null texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def documents_once(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, copy)``: rows that repeat a key and its text once. ``copy`` is a hash of the text.

    Only keys and hashes are counted over the whole corpus; texts move only where a key has copies.
    """
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(text)).alias("copy"))
    twice = rows.groupBy(F.col(key).alias("_k"), F.col("copy").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", "_c")
    twice, n = cut_counted(twice, "copies")
    if not n:
        return rows
    same = rows[key].eqNullSafe(F.col("_k")) & (rows["copy"] == F.col("_c"))
    once = rows.join(bounded_broadcast(twice), same, "left_anti")
    return once.unionByName(rows.join(bounded_broadcast(twice), same, "left_semi").dropDuplicates([key, "copy"]))


def word_table(docs: DataFrame, text: str, file: str) -> DataFrame:
    """``(word, n, ids)``: each distinct word of the texts, how often it occurs, and its ids; encoded once.

    ``file`` is read by each Python worker, as JSON of the tokenizers library.
    """
    content = Path(file).read_text(encoding="utf-8")  # of fixed size, travels with the tasks
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shared.value)
        tok.encode_special_tokens = True
        for batch in batches:
            found = tok.encode_batch(batch["word"].tolist(), add_special_tokens=False)
            yield batch.assign(ids=[e.ids for e in found])

    counts = docs.select(F.explode(_split(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return cut(counts.mapInPandas(run, "word string, n bigint, ids array<int>"), "words")


@dataclass
class Words:
    """The table of distinct words in two parts: ``near``, Arrow bytes of the frequent and short ones, which every
    task holds, and ``far``, the rows of all others; null if there are none."""

    near: Broadcast[bytes]
    far: DataFrame | None


def halves(table: DataFrame, limit: int = NEAR_WORDS) -> Words:
    """The most frequent words, at most ``limit`` of them, are near unless they are long; all others are far.

    Frequencies are looked at in eighths of a power of two, so the driver sees a few hundred counts at most.
    """
    step = F.floor(F.log2("n") * 8)
    left, least = limit, None
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        left -= r["words"]
        if left < 0:
            break
        least = r["step"]
    near = F.lit(False) if least is None else (step >= least) & (F.octet_length("word") <= NEAR_BYTES)
    far, n = cut_counted(table.where(~near), "far-words")
    held = table.where(near).select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    return Words(table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), far if n else None)


_GAPS = pa.list_(pa.struct([("no", pa.int32()), ("at", pa.int32()), ("word", pa.string())]))


def join_near(docs: DataFrame, key: str, text: str, words: Words, with_ids: bool = True) -> DataFrame:
    """``(key, copy, size, ids, gaps)``: the words of each text, by position, with the ids of the near table.

    The join is one hash lookup of a whole Arrow batch of words, so positions need no rows of their own.
    ``gaps`` holds the words that are not near, numbered, with the place in ``ids`` where theirs belong.
    """
    kind, shared = docs.schema[key].dataType.simpleString(), words.near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        known, ids = (table[c].chunk(0) if len(table) else pa.array([], table.schema.field(c).type) for c in ("word", "ids"))
        lengths = np.append(pc.list_value_length(ids).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        for batch in batches:
            lists = batch["w"]
            flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            at = pc.index_in(flat, value_set=known)
            ends = np.concatenate([[0], np.cumsum(lengths[pc.fill_null(at, len(known)).to_numpy(zero_copy_only=False)])])
            first = ends[starts]
            gap = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            row = np.searchsorted(starts, gap, side="right") - 1
            cuts = np.searchsorted(gap, starts)
            missing = pa.StructArray.from_arrays([
                pa.array((np.arange(len(gap)) - cuts[row]).astype(np.int32)), pa.array((ends[gap] - first[row]).astype(np.int32)), flat.take(pa.array(gap))], fields=list(_GAPS.value_type))
            out = [batch["k"], batch["copy"], pa.array(np.diff(first))]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), ids.take(at).flatten()))
            out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), missing))
            yield pa.RecordBatch.from_arrays(out, names=["k", "copy", "size", *["ids"][: int(with_ids)], "gaps"])

    layout = f"k {kind}, copy bigint, size bigint, {'ids array<int>, ' if with_ids else ''}gaps array<struct<no:int,at:int,word:string>>"
    return docs.select(F.col(key).alias("k"), "copy", _split(F.col(text)).alias("w")).mapInArrow(run, layout)


def encode(docs: DataFrame, key: str, text: str, file: str | None = None, limit: int = NEAR_WORDS) -> DataFrame:
    """``(key, ids)`` for every document, without special tokens; their strings are ordinary text.

    Each distinct word is encoded once and its ids are joined back by position: near words where the text
    stands, so texts and ids are not shuffled; the others, which are rare or long, by a shuffled join whose
    results fill the gaps. An empty text and a null text both give an empty list. Rows that repeat a key with
    the same text give one row, those with another text one more row. A null key is a key like any other.
    """
    words = halves(word_table(docs, text, file or tokenizer_file()), limit)
    rows = join_near(documents_once(docs, key, text), key, text, words)
    if words.far is None:
        return rows.select(F.col("k").alias(key), "ids")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "near-ids")
    gaps = rows.where("size(gaps) > 0").select("row", F.inline("gaps")).join(words.far.select("word", F.col("ids").alias("more")), "word", "left")
    gaps = gaps.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "at", "more"))).alias("fill"))
    part = lambda lo, hi: F.slice("ids", lo + 1, F.greatest(hi - lo, F.lit(0)))
    before = lambda i: F.when(i > 0, F.get("fill", i - 1)["at"]).otherwise(F.lit(0))
    filled = F.flatten(F.transform("fill", lambda g, i: F.concat(part(before(i), g["at"]), g["more"])))
    whole = F.concat(filled, part(F.element_at("fill", -1)["at"], F.size("ids")))
    return rows.join(gaps, "row", "left").select(F.col("k").alias(key), F.when(F.col("fill").isNull(), F.col("ids")).otherwise(whole).alias("ids"))


def token_counts(docs: DataFrame, key: str, text: str, file: str | None = None, limit: int = NEAR_WORDS) -> DataFrame:
    """``(key, tokens)`` for every document: the lengths are joined, not the ids."""
    words = halves(word_table(docs, text, file or tokenizer_file()), limit)
    rows = join_near(documents_once(docs, key, text), key, text, words, with_ids=False)
    if words.far is None:
        return rows.select(F.col("k").alias(key), F.col("size").alias("tokens"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "near-sizes")
    gaps = rows.where("size(gaps) > 0").select("row", F.inline("gaps")).join(words.far.select("word", F.size("ids").alias("more")), "word", "left")
    gaps = gaps.groupBy("row").agg(F.sum("more").alias("more"))
    return rows.join(gaps, "row", "left").select(F.col("k").alias(key), (F.col("size") + F.coalesce("more", F.lit(0))).alias("tokens"))


def pieces(spark: SparkSession, file: str | None = None) -> DataFrame:
    """The vocabulary as ``(id, piece BINARY)``; it has a fixed, small number of rows."""
    model = json.loads(Path(file or tokenizer_file()).read_text(encoding="utf-8"))["model"]
    # byte-level vocabularies write a byte as a printable character: its own if printable, else 256 + n
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    rows = [(i, bytearray(back[c] for c in p)) for p, i in model["vocab"].items() if all(c in back for c in p)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, key: str, ids: str, file: str | None = None) -> DataFrame:
    """``(key, text)``: ids joined to their pieces and put together. An empty or null list gives ''."""
    flat = encoded.select(key, F.xxhash64(F.col(ids)).alias("copy"), F.posexplode_outer(ids).alias("pos", "id"))
    joined = flat.join(F.broadcast(pieces(encoded.sparkSession, file)), "id", "left")
    at = F.when(F.col("id").isNotNull(), F.struct("pos", F.hex("piece").alias("h")))
    lists = joined.groupBy(key, "copy").agg(F.array_sort(F.collect_set(at)).alias("w"))
    return lists.select(key, F.decode(F.unhex(F.array_join(F.transform("w", lambda x: x["h"]), "")), "UTF-8").alias("text"))


def rank_file_tokens(file: str) -> dict[bytes, int]:
    """A rank file as a dictionary, for checks against another library."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(file).read_bytes().splitlines())}
