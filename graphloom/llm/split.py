"""Oversized texts into overlapping pieces, cut at natural boundaries near rolling-hash landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "key string, piece_no int, n_pieces int, n_tokens int, overlap int, start_char int, end_char int, boundary string, text string"
LEVELS = ("word", "sentence", "line", "paragraph")

#: Runs of characters other than those with the Unicode property White_Space (fixed values).
_TOKEN = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SENTENCE_END = regex.compile(r"[.!?。！？…][\p{Pe}\p{Pf}\"'*_]*$")
_BREAK = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")


def boundary_levels(text: str, tokens: list[str], ends: np.ndarray) -> np.ndarray:
    """The kind of boundary after each token: 3 blank line, 2 line end, 1 sentence end, 0 between words and after
    the last one. ``ends`` are the tokens' ends in the text."""
    out = np.zeros(len(tokens), dtype=np.int8)
    for i, t in enumerate(tokens):
        if not t[-1].isalnum() and _SENTENCE_END.search(t):
            out[i] = 1
    at = np.fromiter((m.start() for m in _BREAK.finditer(text)), dtype=np.int64)
    breaks = np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(tokens) + 1)[1 : len(tokens) + 1]
    out[breaks == 1], out[breaks > 1] = 2, 3
    out[-1:] = 0
    return out


@lru_cache(maxsize=100_000)
def _hash(token: str) -> int:
    return crc32(token.encode())


def rolling_hashes(tokens: list[str], window: int) -> np.ndarray:
    """Polynomial hash of the ``window`` tokens that end at each token."""
    h = np.fromiter(map(_hash, tokens), dtype=np.uint64, count=len(tokens))
    out = np.zeros(len(tokens), dtype=np.uint64)
    factor = np.uint64(1)
    for back in range(min(window, len(tokens))):
        out[back:] += h[: len(tokens) - back] * factor
        factor = np.uint64((int(factor) * 0x9E3779B97F4A7C15) % 2**64)
    return out ^ (out >> np.uint64(29))


def cut_points(levels: np.ndarray, hashes: np.ndarray, first: int, rest: int, min_part: float) -> list[int]:
    """Token numbers after which the text is cut, without its end.

    In each piece the landmark is the smallest hash between the minimum and the maximum size. The cut is
    the boundary nearest to the landmark among those of the highest kind there; if the span holds none,
    any natural boundary before the minimum; else the landmark itself.
    """
    cuts, start, n = [], 0, len(levels)
    while n - start > (first if not cuts else rest):
        most = first if not cuts else rest
        least = max(1, int(most * min_part))
        lo, hi = start + least - 1, start + most - 1
        mark = hi - int(np.argmin(hashes[lo : hi + 1][::-1]))  # the last one of ties
        best = int(levels[lo : hi + 1].max())
        if best:
            at = lo + np.flatnonzero(levels[lo : hi + 1] == best)
            mark = int(at[np.argmin(np.abs(at - mark))])
        elif lo > start and levels[start:lo].max() > 0:
            top = levels[start:lo].max()
            mark = start + int(np.flatnonzero(levels[start:lo] == top)[-1])
        cuts.append(mark)
        start = mark + 1
    return cuts


def split_text(text: str, max_tokens: int | None, overlap: int | None, window: int = 8, min_part: float = 0.25) -> list[tuple]:
    """Pieces ``(piece_no, n_pieces, n_tokens, overlap, start_char, end_char, boundary, text)``.

    Tokens are runs of characters other than Unicode white space. A null limit or a text within it: one
    piece. A limit below 1 counts as 1; an overlap is at most the limit less one.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if max_tokens is None or n <= max(1, max_tokens):
        return [(0, 1, n, 0, 0, len(text), "end", text)]
    limit = max(1, max_tokens)
    shared = min(max(0, overlap or 0), limit - 1)
    words = [text[a:b] for a, b in spans]
    levels = boundary_levels(text, words, np.array([b for _, b in spans]))
    hashes = rolling_hashes(words, window)
    cuts = cut_points(levels, hashes, limit, limit - shared, min_part)
    out, start = [], 0
    for no, end in enumerate([*cuts, n - 1]):
        head = min(shared, start)
        a = spans[start - head][0] if no else 0
        b = spans[end][1] if end < n - 1 else len(text)
        out.append((no, len(cuts) + 1, end - start + 1 + head, head, a, b, LEVELS[levels[end]] if end < n - 1 else "end", text[a:b]))
        start = end + 1
    return out


def split_texts(df: DataFrame, key: str, text: str, max_tokens: str, overlap: str, with_text: bool = True) -> DataFrame:
    """Every text of ``df`` in pieces, see ``split_text``; limits stand in columns of each row.

    Null texts count as ''; without ``with_text`` the pieces' texts are null. Pieces depend on their own row only,
    so nothing is shuffled here.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for k, t, m, o in zip(batch["key"], batch["text"], batch["m"], batch["o"]):
                rows.extend((k, *piece[:-1], piece[-1] if with_text else None) for piece in split_text(t, None if pd.isna(m) else int(m), None if pd.isna(o) else int(o)))
            yield pd.DataFrame(rows, columns=names)

    cols = [F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(max_tokens).cast("int").alias("m"), F.col(overlap).cast("int").alias("o")]
    return df.select(*cols).mapInPandas(run, PIECES).withColumnRenamed("key", key)
