"""String similarity: matching-block ratio in Arrow batches, and native bounds that spare most of it."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import letter_tokens


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio 2M/T of a to b; not symmetric; null if either is null."""
    memo: dict[tuple[str, str], float] = {}
    match, second = SequenceMatcher(None), None  # what it prepares of the second text serves all rows in a row
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in memo:
            if y != second:
                match.set_seq2(y)
                second = y
            match.set_seq1(x)
            memo[x, y] = match.ratio()
        out.append(memo[x, y])
    return pd.Series(out, dtype="float64")


#: Characters that are counted one by one; all others are counted together.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 _-"


def counted(text: str, prefix: str) -> list[Column]:
    """Columns with the counts of each character of ``ALPHABET`` and of all others in a text column."""
    one = [F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in ALPHABET]
    rest = F.length(F.translate(text, ALPHABET, ""))
    return [c.cast("int").alias(f"{prefix}{i}") for i, c in enumerate([*one, rest])]


def length_bound(la: Column, lb: Column) -> Column:
    """An upper bound of the ratio from lengths: twice the shorter over both; 1 for two empty texts."""
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))


def count_bound(a: str, b: str, la: Column, lb: Column) -> Column:
    """An upper bound of the ratio from the columns that ``counted`` made on both sides: plain integer
    arithmetic, so a join condition with it compiles to straight code."""
    common = F.lit(0)
    for i in range(len(ALPHABET) + 1):
        common = common + F.least(f"{a}{i}", f"{b}{i}")
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * common / (la + lb))


def long_tokens(key: Column) -> Column:
    return F.filter(F.array_distinct(letter_tokens(key)), lambda t: F.length(t) >= 4)


def overlap_share(entity_tokens: Column, label_tokens: Column) -> Column:
    """Share of the entity's distinct tokens that the label has."""
    e = F.array_distinct(entity_tokens)
    return F.size(F.array_intersect(e, label_tokens)) / F.greatest(F.size(e), F.lit(1))


def fuzzy_score(a: Column, b: Column) -> Column:
    """0.80 of the matching-block ratio, 0.15 of the share of a's tokens that b has, 0.05 if there is one; of the
    lower-cased, trimmed texts. Two nulls score 1, a null and a text 0."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    share = overlap_share(letter_tokens(x), letter_tokens(y))
    score = 0.80 * match_ratio(x, y) + 0.15 * share + 0.05 * F.when(share > 0, 1.0).otherwise(0.0)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(score)


def fuzzy_match(a: Column, b: Column, least: float = 0.45) -> Column:
    return fuzzy_score(a, b) >= least
