"""Texts that look the same into one form.

After compatibility normalization and deletion of ignorable characters, every token is a lattice: each
letter may stand for its look-alikes in the Latin, Cyrillic, Greek, Armenian and Cherokee scripts. A Viterbi search finds
the most likely reading under character bigrams of each script, counted over the whole corpus, with a
penalty for a change of script within the token. The lattice and the text's script, which is told by
letters without look-alikes, are the same for texts that look the same, and a reading holds one letter
of each class, so two texts get the same form if and only if their lattices are the same.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut

#: Letters that look the same: Latin, Cyrillic, Greek, Armenian, Cherokee; '-' where a script has none (fixed
#: values, from the published Unicode table of confusable characters).
CLASSES = """
A А Α - Ꭺ|B В Β - Ᏼ|C С Ϲ - Ꮯ|D - - - Ꭰ|E Е Ε - Ꭼ|G Ԍ - - Ꮐ|H Н Η - Ꮋ|I І Ι - -|J Ј Ϳ - Ꭻ|K К Κ - Ꮶ|L - - - Ꮮ|M М Μ - Ꮇ
N - Ν - -|O О Ο Օ -|P Р Ρ - Ꮲ|Q Ԛ - - -|R - - - Ꭱ|S Ѕ - Տ Ꮪ|T Т Τ - Ꭲ|V - - - Ꮩ|W Ԝ - - Ꮃ|X Х Χ - -|Y Ү Υ - -|Z - Ζ - Ꮓ
a а - - -|c с ϲ - -|d ԁ - - -|e е - - -|g - - ց -|h һ - հ -|i і - - -|j ј ϳ յ -|l ӏ - - -|n - - ո -|o о ο օ -|p р - - -
q ԛ - զ -|s ѕ - - -|u - - ս -|v ѵ ν - -|w ԝ - - -|x х - - -|y у - - -
- Г Γ - -|- П Π - -|- Ф Φ - -
"""
SCRIPTS = ("latin", "cyrillic", "greek", "armenian", "cherokee")
#: Hyphens that look like the plain one.
HYPHENS = "\u2010\u2011"
#: Compatibility mappings of these kinds look like their plain text; super- and subscripts, circled
#: signs, fractions and the like do not.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")

_IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}--[\p{Prepended_Concatenation_Mark}]]", flags=regex.V1)
_BLANK = regex.compile(r"\p{Zs}")
_TOKEN = regex.compile(r"([\p{L}\p{M}]+)")
_ASCII_TOKEN = re.compile(r"([A-Za-z]+)")
SWITCH = -12.0
CONTEXT = 4.0
#: Code points from here on belong to none of the scripts.
_END = 0x2000


def lattice_table() -> tuple[dict[str, str], dict[str, tuple[str | None, ...]]]:
    """Letter to the representative of its class, and representative to its letters by script."""
    rep: dict[str, str] = {}
    letters: dict[str, tuple[str | None, ...]] = {}
    for row in CLASSES.replace("\n", "|").split("|"):
        cells = tuple(None if c == "-" else c for c in row.split())
        if cells:
            head = next(c for c in cells if c)
            letters[head] = cells
            rep |= {c: head for c in cells if c}
    return rep, letters


REP, LETTERS = lattice_table()


def _plain(c: str) -> str:
    kind = unicodedata.decomposition(c).split(" ", 1)[0]
    return unicodedata.normalize("NFKD", c) if kind in SAME_LOOK else c


class _Looks(dict):
    """Code point to what a reader sees of it: nothing for ignorable ones, a blank for blanks, plain letters for
    compatibility forms, the representative for letters with look-alikes. Each is worked out once."""

    def __missing__(self, n: int) -> str:
        out = ""
        for c in "".join(map(_plain, unicodedata.normalize("NFD", chr(n)))):
            if not _IGNORABLE.match(c):
                out += " " if _BLANK.match(c) else "-" if c in HYPHENS else REP.get(c, c)
        self[n] = out = "" if _IGNORABLE.match(chr(n)) else out
        return out


_LOOKS = _Looks()


def lattice_text(text: str) -> str:
    """The text with each letter class at its representative: what a reader sees."""
    return text if text.isascii() else unicodedata.normalize("NFD", text.translate(_LOOKS))


def script_of(c: str) -> int:
    """The letter's place in ``SCRIPTS``, -1 for other characters."""
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return 0 if c.isalpha() else -1
    for k, spans in enumerate((((0x400, 0x530),), ((0x370, 0x400), (0x1F00, 0x2000)), ((0x530, 0x590),), ((0x13A0, 0x1400),)), 1):
        if any(a <= n < b for a, b in spans):
            return k
    return -1


#: Script of each code point, and the same without the letters that have look-alikes.
_KIND = np.array([script_of(chr(n)) for n in range(_END)] + [-1], dtype=np.int8)
_OWN = np.where([chr(n) in LETTERS for n in range(_END)] + [True], -1, _KIND)


def _codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _END)


def context_of(lattice: str) -> int:
    """The script with the most letters that no other script has; the earlier one of ties."""
    if lattice.isascii() or max(lattice) < "\u0370":
        return 0
    return int(np.argmax(np.bincount(_OWN[_codes(lattice)] + 1, minlength=len(SCRIPTS) + 1)[1:]))


class _Readings(dict):
    """Readings of lattice tokens in one context; forgets all when there are too many."""

    def __init__(self, reader: Reader, context: int, memory: int) -> None:
        self.reader, self.context, self.memory = reader, context, memory

    def __missing__(self, token: str) -> str:
        if len(self) >= self.memory:
            self.clear()
        self[token] = out = self.reader.read(token, self.context)
        return out


class Reader:
    """Viterbi readings of lattice tokens under bigram scores; pure function of token and context."""

    def __init__(self, bigrams: dict[str, float], memory: int = 200_000) -> None:
        self.bigrams, self.floor = bigrams, min(bigrams.values(), default=-10.0) - 1.0
        self.seen = [_Readings(self, k, memory) for k in range(len(SCRIPTS))]

    def read(self, token: str, context: int) -> str:
        """The best reading; ties go to the earlier script."""
        states: dict[int, tuple[float, str, str]] = {-1: (0.0, "^", "")}  # script: score, last letter, reading
        for c in token:
            options = [(s, x) for s, x in enumerate(LETTERS[c]) if x] if c in LETTERS else [(script_of(c), c)]
            if options[0][0] < 0:  # marks and letters of other scripts leave the state as it is
                states = {s: (v, last, out + c) for s, (v, last, out) in states.items()}
                continue
            new: dict[int, tuple[float, str, str]] = {}
            for s, x in options:
                near = CONTEXT if s == context else 0.0
                best = max(
                    ((v + self.bigrams.get(last + x, self.floor) + near + (SWITCH if before not in (-1, s) else 0.0), -before, out) for before, (v, last, out) in states.items()),
                    key=lambda t: t[:2],
                )
                new[s] = (best[0], x, best[2] + x)
            states = new
        return max(((v, -s, o) for s, (v, _, o) in states.items()), key=lambda t: t[:2])[2]

    def form(self, text: str) -> str:
        """The text in its one form, composed (NFC)."""
        s = lattice_text(text)
        known = self.seen[context_of(s)]
        parts = (_ASCII_TOKEN if s.isascii() else _TOKEN).split(s)  # tokens stand at the odd places
        parts[1::2] = [known[t] for t in parts[1::2]]
        return unicodedata.normalize("NFC", "".join(parts))


def bigram_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(pair, n)``: neighbouring letters of one script over all texts; '^' stands before a token.

    Counted with numpy in each batch and summed; the result is bounded by the squares of the alphabets.
    """

    letters = np.concatenate([[ord("^")], np.flatnonzero(_KIND >= 0)])
    place = np.zeros(_END + 1, dtype=np.int32)
    place[letters[1:]] = np.arange(1, len(letters))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = _codes("\n".join(t for t in batch["t"] if t))
            scripts, at = _KIND[codes], place[codes]
            inside = (scripts[1:] >= 0) & ((scripts[:-1] == scripts[1:]) | (scripts[:-1] < 0))
            n = np.bincount(at[:-1][inside] * len(letters) + at[1:][inside])  # all others are at place 0, as '^'
            hit = np.flatnonzero(n)
            if len(hit):
                yield pd.DataFrame({"pair": [chr(a) + chr(b) for a, b in zip(letters[hit // len(letters)], letters[hit % len(letters)])], "n": n[hit].astype(np.int64)})

    return docs.select(F.col(text).alias("t")).mapInPandas(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def reader_scores(docs: DataFrame, text: str) -> dict[str, float]:
    """Log-probabilities of the second letter after the first, over all texts."""
    counts = {r["pair"]: r["n"] for r in cut(bigram_counts(docs, text), "bigrams").toLocalIterator()}
    after: dict[str, int] = {}
    for pair, n in counts.items():
        after[pair[0]] = after.get(pair[0], 0) + n
    return {pair: math.log((n + 0.5) / (after[pair[0]] + 50)) for pair, n in counts.items()}


def same_form(docs: DataFrame, key: str, text: str, with_form: bool = True) -> DataFrame:
    """``(key, form, form_hash, text_hash)``; hashes are 128 bits in hex.

    Null texts give null form and hashes; empty and blank texts are forms like any other. Repeated rows
    stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(reader_scores(docs, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        digest = lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        for batch in batches:
            texts = [None if t is None else str(t) for t in batch["t"]]
            forms = [None if t is None else reader.form(t) for t in texts]
            yield pd.DataFrame({"k": batch["k"], "form": forms if with_form else None, "form_hash": [digest(f) for f in forms], "text_hash": [digest(t) for t in texts]})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, form string, form_hash string, text_hash string").withColumnRenamed("k", key)


def classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class_id, texts, members)``: one row per document that shares its form with another text.

    ``class_id`` is the smallest key of the class, ``texts`` its number of different texts.
    """
    rows = cut(same_form(docs.where(F.regexp_like(text, F.lit(r"(?U)\S"))), key, text, False).drop("form"), "forms")
    many = rows.groupBy("form_hash", "text_hash").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("n"))
    many = many.groupBy("form_hash").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members")).where("texts > 1")
    return rows.join(many, "form_hash").select(key, "class_id", "texts", "members", "form_hash", "text_hash")


def pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key_a, key_b)``, smaller first: documents of one class whose texts differ.

    Only classes with two or more different texts reach the join, so a group of exact copies, however
    large, is never paired with itself.
    """
    rows = cut(classes(docs, key, text).select(key, "form_hash", "text_hash").distinct(), "classes")
    a = rows.select(F.col(key).alias(f"{key}_a"), "form_hash", F.col("text_hash").alias("ta"))
    b = rows.select(F.col(key).alias(f"{key}_b"), "form_hash", F.col("text_hash").alias("tb"))
    hit = a.join(b, "form_hash").where((F.col("ta") != F.col("tb")) & (F.col(f"{key}_a") < F.col(f"{key}_b")))
    return hit.select(f"{key}_a", f"{key}_b").distinct()
