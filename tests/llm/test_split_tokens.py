import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import tokens as tk
from graphloom.llm.split import split_text, split_texts

WORD = regex.compile(r"\P{White_Space}+")


def check_pieces(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    all_tokens = WORD.findall(text)
    shared = min(max(0, overlap or 0), limit - 1)
    if len(all_tokens) <= limit:
        assert len(pieces) == 1 and pieces[0][-1] == text
        return pieces
    joined, before = [], []
    for no, total, n, head, a, b, kind, piece in pieces:
        own = WORD.findall(piece)
        assert piece == text[a:b] and len(own) == n <= limit and total == len(pieces)
        if no:
            assert head == min(shared, len(joined)) and own[:head] == joined[len(joined) - head:]
        joined += own[head:]
        before = own
    assert joined == all_tokens
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\t\u00a0\u2003!-é\r", max_size=300), st.integers(1, 12), st.integers(-1, 14))
def test_pieces_hold(text, limit, overlap):
    check_pieces(text, limit, overlap)


def test_boundaries_and_edits():
    rnd = random.Random(1)
    sentence = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rnd.randrange(99)) for _ in range(rnd.randrange(4, 9))) + "."
    text = "\n\n".join(" ".join(sentence() for _ in range(4)) for _ in range(120))
    pieces = check_pieces(text, 60, 10)
    assert {p[6] for p in pieces[:-1]} == {"paragraph"}
    edited = text[:3000].rstrip() + " inserted words here " + text[3000:]
    before, after = {p[-1] for p in pieces}, {p[-1] for p in check_pieces(edited, 60, 10)}
    assert len(after - before) <= 3
    no_boundary = check_pieces(" ".join("w%d" % i for i in range(500)), 40, 0)
    assert {p[6] for p in no_boundary[:-1]} == {"word"}


def test_limits_of_rows(spark):
    rows = [("a", None, 5, 1), ("b", "", 5, 1), ("c", "x " * 20, None, None), ("d", "x " * 20, 5, None), ("e", "x " * 6, 0, 3), ("f", "y" * 200_000, 5, 1)]
    got = split_texts(spark.createDataFrame(rows, "k string, t string, m int, o int"), "k", "t", "m", "o").groupBy("k").count().collect()
    count = {r["k"]: r["count"] for r in got}
    assert 4 <= count.pop("d") <= 6 and count == {"a": 1, "b": 1, "c": 1, "e": 6, "f": 1}


TEXTS = [None, "", " ", "  two  blanks ", "It's we'll I'M don't", "<|endoftext|> plain <|endoftext|>", "1234 ½ ²", "Ærø—naïve\u00a0x\u3000y", "\r\n\t\n x", "👩‍⚕️👍🏽", "日本語テキスト。", "a" * 5000, "\u200b\ufeff", "e\u0301", "x" + " " * 400 + "y", "\u0085\u2028a"]


def test_ids(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("ab 1.,'sé\n") for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(4, TEXTS[4]), (None, "k")], "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("pos", F.lit(1)).withColumn("n", F.lit(0))
    want = {i: tok.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    want[None] = tok.encode("k").ids
    for limit in (tk.NEAR_WORDS, 10):  # with the second most words are joined by shuffle
        rows = tk.encode(df, "doc_id", "text", limit=limit).collect()
        assert len(rows) == len(want) and {r["doc_id"]: list(r["ids"]) for r in rows} == want
        counts = {r["doc_id"]: r["tokens"] for r in tk.token_counts(df.dropDuplicates(["doc_id"]), "doc_id", "text", limit=limit).collect()}
        assert counts == {k: len(v) for k, v in want.items()}
    back = {r["doc_id"]: r["text"] for r in tk.decode(tk.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {**{i: t or "" for i, t in enumerate(texts)}, None: "k"}
    assert tk.encode(df.limit(0), "doc_id", "text").collect() == []


def test_other_library_agrees():
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tk.rank_file_tokens(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tok = Tokenizer.from_file(tk.tokenizer_file())
    tok.encode_special_tokens = True
    for t in filter(None, TEXTS):
        assert tok.encode(t, add_special_tokens=False).ids == enc.encode_ordinary(t)


@pytest.mark.parametrize("again", [{}, {"doc_id": 1}])
def test_same_key_other_text(spark, again):
    df = spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted(len(r["ids"]) for r in tk.encode(df, "doc_id", "text").collect()) == [1, 2]
