import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm.lookalike import Reader, classes, lattice_text, lattice_table, pairs, same_form
from graphloom.llm.mix import demand, invert, mixture, schedule_table


def test_one_form():
    r = Reader({})
    base = "Fixed Schedule: co-op naïve café - x 12"
    same = [
        "Ｆixed Schedule: co-op naïve café - x 12", "Fi\u200bxed\u00a0Schedule: co\u2011op na\u00efve cafe\u0301 - x 12", "Fіxed Ѕсhedule: cо-οp naïve caf\u0435\u0301 - х 12",
        "\ufb01xed"[:0] + "Fixed\u3000Schedule: co-op naïve café \u2010 x 12", "Fixed Sche\u00addule\u2060: co-op na\u0456\u0308ve café - x 12",
    ]
    assert {r.form(t) for t in same} == {r.form(base)} == {base}
    other = ["fixed Schedule: co-op naïve café - x 12", base.replace("é", "e"), base.replace("12", "1²"), base.replace(" - ", " – "), base.replace("  ", " ").replace(" x", "  x"), base.replace("x", "×"), base.replace("o", "0", 1)]
    assert all(r.form(t) != base for t in other) and len({r.form(t) for t in other}) == len(other)


def test_forms_by_script():
    r = Reader({})
    russian = "Врач открыл сор и мост, дверь закрыта."
    mixed = russian.replace("с", "c").replace("о", "o")
    assert r.form(russian) == r.form(mixed) == russian
    assert r.form("The cop оpened a dооr.") == "The cop opened a door."
    assert r.form("Տօft ᎢᎬᎪ ҽ") == "Soft TEA ҽ"  # Armenian and Cherokee letters
    assert r.form("™ ① ² ½") == "™ ① ² ½" and r.form("ﬁ µ K …") == "fi μ K ..."


def test_forms_are_equal_only_if_lattices_are():
    rep, letters = lattice_table()
    r = Reader({"^с": -1.0, "со": -0.5, "^c": -2.0})
    words = ["сор", "cop", "сoр", "соr", "сур", "ТОР", "TOP", "ΤΟΡ", "моp", "дом", "Αа", "x́", "ё", "e\u0308", "е\u0308"]
    by_form, by_lattice = defaultdict(set), defaultdict(set)
    for w in words:
        for ctx in range(5):
            s = lattice_text(w)
            by_form[ctx, unicodedata.normalize("NFC", r.read(s, ctx))].add(w)
            by_lattice[ctx, s].add(w)
    assert sorted(map(sorted, by_form.values())) == sorted(map(sorted, by_lattice.values()))
    assert all(len([c for c in row if c]) == len({c for c in row if c}) for row in letters.values()) and len(rep) == sum(len([c for c in row if c]) for row in letters.values())


def test_pairs(spark):
    rows = [(1, "open door"), (2, "open dооr"), (3, "open door"), (4, "open\u00a0door"), (5, "Open door"), (6, None), (7, ""), (8, " "), (9, "\u00a0"), (10, "x" * 50_000), (11, "x" * 49_999 + "х"), (4, "open\u00a0door")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("k", F.lit(0))
    assert {tuple(r) for r in pairs(df, "doc_id", "text").collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11)}
    got = {(r["doc_id"], r["class_id"], r["texts"]) for r in classes(df, "doc_id", "text").collect()}
    assert got == {(i, 1, 3) for i in (1, 2, 3, 4)} | {(10, 10, 2), (11, 10, 2)}
    assert same_form(df.where("doc_id = 6"), "doc_id", "text").first()["form"] is None
    assert pairs(df.limit(0), "doc_id", "text").collect() == []


def test_demand(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 5), ("gone", 0.1, 3), ("no", None, 3), (None, 0.2, 1), ("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 300), ("no", 50)], "source string, size long")
    got = {r["source"]: r["tokens"] for r in demand(sizes, targets).collect()}
    assert got == {"a": 893, "b": 200, "c": 357, "gone": 0, "no": 0}
    got = {r["source"]: r["tokens"] for r in demand(sizes, targets, total=10**6).collect()}
    assert got == {"a": 1000, "b": 200, "c": 1500, "gone": 0, "no": 0}
    got = {r["source"]: r["tokens"] for r in demand(sizes, targets, total=100).collect()}
    assert got["a"] + got["b"] + got["c"] == pytest.approx(100, abs=2) and got["a"] == 50


def test_invert(spark):
    seg = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("t", "dt", "w0", "w1", "c"), s)]) for s in ((0, 0.5, 0.5, 1.0, 0), (0.5, 0.5, 1.0, 1.5, 0.375))])
    us = [i / 50 for i in range(51)]
    rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", invert(F.col("u"), seg).alias("t")).collect()
    area = lambda t: 0.5 * t + t * t / 2
    assert all(area(r["t"]) == pytest.approx(r["u"], abs=1e-9) for r in rows)


def test_schedules_sum_to_one(spark):
    plan = spark.createDataFrame([("a", 700, 900), ("b", 200, 50), ("c", 100, 400), ("none", 0, 10)], "source string, tokens long, size long")
    given = {"c": [2.0, 1.0, 0.5, 0.5, 1.0]}
    rows = {r["source"]: r for r in schedule_table(plan, given).collect()}
    assert set(rows) == {"a", "b", "c"}
    for k in range(4):
        for end in ("w0", "w1"):
            assert sum(r["segments"][k][end] for r in rows.values()) == pytest.approx(1)
    assert [s["w0"] for s in rows["c"]["segments"]] == pytest.approx([0.2, 0.1, 0.05, 0.05]) and rows["b"]["segments"][0]["w0"] == pytest.approx(0.1) and rows["b"]["segments"][3]["w1"] == pytest.approx(0.3)
    for r in rows.values():
        at = 0.0
        for s in r["segments"]:
            assert s["c"] == pytest.approx(at)
            at += (s["w0"] + s["w1"]) / 2 * s["dt"]
        assert r["area"] == pytest.approx(at)


def test_mixture(spark):
    docs = [(i, "big", "word " * (5 + i % 7)) for i in range(300)] + [(1000 + i, "small", "tiny text here") for i in range(10)] + [(2000, None, "x"), (2001, "other", "x"), (2002, "big", ""), (2003, "big", None), (0, "big", "word " * 5)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 4), ("absent", 0.2, 3)], "source string, target_share double, max_repeats int")
    placed, shares = mixture(d, t)
    rows = placed.collect()
    pos = [(r["position"], r["doc_id"], r["repeat"]) for r in rows]
    assert pos == sorted(pos) and 0 <= pos[0][0] and pos[-1][0] < 1
    used = Counter((r["source"], r["doc_id"]) for r in rows)
    assert max(n for (s, _), n in used.items() if s == "small") == 4 and max(n for (s, _), n in used.items() if s == "big") == 1
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"big", "small", "absent"} and s["absent"]["tokens"] == 0
    for k in ("big", "small"):
        assert s[k]["tokens"] == sum(r["tokens"] for r in rows if r["source"] == k) and abs(s[k]["tokens"] - s[k]["wanted"]) <= 12
    assert sum(r["actual_share"] for r in s.values()) == pytest.approx(1)
    early = sum(r["tokens"] for r in rows if r["source"] == "small" and r["position"] < 0.5)
    assert early < 0.5 * s["small"]["tokens"]  # repeated sources come late
    assert mixture(d.limit(0), t)[0].collect() == []
