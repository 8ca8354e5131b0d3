from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from harfgah.llm import collapse, leaks, lookalikes, overlap
from tests.llm import brute

VOCAB = "سلام خوبی کتاب مدرسه باشه آره دیروز امروز فردا رفتم گفت دیدم نان آب".split()


def lines(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [" ".join(r.choice(VOCAB[: 4 + i % 11]) for _ in range(r.choice([0, 1, 3, 5, 6, 7, 8, 9, 12, 16, 20]))) for i in range(n)]


def edited(text: str, r: random.Random) -> str:
    ws = text.split()
    for _ in range(r.randint(0, max(1, len(ws) // 4))):
        at = r.randrange(len(ws) + 1)
        ws[at : at + r.randint(0, 1)] = [r.choice(VOCAB)] * r.randint(0, 1)
    return " ".join(ws)


def tables(seed: int = 1):
    r = random.Random(seed)
    a, b = lines(60, seed), lines(60, seed + 1)
    evals = [(f"e{i}", a[i], b[i]) for i in range(60)] + [("null", None, None), ("empty", "", " ؟!"), ("again", a[5], b[5])]
    corpus = [(i, edited(r.choice(a), r), edited(r.choice(b), r)) for i in range(400)]
    corpus += [(900, None, "سلام"), (901, "", None), (902, a[5].upper().replace(" ", "  "), None), (903, a[5], b[5]), (904, " ".join(VOCAB * 400), "x")]
    return evals, corpus


@pytest.mark.parametrize("block_rows", [10, 1000])
def test_overlaps_are_all_that_the_definition_names(spark, block_rows):
    evals, corpus = tables()
    e = spark.createDataFrame(evals, "id string, q string, a string").withColumn("key", F.lit(1)).withColumn("side_0", F.lit("x"))
    c = spark.createDataFrame(corpus, "id long, l string, p string").withColumn("side", F.lit("s")).repartition(3)
    for exact in (False, True):
        got = overlap.overlaps(e, c, {"q": "l", "a": "p"}, "id", "id", ("side",), exact, block_rows)
        rows = got.collect()
        assert {(r["eval_id"], r["id"]) for r in rows} == brute.overlaps(evals, corpus) and len(rows) == len({(r["eval_id"], r["id"]) for r in rows})
        assert {r["corpus_side"] for r in rows} == {"s"}
    by_key, texts = {x[0]: x for x in evals}, {x[0]: x for x in corpus}
    for r in rows:
        k = 1 if r["side"] == "q" else 2
        e_, t_ = brute.words(by_key[r["eval_id"]][k]), brute.words(texts[r["id"]][k])
        assert r["longer_words"] == max(len(e_), len(t_))
        if not r["same"]:
            assert r["common_words"] == brute.common(e_, t_)


def test_same_letters_are_found_however_they_are_cut_into_words(spark):
    r = random.Random(9)
    evals = [(f"e{i}", "".join(r.choice("ab") for _ in range(r.choice([1, 3, 7, 8, 9, 15, 40]))), None) for i in range(60)]
    cut = lambda t: "".join(c + r.choice(["", "", " ", "-"]) for c in t)
    corpus = [(i, cut(r.choice(evals)[1]) + r.choice(["", "", "b"]), "") for i in range(300)] + [(999, None, None)]
    e = spark.createDataFrame(evals, "id string, q string, a string")
    c = spark.createDataFrame(corpus, "k long, l string, p string")
    got = {(x["id"], x["k"]) for x in overlap.overlaps(e, c, {"q": "l", "a": "p"}, "id", "k").collect()}
    assert got == brute.overlaps(evals, corpus) and len(got) > 200


def test_chain_never_exceeds_the_alignment():
    r = random.Random(4)
    for _ in range(300):
        e, t = [r.choice("abcd") for _ in range(r.randint(5, 12))], [r.choice("abcd") for _ in range(r.randint(4, 12))]
        seeds = sorted((i, -j) for i in range(len(t) - 1) for j in range(len(e) - 1) if t[i : i + 2] == e[j : j + 2])
        if seeds:
            assert overlap.chained([i for i, _ in seeds], [-j for _, j in seeds]) <= brute.common(e, t)


def test_winnowing_keeps_a_hash_of_every_window():
    import numpy as np

    r = np.random.default_rng(1)
    h, text = r.integers(0, 50, 200), np.repeat(np.arange(4), 50)
    kept = set(overlap.winnowed(h, text, 4).tolist())
    for i in range(200 - 3):
        if text[i] == text[i + 3]:
            assert kept & set(range(i, i + 4))


def test_leaks_are_all_that_the_definition_names(spark):
    evals, corpus = tables(7)
    e = spark.createDataFrame(evals, "id string, expected string, input string")
    c = spark.createDataFrame(corpus, "example_id long, latin string, persian string").withColumn("text_0", F.lit(None).cast("string"))
    for block_rows in (9, 1000):
        got = leaks.leaks(e, c, ["expected", "input"], ["latin", "persian"], "id", "example_id", block_rows=block_rows).collect()
        assert {(r["id"], r["example_id"]) for r in got} == brute.leaks(evals, corpus)
        assert len(got) == len({(r["id"], r["example_id"]) for r in got}) and all(r["leaked_expected"] or r["leaked_input"] for r in got)


def test_no_rows(spark):
    e = spark.createDataFrame([], "id string, q string, a string")
    c = spark.createDataFrame([], "k long, l string, p string")
    one_e, one_c = spark.createDataFrame([("e", "a b c d e", None)], e.schema), spark.createDataFrame([(1, "a b c d e", None)], c.schema)
    for x, y in ((e, c), (one_e, c), (e, one_c)):
        assert overlap.overlaps(x, y, {"q": "l", "a": "p"}, "id", "k").count() == 0
        assert leaks.leaks(x, y, ["q", "a"], ["l", "p"], "id", "k").count() == 0
    assert overlap.overlaps(one_e, one_c, {"q": "l", "a": "p"}, "id", "k").count() == 1


def test_collapse(spark):
    rows = [(1, "Salam", "سلام"), (2, "salam!", " سلام."), (3, "sa lam", "سـلام"), (4, None, "سلام"), (5, "", "سلام"), (6, None, None), (7, "؟", ""), (8, "سلام", "salam"), (9, "x" * 100_000, None), (10, "x" * 100_000 + "!", "")]
    rows += [(100 + i, "hot", "داغ") for i in range(300)]
    payloads = [(500, '{"persian": "سلام", "latin": "SALAM", "other": 1}'), (501, '{"latin": "salam", "persian": "سل'), (502, "[1]"), (503, '{"latin": 5, "persian": "\\u0633\\u0644\\u0627\\u0645"}'), (504, "")]
    df = spark.createDataFrame([(*r, None) for r in rows] + [(k, None, None, p) for k, p in payloads], "id long, latin string, persian string, payload string").withColumns({"h1": F.lit(0), "first_id": F.lit("x"), "_salt": F.lit(1)})
    groups, copies = collapse.collapse(df, "id", payload="payload")
    pairs, sizes = brute.copies(rows + [(500, "SALAM", "سلام"), (503, None, "سلام")])
    assert {tuple(r) for r in copies.collect()} == pairs
    assert {r["first_id"]: r["n_copies"] for r in groups.collect()} == sizes


def test_hot_groups_are_split(spark, monkeypatch):
    from harfgah.operators import skew

    rows = spark.range(1000).select("id", F.lit("same").alias("latin"), F.lit(None).cast("string").alias("persian"))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", ("n", 100))
    _, copies = collapse.collapse(rows, "id")
    assert {tuple(r) for r in copies.collect()} == {(0, i) for i in range(1, 1000)}


def test_different_fields_under_one_fingerprint_stay_apart(spark, monkeypatch):
    rows = [(1, "aa", None), (2, "AA", ""), (3, "bb", None), (4, "b b", None), (5, "cc", "x"), (6, "aa", None)]
    df = spark.createDataFrame(rows, "id long, latin string, persian string")
    c = collapse.Collapsed(df, "id")
    c.prints = c.prints.withColumns({"h1": F.lit(7).cast("long"), "h2": F.lit(7).cast("long")})
    assert {tuple(r) for r in c.copies().collect()} == {(1, 2), (1, 6), (3, 4)}
    assert {r["first_id"]: r["n_copies"] for r in c.groups().collect()} == {1: 3, 3: 2, 5: 1}


def test_collapse_of_nothing(spark):
    groups, copies = collapse.collapse(spark.createDataFrame([], "id long, latin string, persian string"), "id")
    assert groups.count() == copies.count() == 0


def test_field_order_doesnt_matter_and_field_names_do():
    import numpy as np

    a, b = np.array([5], np.uint64), np.array([9], np.uint64)
    assert collapse.multiset_hash({"x": a, "y": b}, 1) == collapse.multiset_hash({"y": b, "x": a}, 1) != collapse.multiset_hash({"x": b, "y": a}, 1)


def test_same_looking(spark):
    rows = [("a", "کتاب"), ("b", "كتاب"), ("c", "کتاب"), ("d", "ﻛﺘﺎﺏ "), ("e", None), ("f", ""), ("g", " ​"), ("h", "کتاب‌ها"), ("i", "کتابها"), ("j", "cop"), ("k", "сор"), ("l", "x " * 50_000), ("m", "x " * 50_000)]
    df = spark.createDataFrame(rows, "id string, t string").withColumns({"form": F.lit(1), "key": F.lit(2)})
    forms = lookalikes.forms(df, "id", "t").cache()
    got = [tuple(r) for r in lookalikes.same_looking(forms, "id").collect()]
    assert set(got) == brute.lookalikes(rows) and len(got) == len(set(got))
    empty = lookalikes.forms(df.limit(0), "id", "t").cache()
    assert lookalikes.same_looking(empty, "id").count() == 0
