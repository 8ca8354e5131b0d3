from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from harfgah.llm import bpe, consensus, packing, repetition, terms
from tests.llm import brute

TEXTS = [None, "", "   ", "a", "سلام سلام سلام", "a b c d e f a b c d x y", "one two three four\none two three four\r\nfive", "x y " * 20, "😂 " * 30, "word " * 40_000, "Ａ b ｃ d a B c D"]


def test_repetition(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"key": F.lit("x"), "n_words": F.lit(-1)})
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        for k in repetition.LENGTHS:
            assert (got[i]["n_words"], got[i][f"repeated_words_{k}"]) == brute.repeated(t, k)
    assert got[6]["repeated_line_chars"] == len("onetwothreefour")
    found = {r["doc_id"] for r in repetition.repetitive(repetition.repetition(df)).collect()}
    assert found == {i for i, t in enumerate(TEXTS) if brute.repeated(t, 4)[0] >= 5 and 10 * brute.repeated(t, 4)[1] >= 3 * brute.repeated(t, 4)[0]}
    assert repetition.with_shares(repetition.repetition(df)).count() == len(TEXTS)
    assert repetition.repetition(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{bpe.FOLDER}/{bpe.TOKENIZER}.json"), reason="no tokenizer files")
def test_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    texts = [*TEXTS, "<|endoftext|>", "a" * 3000, "aab" * 700, "سلام‌ها" * 300, "퟿͸ x", " \n\n  x's 12,5", "\x00\x1e"]
    texts += ["".join(r.choice("ab c'سلn۱2 \n😂é‌.") for _ in range(r.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"ids": F.lit(0), "key": F.lit(0)})
    t = Tokenizer.from_file(f"{bpe.FOLDER}/{bpe.TOKENIZER}.json")
    t.encode_special_tokens = True
    want = {i: e.ids for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df).collect()}
    assert got == want and got[0] == got[1] == []
    assert [t.decode(got[i]) for i in (4, 5, 6)] == [texts[i] for i in (4, 5, 6)]
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.encoded(df, ids=False).collect()} == {i: len(x) for i, x in want.items()}
    assert bpe.encoded(df.limit(0)).count() == 0


def test_packing(spark):
    r = random.Random(2)
    sizes = [None, 0, 1, 2048, 2049, 4096, 10_000] + [min(3000, int(r.paretovariate(0.8) * 20)) for _ in range(3000)] + [700] * 500
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumns({"size": F.lit("x"), "rank": F.lit(None).cast("int")}).cache()
    rows = packing.packed(df).collect()
    check_packing(rows, sizes, 2048)
    one = packing.fill(packing.packed(df)).first()
    assert one["n_tokens"] == sum(s or 0 for s in sizes) and one["used_share"] > 0.99
    none = packing.packed(df.limit(0))
    assert none.count() == 0 and packing.fill(none).first()["n_sequences"] == 0


def check_packing(rows, sizes, capacity):
    used: dict[int, list[tuple[int, int]]] = {}
    total: dict[int, int] = {}
    for x in rows:
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["part_tokens"]
        if x["seq_id"] is None:
            assert not sizes[x["doc_id"]]
        else:
            used.setdefault(x["seq_id"], []).append((x["seq_offset"], x["seq_offset"] + x["part_tokens"]))
    assert total == {i: s or 0 for i, s in enumerate(sizes)}
    assert sorted(used) == list(range(len(used)))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    parts = {i: sum(x["doc_id"] == i for x in rows) for i in (3, 4, 5, 6)}
    assert parts == {3: 1, 4: 2, 5: 2, 6: 5}


def test_a_common_size_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_AT_ONCE", 40)
    sizes = [700] * 1000 + [3] * 50
    rows = packing.packed(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").cache()).collect()
    seen = [(x["seq_id"], x["seq_offset"]) for x in rows]
    assert len(seen) == len(set(seen)) == 1050 and max(x["seq_id"] for x in rows) == 499


def test_best_fit_is_close_to_the_least():
    r = random.Random(3)
    counts: dict[int, int] = {}
    for _ in range(20_000):
        s = r.randint(1, 2048)
        counts[s] = counts.get(s, 0) + 1
    runs = packing.best_fit(counts, 2048)
    n = max(first + k for _, _, k, first, _ in runs)
    assert n <= 1.02 * sum(s * c for s, c in counts.items()) / 2048 + 1


def test_terms(spark):
    texts = [*TEXTS[:9], "سلام سلام x", "x_y", *["داغ " * 3] * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("term", F.lit("a")).repartition(5).cache()
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in terms.term_counts(df, share=0.05).collect()}
    assert got == brute.terms(texts)
    assert "داغ" in terms.heavy_terms(df, share=0.05)
    marks = {r["term"]: r["mark"] for r in terms.marked(terms.term_counts(df), df.agg(F.count("*").alias("n_all"))).collect()}
    assert all(marks[t] == ("common" if 20 * r > len(texts) else "rare" if r < 3 else None) for t, (_, r) in got.items())
    assert terms.term_counts(df.limit(0)).count() == 0


def test_a_summary_keeps_every_heavy_term():
    r = random.Random(1)
    stream = ["h"] * 300 + [f"w{r.randrange(5000)}" for _ in range(2700)]
    r.shuffle(stream)
    s = terms.Summary(20)
    for i in range(0, len(stream), 100):
        part = stream[i : i + 100]
        s.add(sorted(set(part)), [part.count(x) for x in sorted(set(part))])
    assert s.n == 3000 and len(s.counts) <= 20 and 300 - 3000 / 20 <= s.counts["h"] <= 300


def simulated(n_items: int, seed: int):
    """Items with a true verdict and judges of known reliability, some contrary, some who mostly accept."""
    r = random.Random(seed)
    right = {"good1": (0.95, 0.95), "good2": (0.9, 0.9), "fair1": (0.75, 0.75), "fair2": (0.7, 0.7), "coin": (0.5, 0.5), "contrary": (0.15, 0.15), "lenient": (0.95, 0.4)}
    truth, votes = {}, []
    for i in range(n_items):
        truth[f"i{i}"] = t = r.random() < 0.6
        for j in r.sample(sorted(right), 5):
            says = t if r.random() < right[j][0 if t else 1] else not t
            votes.append((f"i{i}", j, int(says)))
    return truth, votes, right


def test_consensus_finds_the_truth_and_the_judges(spark):
    truth, votes, right = simulated(1500, 5)
    edges = spark.createDataFrame(votes, "item string, judge string, up int")
    items = spark.createDataFrame([(i, "k") for i in truth] + [("none", "k")], "item string, kind string")
    c = consensus.consensus(edges, items)
    got = {r["item_id"]: r for r in c.items.collect()}
    assert set(got) == {*truth, "none"} and got["none"]["verdict"] == "accept" and got["none"]["agreement"] is None
    share = sum((got[i]["verdict"] == "accept") == t for i, t in truth.items()) / len(truth)
    majority = sum((sum(u for i2, _, u in votes if i2 == i) * 2 > 5) == t for i, t in list(truth.items())[:200]) / 200
    assert share > 0.95 and share > majority
    for r in c.judges.collect():
        a, b = right[r["judge"]]
        assert abs(r["accepts_right"] - a) < 0.06 and abs(r["rejects_right"] - b) < 0.06


def test_both_ways_to_consensus_agree(spark, monkeypatch):
    truth, votes, _ = simulated(300, 8)
    edges = spark.createDataFrame(votes, "item string, judge string, up int").withColumn("n", F.lit("x"))
    items = spark.createDataFrame([(i, "a" if k % 3 else None) for k, i in enumerate(truth)], "item string, kind string")
    found = []
    for most in (100_000, 1):
        monkeypatch.setattr(consensus, "BROADCAST_JUDGES", most)
        c = consensus.consensus(edges.select("item", "judge", "up"), items)
        rows = {r["item_id"]: (r["verdict"], r["n_votes"], pytest.approx(r["confidence"], abs=1e-6)) for r in c.items.collect()}
        found.append((rows, {r["judge"]: pytest.approx(r["reliability"], abs=1e-6) for r in c.judges.collect()}, c.rounds.first()))
    assert {k: v[:2] for k, v in found[0][0].items()} == {k: v[:2] for k, v in found[1][0].items()} and found[0][2]["rounds"] == found[1][2]["rounds"] > 1
    assert all(found[0][1][j].expected == found[1][1][j] for j in found[0][1]) and found[0][2]["last_change"] < consensus.TOLERANCE
    monkeypatch.setattr(consensus, "MOST", 1)
    with pytest.raises(RuntimeError, match="no consensus"):
        consensus.consensus(edges.select("item", "judge", "up"), items)


def test_long_pieces_are_encoded_by_the_same_query_as_short_ones(spark):
    from tokenizers import Tokenizer

    r = random.Random(6)
    texts = ["".join(r.choice("abcdefgh") for _ in range(3000)), "ن" * 5000, "".join(r.choice("سلامخوب") for _ in range(2000)), "ab" * 4000]
    b = bpe.Bpe()
    t = Tokenizer.from_file(f"{bpe.FOLDER}/{bpe.TOKENIZER}.json")
    values, n = b.encode(texts)
    assert values.tolist() == [i for e in t.encode_batch(texts, add_special_tokens=False) for i in e.ids] and len(n) == 4
    b.encode_sql, b.known = bpe.ENCODE.replace("ROUNDS", "7").replace("CHOSEN", bpe.LEFTMOST), {}
    short = [x[:200] for x in texts]
    assert b.encode(short)[0].tolist() == [i for e in t.encode_batch(short, add_special_tokens=False) for i in e.ids]
    assert b.decode([*(e.ids for e in t.encode_batch(short, add_special_tokens=False)), [], None]) == [*short, "", None]


def test_decoding(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("letters", F.lit(1))
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [int(bpe.Bpe().byte[0xFF])])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(odd).collect()} == {1: None, 2: "", 3: "\ufffd"}
    assert bpe.decoded(odd.limit(0)).count() == 0


def test_votes(spark):
    from datetime import datetime as D

    rows = [("a", "j", " Accept", D(2025, 1, 1)), ("a", "j", "reject", D(2025, 1, 2)), ("a", "j", "unsure", D(2025, 1, 3)), ("a", "k", "ACCEPT ", None), ("a", "k", "ACCEPT ", None), (None, "j", "accept", None), ("b", None, "accept", None), ("b", "j", None, None), ("b", "j", "", None), ("c", "j", "accept", D(2025, 1, 1)), ("c", "j", "reject", D(2025, 1, 1))]
    df = spark.createDataFrame(rows, "i string, w string, v string, t timestamp").withColumns({"item": F.lit(1), "up": F.lit(9)})
    assert sorted(map(tuple, consensus.votes(df, "i", "w", "v", "t").collect())) == [("a", "j", 0), ("a", "k", 1), ("c", "j", 1)]
    empty = consensus.consensus(consensus.votes(df.limit(0), "i", "w", "v", "t"), spark.createDataFrame([("x", "k")], "item string, kind string"))
    assert [tuple(r)[:3] for r in empty.items.collect()] == [("x", "k", "accept")] and empty.judges.count() == 0
    nothing = consensus.consensus(consensus.votes(df.limit(0), "i", "w", "v", "t"), spark.createDataFrame([], "item string, kind string"))
    assert nothing.items.count() == 0
