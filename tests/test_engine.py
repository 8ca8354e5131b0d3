from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from harfgah.engine import Engine, Options
from harfgah.operators.channel import Channel, channel_score, from_rules, labels_of
from harfgah.operators.convert import Converter, Tables, latin_key, persian_key, promoted, typed_vowels, vowel_misses
from harfgah.operators.speller import labelled, synthetic, typed
from harfgah.operators.tensors import Weights, beam, dequantised, forward

FREQUENCY = {"سلام": 1.0, "خوبی": 0.8, "خوب": 0.9, "کتاب": 0.7, "مدرسه": 0.6, "مثلا": 0.9, "صبر": 0.4, "سبر": 0.1, "صابر": 0.3, "می‌روم": 0.5, "میروم": 0.2, "امید": 0.4, "ناامید": 0.5, "بیست": 0.4}


def test_skeletons():
    for fa, latin in (("کتاب", "ketaab"), ("صبر", "sabr"), ("ضعیف", "zaeef"), ("طلا", "talaa"), ("غذا", "ghazaa"), ("قند", "qand"), ("خواب", "khaab"), ("مدرسه", "madreseh"), ("مدرسه", "madrese"), ("اما", "ammaa")):
        assert persian_key(fa) == latin_key(latin)
    assert persian_key("است،") is None and latin_key("a1") is None
    t = Tables(frequency=FREQUENCY)
    assert t.buckets[latin_key("sabr")] == ["صبر", "صابر", "سبر"] and t.frequency["میروم"] == 0.5


def test_channel():
    assert channel_score("sabr", "صبر") == pytest.approx(channel_score("sabr", "سبر"))
    assert channel_score("sabr", "کتاب") == -math.inf
    assert channel_score("khosh", "خوش") > channel_score("xosh", "خوش")
    assert -math.inf < channel_score("ammaa", "اما") < channel_score("amaa", "اما")
    assert channel_score("khaab", "خواب") > -math.inf and channel_score("", "") == 0
    assert all(sum(map(math.exp, of.values())) == pytest.approx(1) for of in from_rules().values())
    for latin, fa in (("salam", "سلام"), ("miram", "می‌رم"), ("khaab", "خواب")):
        labels = labels_of(latin, fa)
        assert len(labels) == len(latin) and "".join(labels) == fa
    assert labels_of("sabr", "کتاب") is None and Channel().best("a", "")[0] == -math.inf


def test_word_passes():
    c = Converter(Tables(frequency=FREQUENCY, loanwords={"file": ["فایل"], "gol": ["گل", "گول"]}))
    first = {w: c.convert(w)[0][0] for w in ("salam", "Salaaaam", "khubi", "ketabo", "ketabamo", "madreseam", "masalan", "na", "file", "baad", "ketabharo")}
    assert first == {"salam": "سلام", "Salaaaam": "سلام", "khubi": "خوبی", "ketabo": "کتابو", "ketabamo": "کتابمو", "madreseam": "مدرسهام", "masalan": "مثلا", "na": "نه", "file": "فایل", "baad": "بعد", "ketabharo": "کتابهارو"}
    assert [p for _, p, _ in c.convert("gol")[:2]] == [0.54, 0.36]
    assert c.copula("ketabe", [("کتاب", 0.9, "")]) == [("کتاب", 0.72, ""), ("کتابه", 0.2, "copula")]
    assert promoted([("a", 0.5, ""), ("b", 0.3, "")], "b", "r") == [("b", 0.8, "r"), ("a", 0.2, "")]
    assert typed_vowels("salam") == ["Aa", "Aa"] and typed_vowels("xyz") == ["i"]
    assert vowel_misses(["e"], "ae") == 0 and vowel_misses(["o"], "a") == 1 and vowel_misses([], "aei") == 0


def test_shared_beginnings_change_no_score():
    import random

    r = random.Random(3)
    c = Channel()
    for _ in range(200):
        latin = "".join(r.choice(["a", "b", "kh", "sh", "oo", "m", "e", "i", "y", "ss"]) for _ in range(r.randint(0, 6)))
        s = c.scorer(latin)
        for _ in range(12):
            fa = "".join(r.choice("ابخوشیمسعه\u200c") for _ in range(r.randint(0, 6)))
            assert s.score(fa) == pytest.approx(c.best(latin, fa)[0]) if c.best(latin, fa)[0] > -math.inf else s.score(fa) == -math.inf


def test_converters_forget_and_find_the_same(monkeypatch):
    from harfgah.operators import convert

    words = ["salam", "khub", "ketab", "madrese", "sabr", "salam"]
    want = [Converter(Tables(frequency=FREQUENCY)).convert(w) for w in words]
    monkeypatch.setattr(convert, "REMEMBERED", 2)
    c = Converter(Tables(frequency=FREQUENCY))
    assert [c.convert(w) for w in words] == want and len(c.known) <= 2


def test_words_beyond_the_common_ones(spark, monkeypatch):
    from harfgah import engine as G

    df = spark.createDataFrame([(1, "salam khubi ketab ma dar USA"), (2, "file filam man pizza the pizza"), (2, "salam")], "id long, text string").withColumn("key", F.lit(1))
    e = Engine(Tables(frequency=FREQUENCY, loanwords={"file": ["فایل"], "pizza": ["پیتزا"]}))
    want = sorted(e.transliterate(df, "id", "text").select("id", "result.text").collect())
    for name in ("COMMON_WORDS", "SPANS_AT_ONCE"):
        monkeypatch.setattr(G, name, 1)
    monkeypatch.setattr(Engine.common_words, "__defaults__", (8, 1))
    assert sorted(e.transliterate(df, "id", "text").select("id", "result.text").collect()) == want and len(want) == 3
    assert want[0]["text"].endswith(" USA") and "فایل فایلم" in want[2]["text"] and want[2]["text"].endswith("pizza the pizza")
    assert not e.uses_clause_marker and Engine(weights=Weights.random("ab$", ["", "x"])).uses_clause_marker


def test_a_stream_is_converted(spark, tmp_path):
    from harfgah.streaming import streams

    rows = spark.createDataFrame([(1, "salam khubi"), (2, None)], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    e = Engine(Tables(frequency=FREQUENCY))
    out = streams.transliterated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), e, "id", "text").select("id", "result.text")
    streams.run_once(out, str(tmp_path / "out")).awaitTermination()
    want = {r["id"]: r["text"] for r in e.transliterate(rows, "id", "text").select("id", "result.text").collect()}
    assert {r["id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want == {1: "سلام خوبی", 2: ""}


def test_affixes():
    from harfgah.operators.convert import Scoring, put_together, taken_apart
    from harfgah.functions.tables import LINK

    assert ("", "ketaab", ["ها", "مون"]) in taken_apart("ketaabhaamoon") and ("نمی", "khoram", []) in taken_apart("nemikhoram") and taken_apart("nam") == []
    assert [put_together("", "قلم", ["ش"]), put_together("", "مدرسه", ["ش"]), put_together("", "جا", ["ی"]), put_together("می", "خورم", []), put_together("", "پا", [LINK])] == ["قلمش", "مدرسهاش", "جایی", "میخورم", "پای"]
    c = Converter(Tables(frequency=FREQUENCY), Scoring(affix=-1.0))
    assert "کتابهامون" in [o for o, _, _ in c.pool("ketabhamoon")]


def test_sentences(spark):
    e = Engine(Tables(frequency=FREQUENCY))
    texts = {1: "salam, khubi?", 2: "", 3: None, 4: "ketab ash", 5: "na omid", 6: "bisto bist", 7: "madrese ye man", 8: "سلام 😂 http://a.ir  x", 9: "  ", 10: "Salam Google", 11: "salam " * 300}
    df = spark.createDataFrame(list(texts.items()), "id long, t string").repartition(3)
    got = {r["id"]: r["result"] for r in e.transliterate(df, "id", "t").collect()}
    assert set(got) == set(texts)
    for key, x in got.items():
        text, units = texts[key] or "", (texts[key] or "").encode("utf-16-le")
        assert "".join(s["output"] for s in x["spans"]) == x["text"] and "".join(s["input"] for s in x["spans"]) == text
        assert all(units[2 * s["start"] : 2 * s["end"]].decode("utf-16-le") == s["input"] for s in x["spans"])
        assert all(s["output"] == s["input"] for s in x["spans"] if s["action"] == "copy")
        assert x["text"] not in x["alternatives"] and len(set(x["alternatives"])) == len(x["alternatives"]) <= 3 and 0 <= x["confidence"] <= 1
    assert got[1]["text"] == "سلام، خوبی؟" and got[4]["text"] == "کتابش" and got[5]["text"] == "ناامید" and got[8]["text"].startswith("سلام 😂 http://a.ir  ")
    assert got[10]["spans"][2]["copy_reason"] == "english" and got[2]["confidence"] == 1.0
    forced = e.transliterate(df.where("id in (1, 10)"), "id", "t", Options(persian_punctuation=False, force=("google",), protect=("salam",), alternatives=0))
    x = {r["id"]: r["result"] for r in forced.collect()}
    assert x[1]["text"].startswith("salam,") and x[10]["spans"][2]["action"] == "convert" and x[1]["alternatives"] == []
    assert e.transliterate(df.limit(0), "id", "t").count() == 0


def test_modes():
    w = Weights.random("abcdefghijklmnopqrstuvwxyz'", ["", "ا", "ب", "س"])
    hybrid = Engine(Tables(frequency=FREQUENCY), weights=w)
    assert hybrid.mode == "hybrid" and hybrid.has_model and not hybrid.has_context
    assert hybrid.converter().convert("salam")[0][0] == "سلام"
    assert Engine(weights=w, mode="model").converter().convert("ab")
    with pytest.raises(ValueError):
        Engine(mode="hybrid")


def test_model():
    import itertools

    import numpy as np

    w = Weights.random("abc", ["", "x", "y"], seed=1)
    logits = forward(w, [1, 2, 3])
    assert logits.shape == (3, 3) and forward(w, []).shape == (0, 3)
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    outputs: dict[str, float] = {}
    for path in itertools.product(range(3), repeat=3):
        o = "".join(w.labels[k] for k in path)
        outputs[o] = max(outputs.get(o, -99.0), sum(math.log(p[i, k]) for i, k in enumerate(path)))
    best = sorted(outputs.items(), key=lambda x: -x[1])[:3]
    assert [s for _, s in beam(logits, w.labels, width=99, k=3)] == pytest.approx([s for _, s in best], abs=1e-5)
    for name, (codes, scales, shape) in w.quantised().items():
        m = w.matrices()[name]
        assert np.abs(dequantised(codes, scales, shape) - m).max() <= max(scales) / 2 + 1e-6
    with pytest.raises(ValueError):
        dequantised(codes, scales[:-1], shape)


def test_speller(spark):
    import random

    for word in ("سلام", "کتاب", "مدرسه", "خواهر", "می‌روم", "بزرگ", "دست", "ئ"):
        for k in range(20):
            pieces = typed(word, random.Random(k))
            latin, labels = labelled(pieces)
            assert "".join(fa for fa, _ in pieces) == word and (not latin or ("".join(labels) == word and len(labels) == len(latin)))
    df = spark.createDataFrame([("سلام",), ("کتاب",), (None,), ("",)], "w string")
    a, b = synthetic(df, "w").collect(), synthetic(df.repartition(3), "w").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and all("".join(r["labels"]) == r["persian"] for r in a)
