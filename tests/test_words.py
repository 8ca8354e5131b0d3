from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harfgah.functions import words as W
from harfgah.functions.tables import CORRESPONDENCES, latin_units, reverse_index
from harfgah.operators import alignment as A
from harfgah.operators import tokens as K
from harfgah.operators.candidates import best_path, best_path_of, segment_all, walked

TEXTS = [(1, "salam, chetori? http://a.ir/x me@b.com 12.5 @ali #tag a_b `x y` 😂 سلام‌ها café"), (2, ""), (3, None), (4, "   "), (5, "ABCd\n\tx"), (6, "x " * 20_000)]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_lose_nothing(spark):
    df = spark.createDataFrame(TEXTS, "id long, t string").withColumns({"pos": F.lit(1), "kind": F.lit("x")})
    rows = K.tokens(df, "id", "t").orderBy("id", "pos").collect()
    for key, text in TEXTS:
        own = [r for r in rows if r["id"] == key]
        assert "".join(r["tok"] for r in own) == (text or "")
        assert all(text[r["start"] : r["start"] + len(r["tok"])] == r["tok"] for r in own)
    kinds = {r["tok"]: r["kind"] for r in rows if r["id"] == 1}
    assert [kinds[t] for t in ("salam", ",", "http://a.ir/x", "me@b.com", "12.5", "@ali", "#tag", "a_b", "`x y`", "😂")] == ["word", "punct", "url", "email", "number", "mention", "hashtag", "identifier", "code", "emoji"]


def test_a_run_of_loanwords_beside_english_stays_english(spark):
    df = spark.createDataFrame([(1, "man file folder download mikonam"), (2, "file man mikonam Google file")], "id long, t string")
    loans = spark.createDataFrame([("file",), ("folder",), (None,)], "word string")
    t = K.guarded(K.classified(K.sentence_flags(K.tokens(df, "id", "t"), "id"), loans), "id").orderBy("id", "pos")
    assert [(r["id"], r["tok"]) for r in t.collect() if r["guarded"]] == [(1, "file"), (1, "folder"), (2, "file")]


SCANS = [
    ("USA ABCd AB12c ABc x", "USA AB Cd AB1 2 c ABc x", "identifier identifier word identifier number word word word"),
    ("सलाम 한국어 Привет a+b", "सलाम 한국어 Привет a + b", "other-script other-script other-script word other-script word"),
    ("👩‍👩‍👧 👍🏽 ⌚ ©", "👩‍👩‍👧 👍🏽 ⌚ ©", "emoji emoji emoji emoji"),
    ("می‌روم۱۲", "می \u200c روم ۱ ۲", "other-script punct other-script punct punct"),
    ("aABc www.X.ir/AbC snake_Case isn't", "aABc www.X.ir/AbC snake_Case isn't", "identifier url identifier word"),
]


@pytest.mark.parametrize(("text", "toks", "kinds"), SCANS)
def test_scanner(text, toks, kinds):
    import duckdb

    from harfgah.plans.scanner_sql import tokens_sql

    got = [(k, t) for k, t in K.scan(text) if k != "space"]
    assert got == list(zip(kinds.split(), toks.split(" "), strict=True))
    con = duckdb.connect()
    con.execute("create table d as select 1 as id, ? as text", [text])
    rows = con.sql(f"select kind, tok, start from {tokens_sql('d', 'id', 'text')} where kind <> 'space' order by pos").fetchall()
    assert [r[:2] for r in rows] == got and all(text[at : at + len(t)] == t for _, t, at in rows)


def test_forced_words_overrule_patterns():
    assert list(K.scan("USA2 USA", frozenset({"usa"}))) == [("identifier", "USA2"), ("space", " "), ("word", "USA")]
    s = K.scanned("salam. man, ok")
    assert [(s.starts[i], s.ends[i]) for i, k in enumerate(s.kind) if k == "word"] == [(True, True), (True, True), (False, True)]


def test_loan_endings(spark):
    from harfgah.operators.affixes import loan_forms, with_endings

    table = {"file": ["فایل"], "page": ["پیج"], "ok": ["اوکی"], "video": ["ویدیو"]}
    want = {"file": ["فایل"], "filam": ["فایلم"], "filea": ["فایلا"], "pageo": ["پیجو"], "pagi": ["پیجی"], "oki": ["اوکی"], "videoi": ["ویدیویی"], "filae": ["فایلا", "فایلاه"], "fil": None, "x": None, "": None}
    assert {w: loan_forms(w, table) for w in want} == want
    rows = with_endings(spark.createDataFrame([(k, v[0]) for k, v in table.items()], "en string, fa string")).collect()
    best = {}
    for r in rows:
        if r["typed"] not in best or r["cut"] > best[r["typed"]][0]:
            best[r["typed"]] = (r["cut"], r["forms"])
    assert all(loan_forms(t, table) == (table[t] if t in table else f) for t, (_, f) in best.items())


def test_naive_conversion(spark):
    first = {k: v[0][0] for k, v in reverse_index().items()}

    def plain(word):
        units, at = [], 0
        while at < len(word):
            u = next((u for u in latin_units() if word.startswith(u, at)), word[at])
            units.append(u)
            at += len(u)
        return "".join(first.get((u, "initial" if i == 0 else "final" if i == len(units) - 1 else "medial"), u) for i, u in enumerate(units))

    for w in ("salam", "khoobi", "x", "emrooz", "kh'ab", "zhaleh", ""):
        assert one(spark, W.naive_word, w) == plain(w)
    assert one(spark, W.naive_text, "salam 12 é!") == f"{plain('salam')} 12 é!"
    assert len(CORRESPONDENCES) == 53 and len([u for u in latin_units() if u not in (" ", "-")]) + 2 == 50


@pytest.mark.parametrize(("word", "base", "run"), [("salaaam", "salaam", ""), ("merciiii", "merci", "iiii"), ("kkkk", "k", "kkkk"), ("aab", "aab", ""), ("", "", "")])
def test_stretches(spark, word, base, run):
    from harfgah.operators.convert import unstretch

    assert one(spark, W.unstretched, word) == base and one(spark, W.final_run, word) == run and unstretch(word) == (base, run)


def test_restretch(spark):
    from harfgah.operators.convert import restretch

    for word, letter, n in (("سلام", "m", 4), ("خوبی", "i", 9), ("آ", "a", 4), ("نه", "k", 5), ("باا", "a", 4), ("abc", "c", 3)):
        column = lambda c, a=letter, k=n: K.restretched(c, F.lit(a), F.lit(k))
        assert one(spark, column, word) == restretch(word, letter * n)


def test_lenient_words(spark):
    join = lambda c: F.array_join(W.lenient_words(W.metric_words(c)), "|")
    assert one(spark, join, "می خورم کتاب ها را") == "میخورم|کتابها|را"
    assert one(spark, join, "ها می") == "ها|می"
    assert one(spark, join, "") == ""


def test_englishness(spark):
    got = {w: one(spark, W.englishness, w) for w in ("the", "man", "realize", "chize", "whim", "x", "hello", "happily")}
    assert got == {"the": 1.0, "man": 0.0, "realize": 0.68, "chize": 0.15, "whim": 0.58, "x": 0.0, "hello": 1.0, "happily": 0.2}


def test_word_errors_and_alignment(spark):
    import random

    r = random.Random(1)
    pairs = [([r.choice("abcd") for _ in range(r.randint(0, 7))], [r.choice("abcd") for _ in range(r.randint(0, 7))]) for _ in range(60)] + [([], ["a"]), (["a"], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a array<string>, b array<string>")
    errors = {x["id"]: x["e"] for x in df.select("id", A.word_errors(F.col("a"), F.col("b")).alias("e")).collect()}
    runs = {x["id"]: x for x in A.aligned(df, "id", "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        d = A.distances(a, b)[-1][-1]
        assert errors[i] == min(d, len(a)) and sum(x["cost"] for x in runs[i]["runs"]) == d
        assert runs[i]["joined_errors"] <= errors[i]
    assert A.joining_errors(["کتابخانه"], ["کتاب", "خانه"]) == 0 == A.joining_errors(["به", "خاطر"], ["بخاطر"])
    assert A.as_one("چطور", ["چه", "طور"]) and not A.as_one("چطور", ["که", "طور"])


def test_segments_and_beam():
    ways = segment_all("kha", 24)
    assert ways[0] == ["kh", "a"] and ["k", "h", "a"] in ways and all("".join(w) == "kha" for w in ways) and len(segment_all("khoooobaaai", 8)) == 8
    assert max(walked("salam").items(), key=lambda x: x[1])[0] in walked("salam", width=4)


def test_best_path_is_the_best_of_all():
    import itertools
    import math
    import random

    r = random.Random(2)
    for _ in range(30):
        lists = [[(f"{i}{k}", r.random()) for k in range(3)] for i in range(4)]
        pair = {(a, b): r.random() for x, y in itertools.pairwise(lists) for a, _ in x for b, _ in y}
        table: dict[str, dict[str, float]] = {}
        for (a, b), x in pair.items():
            if r.random() < 0.6:
                table.setdefault(b, {})[a] = x
        assert best_path_of(lists, table, 2.0) == best_path(lists, lambda a, b: table.get(b, {}).get(a, 0.0), 2.0)  # noqa: B023
        score = lambda path: sum(math.log(lists[i][k][1]) for i, k in enumerate(path)) + sum(2 * pair[lists[i][a][0], lists[i + 1][b][0]] for i, (a, b) in enumerate(itertools.pairwise(path)))  # noqa: B023, E731
        assert score(best_path(lists, lambda a, b: pair[a, b], 2.0)) == pytest.approx(max(map(score, itertools.product(range(3), repeat=4))))  # noqa: B023
