"""Queries over more rows, pairs, words and readings than any smaller job would keep."""

from __future__ import annotations

import pytest

from harfgah.engine import tables_from
from harfgah.plans import candidates as D
from harfgah.plans import conversion
from harfgah.plans import corpus as P
from harfgah.plans import metrics as H


@pytest.fixture(scope="module")
def pairs_dir(spark, tmp_path_factory):
    """3,300 different pairs, three times each."""
    d = tmp_path_factory.mktemp("pairs")
    letters = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنهوی"
    word = lambda i: letters[i // 1024 % 32] + letters[i // 32 % 32] + letters[i % 32]
    rows = [(3 * i + k, "train", "typed_lines", f"{word(i)} {word(i + 3300)}", None) for i in range(3300) for k in range(3)]
    spark.createDataFrame(rows, "example_id long, split string, source string, persian string, latin string").write.parquet(f"{d}/example.parquet")
    spark.createDataFrame([], "loan_id long, en string, fa string, category string, claude string, luna string").write.parquet(f"{d}/loanwords.parquet")
    return str(d)


def test_pairs_beyond_three_thousand(spark, pairs_dir):
    assert P.bigram_pmi_top(spark, pairs_dir).count() == P.bigram_delta_ids(spark, pairs_dir).count() == 3300
    assert P.bigram_live_vocab(spark, pairs_dir).count() == 6600
    assert P.bigram_lookup(spark, pairs_dir).where("score > 0").count() == 3300
    assert len(conversion.engine(spark, pairs_dir).tables.bigrams) == 3300


@pytest.fixture(scope="module")
def lines_dir(spark, tmp_path_factory):
    """A form with ten readings, most often in training lines; one line has no split."""
    d = tmp_path_factory.mktemp("lines")
    readings = ["سر", "سیر", "سار", "صر", "سور", "سیار", "سرو", "سری", "سرا", "صور"]
    texts = [(f"{x} من", "sr man") for i, x in enumerate(readings) for _ in range(20 - i)] + [("سور خوب", "sr khub")] * 9
    rows = [(i, None if i == 0 else "test" if i % 50 == 1 else "train", "typed_lines", fa, latin) for i, (fa, latin) in enumerate(texts)]
    spark.createDataFrame(rows, "example_id long, split string, source string, persian string, latin string").write.parquet(f"{d}/example.parquet")
    return str(d)


def test_eight_readings(spark, lines_dir):
    rows = D.QUERIES["candidate_softmax"](spark, lines_dir).where("typed = 'sr'").collect()
    assert sorted(r["ord"] for r in rows) == list(range(8)) and sum(r["probability"] for r in rows) == pytest.approx(1, abs=1e-3)
    r = H.oracle_recall(spark, lines_dir).collect()[0]
    assert r["oracle"] == r["n_words"] > r["top_8"] > r["top_3"]
    assert sorted(r["place"] for r in H.candidate_hits(spark, lines_dir).collect()) == list(range(10))


def test_every_line(spark, lines_dir):
    import duckdb

    n = spark.read.parquet(f"{lines_dir}/example.parquet").count()
    for name, text in (("document_confidence", "text"), ("viterbi_path", "chosen"), ("text_alternatives", "text")):
        rows = D.QUERIES[name](spark, lines_dir).collect()
        assert len({r["example_id"] for r in rows}) == n and 0 in {r["example_id"] for r in rows}
        if name == "viterbi_path":
            chosen = {r["example_id"]: r[text] for r in rows}
    assert D.QUERIES["context_runs"](spark, lines_dir).count() == n
    # only "سور خوب" is a pair with positive information, and its first word is the form's fifth reading
    assert {chosen[i] for i in range(n - 9, n)} == {"سور خوب"}
    con = duckdb.connect()
    con.sql(f"create view example as select * from '{lines_dir}/example.parquet/*.parquet'")
    assert dict(con.sql(D.ORACLES["viterbi_path"]).fetchall()) == chosen
    want = con.sql(f"select example_id, text, rank from ({D.ORACLES["text_alternatives"]})").fetchall()
    assert sorted(map(tuple, D.QUERIES["text_alternatives"](spark, lines_dir).select("example_id", "text", "rank").collect())) == sorted(want)


def test_documents_are_converted(spark, pairs_dir):
    spark.createDataFrame([(1, "salam"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{pairs_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in conversion.transliterate_full(spark, pairs_dir).collect()}
    assert set(rows) == {1, 2, 3} and rows[1] != "salam"


def test_every_loanword(spark):
    counts = spark.createDataFrame([("من", 1)], "word string, score int")
    loans = spark.range(50_001).selectExpr("lpad(id, 6, '0') as typed", "'وام' as output")
    assert len(tables_from(counts, loans).loanwords) == 50_001
    with pytest.raises(ValueError, match="loanwords"):
        tables_from(counts, loans, most=50_000)
    with pytest.raises(ValueError, match="pairs"):
        tables_from(counts, pairs=spark.range(3).selectExpr("'a' as head", "'b' as tail", "1.0D as pmi"), most=2)


def test_words_beyond_two_thousand(spark, pairs_dir):
    assert P.unigram_logquant(spark, pairs_dir).count() == conversion.front_decode(spark, pairs_dir).count() == 6600
    assert P.vocab_coverage(spark, pairs_dir).collect()[0]["coverage"] == 1.0
    assert P.supplement_words(spark, pairs_dir).count() == 0


def test_every_label(spark, tmp_path):
    rows = [(["", "ا", f"l{i:03}"],) for i in range(150) for _ in range(2)] + [(["once"],)]
    spark.createDataFrame(rows, "labels array<string>").write.parquet(f"{tmp_path}/example.parquet")
    got = {r["label"]: r["rank"] for r in P.label_vocab(spark, str(tmp_path)).collect()}
    assert sorted(got.values()) == list(range(152)) and got[""] == 0 and got["ا"] == 1 and "once" not in got
