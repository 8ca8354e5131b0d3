from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from harfgah.operators import corpus as C
from harfgah.operators.order import indexed
from harfgah.operators.stats import bootstrap, interval
from harfgah.sources import codecs, readers, sinks
from harfgah.streaming import streams


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    p = write(tmp_path / "e.jsonl", [json.dumps({"id": "a", "input": "x", "expected": None}), json.dumps({"id": "b", "input": "y", "expected": "z", "alternatives": ["w"], "category": "chat"})])
    assert [(r["category"], r["alternatives"], r["expected"]) for r in readers.evaluation(spark, p).orderBy("id").collect()] == [("gold", [], None), ("chat", ["w"], "z")]
    with pytest.raises(Exception):
        readers.training(spark, write(tmp_path / "bad.jsonl", ['{"latin": "a"', "x"])).collect()
    t = write(tmp_path / "l.tsv", ["en\tfa\tcategory\tclaude\tluna\tclaude_reason\tluna_reason", 'file\tفایل\ttech\taccept\treject\t\t"x'])
    assert readers.lexical(spark, t).first()["luna_reason"] == '"x'
    s = write(tmp_path / "s.jsonl", ['{"text": "a b"}', '{"words": ["c", "d"]}'])
    assert {r["text"] for r in readers.sentences(spark, s).collect()} == {"a b", "c d"}
    assert [r["text"] for r in readers.sentences(spark, write(tmp_path / "s.txt", ["# x", "", "سلام"])).collect()] == ["سلام"]
    spark.createDataFrame([("q", 1)], "g string, n int").write.parquet(str(tmp_path / "s.parquet"))
    assert readers.sentences(spark, str(tmp_path / "s.parquet"), "g").columns == ["text"]
    g = write(tmp_path / "p.tsv", ["h\th", "Salam.\tسلام", "salam\tدیگر", "short", "x\t"])
    assert [tuple(r) for r in readers.pairs(spark, g, 0, 1, header=True).collect()] == [("salam", "سلام")]
    d, a = write(tmp_path / "w.dic", ["2", "کتاب/aabb", "x"]), write(tmp_path / "w.aff", ["SFX aa Y 1", "SFX aa 0 ها/cc .", "SFX bb اب ا .", "SFX cc 0 ی ."])
    forms = readers.expanded(readers.hunspell_words(spark, d), readers.hunspell_affixes(spark, a))
    assert {r["form"] for r in forms.collect()} == {"کتاب", "x", "کتابها", "کتابهای", "کتا"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(23)], "id long, t string").repartition(5)
    sinks.shards(df, str(tmp_path / "a"), 4, ["id"], start=10)
    got = spark.read.json(str(tmp_path / "a"))
    assert {r["shard"]: sorted(x["id"] for x in got.where(F.col("shard") == r["shard"]).collect()) for r in got.select("shard").distinct().collect()} == {10 + k: list(range(k, 23, 4)) for k in range(4)}
    sinks.shards(df, str(tmp_path / "b"), 4, ["id"], contiguous=True)
    assert sorted(r["n"] for r in spark.read.json(str(tmp_path / "b")).groupBy("shard").agg(F.count("*").alias("n")).collect()) == [5, 6, 6, 6]
    with pytest.raises(Exception):
        sinks.shards(df, str(tmp_path / "a"), 4, ["id"])
    a, b = sinks.manifest(df).first(), sinks.manifest(df.orderBy(F.desc("t"))).first()
    assert a == b and a["rows"] == 23 and sinks.manifest(df.limit(22)).first() != a and sinks.manifest(df.limit(0)).first()["rows"] == 0
    sinks.write_with_manifest(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m.manifest")).first()["rows"] == 23


def test_codecs():
    words = ["سلام", "سلامت", "کتاب", "می‌روم", "a"]
    data = codecs.words_to_bytes(words)
    assert codecs.words_from_bytes(data) == (sorted(words), len(data)) and codecs.words_from_bytes(codecs.words_to_bytes([]))[0] == []
    f = {"سلام": 255, "کتاب": 3}
    assert codecs.frequencies_from_bytes(codecs.frequencies_to_bytes(f)) == {w: s / 255 for w, s in f.items()}
    p = {("a", "b"): 9, ("a", "z" * 300): 255, ("q", "a"): 1}
    assert codecs.pairs_from_bytes(codecs.pairs_to_bytes(p)) == {k: v / 255 for k, v in p.items()}
    v = {"کتاب": "eA", "سر": "", "x": "aei"}
    assert codecs.vowels_from_bytes(codecs.vowels_to_bytes(v)) == v
    for n in (0, 1, 127, 128, 300, 2**31):
        assert codecs.from_varint(codecs.varint(n), 0) == (n, len(codecs.varint(n)))
    for decode, whole in ((lambda b: codecs.words_from_bytes(b), data), (codecs.frequencies_from_bytes, codecs.frequencies_to_bytes(f)), (codecs.pairs_from_bytes, codecs.pairs_to_bytes(p)), (codecs.vowels_from_bytes, codecs.vowels_to_bytes(v))):
        for cut in range(len(whole)):
            with pytest.raises(ValueError):
                decode(whole[:cut])


def test_order_and_draws(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "a long, b long").repartition(6)
    rows = indexed(df, ["a", "b"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(100)) and [(r["a"], r["b"]) for r in rows] == sorted((i % 7, i) for i in range(100))
    assert indexed(df.limit(0), ["a"]).count() == 0
    assert sorted(C.hash_rank(df, "s", "b", 9).collect()) == sorted(C.hash_rank(df.repartition(2), "s", "b", 9).collect())
    counts = df.select(F.col("b").alias("id"), (F.col("b") % 3).alias("x"), F.lit(3).alias("y"))
    s = bootstrap(counts, ["id"], {"m": ("x", "y")}, 40, "7").cache()
    assert s.count() == 40 and sorted(s.collect()) == sorted(bootstrap(counts.repartition(3), ["id"], {"m": ("x", "y")}, 40, "7").collect())
    i = interval(s, "m", 40).first()
    assert i["lo"] <= 1 / 3 <= i["hi"] and bootstrap(counts.limit(0), ["id"], {"m": ("x", "y")}, 5, "7").count() == 0


def test_streams(spark, tmp_path):
    rows = [(1, "salam", "2025-01-01 10:00:00", "a"), (1, "khubi", "2025-01-01 11:00:00", "a"), (2, None, "2025-01-02 10:00:00", "b")]
    spark.createDataFrame(rows, "id long, t string, s string, kind string").select("id", "t", F.to_timestamp("s").alias("at"), "kind").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long, t string, at timestamp, kind string").parquet(str(tmp_path / "in"))
    streams.run_once(streams.converted(stream(), "t"), str(tmp_path / "out")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    streams.run_once(streams.windowed_counts(stream(), "at", "kind"), str(tmp_path / "w")).awaitTermination(60)
    assert [tuple(r)[1:] for r in spark.read.schema("start timestamp, kind string, n long").parquet(str(tmp_path / "w")).collect()] == [("a", 2)]
    q = streams.latest(stream(), "id", ["at"], ["t"]).writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["id"]: r["t"] for r in spark.sql("select * from last").collect()} == {1: "khubi", 2: None}


def test_headers_and_counts_of_every_file(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"p{i}.tsv", ["typed\tfa", f"w{i}\tو{i}", "same\tیک"])
        write(tmp_path / f"w{i}.dic", ["2", f"stem{i}/aa", "x"])
    rows = {tuple(r) for r in readers.pairs(spark, str(tmp_path / "*.tsv"), 0, 1, header=True).collect()}
    assert rows == {("same", "یک"), ("w0", "و0"), ("w1", "و1"), ("w2", "و2")}
    assert {r["stem"] for r in readers.hunspell_words(spark, str(tmp_path / "*.dic")).collect()} == {"stem0", "stem1", "stem2", "x"}
    lines = write(tmp_path / "l.txt", ["a یک", "noblank", " دو", "a سه چهار"])
    assert [tuple(r) for r in readers.pair_list(spark, lines).collect()] == [("a", "سه چهار")]
    marks = write(tmp_path / "m.txt", ["# no", "", "سلام", "!می‌شود"])
    assert {tuple(r) for r in readers.markers(spark, marks).collect()} == {("سلام", False), ("میشود", True)}


def test_an_address_is_read(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
    from urllib.error import HTTPError

    write(tmp_path / "t.tsv", ["typed\tfa", "Salam.\tسلام", "short"])
    handler = partial(SimpleHTTPRequestHandler, directory=str(tmp_path))
    with ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{server.server_address[1]}"
        path = readers.fetched(spark, f"{base}/t.tsv")
        assert [tuple(r) for r in readers.pairs(spark, path, 0, 1, header=True).collect()] == [("salam", "سلام")]
        with pytest.raises(HTTPError):
            readers.fetched(spark, f"{base}/none")
        server.shutdown()


def test_artifacts_of_each_kind(spark):
    said = {"سلام": "salAm", "کتاب": "ketAb"}
    assert codecs.pronunciations_from_bytes(codecs.pronunciations_to_bytes(said) + b"x\n\ty\n") == said and codecs.short_vowels("ketAbo") == ["e", "o"]
    rows = spark.createDataFrame([("a", bytearray(codecs.words_to_bytes(["ب", "ا"]))), ("b", None)], "n string, d binary").withColumn("name", F.lit(1))
    assert [tuple(r) for r in codecs.decoded(rows.drop("name"), "n", "d", "words").collect()] == [("a", 0, "ا"), ("a", 1, "ب")]
    cut = spark.createDataFrame([("a", bytearray(codecs.words_to_bytes(["ب", "ا"])[:-1]))], "n string, d binary")
    with pytest.raises(Exception, match="cut off"):
        codecs.decoded(cut, "n", "d", "words").collect()


def test_stale_references_are_refused(spark):
    rows, refs = spark.createDataFrame([("a",), ("b",), ("b",)], "sha string"), spark.createDataFrame([("b", 1), ("c", 2)], "sha string, ref int")
    assert sorted(tuple(r) for r in C.attached(rows, refs.where("sha = 'b'"), "sha", refuse=True).na.fill(0).collect()) == [("a", 0), ("b", 1), ("b", 1)]
    assert [r["sha"] for r in C.stale(rows, refs, "sha").collect()] == ["c"]
    with pytest.raises(ValueError, match="1 references"):
        C.attached(rows, refs, "sha", refuse=True)


def test_six_bits_and_scans(spark):
    import numpy as np

    from harfgah.operators import tensors as M

    df = spark.createDataFrame([(1, [0.0, 3.1, -3.1, 1.0], [1.0, 0.0, 0.5, 0.5]), (2, [], []), (3, None, [1.0]), (4, [2.0], [0.25])], "id int, v array<double>, g array<double>")
    rows = {r["id"]: r for r in df.select("id", M.letters_of(M.row_codes(F.col("v"), 31)).alias("l"), M.codes_of(M.letters_of(M.row_codes(F.col("v"), 31))).alias("c"), M.convex_scan(F.col("g"), F.col("v")).alias("f"), M.convex_scan(F.col("g"), F.col("v"), back=True).alias("b")).collect()}
    assert rows[1]["l"] == "f+Ap" and rows[1]["c"] == [0, 31, -31, 10] and rows[2]["l"] == "" and rows[2]["c"] == [] and rows[2]["f"] == []
    assert rows[3]["l"] is None and rows[3]["f"] is None and rows[4]["f"] == rows[4]["b"] == [1.5]
    np.testing.assert_allclose(rows[1]["f"], [0.0, 3.1, 0.0, 0.5])
    np.testing.assert_allclose(rows[1]["b"], [3.1, 3.1, -1.3, 0.5])
    with pytest.raises(Exception, match="no code"):
        spark.createDataFrame([("a!",)], "l string").select(M.codes_of(F.col("l"))).collect()
    w = M.Weights.random("ab", ["", "x"])
    for name, (codes, scales, shape) in w.quantised(31, 6).items():
        m = w.matrices()[name]
        assert len(codes) == m.size and np.abs(M.dequantised(codes, scales, shape, 6) - m).max() <= max(scales) / 2 + 1e-6
    with pytest.raises(ValueError):
        M.dequantised("!" + codes[1:], scales, shape, 6)


def test_zeros_of_six_bits_have_a_sign(spark, tmp_path):
    import duckdb

    from harfgah.plans import artifacts

    vecs = [[1.0, -0.001, 0.001, -1.0], [1.0, -0.0, 0.0], [1e-12, -1e-12], [31.0, 0.5, -0.5, 1.5], [1.0, None, -0.001], [1e-12, None], [], None]
    spark.createDataFrame(list(enumerate(vecs)), "vec_id int, embedding array<float>").selectExpr("vec_id", "'a' as label", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    # as text, since -0.0 == 0.0
    want = sorted(map(str, con.sql(artifacts.ORACLES["six_bit_codes"]).fetchall()))
    assert sorted(str(tuple(r)) for r in artifacts.six_bit_codes(spark, str(tmp_path)).collect()) == want and "(0, '+ffA', [1.0, -0.0, 0.0, -1.0])" in want


def test_very_many_different_words(spark):
    from harfgah.operators import alignment as A

    n = len(A.SYMBOLS) // 2
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("a"), i.cast("string"))).alias("a"))
    same = df.select(A.word_errors(F.slice("a", 1, 50), F.concat(F.slice("a", 1, 49), F.array(F.lit("z")))).alias("e")).first()["e"]
    assert same == 1
    with pytest.raises(Exception, match="different words"):
        df.select(A.word_errors(F.col("a"), F.concat(F.transform("a", lambda x: F.concat(F.lit("b"), x)), F.array(F.lit("c"))))).collect()
