from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_the_rest_does_without_the_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['harfgah.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
@pytest.mark.parametrize("name", ["naive_transliterate_docs", "token_offsets", "bigram_pmi_top", "skeleton_topk", "word_accuracy", "judge_kappa", "quantize_rows"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.sql(f"create view {f.split('.')[0]} as select * from '{TABLES}/{f}'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, TABLES)
    cell = lambda v: tuple(v) if isinstance(v, list) else v
    want = sorted((tuple(cell(r[rel.columns.index(c)]) for c in sorted(rel.columns)) for r in rel.fetchall()), key=str)
    assert sorted((tuple(cell(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str) == want and want


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
