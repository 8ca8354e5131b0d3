from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harfgah.functions.fold import DISPLAY, NormalForm, fold, is_normal, normalize, normalize_column, with_forms

CASES = [
    ("كتاب", "کتاب", "کتاب"),
    ("علي", "علی", "علی"),
    ("خانۀ", "خانهٔ", "خانه"),
    ("خانهٔ", "خانهٔ", "خانه"),
    ("مدرسة", "مدرسه", "مدرسه"),
    ("إسم أحمد", "اسم احمد", "اسم احمد"),
    ("ســلام", "سلام", "سلام"),
    ("مُحَمَّد", "محمد", "محمد"),
    ("تن‌‌ها", "تن‌ها", "تنها"),
    ("سلام‌ ‌دنیا", "سلام دنیا", "سلام دنیا"),
    ("‌سلام‌", "سلام", "سلام"),
    ("٣ ۴ 5", "۳ ۴ 5", "3 4 5"),
    ("ﺳﻼﻡ", "سلام", "سلام"),
    ("Café", "Café", "café"),
    ("a‏b﻿", "ab", "ab"),
    ("  a   b  ", "  a   b  ", "a b"),
    ("", "", ""),
]


@pytest.mark.parametrize(("text", "shown", "key"), CASES)
def test_forms(text, shown, key):
    assert normalize(text) == shown and is_normal(shown) and fold(text) == key


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("كيىةۀ‌‍ﻻ٣۴ \n.؟éـًآأ"), st.characters(max_codepoint=0x6FF)), max_size=12))
def test_normal_form_is_stable(text):
    once = normalize(text)
    assert normalize(once) == once and unicodedata.is_normalized("NFC", once)


def test_options():
    assert normalize("٣ ۴", NormalForm(digits="preserve")) == "٣ ۴"
    assert normalize("أة", NormalForm(hamza_alef=False, teh_marbuta=False)) == "أة"
    assert normalize("a?;,", NormalForm(punctuation=True)) == "a؟؛،"
    with pytest.raises(ValueError):
        NormalForm(digits="roman").pairs()


def test_columns_agree_with_the_function(spark):
    rows = [(t,) for t, *_ in CASES if unicodedata.is_normalized("NFKC", t)] + [(None,)]
    df = with_forms(spark.createDataFrame(rows, "t string"), "t").withColumn("c", normalize_column(F.col("t"), DISPLAY))
    for r in df.collect():
        assert r["normal"] == r["c"] == normalize(r["t"]) and r["match_key"] == fold(r["t"])
