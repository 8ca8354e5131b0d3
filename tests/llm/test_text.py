from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from harfgah.llm.lookalikes import consistent, kinds
from harfgah.llm.text import TO_LATIN, Words, key_of, resolve, spell, words_of
from tests.llm import brute

LETTERS = "abز س‌کي ىكةۀأإآ12۳٤ـًٓٔéаеорсﺎﻼﭗｆ．​­﻿⁦ \t\n\xa0_-؟😂ßİ"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(LETTERS), max_size=12)), max_size=8))
def test_a_batch_gives_what_each_text_gives_alone(texts):
    w = Words(texts)
    assert w.n == len(texts)
    for i, t in enumerate(texts):
        assert w.of(i) == words_of(t)
    assert [len(w.of(i)) for i in range(w.n)] == w.size.tolist()
    if texts:
        assert w.keys() == ["".join(w.of(i)) for i in range(w.n)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(LETTERS), max_size=16))
def test_words_are_those_of_the_definition(text):
    assert words_of(text) == brute.words(text)


def test_hashes_depend_on_the_word_alone():
    a, b = Words(["salam خوبی salam", None, ""]), Words(["x خوبی"])
    assert a.hash[0] == a.hash[2] and a.hash[1] == b.hash[1] and a.hash[0] != a.hash[1]
    assert Words(["خوب ی"]).key_hash()[0] == Words(["خوبی!"]).key_hash()[0] != 0
    assert Words([None, "", "؟!"]).key_hash().tolist() == [0, 0, 0]


def test_one_spelling_for_a_token():
    assert spell("аррle") == "apple"  # mixed
    assert spell("сор") == "cop"  # wholly of look-alikes
    assert spell("привeт") == "привет"  # only Cyrillic can spell it
    assert spell("fжa") == "fжa"  # no script can
    assert spell("Σо") == "Σο"  # only Greek can
    assert spell("café") == "café"
    assert resolve("kitаb کتاب") == "kitab کتاب"
    assert all(unicodedata.category(a) in ("Lo", "Lm") or unicodedata.category(a)[1] == unicodedata.category(b)[1] for a, b in TO_LATIN.items())
    assert len(TO_LATIN) > 150 and all(b.isascii() and b.isalpha() for b in TO_LATIN.values())
    assert [resolve(x) for x in "ɡ ı ӏ ᴏ ꓐ Ꭺ ߀ υ ν ѵ ҽ ⲟ ꮯ Ӏ Ι".split()] == list("giioBA0uvvepc".replace("p", "o")) + ["I", "I"]
    assert resolve("мир λόγος خوب ۱۲ ٣") == "мир λόγος خوب ۱۲ ٣"


def test_tables_of_confusables_in_both_formats(tmp_path):
    from harfgah.llm import confusables

    t = tmp_path / "confusables.txt"
    t.write_text("# x\n0430 ;\t0061 ;\tMA\t# comment\n0132 ; 006C 004A ; MA\n", encoding="utf-8")
    got = confusables.skeletons(str(t))
    assert got == {"а": "a", "Ĳ": "lJ"} and all(confusables.skeletons()[k] == v for k, v in got.items())


def test_equal_looking_texts_are_equal():
    same = ["کتاب café", "كتاب café ", "ﻛﺘﺎﺏ　ｃａｆｅ́", "کتاب​ cаfé﻿"]
    assert len({consistent([t])[0] for t in same}) == 1
    different = ["تن‌ها", "تنها", "Tanha", "tanha", "آب", "اب", "مسؤول", "مسوول", "1", "۱", "سلام؟", "سلام?"]
    assert len(set(consistent(different))) == len(different)
    assert consistent([None, "", " ​ "]) == [None, "", ""]
    assert consistent(["a‌", "‌b", "تن‌‌ها"]) == ["a", "b", "تن‌ها"]


def test_kinds():
    assert kinds("аpple сор normal") == (1, 1, 0)
    assert kinds("a​b­") == (0, 0, 2)
    assert kinds(None) == kinds("plain") == (0, 0, 0)


def test_very_long_text():
    assert key_of("سلام " * 300_000) == "سلام" * 300_000
