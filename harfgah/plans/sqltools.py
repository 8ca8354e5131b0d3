"""Pieces of DuckDB SQL that several oracles share.

Character maps and the correspondences are data that both sides read from the same tables, as values of the format; the
steps that use them are written in SQL on their own.
"""

from __future__ import annotations

from harfgah.functions.fold import DEAD_INVISIBLES, DISPLAY, HAMZA_ABOVE, MATCH, ZWNJ, NormalForm, translate_sql
from harfgah.functions.tables import SPLIT_MARKS, first_choice, latin_units


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def split_sql(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[ \t\n\f\r]+'), lambda part: part <> '')"


def match_key_sql(x: str) -> str:
    flat = {k: v.replace(HAMZA_ABOVE, "") for k, v in MATCH.pairs().items()} | dict.fromkeys("‍﻿‎‏؜" + ZWNJ + HAMZA_ABOVE, "")
    return f"array_to_string({split_sql(f'lower({translate_sql(x, flat)})')}, ' ')"


def leak_key_sql(x: str) -> str:
    return match_key_sql(f"translate({x}, {quoted(SPLIT_MARKS)}, {quoted(' ' * len(SPLIT_MARKS))})")


def metric_words_sql(x: str) -> str:
    marks = SPLIT_MARKS + ZWNJ
    return split_sql(f"translate({fold_stretches_sql(x)}, {quoted(marks)}, {quoted(' ' * len(marks))})")


def fold_stretches_sql(x: str) -> str:
    for c in "ءآأؤإئابةتثجحخدذرزژسشصضطظعغفقکكگلمنهویيىپچ":
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}', 'g')"
    return x


def normal_sql(x: str, form: NormalForm = DISPLAY) -> str:
    """The normal form without compatibility forms: dead characters gone, letters mapped, joiners only between letters."""
    x = translate_sql(translate_sql(x, dict.fromkeys(DEAD_INVISIBLES, "")), form.pairs())
    for a, b in ((f"{ZWNJ}+", ZWNJ), (rf"{ZWNJ}([\s\p{{P}}])", r"\1"), (rf"([\s\p{{P}}]){ZWNJ}", r"\1"), (f"^{ZWNJ}|{ZWNJ}$", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def units_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted('|'.join([*latin_units(), '(?s:.)']))}, 0)"


def naive_word_sql(x: str) -> str:
    keys, values = zip(*sorted(first_choice().items()), strict=True)
    table = f"map([{', '.join(map(quoted, keys))}], [{', '.join(map(quoted, values))}])"
    return (
        f"array_to_string(list_transform({units_sql(f'lower({x})')}, lambda u, i: coalesce({table}"
        f"[u || '|' || case when i = 1 then 'initial' when i = len({units_sql(f'lower({x})')}) then 'final' else 'medial' end], u)), '')"
    )


def unstretch_sql(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c * 2 if c in 'ao' else c}', 'g')"
    return x


def values_sql(rows: list[tuple], names: str) -> str:
    """A table of constants; text is quoted, None is null."""
    cell = lambda v: "null" if v is None else quoted(v) if isinstance(v, str) else repr(v)
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as t({names})"
