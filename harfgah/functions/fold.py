"""Canonical and lookup forms of Persian text.

Every step that maps single characters is put into one table for str.translate, made per option set; what is left are
NFKC before it, the hygiene of the zero-width non-joiner after it and NFC at the end. The same tables are turned into
Spark column expressions (no NFKC there) and into SQL, so that all three agree on text without compatibility forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZWNJ = "‌"
HAMZA_ABOVE = "ٔ"

# Fixed values of the project's normal form.
DEAD_INVISIBLES = "‍﻿‎‏؜"
MARKS = "ـًٌٍَُِّْٰ"
LETTERS = {
    "ى": "ی",
    "ي": "ی",
    "ۍ": "ی",
    "ے": "ی",
    "ې": "ی",
    "ك": "ک",
    "ڪ": "ک",
    "ہ": "ه",
    "ە": "ه",
    "ۀ": "هٔ",
    "ٱ": "ا",
}
HAMZA_ALEF = {"أ": "ا", "إ": "ا"}
TEH_MARBUTA = {"ة": "ه"}
PUNCTUATION = {"?": "؟", ";": "؛", ",": "،"}
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
LATIN_DIGITS = "0123456789"


@dataclass(frozen=True)
class NormalForm:
    """digits: persian (Arabic-Indic ones become Persian), latin (both become ASCII) or preserve."""

    digits: str = "persian"
    hamza_alef: bool = True
    teh_marbuta: bool = True
    punctuation: bool = False
    collapse: bool = False

    def pairs(self) -> dict[str, str]:
        """The single-character map of this form; removed characters map to nothing."""
        out = dict.fromkeys(MARKS, "") | LETTERS
        if self.hamza_alef:
            out |= HAMZA_ALEF
        if self.teh_marbuta:
            out |= TEH_MARBUTA
        if self.digits == "persian":
            out |= dict(zip(ARABIC_DIGITS, PERSIAN_DIGITS, strict=True))
        elif self.digits == "latin":
            out |= dict(zip(ARABIC_DIGITS + PERSIAN_DIGITS, LATIN_DIGITS * 2, strict=True))
        elif self.digits != "preserve":
            raise ValueError(f"digits: {self.digits!r}")
        if self.punctuation:
            out |= PUNCTUATION
        return out


DISPLAY = NormalForm()
MATCH = NormalForm(digits="latin", collapse=True)

_dead = dict.fromkeys(map(ord, DEAD_INVISIBLES))
_loose = regex.compile(rf"(?<![^\s\p{{P}}]){ZWNJ}+|{ZWNJ}+(?![^\s\p{{P}}])|(?<={ZWNJ}){ZWNJ}+")
_blanks = regex.compile(r"[^\S\n]+")
_around_newline = regex.compile(r" ?\n ?")


@cache
def table_of(form: NormalForm) -> dict[int, str]:
    return str.maketrans(form.pairs())


def tidy_zwnj(s: str) -> str:
    """Keep one non-joiner of a run, and none beside blanks, punctuation or an end."""
    return _loose.sub("", s) if ZWNJ in s else s


def normalize(text: str | None, form: NormalForm = DISPLAY) -> str | None:
    """The canonical form; None stays None."""
    if not text:
        return text
    s = unicodedata.normalize("NFKC", text.translate(_dead)).translate(table_of(form))
    s = tidy_zwnj(s)
    if form.collapse:
        s = _around_newline.sub("\n", _blanks.sub(" ", s)).strip()
    return unicodedata.normalize("NFC", s)


def fold(text: str | None) -> str | None:
    """The lossy lookup key: no non-joiner, no hamza above, lower case, ASCII digits, single blanks."""
    s = normalize(text, MATCH)
    return s and s.replace(ZWNJ, "").replace(HAMZA_ABOVE, "").lower()


def is_normal(text: str, form: NormalForm = DISPLAY) -> bool:
    return normalize(text, form) == text


def with_forms(df: DataFrame, column: str, form: NormalForm = DISPLAY, normal: str = "normal", key: str = "match_key") -> DataFrame:
    """Add the canonical and the lookup form of a text column, in Arrow batches. Null gives null, empty gives empty."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (normal, key)] + [T.StructField(normal, T.StringType()), T.StructField(key, T.StringType())])
    kept = [f.name for f in schema.fields[:-2]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            made = [pa.array([normalize(x, form) for x in texts], pa.string()), pa.array([fold(x) for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + made, names=[*kept, normal, key])

    return df.mapInArrow(work, schema)


# Column expressions: the same steps without NFKC and NFC.


def translated(c: Column, pairs: dict[str, str]) -> Column:
    """One translate for the one-to-one part and the removals, a replace for each pair that grows."""
    flat = {k: v for k, v in pairs.items() if len(v) == 1} | {k: v for k, v in pairs.items() if not v}
    if flat:
        c = F.translate(c, "".join(flat), "".join(flat.values()))
    for k, v in pairs.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def normalize_column(c: Column, form: NormalForm = DISPLAY) -> Column:
    c = translated(translated(c, dict.fromkeys(DEAD_INVISIBLES, "")), form.pairs())
    c = F.regexp_replace(c, rf"(?<![^\s\p{{P}}]){ZWNJ}+|{ZWNJ}+(?![^\s\p{{P}}])|(?<={ZWNJ}){ZWNJ}+", "")
    if form.collapse:
        c = F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t\f\r]+", " "), " ?\n ?", "\n"))
    return c


def fold_column(c: Column) -> Column:
    return F.lower(F.translate(normalize_column(c, MATCH), ZWNJ + HAMZA_ABOVE, ""))


def translate_sql(expr: str, pairs: dict[str, str]) -> str:
    """The same map as a DuckDB expression."""
    flat = {k: v for k, v in pairs.items() if len(v) == 1} | {k: v for k, v in pairs.items() if not v}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({expr}, {quote(''.join(flat))}, {quote(''.join(flat.values()))})" if flat else expr
    for k, v in pairs.items():
        if len(v) > 1:
            out = f"replace({out}, {quote(k)}, {quote(v)})"
    return out
