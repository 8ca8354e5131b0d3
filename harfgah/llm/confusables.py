"""Letters that look like a Latin letter, by the table of confusable characters that the Unicode consortium publishes.

The table is read from the copy that Spark's own library for collations has in its jar, or from a confusables.txt.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zipfile
from functools import cache
from glob import glob

import regex

#: A jar with the table, or a confusables.txt; unset: the jar of the Spark that runs.
SOURCE = os.environ.get("UNICODE_CONFUSABLES", "")
#: Alphabets of which ten letters or more look like Latin ones; words in them are told apart from look-alikes.
SCRIPTS = ("cyrillic", "greek", "armenian", "cherokee", "coptic", "lisu")
_of = {s: regex.compile(rf"\p{{Script={s.title()}}}") for s in ("latin", *SCRIPTS)}
# Look-alikes that the table lacks.
MORE = {"Ԛ": "Q"}
_MAGIC = 0x3845FDEF


def _jar() -> str:
    import pyspark

    for folder in (os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", ""), os.path.join(os.path.dirname(pyspark.__file__), "../..")):
        if found := glob(os.path.join(folder, "jars", "icu4j-*.jar")):
            return found[0]
    raise FileNotFoundError("no table of confusable characters: set UNICODE_CONFUSABLES to a confusables.txt or to an icu4j jar")


def _from_jar(path: str) -> dict[str, str]:
    """The compiled table: sorted code points, each with the one character it stands for or a place in a string."""
    with zipfile.ZipFile(path) as jar:
        name = next(x for x in jar.namelist() if x.endswith("confusables.cfu"))
        data = jar.read(name)
    start = struct.unpack_from(">H", data)[0]
    magic, _, _, keys_at, n_keys, values_at, n_values, text_at, n_text = struct.unpack_from(">9i", data, start)
    if magic != _MAGIC or n_keys != n_values:
        raise ValueError(f"{path}: {name} isn't a table of confusable characters")
    keys = struct.unpack_from(f">{n_keys}i", data, start + keys_at)
    values = struct.unpack_from(f">{n_values}H", data, start + values_at)
    text = data[start + text_at : start + text_at + 2 * n_text].decode("utf-16-be", "surrogatepass")
    return {chr(k & 0xFFFFFF): chr(v) if k >> 24 == 0 else text[v : v + (k >> 24) + 1] for k, v in zip(keys, values, strict=True)}


def _from_text(path: str) -> dict[str, str]:
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            cells = line.partition("#")[0].split(";")
            if len(cells) >= 2:
                source, into = ("".join(chr(int(x, 16)) for x in c.split()) for c in cells[:2])
                if len(source) == 1:
                    out[source] = into
    return out


@cache
def skeletons(source: str = SOURCE) -> dict[str, str]:
    return _from_text(source) if source.endswith(".txt") else _from_jar(source or _jar())


def _letter(c: str, like: str) -> str | None:
    """The ASCII letter that c looks like in its own case; None if there is none."""
    kind = unicodedata.category(c)
    if kind[0] != "L" or len(like) != 1 or not like.isascii() or not like.isalpha() or unicodedata.normalize("NFKC", c) != c:
        return None
    # the table writes a capital I, and all that looks like it, as a small l
    if like == "l" and kind != "Ll":
        return "I"
    return None if (kind == "Lu" and like.islower()) or (kind == "Ll" and like.isupper()) else like


@cache
def lookalikes() -> dict[str, dict[str, str]]:
    """Of each alphabet, and of the Latin one beyond ASCII, its letters that look like an ASCII letter of the same case."""
    out: dict[str, dict[str, str]] = {s: {} for s in ("latin", *SCRIPTS)}
    for c, like in sorted((MORE | skeletons()).items()):
        if not c.isascii() and (letter := _letter(c, like)):
            for script, p in _of.items():
                if p.match(c):
                    out[script][c] = letter
    return out


@cache
def digits() -> dict[str, str]:
    """Digits of other scripts that look like an ASCII digit; those of the Arabic script are the normal form's matter."""
    zero_one = {"O": "0", "o": "0", "l": "1"}
    arabic = regex.compile(r"[\p{Script=Arabic}٠-٩۰-۹]")
    found = {c: zero_one.get(like, like) for c, like in skeletons().items() if unicodedata.category(c) == "Nd" and not c.isascii() and not arabic.match(c)}
    return {c: like for c, like in found.items() if len(like) == 1 and like.isascii() and like.isdigit() and unicodedata.normalize("NFKC", c) == c}
