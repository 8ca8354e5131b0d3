"""Problem 4: visually identical text with different characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harfgah.functions.fold import DISPLAY, tidy_zwnj
from harfgah.llm.arrow import map_batches, pieces
from harfgah.llm.text import INVISIBLE, LOOKALIKES, SEP, Codes, _foreign, _script, _token, scripts_of
from harfgah.operators.skew import hot_keys, salted_join
from harfgah.session import cut

_invisible = re.compile("[" + "".join(sorted(map(re.escape, INVISIBLE))) + "]")


def consistent(texts: list[str | None]) -> list[str | None]:
    """The one form of each text that all texts which look like it share; None stays None.

    Invisible format characters go, compatibility forms and combining accents are composed, each token of mixed or
    whole-script look-alikes gets the one script that can spell it, then the project's normal form, and one blank for
    any blank space. Non-joiners between letters, case, accents and punctuation stay.
    """
    c = Codes(f" {SEP} ".join([t.replace(SEP, " ") if t else "" for t in texts])).nfkc(INVISIBLE).resolved()
    c = c.mapped({k: v for k, v in DISPLAY.pairs().items() if k in c.chars})
    s = Codes(tidy_zwnj(c.s)).joined("NFC").s
    return [None if t is None else " ".join(x.split()) for t, x in zip(texts, s.split(SEP), strict=True)]


def kinds(text: str | None) -> tuple[int, int, int]:
    """Tokens of several scripts, tokens wholly of look-alikes of another alphabet, and invisible characters."""
    if not text or text.isascii():
        return 0, 0, 0
    mixed = whole = 0
    if _foreign.search(text):
        for m in _token.finditer(text):
            letters = [x for x in m[0] if x.isalpha()]
            own = {name for name, p in _script.items() if any(map(p.match, letters))}
            mixed += len(own) > 1
            whole += len(own) == 1 and own <= set(LOOKALIKES) and all("latin" in scripts_of(x) for x in letters)
    return mixed, whole, len(_invisible.findall(text))


def forms(df: DataFrame, key: str, text: str, detail: bool = False) -> DataFrame:
    """key, text, form; with detail also mixed_tokens, whole_tokens and invisible. A null text has a null form."""
    kind = df.schema[key].dataType.simpleString()
    more = ["mixed_tokens", "whole_tokens", "invisible"] if detail else []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in pieces(texts):
            out = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(consistent(texts[a:b]), pa.string())]
            if detail:
                out += [pa.array(x, pa.int32()) for x in zip(*map(kinds, texts[a:b]), strict=True)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "text", "form", *more])

    out = map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, text string, form string" + "".join(f", {x} int" for x in more))
    return out.withColumnRenamed("key", key)


def same_looking(rows: DataFrame, key: str = "key") -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows of forms() with the same form but different texts.

    Rows with the same text make no pair and are gathered first: pairs are made between the different texts of a form,
    then each is expanded to the rows that have it; forms of very many texts and hot texts are split. A blank or null text has no pair.
    rows is read more than once; give a stored table.
    """
    rows = rows.where("form <> ''").select(F.col(key).alias("id"), "form", "text")
    variants = rows.groupBy("form", "text").agg(F.count("*").alias("n"))
    several = variants.groupBy("form").agg(F.count("*").alias("k"), F.sum("n").alias("of_form")).where("k > 1")
    variants = cut(variants.join(several, "form"))
    hot = hot_keys(variants, ["form", "text"])
    crowded = hot_keys(variants.groupBy("form").agg(F.first("k").alias("n")), ["form"])
    a = variants.select("form", F.col("text").alias("text_a"))
    pairs = salted_join(a, a.withColumnRenamed("text_a", "text_b"), ["form"], crowded).where("text_a <> text_b")
    half = salted_join(rows, pairs.withColumnRenamed("text_a", "text"), ["form", "text"], hot).select(F.col("id").alias("id_a"), "form", F.col("text_b").alias("text"))
    out = half.join(rows, ["form", "text"]) if hot is None else salted_join(half, rows, ["form", "text"], hot)
    return out.where("id_a < id").select("id_a", F.col("id").alias("id_b"))
