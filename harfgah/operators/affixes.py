"""Affixes of Latin-typed and of Persian words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harfgah.functions.tables import MIN_STEM, PLURAL, POSSESSIVE_AFTER_CONSONANT, POSSESSIVE_AFTER_VOWEL, PREFIXES, SUFFIXES


#: What a word ends in, as far as endings care: a long vowel, ye, he, or any other letter.
LAST = {"ا": "long", "و": "long", "ی": "ye", "ه": "he"}


@cache
def loan_endings(last: str) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Typed ending to (parts, Persian endings) for a loanword that ends like this; of several readings the one of fewest parts.

    Parts are plural, possessive, and a final o (marker), i (the ending ye) or e (unwritten, or he).
    """
    out: dict[str, tuple[int, tuple[str, ...]]] = {}
    for plural, of_plural in [("", ""), *PLURAL.items()]:
        # every plural ends in alef, so what follows it follows a vowel
        owners = POSSESSIVE_AFTER_VOWEL if plural or last != "other" else POSSESSIVE_AFTER_CONSONANT
        for owner, of_owner in [("", ""), *owners.items()]:
            so_far = of_plural + of_owner
            end = LAST.get(so_far[-1], "other") if so_far else last
            i = {"long": "یی", "ye": "", "he": "ای", "other": "ی"}[end]
            for tail, forms in (("", ("",)), ("o", ("و",)), ("i", (i,)), ("e", ("", "ه"))):
                typed, parts = plural + owner + tail, bool(plural) + bool(owner) + bool(tail)
                if parts and parts < out.get(typed, (9,))[0]:
                    out[typed] = (parts, tuple(so_far + f for f in forms))
    return out


def loan_forms(word: str, table: Mapping[str, Sequence[str]]) -> list[str] | None:
    """The spellings of a typed word that the table has, bare or with endings on the longest stem; None if it has none.

    A stem may have dropped its silent final e. Only a bare word keeps more than its first spelling.
    """
    if word in table:
        return list(table[word])
    for cut in range(len(word) - 1, 1, -1):
        typed, rest = word[:cut], word[cut:]
        stem = table.get(typed) or (None if typed[-1] == "e" else table.get(typed + "e"))
        found = stem and loan_endings(LAST.get(stem[0][-1:], "other")).get(rest)
        if found:
            return [stem[0] + ending for ending in found[1]]
    return None


def with_endings(stems: DataFrame) -> DataFrame:
    """typed, forms, cut (letters of the stem as typed) of loanwords en, fa with every ending; a fixed number for each."""
    rows = [(last, typed, list(forms)) for last in ("long", "ye", "he", "other") for typed, (_, forms) in loan_endings(last).items()]
    # a fixed table of endings
    endings = F.broadcast(stems.sparkSession.createDataFrame(rows, "last string, ending string, endings array<string>"))
    last = F.right("fa", F.lit(1))
    of = F.when(last.isin("ا", "و"), "long").when(last == "ی", "ye").when(last == "ه", "he").otherwise("other")
    # a bare stem keeps any other that would need its silent e from being tried
    short = stems.where("en like '%e'").select(F.expr("left(en, length(en) - 1)").alias("stem"), "fa", F.lit(True).alias("silent")).where(F.col("stem").rlike("[^e]$") & (F.length("stem") > 1))
    short = short.join(stems.select(F.col("en").alias("stem")), "stem", "left_anti")
    whole = stems.select(F.col("en").alias("stem"), "fa", F.lit(False).alias("silent")).where(F.length("stem") > 1)
    rows = whole.unionByName(short.groupBy("stem", "silent").agg(F.min("fa").alias("fa")))
    rows = rows.withColumn("last", of).join(endings, "last")
    return rows.select(F.concat("stem", "ending").alias("typed"), F.transform("endings", lambda e: F.concat(F.col("fa"), e)).alias("forms"), F.length("stem").alias("cut"))


def decomposed(words: DataFrame, word: str) -> DataFrame:
    """word, prefix, stem, suffix, outer_suffix: every way to take off one prefix and up to two suffixes.

    The affixes are literals of the plan, tried on each word in its row: no join. A stem keeps three letters or more.
    """
    prefixes = F.filter(F.array(*(F.lit(p) for p in ("", *dict(PREFIXES)))), lambda p: F.startswith(F.col("word"), p))
    suffixes = F.array(*(F.lit(s) for s, _ in SUFFIXES))

    def off(stem: Column) -> Column:
        return F.filter(suffixes, lambda s: F.endswith(stem, s) & (F.length(stem) - F.length(s) >= MIN_STEM))

    rows = words.select(F.col(word).alias("word")).select("word", F.explode(prefixes).alias("prefix"))
    rows = rows.withColumn("rest", F.expr("substr(word, length(prefix) + 1)"))
    rows = rows.select("word", "prefix", "rest", F.explode(F.concat(F.array(F.lit("")), off(F.col("rest")))).alias("outer"))
    rows = rows.withColumn("mid", F.expr("left(rest, length(rest) - length(outer))"))
    rows = rows.select("word", "prefix", "outer", "mid", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("outer") != "", off(F.col("mid"))).otherwise(F.array().cast("array<string>")))).alias("inner"))
    rows = rows.withColumn("stem", F.expr("left(mid, length(mid) - length(inner))"))
    suffix = F.when(F.col("inner") != "", F.col("inner")).otherwise(F.col("outer"))
    outer = F.when(F.col("inner") != "", F.col("outer")).otherwise("")
    return rows.where(((F.col("prefix") != "") | (F.col("outer") != "")) & (F.length("stem") >= MIN_STEM)).select("word", "prefix", "stem", suffix.alias("suffix"), outer.alias("outer_suffix"))


def joined_suffix(word: Column, suffix: Column) -> Column:
    """How an ending is written after a word: with alef after a silent he, doubled after a long vowel."""
    he, long, ye = word.endswith("ه"), word.rlike("[او]$"), word.endswith("ی")
    return (
        F.when(suffix.isin("م", "ت", "ش") & he, F.concat(F.lit("ا"), suffix))
        .when((suffix == "ی") & he, "ای")
        .when((suffix == "ی") & long, "یی")
        .when((suffix == "ی") & ye, "")
        .when((suffix == "و") & (long | he | ye), "رو")
        .otherwise(suffix)
    )
