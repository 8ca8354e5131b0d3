"""Words, keys and predicates as column expressions."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harfgah.functions.fold import ARABIC_DIGITS, HAMZA_ABOVE, MATCH, PERSIAN_DIGITS, ZWNJ, normalize_column, translated
from harfgah.functions.tables import ENGLISH, ENGLISH_CLUSTERS, ENGLISH_SUFFIXES, HOMOGRAPHS, JOINING_PREFIXES, JOINING_SUFFIXES, SPLIT_MARKS, first_choice, latin_units

#: Blanks that regular expressions of Java and RE2 agree on.
BLANK = r"[ \t\n\f\r]"
LATIN_WORD = "[A-Za-z]+"
PERSIAN_WORD = "[؀-ۿ]+"


def split_blank(c: Column) -> Column:
    """The parts between blanks, empty ones left out; null stays null."""
    return F.filter(F.split(c, BLANK + "+"), lambda w: w != "")


def match_key(c: Column) -> Column:
    """The lookup key without compatibility forms: folded letters, ASCII digits, no marks or joiners, lower case, single blanks."""
    drop = dict.fromkeys("‍﻿‎‏؜" + ZWNJ + HAMZA_ABOVE, "")
    pairs = {k: v.replace(HAMZA_ABOVE, "") for k, v in MATCH.pairs().items()}
    return F.array_join(split_blank(F.lower(translated(c, {**drop, **pairs}))), " ")


def leak_key(c: Column) -> Column:
    """The folded words of a sentence, one blank apart, marks being word breaks."""
    return match_key(F.translate(c, SPLIT_MARKS, " " * len(SPLIT_MARKS)))


def metric_words(c: Column) -> Column:
    """Words for accuracy: stretches folded, joiners and marks are blanks."""
    marks = SPLIT_MARKS + ZWNJ
    return split_blank(F.translate(stretch_folded(c), marks, " " * len(marks)))


def stretch_folded(c: Column) -> Column:
    """Three or more of one Persian letter become one."""
    return F.regexp_replace(c, r"(?=\p{IsArabic})(\p{L})\1{2,}", "$1")


def orthographic(c: Column) -> Column:
    """Alef forms to bare alef, digits to ASCII."""
    return F.translate(c, "آأإ" + PERSIAN_DIGITS + ARABIC_DIGITS, "ااا" + "0123456789" * 2)


def lenient_words(words: Column) -> Column:
    """Verbal prefixes joined to the word after them, endings to the word before: one pass with what waits for its word."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("wait"))

    def step(acc: Column, raw: Column) -> Column:
        w = orthographic(raw)
        out, wait = acc["out"], acc["wait"]
        glued = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), w)))
        return (
            F.when(w.isin(*JOINING_PREFIXES), F.struct(out.alias("out"), F.concat(wait, w).alias("wait")))
            .when((wait == "") & w.isin(*JOINING_SUFFIXES) & (F.size(out) > 0), F.struct(glued.alias("out"), wait.alias("wait")))
            .otherwise(F.struct(F.concat(out, F.array(F.concat(wait, w))).alias("out"), F.lit("").alias("wait")))
        )

    return F.aggregate(words, start, step, lambda acc: F.when(acc["wait"] != "", F.concat(acc["out"], F.array(acc["wait"]))).otherwise(acc["out"]))


def unstretched(c: Column) -> Column:
    """A run of three or more of a letter becomes one, of a and o two; c in lower case."""
    return F.regexp_replace(F.regexp_replace(c, r"([ao])\1{2,}", "$1$1"), r"([b-np-z])\1{2,}", "$1")


def final_run(c: Column) -> Column:
    """The run of three or more of a letter at the end, or the empty string."""
    return F.regexp_extract(c, r"(([a-z])\2{2,})$", 1)


def englishness(c: Column) -> Column:
    """0 to 0.99: how English a lower-case word looks; 1 for a listed word, 0 for Latin-typed Persian."""
    suffix = reduce(lambda a, b: a | b, (c.endswith(s) & (F.length(c) >= (6 if s in ("ize", "ise") else len(s) + 2)) for s in ENGLISH_SUFFIXES))
    pieces = [
        F.when(suffix, 0.45).otherwise(0.0),
        F.when(c.contains("wh"), 0.5).otherwise(0.0),
        F.when(c.contains("th"), 0.35).otherwise(0.0),
        *(F.when(c.contains(k), 0.08).otherwise(0.0) for k in ENGLISH_CLUSTERS),
        F.when(c.rlike(r"(.)\1") & ~c.rlike("aa|ee|oo|ii|uu"), 0.2).otherwise(0.0),
        F.when(c.rlike("[bcdfgklmnprstvz]e$") & (F.length(c) > 3), 0.15).otherwise(0.0),
    ]
    score = F.least(F.round(reduce(lambda a, b: a + b, pieces), 2), F.lit(0.99))
    return F.when(F.length(c) < 2, 0.0).when(c.isin(*sorted(HOMOGRAPHS)), 0.0).when(c.isin(*sorted(ENGLISH)), 1.0).otherwise(score)


_doubled = re.compile(r"(.)\1")
_long = re.compile("aa|ee|oo|ii|uu")
_silent_e = re.compile("[bcdfgklmnprstvz]e$")


@lru_cache(100_000)
def englishness_of(word: str) -> float:
    """englishness of one word."""
    if len(word) < 2 or word in HOMOGRAPHS:
        return 0.0
    if word in ENGLISH:
        return 1.0
    score = 0.45 * any(word.endswith(s) and len(word) >= (6 if s in ("ize", "ise") else len(s) + 2) for s in ENGLISH_SUFFIXES)
    score += 0.5 * ("wh" in word) + 0.35 * ("th" in word) + 0.08 * sum(k in word for k in ENGLISH_CLUSTERS)
    score += 0.2 * bool(_doubled.search(word) and not _long.search(word)) + 0.15 * bool(len(word) > 3 and _silent_e.search(word))
    return min(round(score, 2), 0.99)


UNIT_PATTERN = "|".join([*latin_units(), "(?s:.)"])


def greedy_units(c: Column) -> Column:
    """The Latin units of a lower-case word, longest first at each place."""
    return F.regexp_extract_all(c, F.lit(UNIT_PATTERN), 0)


def naive_word(c: Column) -> Column:
    """Each unit by its heaviest Persian spelling at its place in the word; a unit without one stays."""
    table = F.create_map(*(F.lit(x) for kv in sorted(first_choice().items()) for x in kv))

    def spelled(units: Column) -> Column:
        at = lambda i: F.when(i == 0, "initial").when(i == F.size(units) - 1, "final").otherwise("medial")
        return F.array_join(F.transform(units, lambda u, i: F.coalesce(F.try_element_at(table, F.concat(u, F.lit("|"), at(i))), u)), "")

    # as the one element of an array the units are made once, though they are used twice
    return F.get(F.transform(F.array(greedy_units(F.lower(c))), spelled), F.lit(0))


def naive_text(c: Column) -> Column:
    """Every run of Latin letters and apostrophes converted unit by unit, the rest as it is."""
    parts = F.regexp_extract_all(c, F.lit("[A-Za-z']+|[^A-Za-z']+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[A-Za-z']"), naive_word(p)).otherwise(p)), "")


def confusable_key(c: Column) -> Column:
    """Words that differ only in alef, vav and ye share it."""
    return F.translate(c, "اآوی", "")


_NO_WORD = r"[^\w\u200c\u0600-\u06ff]|[\u060c\u061b\u061f\u066a-\u066c\u06d4]"


def sentence_words(c: Column) -> Column:
    """The words of a sentence in normal form, marks being word breaks; null if there are none or one isn't all of Persian letters."""
    normal = lambda x: normalize_column(x)
    spaced = F.regexp_replace(normal(c), r"(?U)" + _NO_WORD, " ")
    words = F.filter(F.transform(F.split(spaced, r"[ \t\n\f\r]+"), normal), lambda w: w != "")
    return F.when((F.size(words) > 0) & F.forall(words, lambda w: w.rlike(r"\A[ء-غف-يپچژکگی\u200c\u0654]+\z")), words)


def has_span(whole: Column, part: Column) -> Column:
    """Do the words of part stand in a row in whole."""
    n = F.size(whole) - F.size(part)
    places = F.when(n >= 0, F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: F.slice(whole, i, F.size(part)) == part)


def without_link(word: Column, typed: Column) -> Column:
    """A typing without the linking vowel that its sentence put behind it: e after a consonant, ye after a vowel."""
    e = ~word.rlike("[اآویه]$") & typed.rlike("[^aeoiu]e$") & (F.length(typed) > 1)
    ye = word.rlike("[اوی]$") & typed.rlike("[aeoiu]ye$") & (F.length(typed) > 2)
    return F.when(e, F.left(typed, F.length(typed) - 1)).when(ye, F.left(typed, F.length(typed) - 2)).otherwise(typed)


def said_vowels(typed: Column) -> Column:
    """The vowels of a typing, one letter each: a e o, A i u for the long ones, a y between consonants as i."""
    for spelled, vowel in (("aa", "A"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("ou", "u"), ("uu", "u")):
        typed = F.replace(typed, F.lit(spelled), F.lit(vowel))
    typed = F.regexp_replace(typed, "([^aeoAiuy])y([^aeoAiuy])", "$1i$2")
    return F.regexp_replace(typed, "[^aeoAiu]", "")


def persian_skeleton(c: Column) -> Column:
    """Consonants only, homophones as one, doubles once, no final he; null for a word with anything but letters."""
    s = F.translate(c, "صثذضظطغحعءئؤأآاویۀ" + ZWNJ, "سسزززتقه")
    s = F.regexp_replace(s, r"([ب-ی])\1+", "$1")
    return F.when(c.rlike(r"^[ء-غف-يپچژکگی‌]+$"), F.regexp_replace(s, "ه$", ""))


def latin_skeleton(c: Column) -> Column:
    """The same key from the Latin side, by digraphs, then letters; null for a word with anything but letters."""
    s = F.lower(c)
    for typed, fa in (("kh", "خ"), ("sh", "ش"), ("ch", "چ"), ("zh", "ژ"), ("gh", "ق")):
        s = F.replace(s, F.lit(typed), F.lit(fa))
    s = F.translate(s, "bptsjhxdrzqfkcglmnvwyaeiou'", "بپتسجهخدرزقفککگلمن")
    s = F.regexp_replace(s, r"([ب-ی])\1+", "$1")
    return F.when(c.rlike("^[A-Za-z']+$"), F.regexp_replace(s, "ه$", ""))


def hash_share(c: Column) -> Column:
    """0 to 1 from the first 32 bits of the sha256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295)


def hash_split(c: Column, dev: float = 0.05, test: float = 0.05) -> Column:
    """test, dev or train, the same for a word in every run and corpus."""
    return F.when(hash_share(c) < test, "test").when(hash_share(c) < test + dev, "dev").otherwise("train")


def content_id(*columns: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(F.concat_ws("\t", *columns), 256), 1, length)
