"""The word and sentence passes over the readings that typed forms have in the examples.

A pass of a word is asked of every form that could be typed: the forms that were, with the endings that the pass knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.engine import DETACHED
from harfgah.functions import words as W
from harfgah.functions.fold import NormalForm, normalize_column, with_forms
from harfgah.functions.tables import DEMONSTRATIVES, POSSESSIVE_AFTER_CONSONANT, POSSESSIVE_AFTER_VOWEL, SUFFIX_AFTER_HE, TANVIN_ADVERBS
from harfgah.plans import candidates as D
from harfgah.plans import corpus as P
from harfgah.plans import words as T
from harfgah.plans.registry import Registry
from harfgah.plans.sqltools import normal_sql, quoted, values_sql
from harfgah.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def listed(words) -> str:
    return "(" + ", ".join(map(quoted, sorted(words))) + ")"


SCORES_SQL = f"(select word, score from ({P.ORACLES['unigram_logquant']}))"
FIRST_SQL = f"(select typed, output from {D.LISTS_SQL} where ord = 0 and regexp_full_match(typed, '[a-z'']+'))"


def scores(spark: SparkSession, d: str) -> DataFrame:
    return P.unigram_logquant(spark, d).select("word", "score")


def first(spark: SparkSession, d: str) -> DataFrame:
    return D.lists(spark, d).where((F.col("ord") == 0) & F.col("typed").rlike(r"\A[a-z']+\z")).select("typed", "output")


@query(f"select typed || 'ye' as word, arg_min(output, ord) as output from {D.LISTS_SQL} l join {SCORES_SQL} s on s.word = l.output where regexp_full_match(typed, '[a-z'']+[^aeiou]e') and length(typed) >= 4 and ends_with(output, 'ه') group by typed")
def glued_link(spark: SparkSession, d: str) -> DataFrame:
    """Forms in e with a linking ye typed onto them: the first reading in he that is a table word."""
    rows = D.lists(spark, d).where(F.col("typed").rlike(r"\A[a-z']+[^aeiou]e\z") & (F.length("typed") >= 4) & F.col("output").endswith("ه"))
    rows = rows.join(scores(spark, d).select(F.col("word").alias("output")), "output", "left_semi")
    return rows.groupBy(F.concat("typed", F.lit("ye")).alias("word")).agg(F.min_by("output", "ord").alias("output"))


@query(f"select typed || e as word, f.output || fa as output from {FIRST_SQL} f join {SCORES_SQL} s on s.word = f.output, {values_sql(list(SUFFIX_AFTER_HE.items()), 'e, fa')} where regexp_matches(typed, '[^aeiou]e$') and length(typed) >= 3 and ends_with(f.output, 'ه')")
def ending_after_he(spark: SparkSession, d: str) -> DataFrame:
    """Forms in e whose reading is a table word in he, with each ending that is written apart from a silent he."""
    endings = F.array(*(F.struct(F.lit(e).alias("e"), F.lit(fa).alias("fa")) for e, fa in SUFFIX_AFTER_HE.items()))
    rows = first(spark, d).where(F.col("typed").rlike("[^aeiou]e$") & (F.length("typed") >= 3) & F.col("output").endswith("ه"))
    rows = rows.join(scores(spark, d).select(F.col("word").alias("output")), "output", "left_semi").select("typed", "output", F.inline(endings))
    return rows.select(F.concat("typed", "e").alias("word"), F.concat("output", "fa").alias("output"))


LATIN_SKELETON_SQL = T.ORACLES["latin_skeletons"].split(" from ")[0].removeprefix("select word, ").removesuffix(" as skeleton")
BUCKETS_SQL = f"({T.ORACLES['persian_skeletons']})"


@query(
    f"""with w as (select word, left(word, length(word) - 1) as stem from {T.LATIN_WORDS_SQL} where length(word) >= 4 and regexp_matches(word, '[^a]an$')), b as (select p.word as reading, skeleton, s.score from {BUCKETS_SQL} p join {SCORES_SQL} s using (word)),
    a as (select w.word, arg_max(b.reading, (b.score, b.reading)) as adverb, max(b.score) as score from w join b on b.skeleton = {LATIN_SKELETON_SQL.replace('word', 'w.stem')} where b.reading in {listed(TANVIN_ADVERBS)} group by 1),
    t as (select w.word, max(b.score) as top from w join b on b.skeleton = {LATIN_SKELETON_SQL.replace('word', 'w.word')} group by 1)
    select a.word, a.adverb as output from a left join t using (word) where coalesce(t.top, 0) < a.score"""
)
def adverb_in_an(spark: SparkSession, d: str) -> DataFrame:
    """Typed words in an that are an adverb, unless the table reads the whole word as something as common."""
    words = T.latin_words(spark, d).select("word").where((F.length("word") >= 4) & F.col("word").rlike("[^a]an$"))
    buckets = T.persian_words(spark, d).join(scores(spark, d), "word").select(F.col("word").alias("reading"), "score", W.persian_skeleton(F.col("word")).alias("skeleton")).where("skeleton is not null")
    adverbs = buckets.where(F.col("reading").isin(*sorted(TANVIN_ADVERBS)))
    stem = W.latin_skeleton(F.expr("left(word, length(word) - 1)"))
    found = words.withColumn("skeleton", stem).join(adverbs, "skeleton").groupBy("word").agg(F.max_by("reading", F.struct("score", "reading")).alias("output"), F.max("score").alias("score"))
    # the commonest word of each bucket, before the join
    tops = buckets.groupBy("skeleton").agg(F.max("score").alias("top"))
    whole = words.withColumn("skeleton", W.latin_skeleton(F.col("word"))).join(tops, "skeleton").select("word", "top")
    return found.join(whole, "word", "left").where(F.coalesce("top", F.lit(0)) < F.col("score")).select("word", "output")


#: Place, typed, Persian, whether it follows a vowel (null: either).
OWNERS = [(i, t, fa, v) for i, (t, fa, v) in enumerate([("", "", None), *((t, fa, False) for t, fa in POSSESSIVE_AFTER_CONSONANT.items()), *((t, fa, True) for t, fa in POSSESSIVE_AFTER_VOWEL.items())])]
OWNERS_SQL = values_sql(OWNERS, "i, t, fa, v").replace("True", "true").replace("False", "false")


@query(
    f"""with f as materialized {FIRST_SQL}, r as (select f.typed || t || 'o' as word, f.output || fa || 'و' as output, s.score, i from f join {SCORES_SQL} s on s.word = f.output, (select i, t, fa, v::boolean as v from {OWNERS_SQL})
      where length(f.typed) >= 2 and (v is null or v = (right(f.typed, 1) in ('a', 'e', 'i', 'o', 'u'))) and length(f.typed || t) >= 3 and right(f.typed || t, 1) <> 'o')
    select word, arg_min(output, (-score, i, output)) as output from r where word not in (select typed from f where right(output, 1) in ('و', 'ع')) group by word"""
)
def object_marker(spark: SparkSession, d: str) -> DataFrame:
    """Forms with a possessive or none and the marker o: the commonest stem that the word can be cut to."""
    endings = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.lit(fa).alias("fa"), F.lit(v).cast("boolean").alias("v")) for i, t, fa, v in OWNERS))
    base = first(spark, d)
    rows = base.where(F.length("typed") >= 2).join(scores(spark, d).withColumnRenamed("word", "output"), "output").select("typed", F.col("output").alias("stem"), "score", F.inline(endings))
    body = F.concat("typed", "t")
    rows = rows.where((F.col("v").isNull() | (F.col("v") == F.right("typed", F.lit(1)).isin(*"aeiou"))) & (F.length(body) >= 3) & ~body.endswith("o"))
    rows = rows.select(F.concat(body, F.lit("o")).alias("word"), F.concat("stem", "fa", F.lit("و")).alias("output"), "score", "i")
    kept = base.where(F.right("output", F.lit(1)).isin("و", "ع")).select(F.col("typed").alias("word"))
    return rows.join(kept, "word", "left_anti").groupBy("word").agg(F.min(F.struct(-F.col("score"), "i", "output")).alias("b")).select("word", "b.output")


@query(
    f"""with f as materialized (select f.typed, f.output from {FIRST_SQL} f join {SCORES_SQL} s on s.word = f.output where length(f.typed) > 1),
    r as (select typed || 'haro' as word, output || 'هارو' as output, 0 as i from f union all select typed || 'aro', output || 'ارو', 1 from f where not ends_with(typed, 'a'))
    select word, arg_min(output, (i, output)) as output from r group by word"""
)
def plural_marker(spark: SparkSession, d: str) -> DataFrame:
    """Forms with a plural and the marker ro; the plural with h first."""
    rows = first(spark, d).where(F.length("typed") > 1).join(scores(spark, d).select(F.col("word").alias("output")), "output", "left_semi")
    a = rows.select(F.concat("typed", F.lit("haro")).alias("word"), F.concat("output", F.lit("هارو")).alias("output"), F.lit(0).alias("i"))
    b = rows.where(~F.col("typed").endswith("a")).select(F.concat("typed", F.lit("aro")).alias("word"), F.concat("output", F.lit("ارو")).alias("output"), F.lit(1).alias("i"))
    return a.unionByName(b).groupBy("word").agg(F.min(F.struct("i", "output")).alias("b")).select("word", "b.output")


# Neighbouring words of lines, one blank apart.

NEIGHBOURS_SQL = "(select example_id, i as pos, l[i] as a, l[i + 1] as b from (select example_id, l, unnest(generate_series(1, len(l) - 1)) as i from (select example_id, string_split(lower(latin), ' ') as l from example where latin is not null)) where l[i] <> '' and l[i + 1] <> '')"
READ_SQL = f"(select n.*, coalesce(x.output, n.a) as before, coalesce(y.output, n.b) as after from {NEIGHBOURS_SQL} n left join {FIRST_SQL} x on x.typed = n.a left join {FIRST_SQL} y on y.typed = n.b where {{}})"


def neighbours(spark: SparkSession, d: str, where) -> DataFrame:
    """example_id, pos, a, b, before, after: neighbouring words that a pass asks for, found in the line's array, and their first readings."""
    words = F.split(F.lower("latin"), " ")
    rows = table(spark, d, "example").where("latin is not null").select("example_id", words.alias("l")).where(F.size("l") > 1)
    pairs = rows.select("example_id", F.inline(F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.struct(i.cast("long").alias("pos"), F.get("l", i - 1).alias("a"), F.get("l", i).alias("b")))))
    read = first(spark, d)
    pairs = pairs.where("a <> '' and b <> ''").where(where)
    pairs = pairs.join(read.select(F.col("typed").alias("a"), F.col("output").alias("before")), "a", "left").join(read.select(F.col("typed").alias("b"), F.col("output").alias("after")), "b", "left")
    return pairs.withColumns({"before": F.coalesce("before", "a"), "after": F.coalesce("after", "b")})


LINKS = "(b in ('e', 'ie') or (b = 'ye' and regexp_matches(a, '[aeiou]$')))"
ENDING_SQL = f"regexp_full_match(b, {quoted(DETACHED.pattern)})"


@query(
    f"""select example_id, pos, case when {ENDING_SQL} then 'ending' else 'link' end as kind,
    case when {ENDING_SQL} then before || case when ends_with(b, 'yeh') then coalesce((select output from {FIRST_SQL} f where f.typed = left(b, length(b) - 1)), left(b, length(b) - 1)) else after end
      when b = 'ye' and right(before, 1) in ('ا', 'و') then before || 'ی' else before end as joined
    from {READ_SQL.format(f'({ENDING_SQL} or {LINKS})')}"""
)
def detached_link(spark: SparkSession, d: str) -> DataFrame:
    """Endings and linking vowels typed as a word of their own, joined to the word before."""
    ending = F.col("b").rlike(rf"\A(?:{DETACHED.pattern})\z")
    link = F.col("b").isin("e", "ie") | ((F.col("b") == "ye") & F.col("a").rlike("[aeiou]$"))
    rows = neighbours(spark, d, ending | link)
    short = first(spark, d).select(F.concat("typed", F.lit("h")).alias("b"), F.col("output").alias("without_h")).where("b like '%yeh'")
    rows = rows.join(short, "b", "left")
    read = F.when(F.col("b").endswith("yeh"), F.coalesce("without_h", F.expr("left(b, length(b) - 1)"))).otherwise(F.col("after"))
    joined = F.when(ending, F.concat("before", read)).when((F.col("b") == "ye") & F.col("before").rlike("[او]$"), F.concat("before", F.lit("ی"))).otherwise(F.col("before"))
    return rows.select("example_id", "pos", F.when(ending, "ending").otherwise("link").alias("kind"), joined.alias("joined"))


@query(
    f"""with r as {READ_SQL.format("b = 'ash'")}, he as (select typed, arg_min(output, ord) as he from {D.LISTS_SQL} l join {SCORES_SQL} s on s.word = l.output where ends_with(output, 'ه') group by typed)
    select example_id, pos, case when regexp_matches(a, 'eh?$') then he.he || 'اش' else before || 'ش' end as joined from r left join he on he.typed = r.a
    where before not in {listed(DEMONSTRATIVES)} and case when regexp_matches(a, 'eh?$') then he.he is not null else not regexp_matches(a, '[aeiou]$') end"""
)
def detached_possessive(spark: SparkSession, d: str) -> DataFrame:
    """ash typed as a word of its own: with alef after a table word in he, else onto a consonant."""
    he = D.lists(spark, d).where(F.col("output").endswith("ه")).join(scores(spark, d).select(F.col("word").alias("output")), "output", "left_semi").groupBy(F.col("typed").alias("a")).agg(F.min_by("output", "ord").alias("he"))
    rows = neighbours(spark, d, F.col("b") == "ash").where(~F.col("before").isin(*DEMONSTRATIVES)).join(he, "a", "left")
    silent = F.col("a").rlike("eh?$")
    joined = F.when(silent, F.concat("he", F.lit("اش"))).when(~F.col("a").rlike("[aeiou]$"), F.concat("before", F.lit("ش")))
    return rows.select("example_id", "pos", joined.alias("joined")).where("joined is not null")


TEXT = "text"
FORMS = {"persian_digits": NormalForm(), "latin_digits": NormalForm(digits="latin"), "kept": NormalForm(digits="preserve", hamza_alef=False, teh_marbuta=False), "marks": NormalForm(punctuation=True)}


@query(f"select doc_id, {', '.join(f'{normal_sql(TEXT, f)} as {name}' for name, f in FORMS.items())} from documents")
def normal_options(spark: SparkSession, d: str) -> DataFrame:
    """Every text in normal form by each set of options, compatibility forms aside."""
    return T.docs(spark, d).select("doc_id", *(normalize_column(F.col("text"), f).alias(name) for name, f in FORMS.items()))


def compat_sql(x: str) -> str:
    """Compatibility forms of the blocks that these texts have, by the normal form that Unicode gives them."""
    import unicodedata

    from harfgah.functions.fold import DEAD_INVISIBLES, translate_sql

    blocks = [(0xA0, 0x180), (0x2000, 0x2070), (0x3000, 0x3001), (0xFB50, 0xFDFE), (0xFE70, 0xFF00), (0xFF01, 0xFF5F)]
    forms = {chr(c): f for a, b in blocks for c in range(a, b) if (f := unicodedata.normalize("NFKC", chr(c))) != chr(c)}
    used = {c: f for c, f in forms.items() if len(f) == 1 or 0xFEF5 <= ord(c) <= 0xFEFC or c in "…﷼"}
    return f"nfc_normalize({translate_sql(f'translate({x}, {quoted(DEAD_INVISIBLES)}, {quoted(str())})', used)})"


@query(f"select norm_id, nfc_normalize({normal_sql(compat_sql('input'))}) as normal from normalization")
def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every input in normal form, compatibility forms and all."""
    return with_forms(table(spark, d, "normalization").select("norm_id", "input"), "input").select("norm_id", "normal")
