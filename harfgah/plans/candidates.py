"""Candidate generation, word passes and sentence passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harfgah.functions import words as W
from harfgah.functions.tables import ANY_VOWEL, CORRESPONDENCES, EZAFE_HEADS, POSSESSIVE_AFTER_CONSONANT, POSSESSIVE_AFTER_VOWEL, PREFIXES, SUFFIXES, TYPED_VOWELS, latin_units
from harfgah.operators import affixes as X
from harfgah.operators import candidates as D
from harfgah.plans import corpus as P
from harfgah.plans import words as T
from harfgah.plans.registry import Registry
from harfgah.plans.sqltools import quoted, values_sql
from harfgah.session import dealt, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

SPELLED_SQL = "(select * from " + values_sql([(fa, u, pos, float(w) / (i + 1), i == 0, w) for fa, us, poss, _, w in CORRESPONDENCES for i, u in enumerate(us) for pos in poss if u], "fa, unit, position, w, first, whole").replace("True", "true").replace("False", "false") + ")"


@query(f"select unit, position, fa, w, canonical, row_number() over (partition by unit, position order by w desc, fa) - 1 as rank from (select unit, position, fa, sum(w::double) as w, bool_or(first) as canonical from {SPELLED_SQL} group by all)")
def reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return D.reverse_table(D.correspondences(spark)).withColumn("rank", F.col("rank").cast("long"))


@query(f"select fa, position, unit, round(w / sum(w) over (partition by fa, position), 9) as p from (select fa, position, unit, sum(w) as w from {SPELLED_SQL} where fa <> '' group by all)")
def channel_prior(spark: SparkSession, d: str) -> DataFrame:
    return D.channel_prior(D.correspondences(spark)).withColumn("p", F.round("p", 9))


LETTERS_SQL = "(select label as fa, unit, count(*) as n from (select unnest(labels) as label, unnest(string_split(lower(latin), '')) as unit from example where labels is not null and len(labels) = length(latin)) where label <> '' and regexp_full_match(unit, '[a-z]') group by all)"


@query(
    f"""with c as {LETTERS_SQL}, prior as (select fa, unit, max(w) as w from {SPELLED_SQL} where position = 'medial' and length(unit) = 1 group by all), p as (select fa, unit, w / sum(w) over (partition by fa) as p from prior)
    select coalesce(c.fa, p.fa) as fa, coalesce(c.unit, p.unit) as unit, coalesce(n, 0)::bigint as n, round((coalesce(n, 0) + 5 * coalesce(p, 0)) / (sum(coalesce(n, 0)) over (partition by coalesce(c.fa, p.fa)) + 5), 9) as p from c full join p on c.fa = p.fa and c.unit = p.unit"""
)
def channel_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """One round of re-estimation: how each label was spelled, drawn toward the rules."""
    rows = table(spark, d, "example").where(F.size("labels") == F.length("latin"))
    letters = rows.select(F.inline(F.arrays_zip(F.col("labels").alias("fa"), F.regexp_extract_all(F.lower("latin"), F.lit("(?s:.)"), 0).alias("unit"))))
    counts = letters.where("fa <> ''").where(F.col("unit").rlike("^[a-z]$")).groupBy("fa", "unit").agg(F.count("*").alias("n"))
    spelled = D.correspondences(spark).select("fa", "w", F.explode("pos").alias("position"), F.posexplode("latin").alias("at", "unit")).where("position = 'medial' and length(unit) = 1")
    prior = spelled.groupBy("fa", "unit").agg(F.max(F.col("w") / (F.col("at") + 1)).alias("w"))
    prior = prior.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("fa"))).drop("w")
    return D.smoothed(counts, prior, ["fa"], 5.0).select("fa", "unit", F.coalesce("n", F.lit(0)).alias("n"), F.round("p_new", 9).alias("p"))


LOAN_WORDS_SQL = "(select distinct lower(en) as word from loanwords where regexp_full_match(en, '[A-Za-z]+'))"


def loan_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loanwords").where(F.col("en").rlike(r"\A[A-Za-z]+\z")).select(F.lower("en").alias("word")).distinct()


UNITS_SQL = values_sql([(u, i) for i, u in enumerate(latin_units())], "unit, o")


@query(
    f"""with recursive u as (select * from {UNITS_SQL}), s(word, done, units, path) as (select word, 0, []::varchar[], []::integer[] from {LOAN_WORDS_SQL}
    union all select word, done + length(unit), list_append(units, unit), list_append(path, o) from s, u where done < length(word) and starts_with(substr(word, done + 1), unit))
    select word, rank::integer as rank, units from (select word, units, row_number() over (partition by word order by path) - 1 as rank from s where done = length(word)) where rank < 8"""
)
def segmentations(spark: SparkSession, d: str) -> DataFrame:
    """The first eight ways to cut each loanword into units."""
    return D.segmentations(loan_words(spark, d), "word", 8)


@query()
def beam_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of every different Latin word by rules alone."""
    return D.beam_candidates(T.latin_words(spark, d), "word").withColumn("score", F.round("score", 6))


SKELETON_SQL = f"({T.ORACLES['persian_skeletons'].replace('select word,', 'select word, n,', 1)})"


@query(f"select skeleton, count(*) as n_words, sum(n)::bigint as n, arg_max(word, (n, word)) as commonest from {SKELETON_SQL} group by skeleton")
def skeleton_buckets(spark: SparkSession, d: str) -> DataFrame:
    words = T.persian_words(spark, d).withColumn("skeleton", W.persian_skeleton(F.col("word"))).where("skeleton is not null")
    return words.groupBy("skeleton").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"), F.max_by("word", F.struct("n", "word")).alias("commonest"))


@query(
    f"""select typed, output, n, rank from (select t.word as typed, p.word as output, p.n, row_number() over (partition by t.word order by p.n desc, p.word) - 1 as rank
    from ({T.ORACLES['latin_skeletons']}) t join {SKELETON_SQL} p using (skeleton)) where rank < 3"""
)
def skeleton_topk(spark: SparkSession, d: str) -> DataFrame:
    """Of every Latin word the three commonest Persian words with its consonants."""
    words = T.persian_words(spark, d).select(F.col("word").alias("output"), "n", W.persian_skeleton(F.col("word")).alias("skeleton")).where("skeleton is not null")
    asked = T.latin_words(spark, d).select(F.col("word").alias("typed"), W.latin_skeleton(F.col("word")).alias("skeleton"))
    # the best three of a bucket are kept before the join: a bucket that many share isn't multiplied out
    top = D.best_by_key(words, ["skeleton"], [F.desc("n"), F.asc("output")], 3)
    return asked.join(top, "skeleton").select("typed", "output", "n", F.col("ord").cast("long").alias("rank"))


@query(f"select typed, count(*) filter (where word in (select fa from loanwords)) as n_attested, count(*) as n_forms from {P.TYPED_SQL} group by typed")
def attested_keys(spark: SparkSession, d: str) -> DataFrame:
    """How many readings of each typed form are in the lexicon."""
    lex = table(spark, d, "loanwords").select(F.col("fa").alias("word")).where("word is not null").distinct().withColumn("hit", F.lit(1))
    return P.typed(spark, d).join(lex, "word", "left").groupBy("typed").agg(F.count("hit").alias("n_attested"), F.count("*").alias("n_forms"))


# Candidate lists: the readings that a typed form got, by how often.

#: Readings that are ranked anew in context.
READINGS = 8
LISTS_SQL = f"""(select typed, ord, output, n, round(exp(s - max(s) over (partition by typed)) / sum(exp(s)) over (partition by typed) * exp(max(s) over (partition by typed)), 4) as probability from
 (select typed, word as output, n, round(ln(1 + n), 6) as s, row_number() over (partition by typed order by n desc, word) - 1 as ord from {P.TYPED_SQL}) where ord < {READINGS})"""
ALL_LISTS_SQL = LISTS_SQL.replace(f" where ord < {READINGS})", ")")


def lists(spark: SparkSession, d: str, k: int | None = READINGS) -> DataFrame:
    rows = P.typed(spark, d).withColumnRenamed("word", "output")
    top = D.best_by_key(rows, ["typed"], [F.desc("n"), F.asc("output")], k).withColumn("s", F.round(F.log(1 + F.col("n")), 6))
    return D.softmax(top, ["typed"], "s").select("typed", F.col("ord").cast("long").alias("ord"), "output", "n", "probability")


@query(f"select * from {LISTS_SQL}")
def candidate_softmax(spark: SparkSession, d: str, k: int = READINGS) -> DataFrame:
    return lists(spark, d, k)


@query(
    f"""with l as {LISTS_SQL}, f as (select *, ord = max(ord) over (partition by typed) as first, coalesce(sum(probability) filter (where ord <> m) over (partition by typed), 0) as rest from (select *, max(ord) over (partition by typed) as m from l))
    select typed, output, row_number() over (partition by typed order by not first, ord) - 1 as ord, case when first then 0.8 else round(0.2 * probability / case when rest = 0 then 1 else rest end, 4) end as probability from f"""
)
def promote_rescale(spark: SparkSession, d: str, k: int = READINGS) -> DataFrame:
    """The last candidate put first."""
    rows = lists(spark, d, k)
    rows = rows.withColumn("last", F.col("ord") == F.max("ord").over(Window.partitionBy("typed")))
    return D.promoted(rows, ["typed"], F.col("last")).select("typed", "output", F.col("ord").cast("long").alias("ord"), "probability")


@query(
    f"""with l as (select *, ends_with(output, 'ه') and length(output) > 1 as he from {LISTS_SQL}), m as (select *, sum(he::integer) over w > 0 and sum(he::integer) over w < count(*) over w as mixed, greatest(probability, 1e-6) * case when he then exp(2.0) else 1 end as weight from l window w as (partition by typed)),
    n as (select *, case when mixed then round(weight / sum(weight) over (partition by typed), 4) else probability end as p from m)
    select typed, output, row_number() over (partition by typed order by case when mixed then -weight end, ord) - 1 as ord, p as probability from n"""
)
def final_class_tilt(spark: SparkSession, d: str, k: int = READINGS) -> DataFrame:
    """Readings with a final he favoured, as at the end of a clause."""
    he = F.col("output").endswith("ه") & (F.length("output") > 1)
    return D.tilted(lists(spark, d, k), ["typed"], he, 2.0).select("typed", "output", F.col("ord").cast("long").alias("ord"), "probability")


BETWEEN_SQL = "regexp_replace({}, '([^aeiou])y([^aeiou]|$)', '\\1#\\2', 'g')"
SLOTS_SQL = "list_transform(regexp_extract_all(" + BETWEEN_SQL.format(BETWEEN_SQL.format("typed")) + ", '[aeiou]+|#+', 0), lambda r: case r " + " ".join(f"when {quoted('#' if k == 'y' else k)} then {quoted(v)}" for k, v in TYPED_VOWELS.items()) + f" else {quoted(ANY_VOWEL)} end)"
#: Each typed vowel costs one if the word has no such vowel for it, in order; what the word has beside them costs nothing.
MISSES_SQL = """list_extract(list_reduce(list_concat([list_transform(range(length(vowels) + 1), lambda z: 0)], list_transform(slots, lambda can: [strpos(can, substr(vowels, j, 1)) for j in range(1, length(vowels) + 1)])),
 lambda row, fits: list_reduce(list_concat([[row[1] + 1]], list_transform(range(1, length(vowels) + 1), lambda j: [least(row[j] + (fits[j] = 0)::integer, row[j + 1] + 1)])), lambda new, x: list_append(new, least(x[1], new[len(new)])))), -1)"""


@query(
    f"""with l as (select l.*, v.vowels, case when v.vowels is null then l.output else translate(l.output, 'اآوی', '') || '+' end as g, {SLOTS_SQL} as slots from {LISTS_SQL} l left join {P.CONFUSABLE_SQL} v on v.word = l.output),
    m as (select *, case when vowels is null then 0 else {MISSES_SQL} end as misses from l),
    e as (select *, case when count(*) over (partition by typed, g) > 1 then misses - min(misses) over (partition by typed, g) else 0 end as excess from m),
    p as (select *, case when excess > 0 then greatest(probability, 1e-6) * exp(-3.0 * excess) else probability end as q, max(excess) over (partition by typed) > 0 as hit from e),
    r as (select *, case when hit then round(q / sum(q) over (partition by typed), 4) else probability end as pr from p)
    select typed, output, row_number() over (partition by typed order by pr desc, ord) - 1 as ord, pr as probability from r"""
)
def vowel_group_penalty(spark: SparkSession, d: str, k: int = READINGS) -> DataFrame:
    """Confusable readings weighed by how far their vowels are from the typed ones."""
    rows = lists(spark, d, k).join(P.vowel_table(spark, d).withColumnRenamed("word", "output"), "output", "left")
    misses = F.when(F.col("vowels").isNull(), 0).otherwise(D.vowel_misses(D.vowel_slots(F.col("typed")), F.col("vowels")))
    rows = rows.withColumns({"g": F.when(F.col("vowels").isNull(), F.col("output")).otherwise(F.concat(W.confusable_key(F.col("output")), F.lit("+"))), "misses": misses})
    return D.penalised(rows, ["typed"], "g", "misses", 3.0).select("typed", "output", F.col("ord").cast("long").alias("ord"), "probability")


@query(
    f"""with l as {LISTS_SQL}, w as (select lower(en) as typed, min(fa) as fa from loanwords where en is not null and fa is not null group by 1), j as (select l.*, fa from l join w using (typed)),
    r as (select *, sum(case when output <> fa then probability else 0 end) over (partition by typed) as rest from j)
    select typed, fa as output, 0::bigint as ord, 0.9 as probability from (select distinct typed, fa from j)
    union all select typed, output, row_number() over (partition by typed order by ord), round(0.1 * probability / case when rest = 0 then 1 else rest end, 4) from r where output <> fa"""
)
def loanword_merge(spark: SparkSession, d: str, k: int = READINGS) -> DataFrame:
    """A loanword's spelling put first with nine tenths."""
    loans = table(spark, d, "loanwords").where("en is not null and fa is not null").groupBy(F.lower("en").alias("typed")).agg(F.min("fa").alias("fa"))
    rows = lists(spark, d, k).join(loans, "typed")
    w = Window.partitionBy("typed")
    rest = rows.withColumn("rest", F.sum(F.when(F.col("output") != F.col("fa"), F.col("probability")).otherwise(0.0)).over(w)).where("output <> fa")
    kept = rest.select("typed", "output", F.row_number().over(w.orderBy("ord")).cast("long").alias("ord"), F.round((1 - 0.9) * F.col("probability") / F.when(F.col("rest") == 0, 1.0).otherwise(F.col("rest")), 4).alias("probability"))
    return rows.select("typed", F.col("fa").alias("output"), F.lit(0).cast("long").alias("ord"), F.lit(0.9).alias("probability")).distinct().unionByName(kept)


@query(f"select l.typed, l.output, coalesce(u.score, 0)::integer as score, l.ord from {LISTS_SQL} l left join ({P.ORACLES['unigram_logquant']}) u on u.word = l.output")
def frequency_scores(spark: SparkSession, d: str) -> DataFrame:
    """The log frequency of each reading; an unknown one scores 0."""
    return lists(spark, d).join(P.unigram_logquant(spark, d).select(F.col("word").alias("output"), "score"), "output", "left").select("typed", "output", F.coalesce("score", F.lit(0)).alias("score"), "ord")


@query(
    f"""with w as {T.PERSIAN_WORDS_SQL}, c as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as output from (select word, unnest(generate_series(2, length(word))) as i from w) where substr(word, i, 1) = 'و')
    select word, output, n from (select c.word, c.output, w.n, row_number() over (partition by c.word order by c.i) as k from c join w on w.word = c.output) where k = 1"""
)
def short_vowel_vav(spark: SparkSession, d: str) -> DataFrame:
    """Words that stay words when a vav after the first letter is left out: the first such place."""
    words = T.persian_words(spark, d)
    variants = words.select("word", F.explode(F.filter(F.sequence(F.lit(2), F.greatest(F.length("word"), F.lit(2))), lambda i: F.col("word").substr(i, F.lit(1)) == "و")).alias("i"))
    variants = variants.withColumn("output", F.concat(F.col("word").substr(F.lit(1), F.col("i") - 1), F.expr("substr(word, i + 1)")))
    hit = variants.join(words.select(F.col("word").alias("output"), "n"), "output")
    return hit.groupBy("word").agg(F.min(F.struct("i", "output", "n")).alias("b")).select("word", "b.output", "b.n")


@query(
    f"""with w as {T.PERSIAN_WORDS_SQL}, r as (select distinct regexp_replace(word, '([او])یی(.)', '\\1ی\\2') as word from w where regexp_matches(word, '[او]یی.')),
    c as (select word, i, substr(word, 1, i) || 'ی' || substr(word, i + 1) as output from (select word, unnest(generate_series(2, length(word) - 1)) as i from (select word from w union select word from r)) where substr(word, i, 1) = 'ی' and substr(word, i - 1, 1) in ('ا', 'و'))
    select word, output, n from (select c.word, c.output, w.n, row_number() over (partition by c.word order by c.i) as k from c join w on w.word = c.output) where k = 1"""
)
def hiatus_ye(spark: SparkSession, d: str) -> DataFrame:
    """Spellings that are a word when the ye after a long vowel is doubled: of words, and of what letter by letter is written for words with two."""
    words = T.persian_words(spark, d)
    once = words.where(F.col("word").rlike("[او]یی.")).select(F.expr("regexp_replace(word, '^(.*?[او])یی(.)', '$1ی$2')").alias("word"))
    spelled = words.select("word").unionByName(once).distinct()
    variants = spelled.where(F.length("word") > 2).select("word", F.explode(F.filter(F.sequence(F.lit(2), F.length("word") - 1), lambda i: (F.col("word").substr(i, F.lit(1)) == "ی") & F.col("word").substr(i - 1, F.lit(1)).isin("ا", "و"))).alias("i"))
    variants = variants.withColumn("output", F.concat(F.col("word").substr(F.lit(1), F.col("i")), F.lit("ی"), F.expr("substr(word, i + 1)")))
    return variants.join(words.select(F.col("word").alias("output"), "n"), "output").groupBy("word").agg(F.min(F.struct("i", "output", "n")).alias("b")).select("word", "b.output", "b.n")


@query(
    f"""with l as {LISTS_SQL}, s as (select typed, output, probability from l where ord = 0 and typed <> ''), t as (select * from s union all select typed || 'e', output, probability from s where typed || 'e' not in (select typed from s)), w as {T.PERSIAN_WORDS_SQL}
    select t.typed, s.output || 'ه' as output, round(t.probability * 0.8, 4) as top_probability, 0.2::double as probability from t join s on t.typed = s.typed || 'e' join w on w.word = s.output
    where length(t.typed) >= 4 and regexp_matches(t.typed, '[^e]e$') and not ends_with(t.output, 'ه') and not regexp_matches(s.output, '[هاو]$') and s.output not in ({', '.join(map(quoted, EZAFE_HEADS))})
    and not exists (select 1 from l where l.typed = t.typed and l.output = s.output || 'ه')"""
)
def copula_candidates(spark: SparkSession, d: str, k: int = READINGS) -> DataFrame:
    """A reading with the copula for typings in e whose stem is a word, put second with a fifth.

    A typing that is only seen without its e is read as its stem, the e being an unwritten linking vowel.
    """
    rows = lists(spark, d, k)
    first = rows.where("ord = 0 and typed <> ''").select("typed", "output", "probability")
    linked = first.withColumn("typed", F.concat("typed", F.lit("e"))).join(first.select("typed"), "typed", "left_anti")
    top = first.unionByName(linked).select("typed", F.col("output").alias("top"), "probability").where((F.length("typed") >= 4) & F.col("typed").rlike("[^e]e$") & ~F.col("top").endswith("ه"))
    stems = first.select(F.concat("typed", F.lit("e")).alias("typed"), F.col("output").alias("stem")).where(~F.col("stem").rlike("[هاو]$") & ~F.col("stem").isin(*EZAFE_HEADS))
    stems = stems.join(T.persian_words(spark, d).select(F.col("word").alias("stem")), "stem")
    made = top.join(stems, "typed").withColumn("output", F.concat("stem", F.lit("ه"))).join(rows.select("typed", "output"), ["typed", "output"], "left_anti")
    return made.select("typed", "output", F.round(F.col("probability") * 0.8, 4).alias("top_probability"), F.lit(0.2).alias("probability"))


@query(
    f"""with s as (select lower(en) as en, min(fa) as fa from loanwords where regexp_full_match(en, '[A-Za-z]+') and fa <> '' group by 1),
    b as (select en as stem, fa, false as silent from s where length(en) > 1 union all select left(en, length(en) - 1), min(fa), true from s where regexp_matches(en, '[^e]e$') and length(en) > 2 and left(en, length(en) - 1) not in (select en from s) group by 1),
    pl(pt, pf) as (values ('', ''), ('a', 'ا'), ('ha', 'ها')), po(qt, qf, vowel) as (select '', '', null union all {' union all '.join(f"select {quoted(a)}, {quoted(b)}, {v}" for t, v in ((POSSESSIVE_AFTER_CONSONANT, 'false'), (POSSESSIVE_AFTER_VOWEL, 'true')) for a, b in t.items())}),
    body as (select stem, pt || qt as typed, fa || pf || qf as body, (pt <> '')::integer + (qt <> '')::integer as parts, length(stem) as cut from b, pl, po where vowel is null or vowel = regexp_matches(fa || pf, '[اویه]$')),
    f as (select stem || typed as typed, [body] as forms, cut, parts from body where parts > 0 union all select stem || typed || 'o', [body || 'و'], cut, parts + 1 from body
      union all select stem || typed || 'i', [body || case when regexp_matches(body, '[او]$') then 'یی' when ends_with(body, 'ی') then '' when ends_with(body, 'ه') then 'ای' else 'ی' end], cut, parts + 1 from body
      union all select stem || typed || 'e', [body, body || 'ه'], cut, parts + 1 from body),
    t as (select distinct typed from {P.TYPED_SQL})
    select typed, forms[1] as output, forms[2] as second from (select f.*, row_number() over (partition by typed order by cut desc, parts) as k from f join t using (typed) where typed not in (select en from s)) where k = 1
    union all select en, fa, null from s join t on t.typed = s.en"""
)
def loanword_forms(spark: SparkSession, d: str) -> DataFrame:
    """Typed words that are a loanword, bare or with endings on the longest stem, with one spelling or two."""
    stems = table(spark, d, "loanwords").where(F.col("en").rlike(r"\A[A-Za-z]+\z") & (F.col("fa") != "")).groupBy(F.lower("en").alias("en")).agg(F.min("fa").alias("fa"))
    asked = P.typed(spark, d).select("typed").distinct()
    bare = asked.join(stems.withColumnRenamed("en", "typed"), "typed").select("typed", F.col("fa").alias("output"), F.lit(None).cast("string").alias("second"))
    forms = X.with_endings(stems).join(asked, "typed").join(stems.select(F.col("en").alias("typed")), "typed", "left_anti")
    best = forms.groupBy("typed").agg(F.max_by("forms", "cut").alias("f"))
    return bare.unionByName(best.select("typed", F.col("f")[0].alias("output"), F.get("f", F.lit(1)).alias("second")))


@query(
    f"""with w as (select word from {T.LATIN_WORDS_SQL}), p as (select word, '' as prefix, word as rest from w union all select word, latin, substr(word, length(latin) + 1) from w, {values_sql(PREFIXES, 'latin, fa')} where starts_with(word, latin)),
    s as (select latin from {values_sql([(a,) for a, _ in SUFFIXES], 'latin')}),
    a as (select word, prefix, rest as stem, '' as s1, '' as s2 from p union all select word, prefix, left(rest, length(rest) - length(latin)), latin, '' from p, s where ends_with(rest, latin) and length(rest) - length(latin) >= 3),
    b as (select * from a union all select word, prefix, left(stem, length(stem) - length(latin)), latin, s1 from a, s where s1 <> '' and ends_with(stem, latin) and length(stem) - length(latin) >= 3)
    select word, prefix, stem, s1 as suffix, s2 as outer_suffix from b where (prefix <> '' or s1 <> '') and length(stem) >= 3"""
)
def affix_decompose(spark: SparkSession, d: str) -> DataFrame:
    """Every way to take a prefix and up to two suffixes off a Latin word."""
    return X.decomposed(T.latin_words(spark, d), "word")


@query(
    f"""with w as (select word from {T.PERSIAN_WORDS_SQL}), s as (select * from {values_sql([('م',), ('ی',), ('و',), ('ها',)], 'suffix')})
    select word, suffix, word || case when suffix = 'م' and ends_with(word, 'ه') then 'ام' when suffix = 'ی' and ends_with(word, 'ه') then 'ای' when suffix = 'ی' and regexp_matches(word, '[او]$') then 'یی' when suffix = 'ی' and ends_with(word, 'ی') then ''
      when suffix = 'و' and regexp_matches(word, '[اوهی]$') then 'رو' else suffix end as composed from w, s"""
)
def affix_compose(spark: SparkSession, d: str) -> DataFrame:
    """Every word with four endings, by the rules of what joins to what."""
    suffixes = F.array(*map(F.lit, ("م", "ی", "و", "ها")))
    rows = T.persian_words(spark, d).select("word", F.explode(suffixes).alias("suffix"))
    return rows.withColumn("composed", F.concat("word", X.joined_suffix(F.col("word"), F.col("suffix"))))


@query(f"select typed as word, {SLOTS_SQL} as slots from (select word as typed from {T.LATIN_WORDS_SQL})")
def vowel_runs(spark: SparkSession, d: str) -> DataFrame:
    """What the vowels of every typed word can stand for, run by run."""
    return T.latin_words(spark, d).select("word", D.vowel_slots(F.col("word")).alias("slots"))


# Lines of candidate lists.

LINES_SQL = f"(select example_id, pos, typed from (select example_id, unnest(l) as typed, unnest(range(len(l))) as pos from (select example_id, string_split(lower(latin), ' ') as l from example where latin is not null)) where typed <> '')"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The typed words of every line with a Latin text."""
    rows = table(spark, d, "example").select("example_id", F.posexplode(F.split(F.lower("latin"), " ")).alias("pos", "typed"))
    return rows.where("typed <> ''").withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""with s as (select example_id, pos, typed, coalesce(output, typed) as output, coalesce(probability, 0) as probability from {LINES_SQL} left join (select * from {LISTS_SQL} where ord = 0) using (typed))
    select example_id, string_agg(output, ' ' order by pos) as text, round(exp(avg(round(ln(greatest(probability, 1e-9)), 9))), 4) as confidence, count(*) as n_words from s group by example_id"""
)
def document_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Every line put together from the first readings, and the geometric mean of their probabilities."""
    top = lists(spark, d).where("ord = 0").select("typed", "output", "probability")
    rows = lines(spark, d).join(top, "typed", "left").select("example_id", "pos", F.coalesce("output", "typed").alias("output"), F.coalesce("probability", F.lit(0.0)).alias("p"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "output"))), lambda x: x["output"]), " ")
    return rows.groupBy("example_id").agg(text.alias("text"), F.round(F.exp(F.avg(F.round(F.log(F.greatest("p", F.lit(1e-9))), 9))), 4).alias("confidence"), F.count("*").alias("n_words"))


@query(
    f"""with l as (select example_id, pos, typed, typed in (select typed from {LISTS_SQL}) as known from {LINES_SQL}), r as (select *, sum(case when known then 0 else 1 end) over (partition by example_id order by pos) as run from l)
    select example_id, min(pos) as first_pos, count(*) as n_words from r where known group by example_id, run having count(*) > 1"""
)
def context_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more neighbouring words with readings; a word without one breaks the run."""
    known = lists(spark, d).select("typed").distinct().withColumn("known", F.lit(True))
    rows = lines(spark, d).join(known, "typed", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("known"), 0).otherwise(1)).over(Window.partitionBy("example_id").orderBy("pos")))
    return rows.where("known").groupBy("example_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_words")).where("n_words > 1").drop("run")


VITERBI_SQL = f"""
with recursive pairs as {P.PMI_SQL}, l as (select example_id, row_number() over (partition by example_id order by pos) as i, typed from {LINES_SQL} where typed in (select typed from {LISTS_SQL})),
c as (select l.example_id, l.i, s.ord, s.output, ln(greatest(s.probability, 1e-6)) as e from l join {LISTS_SQL} s using (typed)),
v(example_id, i, ord, output, score, path) as (
  select example_id, i, ord, output, e, [output] from c where i = 1
  union all
  select example_id, i, ord, output, (best).s, list_append((best).p, output) from (
    select c.example_id, c.i, c.ord, c.output, arg_max({{'s': v.score + 6 * coalesce(b.pmi, 0) / 6 + c.e, 'p': v.path}}, (round(v.score + coalesce(b.pmi, 0), 9), -v.ord)) as best
    from c join v on v.example_id = c.example_id and v.i = c.i - 1 left join pairs b on b.head = v.output and b.tail = c.output group by all))
select example_id, array_to_string(path, ' ') as chosen from (select v.*, row_number() over (partition by example_id order by i desc, round(score, 9) desc, ord) as k from v) where k = 1
"""


@query(VITERBI_SQL)
def viterbi_path(spark: SparkSession, d: str) -> DataFrame:
    """The readings of every line that fit one another best."""
    options = lists(spark, d).groupBy("typed").agg(F.sort_array(F.collect_list(F.struct("ord", "output", "probability"))).alias("options"))
    # by line over all cores: few bytes, but much work on each, which adaptive execution would put into few tasks
    words = dealt(lines(spark, d).join(options, "typed"), "example_id")
    rows = words.groupBy("example_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "options"))), lambda x: x["options"]).alias("lists"))
    pairs = P.top_pairs(spark, d).select("head", "tail", (F.col("pmi") / 6).alias("score"))
    return D.chosen_paths(rows, "example_id", pairs).select("example_id", F.array_join("chosen", " ").alias("chosen"))


@query(
    f"""with l as {LISTS_SQL}, lex as (select distinct fa as output from loanwords), b as (select typed, output, probability, output in (select word from ({P.ORACLES['unigram_logquant']})) or output in (select output from lex) as known from l where ord = 0),
    a as (select typed, arg_min(output, ord) as output, arg_min(probability, ord) as probability from l where output in (select output from lex) group by typed)
    select b.typed, case when not b.known and a.output is not null and b.probability - a.probability < 0.25 then a.output else b.output end as output from b left join a using (typed)"""
)
def lexicon_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """An unknown first reading gives way to a lexicon word that is nearly as probable."""
    rows = lists(spark, d)
    lex = table(spark, d, "loanwords").where("fa is not null").select(F.col("fa").alias("output")).distinct().withColumn("lex", F.lit(True))
    freq = P.unigram_logquant(spark, d).select(F.col("word").alias("output"), F.lit(True).alias("freq"))
    flagged = rows.join(lex, "output", "left").join(freq, "output", "left")
    best = flagged.where("ord = 0").select("typed", "output", "probability", (F.coalesce("lex", F.lit(False)) | F.coalesce("freq", F.lit(False))).alias("known"))
    other = flagged.where("lex").groupBy("typed").agg(F.min(F.struct("ord", "output", "probability")).alias("o"))
    swap = ~F.col("known") & F.col("o.output").isNotNull() & (F.col("probability") - F.col("o.probability") < 0.25)
    return best.join(other, "typed", "left").select("typed", F.when(swap, F.col("o.output")).otherwise(F.col("output")).alias("output"))


@query(
    f"""with l as (select example_id, pos, typed from {LINES_SQL} where typed in (select typed from {LISTS_SQL})), t as (select l.example_id, l.pos, s.output, s.probability from l join {LISTS_SQL} s using (typed) where s.ord = 0),
    base as (select example_id, string_agg(output, ' ' order by pos) as text from t group by 1),
    v as (select t.example_id, t.pos, s.output, s.ord, t.probability from t join l using (example_id, pos) join {LISTS_SQL} s on s.typed = l.typed where s.ord > 0),
    r as (select *, dense_rank() over (partition by example_id order by probability, pos) as k from v), x as (select * from r where k <= 3),
    a as (select x.example_id, x.k, x.ord, (select string_agg(case when t.pos = x.pos then x.output else t.output end, ' ' order by t.pos) from t where t.example_id = x.example_id) as text from x),
    d as (select example_id, text, min((k, ord)) as place from a where text <> (select text from base where base.example_id = a.example_id) group by 1, 2)
    select example_id, text, rank from (select example_id, text, row_number() over (partition by example_id order by place) - 1 as rank from d) where rank < 3"""
)
def text_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Up to three other readings of every line: one word changed, the least certain first."""
    options = lists(spark, d).groupBy("typed").agg(F.sort_array(F.collect_list(F.struct("ord", "output", "probability"))).alias("o"))
    rows = lines(spark, d).join(options, "typed").groupBy("example_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]).alias("lists"))
    base = F.transform("lists", lambda o: o[0]["output"])
    places = F.sort_array(F.filter(F.transform("lists", lambda o, i: F.struct(o[0]["probability"].alias("p"), i.alias("i"), F.size(o).alias("n"))), lambda x: x["n"] > 1))
    rows = rows.withColumns({"base": base, "places": F.slice(places, 1, 3)})
    texts = F.flatten(F.transform("places", lambda x: F.transform(F.slice(F.get("lists", x["i"]), 2, 8), lambda c: F.array_join(F.transform("base", lambda b, j: F.when(j == x["i"], c["output"]).otherwise(b)), " "))))
    distinct = F.array_distinct(F.filter(texts, lambda t: t != F.array_join("base", " ")))
    return rows.select("example_id", F.posexplode(F.slice(distinct, 1, 3)).alias("rank", "text")).withColumn("rank", F.col("rank").cast("long"))
