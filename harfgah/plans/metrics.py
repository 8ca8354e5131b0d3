"""Accuracy, error classes and habits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.functions import words as W
from harfgah.functions.fold import ARABIC_DIGITS, LATIN_DIGITS, PERSIAN_DIGITS, ZWNJ
from harfgah.functions.tables import JOINING_PREFIXES, JOINING_SUFFIXES
from harfgah.operators import alignment as A
from harfgah.plans import candidates as D
from harfgah.plans.registry import Registry
from harfgah.plans.sqltools import match_key_sql, metric_words_sql, naive_word_sql, split_sql
from harfgah.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

NAIVE_SQL = f"array_to_string(list_transform(regexp_extract_all(input, '[A-Za-z'']+|[^A-Za-z'']+', 0), lambda p: case when regexp_matches(p, '^[A-Za-z'']') then {naive_word_sql('p')} else p end), '')"
#: Every evaluation row with its reference, its other references and the naive conversion as the system's output.
CASES_SQL = f"(select eval_set, id, coalesce(category, 'gold') as category, expected, alternatives, {match_key_sql('expected')} as ref, {match_key_sql(NAIVE_SQL)} as got from (select 'chat_test' as eval_set, id, category, input, expected, alternatives from chat_test union all select 'authored', id, null, input, expected, alternatives from authored) where expected is not null)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_test").select(F.lit("chat_test").alias("eval_set"), "id", "category", "input", "expected", "alternatives")
    rows = rows.unionByName(table(spark, d, "authored").select(F.lit("authored").alias("eval_set"), "id", F.lit(None).cast("string").alias("category"), "input", "expected", "alternatives")).where("expected is not null")
    return rows.select("eval_set", "id", F.coalesce("category", F.lit("gold")).alias("category"), "expected", "alternatives", W.match_key(F.col("expected")).alias("ref"), W.match_key(W.naive_text(F.col("input"))).alias("got"))


def coded_sql(a: str, b: str) -> str:
    known = f"list_distinct(list_concat({a}, {b}))"
    code = lambda w: f"array_to_string(list_transform({w}, lambda x: chr(list_position({known}, x)::integer)), '')"
    return f"case when len({a}) = 0 then 0 else least(case when len({b}) = 0 then len({a}) else levenshtein({code(a)}, {code(b)}) end, len({a})) end"


def coded_text_sql(x: str, a: str, b: str) -> str:
    """A text with its characters as one byte each: DuckDB's edit distance counts bytes."""
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr(list_position(list_distinct(string_split({a} || {b}, '')), c)::integer)), '')"


SCORED_SQL = f"(select *, {split_sql('ref')} as rw, {split_sql('got')} as gw, {coded_sql(split_sql('ref'), split_sql('got'))} as errors from {CASES_SQL})"


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d).withColumns({"rw": W.split_blank(F.col("ref")), "gw": W.split_blank(F.col("got"))})
    return rows.withColumn("errors", A.word_errors(F.col("rw"), F.col("gw")))


@query(f"select id, len(rw)::bigint as total, (len(rw) - errors)::bigint as correct from {SCORED_SQL}")
def word_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("id", F.size("rw").cast("long").alias("total"), (F.size("rw") - F.col("errors")).cast("long").alias("correct"))


ALTS_SQL = f"(select id, min(e)::bigint as errors from (select id, {coded_sql(split_sql('r'), split_sql('got'))} as e from (select id, got, unnest(list_concat([ref], list_transform(alternatives, lambda a: {match_key_sql('a')}))) as r from {CASES_SQL})) group by id)"


@query(f"select s.id, len(rw)::bigint as total, greatest(0, len(rw) - a.errors)::bigint as correct from {SCORED_SQL} s join {ALTS_SQL} a using (id)")
def accepted_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The least errors over all accepted references, out of the first one's words."""
    rows = cases(spark, d)
    refs = rows.select("id", "got", F.size(W.split_blank(F.col("ref"))).alias("total"), F.explode(F.concat(F.array("ref"), F.transform(F.coalesce("alternatives", F.array().cast("array<string>")), W.match_key))).alias("r"))
    errors = A.word_errors(W.split_blank(F.col("r")), W.split_blank(F.col("got")))
    return refs.groupBy("id").agg(F.first("total").cast("long").alias("total"), F.min(errors).alias("e")).select("id", "total", F.greatest(F.lit(0), F.col("total") - F.col("e")).cast("long").alias("correct"))


def lenient_sql(column: str) -> str:
    """id and the words of a column of the cases, prefixes and endings joined to their stems."""
    return f"""(with w as (select id, unnest({metric_words_sql(column)}) as raw, unnest(range(len({metric_words_sql(column)}))) as pos from {CASES_SQL}),
    f as (select id, pos, translate(raw, 'آأإ{PERSIAN_DIGITS}{ARABIC_DIGITS}', 'ااا{LATIN_DIGITS}{LATIN_DIGITS}') as w from w),
    k as (select *, w in {JOINING_PREFIXES} as pre, w in {JOINING_SUFFIXES} as suf from f), l as (select *, coalesce(lag(pre) over (partition by id order by pos), false) as after_pre from k),
    s as (select *, sum(case when after_pre or (suf and pos > 0) then 0 else 1 end) over (partition by id order by pos) as g from l), j as (select id, g, string_agg(w, '' order by pos) as word from s group by all)
    select c.id, coalesce(list(word order by g) filter (where word is not null), []) as words from {CASES_SQL} c left join j using (id) group by c.id)"""


def one_sql(solid: str, words: str, k: int) -> str:
    """Could so many words from a place of a list be the one solid word."""
    return f"({solid} = array_to_string({words}, '') or (({words})[1] in ('به', 'چه') and {solid} = left(({words})[1], 1) || substr(array_to_string({words}, ''), 3)))::integer"


#: All cells of the alignment, one after another: the list of those before holds what each needs.
LENIENT_SQL = f"""(with p as (select r.id, r.words as r, g.words as g from {lenient_sql('ref')} r join {lenient_sql('got')} g using (id)),
 c as (select *, len(g) + 1 as w, list_transform(range(((len(r) + 1) * (len(g) + 1))::bigint), lambda z: [z // (len(g) + 1), z % (len(g) + 1)]) as cells from p),
 x as (select id, r, g, w, list_transform(cells, lambda z: case when z[1] = 0 or z[2] = 0 then [z[1], z[2], 0, 0, 0, 0, 0] else [z[1], z[2], (r[z[1]] <> g[z[2]])::integer,
   case when z[2] >= 2 then {one_sql('r[z[1]]', 'g[z[2] - 1 : z[2]]', 2)} else 0 end, case when z[2] >= 3 then {one_sql('r[z[1]]', 'g[z[2] - 2 : z[2]]', 3)} else 0 end,
   case when z[1] >= 2 then {one_sql('g[z[2]]', 'r[z[1] - 1 : z[1]]', 2)} else 0 end, case when z[1] >= 3 then {one_sql('g[z[2]]', 'r[z[1] - 2 : z[1]]', 3)} else 0 end] end) as cells from c)
 select id, len(r) as total, least(len(r), (list_reduce(list_concat([[]::bigint[]], cells), lambda d, z: list_append(d, case when z[1] = 0 or z[2] = 0 then z[1] + z[2] else least(d[(z[1] - 1) * w + z[2] + 1] + 1, d[z[1] * w + z[2]] + 1, d[(z[1] - 1) * w + z[2]] + z[3],
   case when z[4] = 1 then d[(z[1] - 1) * w + z[2] - 1] else 1000000 end, case when z[5] = 1 then d[(z[1] - 1) * w + z[2] - 2] else 1000000 end,
   case when z[6] = 1 then d[(z[1] - 2) * w + z[2]] else 1000000 end, case when z[7] = 1 then d[(z[1] - 3) * w + z[2]] else 1000000 end) end)))[-1]) as errors from x)"""


@query(f"select id, total::integer as total, (total - errors)::integer as correct from {LENIENT_SQL}")
def lenient_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy where affixes may be joined and one word may be written as two or three."""
    rows = cases(spark, d).select("id", W.lenient_words(W.metric_words(F.col("ref"))).alias("r"), W.lenient_words(W.metric_words(F.col("got"))).alias("g"))
    return A.aligned(rows, "id", "r", "g").select("id", F.col("n_ref").alias("total"), (F.col("n_ref") - F.col("joined_errors")).alias("correct"))


@query()
def mismatch_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d).select("id", W.split_blank(F.col("ref")).alias("r"), W.split_blank(F.col("got")).alias("g"))
    return A.aligned(rows, "id", "r", "g").select("id", F.inline("runs"))


ASCII_SQL = "regexp_replace(lower({}), '[^a-z ]', '', 'g')"


@query(f"select id, round(case when length(a) = 0 then (length(b) > 0)::integer else (case when length(b) = 0 then length(a) else levenshtein(a, b) end) / length(a) end, 6) as cer from (select id, {ASCII_SQL.format('input')} as a, replace(replace({ASCII_SQL.format('input')}, 'oo', 'u'), 'aa', 'a') as b from chat_test)")
def cer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Character error rate of a typing against one with short vowels."""
    a = F.regexp_replace(F.lower("input"), "[^a-z ]", "")
    b = F.replace(F.replace(a, F.lit("oo"), F.lit("u")), F.lit("aa"), F.lit("a"))
    return table(spark, d, "chat_test").select("id", a.alias("a"), b.alias("b")).select("id", F.round(A.char_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query(f"select id, len(regexp_extract_all(expected, '{ZWNJ}', 0))::bigint as n_joiners, list_transform(list_filter(range(length(expected)), lambda i: substr(expected, i + 1, 1) = '{ZWNJ}'), lambda i: i)::integer[] as places from chat_test where expected is not null")
def zwnj_signature(spark: SparkSession, d: str) -> DataFrame:
    places = F.filter(F.transform(F.split("expected", ""), lambda c, i: F.when(c == ZWNJ, i)), lambda i: i.isNotNull())
    return table(spark, d, "chat_test").where("expected is not null").select("id", (F.length("expected") - F.length(F.replace("expected", F.lit(ZWNJ), F.lit("")))).cast("long").alias("n_joiners"), places.alias("places"))


@query("select lang, count(*) as n, sum(len(regexp_extract_all(text, '[?;,]', 0)))::bigint as n_latin_marks, sum(len(regexp_extract_all(text, '[؟؛،]', 0)))::bigint as n_persian_marks from documents group by lang")
def punctuation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Marks that localisation would change, and those that are Persian already."""
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("[?;,]"))).cast("long").alias("n_latin_marks"), F.sum(F.regexp_count("text", F.lit("[؟؛،]"))).cast("long").alias("n_persian_marks"))


RECALL_SQL = f"(select t.word, t.typed, t.n, min(l.ord) filter (where l.output = t.word) as place from {D.P.TYPED_SQL} t join {D.ALL_LISTS_SQL} l using (typed) group by all)"


@query(f"select count(*) as n_pairs, sum(n)::bigint as n_words, {', '.join(f'sum(n) filter (where place < {k})::bigint as top_{k}' for k in (1, 3, D.READINGS))}, sum(n) filter (where place is not null)::bigint as oracle from {RECALL_SQL}")
def oracle_recall(spark: SparkSession, d: str) -> DataFrame:
    """How often the word is the first reading, among three, among as many as are reranked, among all of the form."""
    hit = D.P.typed(spark, d).join(D.lists(spark, d, None).select("typed", F.col("output").alias("word"), "ord"), ["typed", "word"], "left")
    n = lambda c: F.sum(F.when(c, F.col("n")))
    tops = [n(F.col("ord") < k).alias(f"top_{k}") for k in (1, 3, D.READINGS)]
    return hit.agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_words"), *tops, n(F.col("ord").isNotNull()).alias("oracle"))


@query(f"select place, count(*) as n_pairs, sum(n)::bigint as n_words from {RECALL_SQL} group by place")
def candidate_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every reading's place among all of its form."""
    hit = D.P.typed(spark, d).join(D.lists(spark, d, None).select("typed", F.col("output").alias("word"), F.col("ord").alias("place")), ["typed", "word"], "left")
    return hit.groupBy("place").agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n_words"))


MISSES_SQL = f"(select t.word as want, l.output as got, t.n from {D.P.TYPED_SQL} t join {D.LISTS_SQL} l on l.typed = t.typed and l.ord = 0 where l.output <> t.word)"


def misses(spark: SparkSession, d: str) -> DataFrame:
    first = D.lists(spark, d).where("ord = 0").select("typed", F.col("output").alias("got"))
    return D.P.typed(spark, d).join(first, "typed").where("got <> word").select(F.col("word").alias("want"), "got", "n")


MISS_FOLD = ("سصثتطزذضظقغهحاآ", "sssttzzzzqqhhaa".replace(" ", ""))


@query(
    f"""select case when contains(want, '{ZWNJ}') then 'joiner' when regexp_matches(want, '[عءئؤ]') and not regexp_matches(got, '[عءئؤ]') then 'ain or hamza' when translate(want, 'آ', 'ا') = translate(got, 'آ', 'ا') then 'alef form'
      when translate(want, 'وی', '') = translate(got, 'وی', '') then 'long vowel' when translate(want, '{MISS_FOLD[0]}', '{MISS_FOLD[1]}') = translate(got, '{MISS_FOLD[0]}', '{MISS_FOLD[1]}') then 'homophone'
      when abs(length(want) - length(got)) >= 2 then 'other word' else 'other' end as class, count(*) as n_pairs, sum(n)::bigint as n from {MISSES_SQL} group by 1"""
)
def miss_classes(spark: SparkSession, d: str) -> DataFrame:
    """Why a word isn't the first reading, by the first reason that holds."""
    w, g = F.col("want"), F.col("got")
    same = lambda a, b: F.translate(w, a, b) == F.translate(g, a, b)
    kind = (
        F.when(w.contains(ZWNJ), "joiner").when(w.rlike("[عءئؤ]") & ~g.rlike("[عءئؤ]"), "ain or hamza").when(same("آ", "ا"), "alef form").when(same("وی", ""), "long vowel")
        .when(same(*MISS_FOLD), "homophone").when(F.abs(F.length(w) - F.length(g)) >= 2, "other word").otherwise("other")
    )
    return misses(spark, d).groupBy(kind.alias("class")).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n"))


HOMO = ("صثذضظطغحعئءأ", "سسزززتقهاااا")


@query(
    f"""select case when regexp_matches(want, '[0-9]') <> regexp_matches(got, '[0-9]') then 'number' when regexp_replace(want, 'ه$', '') = regexp_replace(got, 'ه$', '') then 'he' when translate(want, '{HOMO[0]}', '{HOMO[1]}') = translate(got, '{HOMO[0]}', '{HOMO[1]}') then 'homophone'
      when translate(translate(want, '{HOMO[0]}', '{HOMO[1]}'), 'اوی', '') = translate(translate(got, '{HOMO[0]}', '{HOMO[1]}'), 'اوی', '') then 'vowel' else 'other' end as error, count(*) as n_pairs, sum(n)::bigint as n from {MISSES_SQL} group by 1"""
)
def error_groups(spark: SparkSession, d: str) -> DataFrame:
    w, g = F.col("want"), F.col("got")
    f = lambda c: F.translate(c, *HOMO)
    bare = lambda c: F.translate(f(c), "اوی", "")
    kind = F.when(w.rlike("[0-9]") != g.rlike("[0-9]"), "number").when(F.regexp_replace(w, "ه$", "") == F.regexp_replace(g, "ه$", ""), "he").when(f(w) == f(g), "homophone").when(bare(w) == bare(g), "vowel").otherwise("other")
    return misses(spark, d).groupBy(kind.alias("error")).agg(F.count("*").alias("n_pairs"), F.sum("n").alias("n"))


DIGRAPHS = [("kh", "خ", "که"), ("sh", "ش", "سه"), ("ch", "چ", "که"), ("zh", "ژ", "زه"), ("gh", "ق", "گه")]


@query(f"select unit, count(*) as n_pairs, count(*) filter (where list_contains(list_transform(list_filter(range(1, length(got) + 1), lambda i: substr(got, i, length(wrong)) = wrong), lambda i: left(got, i - 1) || whole || substr(got, i + length(wrong))), want)) as n_repaired from {MISSES_SQL}, {D.values_sql(DIGRAPHS, 'unit, whole, wrong')} where contains(got, wrong) and contains(want, whole) group by unit")
def digraph_splits(spark: SparkSession, d: str) -> DataFrame:
    """Readings that spelled a digraph as two letters, and those that one replacement repairs."""
    rules = F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(x).alias("whole"), F.lit(y).alias("wrong")) for u, x, y in DIGRAPHS))
    rows = misses(spark, d).select("want", "got", F.inline(rules)).where(F.contains("got", "wrong") & F.contains("want", "whole"))
    fixed = F.transform(F.sequence(F.lit(1), F.length("got")), lambda i: F.when(F.col("got").substr(i, F.length("wrong")) == F.col("wrong"), F.concat(F.col("got").substr(F.lit(1), i - 1), "whole", F.col("got").substr(i + F.length("wrong"), F.length("got")))))
    return rows.groupBy("unit").agg(F.count("*").alias("n_pairs"), F.count_if(F.coalesce(F.array_contains(F.array_compact(fixed), F.col("want")), F.lit(False))).alias("n_repaired"))


HABITS = {"aa": "aa", "oo": "oo", "ou": "ou", "ee": "ee", "q": "q", "x": "x", "w": "w", "kh": "kh", "final_e": "e( |$)", "final_eh": "eh( |$)", "apostrophe": "'"}
HABIT_SQL = f"(select coalesce(persona, 'none') as persona, count(*) as n_lines, sum(len({split_sql('t')}))::double as words, {', '.join(f'''sum(len(regexp_extract_all(t, {chr(39)}{p.replace(chr(39), chr(39) * 2)}{chr(39)}, 0))) as {k}''' for k, p in HABITS.items())} from (select persona, regexp_replace(lower(latin), '[^a-z'' ]+', ' ', 'g') as t from example where latin is not null) group by 1)"


def _habits(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace(F.lower("latin"), "[^a-z' ]+", " ")
    rows = table(spark, d, "example").where("latin is not null").select(F.coalesce("persona", F.lit("none")).alias("persona"), t.alias("t"))
    return rows.groupBy("persona").agg(F.count("*").alias("n_lines"), F.sum(F.size(W.split_blank(F.col("t")))).cast("double").alias("words"), *(F.sum(F.regexp_count("t", F.lit(p))).alias(k) for k, p in HABITS.items()))


@query(f"select persona, n_lines, {', '.join(f'round(100 * {k} / words, 6) as {k}' for k in HABITS)} from {HABIT_SQL}")
def typing_habits(spark: SparkSession, d: str) -> DataFrame:
    """How often in a hundred words each persona types what others type otherwise."""
    return _habits(spark, d).select("persona", "n_lines", *(F.round(100 * F.col(k) / F.col("words"), 6).alias(k) for k in HABITS))


@query(f"with h as (select persona, {', '.join(f'round(100 * {k} / words, 6) as {k}' for k in HABITS)} from {HABIT_SQL}), r as (select * from h where persona = 'careful') select h.persona, round(({' + '.join(f'abs(h.{k} - r.{k}) / greatest(r.{k}, 0.5)' for k in HABITS)}) / {len(HABITS)}, 6) as l1 from h, r")
def habit_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far each persona's habits are from the careful one's."""
    h = typing_habits(spark, d).drop("n_lines")
    r = h.where("persona = 'careful'").select(*(F.col(k).alias(f"r_{k}") for k in HABITS))
    parts = [F.abs(F.col(k) - F.col(f"r_{k}")) / F.greatest(F.col(f"r_{k}"), F.lit(0.5)) for k in HABITS]
    return h.join(F.broadcast(r)).select("persona", F.round(sum(parts[1:], parts[0]) / len(HABITS), 6).alias("l1"))


TIER_SQL = f"(select s.eval_set, s.category, s.id, len(rw) as total, len(rw) - s.errors as strict, greatest(0, len(rw) - a.errors) as accepted, (ref = got)::integer as exact from {SCORED_SQL} s join {ALTS_SQL} a using (id))"


def tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("eval_set", "category", "id", F.size("rw").alias("total"), (F.size("rw") - F.col("errors")).alias("strict"), (F.col("ref") == F.col("got")).cast("int").alias("exact"))
    return rows.join(accepted_accuracy(spark, d).select("id", F.col("correct").alias("accepted")), "id")


@query(f"select coalesce(category, 'all') as category, count(*) as n, sum(t.total)::bigint as n_words, sum(strict)::bigint as strict, sum(accepted)::bigint as accepted, sum(exact)::bigint as exact, sum(l.total)::bigint as n_joined_words, sum(l.total - l.errors)::bigint as orthographic, round(sum(strict) / nullif(sum(t.total), 0), 6) as accuracy, round(sum(l.total - l.errors) / nullif(sum(l.total), 0), 6) as orthographic_accuracy from {TIER_SQL} t join {LENIENT_SQL} l using (id) group by rollup (category)")
def category_report(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by category, and over all: strict, accepted, exact, and orthographic, which has its own number of words."""
    joined = lenient_accuracy(spark, d).select("id", F.col("total").alias("joined"), F.col("correct").alias("orthographic"))
    r = tiers(spark, d).join(joined, "id").rollup("category")
    total = [F.count("*").alias("n"), *(F.sum(a).alias(b) for a, b in (("total", "n_words"), ("strict", "strict"), ("accepted", "accepted"), ("exact", "exact"), ("joined", "n_joined_words"), ("orthographic", "orthographic")))]
    made = r.agg(*total).withColumns({"accuracy": F.round(F.try_divide("strict", "n_words"), 6), "orthographic_accuracy": F.round(F.try_divide("orthographic", "n_joined_words"), 6)})
    return made.withColumn("category", F.coalesce("category", F.lit("all")))


SUBJECTS_SQL = f"(select eval_set, 'naive' as subject, errors as e, len(rw) as total from {SCORED_SQL} union all select eval_set, 'nothing', len(rw), len(rw) from {SCORED_SQL})"


@query(f"select subject, eval_set, count(*) as n, round(1 - sum(e) / nullif(sum(total), 0), 6) as accuracy from {SUBJECTS_SQL} group by all")
def subject_scores(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).groupBy("subject", "eval_set").agg(F.count("*").alias("n"), F.round(1 - F.try_divide(F.sum("e"), F.sum("total")), 6).alias("accuracy"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("eval_set", F.col("errors").alias("naive"), F.size("rw").alias("nothing"), F.size("rw").alias("total"))
    return rows.unpivot(["eval_set", "total"], ["naive", "nothing"], "subject", "e")


@query(f"select eval_set, round(1 - sum(e) filter (where subject = 'naive') / nullif(sum(total) filter (where subject = 'naive'), 0), 6) as naive, round(1 - sum(e) filter (where subject = 'nothing') / nullif(sum(total) filter (where subject = 'nothing'), 0), 6) as nothing, round((sum(e) filter (where subject = 'nothing') - sum(e) filter (where subject = 'naive')) / nullif(sum(total) filter (where subject = 'naive'), 0), 6) as gain from {SUBJECTS_SQL} group by eval_set")
def gain_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = _subjects(spark, d).groupBy("eval_set").pivot("subject", ["naive", "nothing"]).agg(F.sum("e").alias("e"), F.sum("total").alias("t"))
    return p.select("eval_set", F.round(1 - F.try_divide("naive_e", "naive_t"), 6).alias("naive"), F.round(1 - F.try_divide("nothing_e", "nothing_t"), 6).alias("nothing"), F.round(F.try_divide(F.col("nothing_e") - F.col("naive_e"), "naive_t"), 6).alias("gain"))


JUDGED_SQL = "(select id, ref_span, hyp_span, bool_and(v = 'accept') as accepted from (select id, ref_span, hyp_span, lower(trim(verdict)) as v from judge_calibration where judge in ('claude', 'luna')) where v in ('accept', 'reject') group by all)"


@query(
    f"""with a as (select id, bool_and(accepted) as accepted from {JUDGED_SQL} group by id), c as (select eval_set, id, case when length(ref) = 0 then (length(got) > 0)::integer else (case when length(got) = 0 then length(ref) else levenshtein({coded_text_sql('ref', 'ref', 'got')}, {coded_text_sql('got', 'ref', 'got')}) end) / length(ref) end as cer from {CASES_SQL})
    select eval_set, c.id, round(cer, 6) as cer, case when a.accepted then 'kept by audit' when a.accepted = false then 'set aside by audit' when cer > 0.9 then 'set aside' else 'kept' end as part from c left join a using (id)"""
)
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows whose reference is too far from what was typed are set aside; where judges audited a row, they decide."""
    v = table(spark, d, "judge_calibration").where("judge in ('claude', 'luna')").select("id", F.lower(F.trim("verdict")).alias("v")).where("v in ('accept', 'reject')")
    audit = v.groupBy("id").agg(F.bool_and(F.col("v") == "accept").alias("accepted"))
    rows = cases(spark, d).select("eval_set", "id", A.char_error_rate(F.col("ref"), F.col("got")).alias("cer")).join(audit, "id", "left")
    part = F.when(F.col("accepted"), "kept by audit").when(~F.col("accepted"), "set aside by audit").when(F.col("cer") > 0.9, "set aside").otherwise("kept")
    return rows.select("eval_set", "id", F.round("cer", 6).alias("cer"), part.alias("part"))


@query(f"select s.category, count(*) as n, sum(len(rw))::bigint as n_words, sum(errors)::bigint as errors, sum(least(errors, coalesce(j.n, 0)))::bigint as refunded from {SCORED_SQL} s left join (select id, count(*) filter (where accepted) as n from {JUDGED_SQL} group by id) j using (id) group by s.category")
def judged_tier(spark: SparkSession, d: str) -> DataFrame:
    """Errors of each category, and how many of them are refunded for spans that both judges accepted."""
    v = table(spark, d, "judge_calibration").where("judge in ('claude', 'luna')").select("id", "ref_span", "hyp_span", F.lower(F.trim("verdict")).alias("v")).where("v in ('accept', 'reject')")
    spans = v.groupBy("id", "ref_span", "hyp_span").agg(F.bool_and(F.col("v") == "accept").alias("accepted"))
    refunds = spans.groupBy("id").agg(F.count_if("accepted").alias("n_accepted"))
    rows = scored(spark, d).join(refunds, "id", "left")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.size("rw")).alias("n_words"), F.sum("errors").alias("errors"), F.sum(F.least("errors", F.coalesce("n_accepted", F.lit(0)))).alias("refunded"))
