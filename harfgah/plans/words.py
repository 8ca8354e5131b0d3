"""Folding, word and token queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.functions import words as W
from harfgah.functions.fold import ARABIC_DIGITS, DEAD_INVISIBLES, HAMZA_ALEF, LATIN_DIGITS, LETTERS, MARKS, PERSIAN_DIGITS, PUNCTUATION, TEH_MARBUTA, ZWNJ, translate_sql, translated
from harfgah.functions.tables import ENGLISH, ENGLISH_CLUSTERS, ENGLISH_SUFFIXES, HOMOGRAPHS, JOINING_PREFIXES, JOINING_SUFFIXES
from harfgah.operators import tokens as K
from harfgah.plans.scanner_sql import tokens_sql
from harfgah.plans.sqltools import leak_key_sql, match_key_sql, metric_words_sql, naive_word_sql, normal_sql, quoted, split_sql, unstretch_sql
from harfgah.session import parallel, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return parallel(table(spark, d, "documents").select("doc_id", "text"))


def latin_words(spark: SparkSession, d: str) -> DataFrame:
    """Every different Latin word of example.latin in lower case, with its count."""
    words = table(spark, d, "example").select(F.explode(F.regexp_extract_all(F.col("latin"), F.lit(W.LATIN_WORD), 0)).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))


LATIN_WORDS_SQL = f"(select lower(w) as word, count(*) as n from (select unnest(regexp_extract_all(latin, '{W.LATIN_WORD}', 0)) as w from example) group by 1)"


def persian_words(spark: SparkSession, d: str) -> DataFrame:
    """Every different word of example.persian in folded form, with its count."""
    words = table(spark, d, "example").select(F.explode(F.split(W.leak_key(F.col("persian")), " ")).alias("word"))
    return words.where(words["word"].rlike(f"^{W.PERSIAN_WORD}$")).groupBy("word").agg(F.count("*").alias("n"))


PERSIAN_WORDS_SQL = f"(select word, count(*) as n from (select unnest(string_split({leak_key_sql('persian')}, ' ')) as word from example) where regexp_full_match(word, '{W.PERSIAN_WORD}') group by 1)"


@query(f"select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z'']+|[^A-Za-z'']+', 0), lambda p: case when regexp_matches(p, '^[A-Za-z'']') then {naive_word_sql('p')} else p end), '') as output from documents")
def naive_transliterate_docs(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its Latin runs converted unit by unit."""
    return docs(spark, d).select("doc_id", W.naive_text(F.col("text")).alias("output"))


LETTER_PAIRS = LETTERS | HAMZA_ALEF | TEH_MARBUTA


@query(f"select doc_id, {translate_sql('text', LETTER_PAIRS)} as folded from documents")
def fold_letters(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", translated(F.col("text"), LETTER_PAIRS).alias("folded"))


@query("select doc_id, replace(replace(replace(text, '?', '؟'), ';', '؛'), ',', '،') as localised from documents")
def localize_punct(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", translated(F.col("text"), PUNCTUATION).alias("localised"))


@query(f"select example_id, translate(persian, '{ARABIC_DIGITS}', '{PERSIAN_DIGITS}') as persian_digits, translate(persian, '{ARABIC_DIGITS}{PERSIAN_DIGITS}', '{LATIN_DIGITS}{LATIN_DIGITS}') as latin_digits from example")
def fold_digits(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("persian")
    return table(spark, d, "example").select("example_id", F.translate(p, ARABIC_DIGITS, PERSIAN_DIGITS).alias("persian_digits"), F.translate(p, ARABIC_DIGITS + PERSIAN_DIGITS, LATIN_DIGITS * 2).alias("latin_digits"))


@query(f"select norm_id, translate(input, '{MARKS}{DEAD_INVISIBLES}', '') as bare, length(input) - length(translate(input, '{MARKS}{DEAD_INVISIBLES}', '')) as removed from normalization")
def strip_marks(spark: SparkSession, d: str) -> DataFrame:
    bare = F.translate("input", MARKS + DEAD_INVISIBLES, "")
    return table(spark, d, "normalization").select("norm_id", bare.alias("bare"), (F.length("input") - F.length(bare)).cast("long").alias("removed"))


@query(
    rf"""select norm_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(input, '{ZWNJ}+', '{ZWNJ}', 'g'),
    '{ZWNJ}([ \t\n\f\r\p{{P}}])', '\1', 'g'), '([ \t\n\f\r\p{{P}}]){ZWNJ}', '\1', 'g'), '^{ZWNJ}|{ZWNJ}$', '', 'g') as tidy from normalization"""
)
def zwnj_hygiene(spark: SparkSession, d: str) -> DataFrame:
    edge = r"[^ \t\n\f\r\p{P}]"
    tidy = F.regexp_replace("input", rf"(?<!{edge}){ZWNJ}+|{ZWNJ}+(?!{edge})|(?<={ZWNJ}){ZWNJ}+", "")
    return table(spark, d, "normalization").select("norm_id", tidy.alias("tidy"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(text, '[ \t\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10)) as collapsed from documents")
def collapse_ws(spark: SparkSession, d: str) -> DataFrame:
    c = F.regexp_replace(F.regexp_replace("text", r"[ \t\f\r]+", " "), " ?\n ?", "\n")
    return docs(spark, d).select("doc_id", F.regexp_replace(c, "^[ \n]+|[ \n]+$", "").alias("collapsed"))


@query(f"select id, {match_key_sql('expected')} as match_key, {leak_key_sql('expected')} as leak_key from chat_test union all select id, {match_key_sql('expected')}, {leak_key_sql('expected')} from authored")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_test").select("id", "expected").unionByName(table(spark, d, "authored").select("id", "expected"))
    return rows.select("id", W.match_key(F.col("expected")).alias("match_key"), W.leak_key(F.col("expected")).alias("leak_key"))


@query(f"select split, count(*) as n, count(distinct {leak_key_sql('persian')}) as n_keys, count(*) filter (where {normal_sql('persian')} = persian) as n_normal, count(*) filter (where {match_key_sql('persian')} = persian) as n_lookup from example group by split")
def normal_share(spark: SparkSession, d: str) -> DataFrame:
    """How many rows are already in normal form, how many in lookup form, and how many different keys there are."""
    p = F.col("persian")
    rows = table(spark, d, "example").select("split", p, W.normalize_column(p).alias("form"), W.match_key(p).alias("k"), W.leak_key(p).alias("leak"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("leak").alias("n_keys"), F.count_if(F.col("form") == p).alias("n_normal"), F.count_if(F.col("k") == p).alias("n_lookup"))


@query(f"select word, n, {unstretch_sql('word')} as base, regexp_extract(word, '({'|'.join(c + '{3,}' for c in 'abcdefghijklmnopqrstuvwxyz')})$', 1) as final_run from {LATIN_WORDS_SQL}")
def unstretch_words(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    return latin_words(spark, d).select("word", "n", W.unstretched(w).alias("base"), W.final_run(w).alias("final_run"))


@query(
    """with w as (select distinct word from (select unnest(regexp_extract_all(persian, '[ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیآ]+', 0)) as word from example))
    select word, case when right(word, 1) in ('ا', 'آ', 'ی', 'ه', 'و') then word || repeat(case when right(word, 1) = 'آ' then 'ا' else right(word, 1) end, greatest(0, 5 - length(case right(word, 1)
      when 'ا' then regexp_extract(word, 'ا+$') when 'آ' then regexp_extract(word, '[آا]+$') when 'ی' then regexp_extract(word, 'ی+$') when 'ه' then regexp_extract(word, 'ه+$') else regexp_extract(word, 'و+$') end))) else word end as stretched,
    case when right(word, 1) in ('ا', 'آ', 'ی', 'ه', 'و') then word else word || repeat(right(word, 1), greatest(0, 6 - (length(word) - length(rtrim(word, right(word, 1)))))) end as hummed from w"""
)
def restretch_words(spark: SparkSession, d: str) -> DataFrame:
    """Every Persian word after a typed final vowel that was stretched to five letters, and after a consonant stretched to nine."""
    words = table(spark, d, "example").select(F.explode(F.regexp_extract_all("persian", F.lit("[ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیآ]+"), 0)).alias("word")).distinct()
    return words.select("word", K.restretched(F.col("word"), F.lit("a"), F.lit(5)).alias("stretched"), K.restretched(F.col("word"), F.lit("m"), F.lit(9)).alias("hummed"))


@query(f"select doc_id, len({metric_words_sql('text')})::bigint as n_words, len(list_distinct({metric_words_sql('text')}))::bigint as n_distinct, length(text) as n_chars from documents")
def split_words_counts(spark: SparkSession, d: str) -> DataFrame:
    words = W.metric_words(F.col("text"))
    size = lambda c: F.when(c.isNotNull(), F.size(c).cast("long"))
    return docs(spark, d).select("doc_id", size(words).alias("n_words"), size(F.array_distinct(words)).alias("n_distinct"), F.length("text").cast("long").alias("n_chars"))


@query(
    f"""with w as (select example_id, unnest({metric_words_sql('persian')}) as raw, unnest(range(len({metric_words_sql('persian')}))) as pos from example),
    f as (select example_id, pos, translate(raw, 'آأإ{PERSIAN_DIGITS}{ARABIC_DIGITS}', 'ااا{LATIN_DIGITS}{LATIN_DIGITS}') as w from w),
    k as (select *, w in {JOINING_PREFIXES} as pre, w in {JOINING_SUFFIXES} as suf from f),
    l as (select *, coalesce(lag(pre) over (partition by example_id order by pos), false) as after_pre from k),
    s as (select *, sum(case when after_pre or (suf and not after_pre and pos > 0) then 0 else 1 end) over (partition by example_id order by pos) as g from l),
    j as (select example_id, g, string_agg(w, '' order by pos) as word from s group by all)
    select example_id, string_agg(word, ' ' order by g) as joined, count(*) as n_words from j group by example_id"""
)
def lenient_words(spark: SparkSession, d: str) -> DataFrame:
    """Words after prefixes and endings are joined to their stems."""
    words = W.lenient_words(W.metric_words(F.col("persian")))
    rows = table(spark, d, "example").select("example_id", words.alias("w"))
    return rows.where(F.size("w") > 0).select("example_id", F.array_join("w", " ").alias("joined"), F.size("w").cast("long").alias("n_words"))


def _listed(words) -> str:
    return "(" + ", ".join(map(quoted, sorted(words))) + ")"


ENGLISHNESS_SQL = (
    "case when length(word) < 2 then 0.0 when word in " + _listed(HOMOGRAPHS) + " then 0.0 when word in " + _listed(ENGLISH) + " then 1.0 else least(0.99, round("
    + "case when " + " or ".join(f"(length(word) >= {6 if s in ('ize', 'ise') else len(s) + 2} and ends_with(word, '{s}'))" for s in ENGLISH_SUFFIXES) + " then 0.45 else 0 end"
    + " + case when contains(word, 'wh') then 0.5 else 0 end + case when contains(word, 'th') then 0.35 else 0 end"
    + "".join(f" + case when contains(word, '{c}') then 0.08 else 0 end" for c in ENGLISH_CLUSTERS)
    + " + case when regexp_matches(word, '" + "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyz") + "') and not regexp_matches(word, 'aa|ee|oo|ii|uu') then 0.2 else 0 end"
    + " + case when regexp_matches(word, '[bcdfgklmnprstvz]e$') and length(word) > 3 then 0.15 else 0 end, 2)) end::double"
)


@query(f"select word, n, {ENGLISHNESS_SQL} as englishness from {LATIN_WORDS_SQL}")
def englishness_scores(spark: SparkSession, d: str) -> DataFrame:
    return latin_words(spark, d).select("word", "n", W.englishness(F.col("word")).alias("englishness"))


@query(f"select word, n, translate(word, 'اآوی', '') as confusable_key, right(word, 1) = 'ه' as ends_in_he, substr(sha256(word), 1, 10) as content_id from {PERSIAN_WORDS_SQL}")
def word_keys(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("word")
    return persian_words(spark, d).select("word", "n", W.confusable_key(w).alias("confusable_key"), w.endswith("ه").alias("ends_in_he"), W.content_id(w, length=10).alias("content_id"))


def _doubles(x: str, letters: str) -> str:
    for c in letters:
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


@query(f"select word, regexp_replace({_doubles(f'''translate(word, 'صثذضظطغحعءئؤأآاویۀ', 'سسزززتقه')''', 'بپتجچخدرزژسشفقکگلمنه')}, 'ه$', '') as skeleton from {PERSIAN_WORDS_SQL} where regexp_full_match(word, '[ء-غف-يپچژکگی]+')")
def persian_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return persian_words(spark, d).select("word", W.persian_skeleton(F.col("word")).alias("skeleton")).where("skeleton is not null")


@query(
    "select word, regexp_replace("
    + _doubles("translate(replace(replace(replace(replace(replace(word, 'kh', 'خ'), 'sh', 'ش'), 'ch', 'چ'), 'zh', 'ژ'), 'gh', 'ق'), 'bptsjhxdrzqfkcglmnvwyaeiou''', 'بپتسجهخدرزقفککگلمن')", "بپتجچخدرزژسشفقکگلمنه")
    + f", 'ه$', '') as skeleton from {LATIN_WORDS_SQL}"
)
def latin_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return latin_words(spark, d).select("word", W.latin_skeleton(F.col("word")).alias("skeleton"))


@query(
    """select id, regexp_replace(trim(regexp_replace(lower(input), '[^a-z'' ]+', ' ', 'g')), ' +', ' ', 'g') as letters,
    replace(expected, chr(8204), '') as solid, list_filter(list_distinct(list_concat([expected], alternatives)), lambda a: a is not null and a <> replace(expected, chr(8204), '')).list_sort() as others,
    case when expected is null or expected = '' then 'missing' when not regexp_matches(expected, '[ء-ی]') then 'charset' when regexp_matches(expected, '[A-Za-z]') then 'latin' end as problem
    from chat_test"""
)
def reference_forms(spark: SparkSession, d: str) -> DataFrame:
    """Typed letters; the reference without joiners and its other accepted forms; why a reference is refused."""
    e, solid = F.col("expected"), F.replace(F.col("expected"), F.lit(ZWNJ), F.lit(""))
    letters = F.regexp_replace(F.trim(F.regexp_replace(F.lower("input"), "[^a-z' ]+", " ")), " +", " ")
    others = F.array_sort(F.filter(F.array_distinct(F.concat(F.array(e), "alternatives")), lambda a: a.isNotNull() & (a != solid)))
    problem = F.when(e.isNull() | (e == ""), "missing").when(~e.rlike("[ء-ی]"), "charset").when(e.rlike("[A-Za-z]"), "latin")
    return table(spark, d, "chat_test").select("id", letters.alias("letters"), solid.alias("solid"), others.alias("others"), problem.alias("problem"))


CLASSES = [("صث", "س"), ("ذضظ", "ز"), ("ط", "ت"), ("غ", "ق"), ("ح", "ه"), ("عئءأ", "ا")]


@query(f"select translate(word, '{''.join(a for a, _ in CLASSES)}', '{''.join(b * len(a) for a, b in CLASSES)}') as homophones, count(*) as n_words, sum(n)::bigint as n, max(word) as last_word from {PERSIAN_WORDS_SQL} group by 1")
def homophone_classes(spark: SparkSession, d: str) -> DataFrame:
    key = F.translate("word", "".join(a for a, _ in CLASSES), "".join(b * len(a) for a, b in CLASSES))
    return persian_words(spark, d).groupBy(key.alias("homophones")).agg(F.count("*").alias("n_words"), F.sum("n").alias("n"), F.max("word").alias("last_word"))


# Tokens.

TOKENS_SQL = tokens_sql("documents", "doc_id", "text")


@query(f"select kind, count(*) as n, sum(length(tok))::bigint as n_chars from {TOKENS_SQL} group by kind")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = K.tokens(docs(spark, d), "doc_id", "text")
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("n_chars"))


@query(f"select doc_id, pos, start, start + length(tok) as stop, kind from {TOKENS_SQL} where kind <> 'space'")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = K.tokens(docs(spark, d), "doc_id", "text")
    return t.where("kind <> 'space'").select("doc_id", "pos", "start", (F.col("start") + F.length("tok")).alias("stop"), "kind")


FLAGS_SQL = f"""(select doc_id, pos, tok, kind,
  coalesce(lag(kind) over w = 'punct' and regexp_matches(lag(tok) over w, '[.!?؟۔]$'), lag(kind) over w is null) as sentence_start,
  coalesce(lead(kind) over w = 'punct', true) as clause_final
  from {TOKENS_SQL} where kind <> 'space' window w as (partition by doc_id order by pos))"""


@query(f"select doc_id, pos, sentence_start, clause_final from {FLAGS_SQL} where kind = 'word'")
def sentence_flags(spark: SparkSession, d: str) -> DataFrame:
    """Of each Latin word: does it begin a sentence, does it end a clause."""
    t = K.sentence_flags(K.tokens(docs(spark, d), "doc_id", "text"), "doc_id")
    return t.where("kind = 'word'").select("doc_id", "pos", "sentence_start", "clause_final")


CLASSIFIED_SQL = f"""(select doc_id, pos, tok, kind, case when kind <> 'word' then null
  when regexp_matches(tok, '^[A-Z][a-z]') and not sentence_start and word not in {_listed(HOMOGRAPHS)} then 'english'
  when loan then null when {ENGLISHNESS_SQL} >= 0.5 then 'english' end as reason, kind = 'word' and loan as loan from
  (select *, word in (select lower(en) from loanwords where en is not null) as loan from (select *, {unstretch_sql('lower(tok)')} as word from {FLAGS_SQL})))"""


@query(f"select coalesce(reason, kind) as class, loan, count(*) as n from {CLASSIFIED_SQL} group by all")
def classify_words(spark: SparkSession, d: str) -> DataFrame:
    """Words kept as English, by a capital or by their look, and those to be converted."""
    t = K.classified(K.sentence_flags(K.tokens(docs(spark, d), "doc_id", "text"), "doc_id"), table(spark, d, "loanwords").select(F.lower("en").alias("word")))
    return t.groupBy(F.coalesce("reason", "kind").alias("class"), "loan").agg(F.count("*").alias("n"))


@query(
    f"""with c as (select *, loan and reason is null as soft, coalesce(reason = 'english', false) as english from {CLASSIFIED_SQL}),
    b as (select *, sum(case when soft and coalesce(lag_soft, false) then 0 else 1 end) over (partition by doc_id order by pos) as island from (select *, lag(soft) over (partition by doc_id order by pos) as lag_soft from c)),
    n as (select *, lag(english) over (partition by doc_id order by pos) as l, lead(english) over (partition by doc_id order by pos) as r from b),
    i as (select doc_id, island, bool_or(soft and (coalesce(l, false) or coalesce(r, false))) as flip from n group by all)
    select doc_id, pos from n join i using (doc_id, island) where soft and flip"""
)
def neighbour_guard(spark: SparkSession, d: str) -> DataFrame:
    """Loanwords that stay English because their run of loanwords touches an English word."""
    t = K.classified(K.sentence_flags(K.tokens(docs(spark, d), "doc_id", "text"), "doc_id"), table(spark, d, "loanwords").select(F.lower("en").alias("word")))
    return K.guarded(t, "doc_id").where("guarded").select("doc_id", "pos")


@query(r"select example_id, len(regexp_extract_all(persian, '[\p{L}‌]+|[^\p{L}‌]+', 0))::bigint as n_tokens, array_to_string(regexp_extract_all(persian, '[\p{L}‌]+|[^\p{L}‌]+', 0), '') = persian as lossless from example")
def persian_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_extract_all("persian", F.lit(r"[\p{L}‌]+|[^\p{L}‌]+"), 0)
    return table(spark, d, "example").select("example_id", F.when(F.col("persian").isNotNull(), F.size(t).cast("long")).alias("n_tokens"), (F.array_join(t, "") == F.col("persian")).alias("lossless"))


@query(f"select doc_id, len(n)::bigint as n_protected, len(list_filter(n, lambda x: contains(output, x)))::bigint as n_kept from (select doc_id, output, list_distinct(regexp_extract_all(text, '[^A-Za-z '']+', 0)) as n from ({ORACLES['naive_transliterate_docs'].replace('select doc_id,', 'select doc_id, text,', 1)})) where n is not null")
def needle_survival(spark: SparkSession, d: str) -> DataFrame:
    """How many runs without Latin letters come through the conversion as they were."""
    rows = docs(spark, d).where("text is not null").select("doc_id", W.naive_text(F.col("text")).alias("output"), F.array_distinct(F.regexp_extract_all("text", F.lit("[^A-Za-z ']+"), 0)).alias("n"))
    return rows.select("doc_id", F.size("n").cast("long").alias("n_protected"), F.size(F.filter("n", lambda x: F.contains(F.col("output"), x))).cast("long").alias("n_kept"))


@query(f"select t.kind, count(*) as n, count(*) filter (where contains(o.output, t.tok)) as n_kept from {TOKENS_SQL} t join ({ORACLES['naive_transliterate_docs']}) o using (doc_id) where t.kind not in ('word', 'space', 'punct') group by t.kind")
def copy_preservation(spark: SparkSession, d: str) -> DataFrame:
    """Spans that a conversion must copy, by kind, and how many of them the naive one leaves as they were."""
    rows = docs(spark, d)
    spans = K.tokens(rows, "doc_id", "text").where(~F.col("kind").isin("word", "space", "punct")).select("doc_id", "kind", "tok")
    kept = spans.join(rows.select("doc_id", W.naive_text(F.col("text")).alias("output")), "doc_id")
    return kept.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.contains("output", F.col("tok"))).alias("n_kept"))


@query(
    f"""select a.id, count(*) as n_inside from (select id, {split_sql('expected')} as part from chat_test where expected is not null) a,
    (select {split_sql('expected')} as whole from chat_test where expected is not null) b
    where len(part) > 0 and len(list_filter(range(len(whole) - len(part) + 1), lambda i: whole[i + 1 : i + len(part)] = part)) > 0 group by a.id"""
)
def word_spans(spark: SparkSession, d: str) -> DataFrame:
    """In how many evaluation references each reference stands as a contiguous span of words.

    The spans of every length that some reference has are exploded and joined by equality, instead of comparing all
    pairs.
    """
    rows = table(spark, d, "chat_test").where("expected is not null").select("id", W.split_blank(F.col("expected")).alias("w")).where(F.size("w") > 0)
    lengths = rows.select(F.size("w").alias("k")).distinct().agg(F.collect_set("k").alias("ks"))  # at most the longest reference
    spans = rows.crossJoin(F.broadcast(lengths)).select(F.col("id").alias("whole"), F.explode(F.array_distinct(F.flatten(F.transform("ks", lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.slice("w", i, k))))))
                                                   .alias("part"))
    return rows.join(spans.distinct(), F.col("w") == F.col("part")).groupBy("id").agg(F.count("*").alias("n_inside"))
