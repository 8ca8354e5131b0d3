"""Corpus and table builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harfgah.functions import words as W
from harfgah.functions.fold import ZWNJ
from harfgah.functions.tables import HOMOGRAPHS
from harfgah.operators import corpus as C
from harfgah.operators.order import indexed
from harfgah.plans.registry import Registry
from harfgah.plans.sqltools import leak_key_sql, quoted
from harfgah.plans.words import PERSIAN_WORDS_SQL, persian_words
from harfgah.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

KEYED_SQL = f"(select example_id, split, source, string_split({leak_key_sql('persian')}, ' ') as w, {leak_key_sql('persian')} as k from example where persian is not null)"
EVAL_SQL = f"(select id, {leak_key_sql('expected')} as k, string_split({leak_key_sql('expected')}, ' ') as w from (select id, expected from chat_test union all select id, expected from authored) where expected is not null)"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "example").where("persian is not null").select("example_id", "split", "source", W.leak_key(F.col("persian")).alias("k"))
    return rows.withColumn("w", F.split("k", " "))


def evals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_test").select("id", "expected").unionByName(table(spark, d, "authored").select("id", "expected"))
    return rows.where("expected is not null").select("id", W.leak_key(F.col("expected")).alias("k")).withColumn("w", F.split("k", " "))


#: Words of the frequency table, and pairs of the pair table.
TABLE_WORDS, TABLE_PAIRS = 25_000, 30_000
UNIGRAMS_SQL = f"(select word, count(*) as n from (select unnest(w) as word from {KEYED_SQL}) where word <> '' group by 1)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    return C.unigrams(keyed(spark, d).select(F.explode("w").alias("word")))


@query(f"select word, n, greatest(1, least(255, round_even(255 * ln(1 + n) / ln(1 + (select max(n) from {UNIGRAMS_SQL})), 0)))::integer as score from {UNIGRAMS_SQL} order by n desc, word limit {TABLE_WORDS}")
def unigram_logquant(spark: SparkSession, d: str) -> DataFrame:
    return C.log_quantised(counts(spark, d), TABLE_WORDS)


@query(f"with u as {UNIGRAMS_SQL}, k as (select word from u order by n desc, word limit {TABLE_WORDS}) select count(*) as n_words, sum(n)::bigint as n_tokens, round(sum(n) filter (where word in (select word from k)) / sum(n), 6) as coverage from u")
def vocab_coverage(spark: SparkSession, d: str, top: int = TABLE_WORDS) -> DataFrame:
    c = counts(spark, d)
    return C.coverage(c, C.log_quantised(c, top))


@query(f"select split, count(*) as n, count(*) filter (where k in (select k from {EVAL_SQL})) as n_leaked from {KEYED_SQL} group by split")
def leak_exact(spark: SparkSession, d: str) -> DataFrame:
    rows, keys = keyed(spark, d), evals(spark, d).select("k").distinct().withColumn("hit", F.lit(1))
    return rows.join(keys, "k", "left").groupBy("split").agg(F.count("*").alias("n"), F.count("hit").alias("n_leaked"))


@query(f"select example_id from {KEYED_SQL} where k not in (select k from {EVAL_SQL})")
def leak_exact_anti(spark: SparkSession, d: str) -> DataFrame:
    """Examples whose words aren't those of an evaluation sentence."""
    return keyed(spark, d).join(evals(spark, d).select("k").distinct(), "k", "left_anti").select("example_id")


def grams_sql(source: str, n: int, key: str) -> str:
    return f"(select distinct {key}, array_to_string(w[i : i + {n - 1}], ' ') as gram from (select {key}, w, unnest(generate_series(1, len(w) - {n - 1})) as i from {source}))"


@query(f"select example_id from {KEYED_SQL} where example_id not in (select example_id from {grams_sql(KEYED_SQL, 4, 'example_id')} where gram in (select gram from {grams_sql(EVAL_SQL, 4, 'id')}))")
def leak_ngram_anti(spark: SparkSession, d: str) -> DataFrame:
    """Examples that share no four words running with an evaluation sentence."""
    return C.without_shared_ngrams(keyed(spark, d), evals(spark, d), "example_id", "w", 4).select("example_id")


@query(f"select gram, count(*) as n_rows from {grams_sql(EVAL_SQL, 4, 'id')} group by gram")
def ngram_set(spark: SparkSession, d: str) -> DataFrame:
    return evals(spark, d).select("id", F.explode(F.array_distinct(C.ngrams(F.col("w"), 4))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_rows"))


RAW_WORDS_SQL = f"(select word, replace(word, '{ZWNJ}', '') as solid, count(*) as n from (select unnest(string_split_regex(persian, '[ \t\n\f\r؟.،!]+')) as word from example) where regexp_full_match(word, '[ء-ی{ZWNJ}]+') group by 1, 2)"


@query(
    f"""with top as (select word from {UNIGRAMS_SQL} order by n desc, word limit {TABLE_WORDS}), w as (select * from {RAW_WORDS_SQL} where solid not in (select word from top))
    select solid, arg_max(word, (n, word)) as word, sum(n)::bigint as n, count(*) as n_forms from w group by solid having sum(n) >= 2"""
)
def supplement_words(spark: SparkSession, d: str, top_words: int = TABLE_WORDS) -> DataFrame:
    """Words outside the table, one spelling for each solid form: the commonest."""
    raw = table(spark, d, "example").select(F.explode(F.split("persian", "[ \t\n\f\r؟.،!]+")).alias("word")).where(F.col("word").rlike(f"^[ء-ی{ZWNJ}]+$"))
    words = raw.groupBy("word").agg(F.count("*").alias("n")).withColumn("solid", F.replace("word", F.lit(ZWNJ), F.lit("")))
    top = counts(spark, d).orderBy(F.desc("n"), "word").limit(top_words).select(F.col("word").alias("solid"))
    return words.join(top, "solid", "left_anti").groupBy("solid").agg(F.max_by("word", F.struct("n", "word")).alias("word"), F.sum("n").alias("n"), F.count("*").alias("n_forms")).where("n >= 2")


PAIRS_SQL = f"(select head, tail, count(*) as n_pair from (select unnest(w) as head, unnest(list_concat(w[2:], [null])) as tail from {KEYED_SQL}) where tail is not null group by 1, 2)"
PMI_SQL = f"""(with u as {UNIGRAMS_SQL}, v as (select * from u order by n desc, word limit {TABLE_WORDS}), p as {PAIRS_SQL}
 select head, tail, n_pair, pmi from (select p.*, round(least(6, ln((n_pair / (select sum(n_pair) from p)) / ((a.n / (select sum(n) from u)) * (b.n / (select sum(n) from u))))), 6) as pmi
 from p join v a on a.word = head join v b on b.word = tail where n_pair >= 3) where pmi > 0 order by n_pair desc, head, tail limit {TABLE_PAIRS})"""


def top_pairs(spark: SparkSession, d: str, top: int = TABLE_PAIRS) -> DataFrame:
    return C.pmi(C.adjacent(keyed(spark, d), "example_id", "w"), counts(spark, d), 3, top)


@query(f"select * from {PMI_SQL}")
def bigram_pmi_top(spark: SparkSession, d: str) -> DataFrame:
    return top_pairs(spark, d)


@query(f"select head as word from {PMI_SQL} union select tail from {PMI_SQL}")
def bigram_live_vocab(spark: SparkSession, d: str) -> DataFrame:
    return _live(top_pairs(spark, d))


def _live(p: DataFrame) -> DataFrame:
    return p.select(F.col("head").alias("word")).union(p.select("tail")).distinct()


@query(
    f"""with p as {PMI_SQL}, v as (select word, row_number() over (order by word) - 1 as id from (select head as word from p union select tail from p)),
    i as (select a.id as head_id, b.id as tail_id, pmi from p join v a on a.word = head join v b on b.word = tail)
    select head_id, tail_id, tail_id - coalesce(lag(tail_id) over (partition by head_id order by tail_id), 0) as delta, greatest(1, least(255, round_even(255 * pmi / 6, 0)))::integer as score from i"""
)
def bigram_delta_ids(spark: SparkSession, d: str) -> DataFrame:
    """Pairs as the encoded table has them: ids in alphabetical order, tails as differences."""
    return _delta_ids(top_pairs(spark, d))


def _delta_ids(pairs: DataFrame) -> DataFrame:
    from harfgah.session import cut

    p = cut(pairs)
    ids = cut(C.word_ids(p.select(F.col("head").alias("word")).union(p.select("tail")), "word"))
    rows = p.join(ids.select(F.col("word").alias("head"), F.col("id").alias("head_id")), "head").join(ids.select(F.col("word").alias("tail"), F.col("id").alias("tail_id")), "tail")
    w = Window.partitionBy("head_id").orderBy("tail_id")
    score = F.greatest(F.lit(1), F.least(F.lit(255), F.bround(255 * F.col("pmi") / 6))).cast("int")
    return rows.select("head_id", "tail_id", (F.col("tail_id") - F.coalesce(F.lag("tail_id").over(w), F.lit(0))).alias("delta"), score.alias("score"))


@query(f"with p as {PMI_SQL} select head, tail, coalesce(pmi, 0.0) / 6 as score from (select distinct w[1] as head, w[2] as tail from {KEYED_SQL} where len(w) > 1) left join p using (head, tail)")
def bigram_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The score of the first two words of every example; a pair that isn't in the table scores 0."""
    return _lookup(spark, d, top_pairs(spark, d))


def _lookup(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    asked = keyed(spark, d).where(F.size("w") > 1).select(F.col("w")[0].alias("head"), F.col("w")[1].alias("tail")).distinct()
    return asked.join(pairs, ["head", "tail"], "left").select("head", "tail", (F.coalesce("pmi", F.lit(0.0)) / 6).alias("score"))


@query(
    f"""with w as (select word, lag(word) over (order by word) as before, row_number() over (order by word) - 1 as id from {PERSIAN_WORDS_SQL})
    select id, word, len(list_filter(range(1, least(length(word), length(coalesce(before, ''))) + 1), lambda i: substr(word, 1, i) = substr(before, 1, i)))::integer as shared,
    substr(word, len(list_filter(range(1, least(length(word), length(coalesce(before, ''))) + 1), lambda i: substr(word, 1, i) = substr(before, 1, i)))::integer + 1) as rest from w"""
)
def front_code(spark: SparkSession, d: str) -> DataFrame:
    return C.front_coded(persian_words(spark, d), "word")


TYPED_SQL = "(select word, typed, count(*) as n from (select unnest(p) as word, unnest(l) as typed from (select string_split(persian, ' ') as p, string_split(lower(latin), ' ') as l from example where persian is not null and latin is not null) where len(p) = len(l)) group by 1, 2)"


def typed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "example").select(F.split("persian", " ").alias("p"), F.split(F.lower("latin"), " ").alias("l")).where(F.size("p") == F.size("l"))
    return rows.select(F.inline(F.arrays_zip("p", "l"))).groupBy(F.col("p").alias("word"), F.col("l").alias("typed")).agg(F.count("*").alias("n"))


@query(f"select word, arg_max(typed, (n, typed)) as typed, max(n) as n_typed, sum(n)::bigint as n from {TYPED_SQL} group by word")
def word_typing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Positional pairs of lines with as many words on both sides; the commonest typing of each word."""
    return typed(spark, d).groupBy("word").agg(F.max_by("typed", F.struct("n", "typed")).alias("typed"), F.max("n").alias("n_typed"), F.sum("n").alias("n"))


#: The vowels of a typing: long ones by their doubled spelling, a y between consonants as i.
SAID_SQL = "regexp_replace(translate(regexp_replace(replace(replace(replace(replace(replace(replace(typed, 'aa', 'A'), 'ee', 'i'), 'ii', 'i'), 'oo', 'u'), 'ou', 'u'), 'uu', 'u'), '([^aeoAiuy])y([^aeoAiuy])', '\\1i\\2', 'g'), 'y', ''), '[^aeoAiu]', '', 'g')"
VOWELS_SQL = rf"""(with t as (select word, arg_max(typed, (n, typed)) as typed from {TYPED_SQL} where regexp_full_match(typed, '[a-z'']+') and regexp_full_match(word, '[ء-غف-يپچژکگی]+') group by word),
 e as (select word, case when not regexp_matches(word, '[اآویه]$') and regexp_matches(typed, '[^aeoiu]e$') and length(typed) > 1 then left(typed, length(typed) - 1)
   when regexp_matches(word, '[اوی]$') and length(typed) > 2 and regexp_matches(typed, '[aeoiu]ye$') then left(typed, length(typed) - 2) else typed end as typed from t)
 select word, {SAID_SQL} as vowels from e)"""


@query(f"select word, vowels from {VOWELS_SQL}")
def typed_vowel_table(spark: SparkSession, d: str) -> DataFrame:
    """The vowels of every word as its commonest typing says them, a linking vowel at the end left out."""
    said = typed(spark, d).where(F.col("typed").rlike(r"\A[a-z']+\z") & F.col("word").rlike(r"\A[ء-غف-يپچژکگی]+\z"))
    rows = said.groupBy("word").agg(F.max_by("typed", F.struct("n", "typed")).alias("typed"))
    return rows.select("word", W.said_vowels(W.without_link(F.col("word"), F.col("typed"))).alias("vowels"))


CONFUSABLE_SQL = f"""(with v as (select *, translate(word, 'اآوی', '') as key from {VOWELS_SQL}) select word, vowels, key from v where key in (select key from v group by key having count(*) >= 2 and count(distinct vowels) >= 2))"""


@query(f"select key, count(*) as n_members, count(distinct vowels) as n_vowels, string_agg(word || ':' || vowels, ' ' order by word) as members from {CONFUSABLE_SQL} group by key")
def confusable_groups(spark: SparkSession, d: str) -> DataFrame:
    """Words that differ in long vowels only: groups of two or more that are known, with two or more different vowels."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "vowels"))), lambda x: F.concat(x["word"], F.lit(":"), x["vowels"])), " ")
    g = typed_vowel_table(spark, d).groupBy(W.confusable_key(F.col("word")).alias("key"))
    return g.agg(F.count("*").alias("n_members"), F.count_distinct("vowels").alias("n_vowels"), members.alias("members")).where("n_members >= 2 and n_vowels >= 2")


def vowel_table(spark: SparkSession, d: str) -> DataFrame:
    """word, vowels of the words of confusable groups: only they can be told apart by their vowels."""
    rows = typed_vowel_table(spark, d).withColumn("key", W.confusable_key(F.col("word")))
    told = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("vowels").alias("k")).where("n >= 2 and k >= 2").select("key")
    return rows.join(told, "key", "left_semi").select("word", "vowels")


@query(f"select word, count(*) as n_forms, sum(n)::bigint as n, string_agg(typed || ':' || n, ' ' order by n desc, typed) as histogram from {TYPED_SQL} group by word having sum(n) >= 3")
def typing_histogram(spark: SparkSession, d: str) -> DataFrame:
    text = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "typed"))), lambda x: F.concat(x["typed"], F.lit(":"), (-x["m"]).cast("string")))
    return typed(spark, d).groupBy("word").agg(F.count("*").alias("n_forms"), F.sum("n").alias("n"), F.array_join(text, " ").alias("histogram")).where("n >= 3")


SHARE_SQL = "('0x' || substr(sha256({}), 1, 8))::uinteger / 4294967295"


@query(f"select word, case when {SHARE_SQL.format('word')} < 0.05 then 'test' when {SHARE_SQL.format('word')} < 0.1 then 'dev' else 'train' end as split from {PERSIAN_WORDS_SQL}")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return persian_words(spark, d).select("word", W.hash_split(F.col("word")).alias("split"))


@query(f"select case when {SHARE_SQL.format('coalesce(line_id, persian)')} < 0.05 then 'test' when {SHARE_SQL.format('coalesce(line_id, persian)')} < 0.1 then 'dev' else 'train' end as by_line, source, count(*) as n from example group by all")
def hash_split_by_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "example").groupBy(W.hash_split(F.coalesce("line_id", "persian")).alias("by_line"), "source").agg(F.count("*").alias("n"))


@query("select shard, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from (select doc_id, (row_number() over (order by doc_id) - 1) % 7 + 20 as shard from documents) group by shard")
def sharded_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt to seven shards, numbered from 20."""
    rows = indexed(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return rows.groupBy((F.col("row_index") % 7 + 20).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("select shard, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from (select doc_id, (row_number() over (order by doc_id) - 1) // ceil((select count(*) from documents) / 7)::bigint as shard from documents) group by shard")
def sharded_contiguous(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    size = docs.agg(F.ceil(F.count("*") / 7).alias("size"))
    rows = indexed(docs, ["doc_id"]).crossJoin(F.broadcast(size))
    return rows.groupBy(F.floor(F.col("row_index") / F.col("size")).alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) where i % 5 = 0")
def every_kth(spark: SparkSession, d: str) -> DataFrame:
    """A systematic sample, every fifth row."""
    return indexed(table(spark, d, "documents").select("doc_id"), ["doc_id"]).where("row_index % 5 = 0").select("doc_id")


POOL_SQL = f"(select k, min(example_id) as example_id, ends_with(k, 'ه') as rich from {KEYED_SQL} where len(w) between 4 and 18 and k not in (select k from {EVAL_SQL}) group by k)"


@query(
    f"""with p as {POOL_SQL}, rich as (select * from p where rich order by md5('7' || k), k limit 100), rest as (select * from p where k not in (select k from rich) order by md5('7' || k), k limit 200)
    select example_id, k, true as targeted from rich union all select example_id, k, false from rest"""
)
def targeted_draw(spark: SparkSession, d: str) -> DataFrame:
    """100 lines that end in he, then 200 of all that are left, both drawn by hash."""
    rows = keyed(spark, d).where(F.size("w").between(4, 18)).join(evals(spark, d).select("k").distinct(), "k", "left_anti")
    pool = rows.groupBy("k").agg(F.min("example_id").alias("example_id"))
    rich = C.hash_rank(pool.where(F.col("k").endswith("ه")), "7", "k", 100)
    rest = C.hash_rank(pool.join(rich, "k", "left_anti"), "7", "k", 200)
    return rich.select("example_id", "k", F.lit(True).alias("targeted")).unionByName(rest.select("example_id", "k", F.lit(False).alias("targeted")))


@query(
    """with s as (select count(*) as n from example where source = 'synthetic'), l as (select example_id, row_number() over (order by example_id) - 1 as i, count(*) over () as n from example where source = 'typed_lines'),
    t as (select round_even((select n from s) * 0.6 / 0.4, 0)::bigint as target)
    select example_id, count(*) as n_copies from l, t, unnest(generate_series(i, target - 1, n)) as g(j) group by example_id"""
)
def mix_upsample(spark: SparkSession, d: str) -> DataFrame:
    """Typed lines repeated until they are six tenths of the mix with the synthetic ones."""
    rows = table(spark, d, "example")
    target = rows.where("source = 'synthetic'").agg(F.bround(F.count("*") * 0.6 / 0.4).cast("long").alias("target"))
    return C.upsampled(rows.where("source = 'typed_lines'").select("example_id"), "example_id", target).groupBy("example_id").agg(F.count("*").alias("n_copies"))


@query(
    """with l as (select count(*) as n from example where source = 'typed_lines'), s as (select example_id, md5('3' || example_id) as h from example where source = 'synthetic'),
    r as (select example_id, row_number() over (order by h, example_id) as i from s)
    select example_id from r where i <= (select round_even(n * 0.4 / 0.6, 0) from l)"""
)
def mix_natural(spark: SparkSession, d: str) -> DataFrame:
    """The synthetic lines that are kept beside all typed ones, so that these are six tenths."""
    rows = table(spark, d, "example")
    keep = rows.where("source = 'typed_lines'").agg(F.bround(F.count("*") * 0.4 / 0.6).alias("keep"))
    ranked = indexed(rows.where("source = 'synthetic'").select("example_id", F.md5(F.concat(F.lit("3"), F.col("example_id").cast("string"))).alias("h")), ["h", "example_id"], "i")
    return ranked.crossJoin(F.broadcast(keep)).where("i < keep").select("example_id")


@query("select label, n, row_number() over (order by label <> '', n desc, label) - 1 as rank from (select label, count(*) as n from (select unnest(labels) as label from example) group by label having count(*) >= 2)")
def label_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Every output label seen twice or more, by count, the empty one first."""
    n = table(spark, d, "example").select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    rows = n.select("label", "n", (F.col("label") != "").alias("spelled"), (-F.col("n")).alias("m"))
    return indexed(rows, ["spelled", "m", "label"], "rank").select("label", "n", "rank")


@query("select source, count(*) as n, count(*) filter (where array_to_string(labels, '') = persian) as lossless, count(*) filter (where len(labels) = length(latin)) as aligned from example where labels is not null group by source")
def label_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Labels must spell the Persian side, and there must be one for each Latin letter."""
    rows = table(spark, d, "example").where("labels is not null")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.array_join("labels", "") == F.col("persian")).alias("lossless"), F.count_if(F.size("labels") == F.length("latin")).alias("aligned"))


@query("select split, sha256(string_agg(row, chr(10) order by example_id)) as hash, count(*) as n from (select split, example_id, example_id || chr(9) || coalesce(latin, '') || chr(9) || coalesce(persian, '') as row from chat_split) group by split".replace("chat_split", "(select id as example_id, category as split, input as latin, expected as persian from chat_test where category is not null)"))
def evaluation_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash of all rows of a category in order; for evaluation sets, which are small by their nature."""
    rows = table(spark, d, "chat_test").where("category is not null").select(F.col("category").alias("split"), F.struct("id", F.concat_ws("\t", "id", F.coalesce("input", F.lit("")), F.coalesce("expected", F.lit(""))).alias("row")).alias("r"))
    return rows.groupBy("split").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "\n"), 256).alias("hash"), F.count("*").alias("n"))


@query("select split, count(*) as n, sum(h % 1000000007)::bigint as order_free_hash from (select split, ('0x' || substr(md5(example_id || ':' || coalesce(latin, '') || ':' || coalesce(persian, '')), 1, 8))::uinteger::bigint as h from example) group by split")
def corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of a split that doesn't depend on the order of its rows, so that it can be added up anywhere."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("example_id").cast("string"), F.coalesce("latin", F.lit("")), F.coalesce("persian", F.lit("")))), 1, 8), 16, 10).cast("long")
    return table(spark, d, "example").groupBy("split").agg(F.count("*").alias("n"), F.sum(h % 1000000007).alias("order_free_hash"))


REASON_SQL = r"""case when latin is null or persian is null or lw not between 2 and 30 then 'length' when not regexp_full_match(latin, '[A-Za-z0-9'' .,!?:-]+') or not regexp_matches(persian, '[ء-ی]') then 'charset'
 when abs(lw - pw) > 1 then 'misaligned' end"""
COUNTED_SQL = r"(select *, len(list_filter(string_split(latin, ' '), lambda x: x <> '')) as lw, len(list_filter(string_split(persian, ' '), lambda x: x <> '')) as pw from example)"


@query(f"select coalesce({REASON_SQL}, 'kept') as reason, source, count(*) as n from {COUNTED_SQL} group by all")
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _reasons(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "source").agg(F.count("*").alias("n"))


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    rows = table(spark, d, "example").withColumns({"lw": words("latin"), "pw": words("persian")})
    reason = (
        F.when(F.col("latin").isNull() | F.col("persian").isNull() | ~F.col("lw").between(2, 30), "length")
        .when(~F.col("latin").rlike(r"\A[A-Za-z0-9' .,!?:-]+\z") | ~F.col("persian").rlike("[ء-ی]"), "charset")
        .when(F.abs(F.col("lw") - F.col("pw")) > 1, "misaligned")
    )
    return rows.withColumn("reason", reason)


@query(f"select 'gold-' || lpad((row_number() over (order by latin, example_id))::varchar, 7, '0') as id, example_id from {COUNTED_SQL} where {REASON_SQL} is null")
def gold_build(spark: SparkSession, d: str) -> DataFrame:
    """Kept pairs with ids in alphabetical order."""
    kept = _reasons(spark, d).where("reason is null").select("example_id", "latin")
    return indexed(kept, ["latin", "example_id"]).select(F.concat(F.lit("gold-"), F.lpad((F.col("row_index") + 1).cast("string"), 7, "0")).alias("id"), "example_id")


@query(
    """with i as (select distinct latin from example where split = 'train'), k as (select distinct persian from example where split = 'train')
    select example_id from example where split = 'dev' and latin is not null and latin not in (select latin from i where latin is not null) and persian is not null and persian not in (select persian from k where persian is not null)"""
)
def dev_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Dev rows of which neither side is a training row's."""
    rows = table(spark, d, "example")
    train = rows.where("split = 'train'")
    dev = rows.where("split = 'dev' and latin is not null and persian is not null")
    return dev.join(train.select("latin").distinct(), "latin", "left_anti").join(train.select("persian").distinct(), "persian", "left_anti").select("example_id")


VOTES_SQL = "(select loan_id, en, fa, category, lower(trim(claude)) as a, lower(trim(luna)) as b from loanwords)"


def loans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "loanwords").select("loan_id", "en", "fa", "category", F.lower(F.trim("claude")).alias("a"), F.lower(F.trim("luna")).alias("b"))


@query(
    f"""with r as (select loan_id, arg_max(verdict, (judged_at, verdict)) as verdict from (select loan_id, lower(trim(verdict)) as verdict, judged_at from loan_review) where verdict in ('accept', 'reject') group by 1)
    select coalesce(v.loan_id, r.loan_id) as loan_id, case when a = b then a else coalesce(r.verdict, a, b) end as verdict, case when a = b then 'agreed' when r.verdict is not null then 'adjudicated' else 'pending' end as how
    from {VOTES_SQL} v full join r on r.loan_id = v.loan_id"""
)
def family_merge(spark: SparkSession, d: str) -> DataFrame:
    """Where both judges agree theirs, else the last reviewer's, else pending."""
    review = table(spark, d, "loan_review").withColumn("verdict", F.lower(F.trim("verdict"))).where("verdict in ('accept', 'reject')")
    last = review.groupBy("loan_id").agg(F.max(F.struct("judged_at", "verdict"))["verdict"].alias("verdict"))
    both = loans(spark, d).join(last, "loan_id", "full")
    same = F.col("a") == F.col("b")
    return both.select("loan_id", F.when(same, F.col("a")).otherwise(F.coalesce("verdict", "a", "b")).alias("verdict"), F.when(same, "agreed").when(F.col("verdict").isNotNull(), "adjudicated").otherwise("pending").alias("how"))


@query("select l.loan_id from (select distinct loan_id from loanwords) l where not exists (select 1 from loan_review r where r.loan_id = l.loan_id and r.judge = 'j01')")
def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    """Items that one judge hasn't seen yet."""
    seen = table(spark, d, "loan_review").where("judge = 'j01'").select("loan_id")
    return table(spark, d, "loanwords").select("loan_id").distinct().join(seen, "loan_id", "left_anti")


#: A reading as common as this is an everyday word, and as many typings of it are evidence of how it is typed.
COMMON, EVIDENCE = 0.25, 10


def _read_sql() -> str:
    from harfgah.plans.words import ORACLES as WORDS

    skeleton = f"({WORDS['persian_skeletons'].replace('select word,', 'select word, n,', 1)})"
    return f"""(select l.en, arg_max(p.word, (p.n, p.word)) as reading from (select distinct lower(en) as en from loanwords where regexp_full_match(en, '[A-Za-z]+')) l
     join (select word as en, skeleton from ({WORDS['latin_skeletons'].split(' from ')[0]} from (select distinct lower(en) as word from loanwords where regexp_full_match(en, '[A-Za-z]+')))) k using (en) join {skeleton} p using (skeleton) group by 1)"""


@query(
    f"""with v as (select *, row_number() over (partition by lower(en) order by loan_id) as nth from {VOTES_SQL} where a = 'accept' and b = 'accept'), u as (select word, score / 255 as score from ({ORACLES['unigram_logquant']})),
    r as {_read_sql()}, t as (select word, typed, n from {TYPED_SQL}), w as (select word, sum(n) as n from t group by word)
    select loan_id, case when nth > 1 then 'taken' when category = 'english' then 'translation' when lower(v.en) in ({', '.join(map(quoted, sorted(HOMOGRAPHS)))}) then 'homograph'
      when r.reading <> fa and coalesce(u.score, 0) >= {COMMON} and (coalesce(w.n, 0) < {EVIDENCE} or coalesce(t.n, 0) > 0) then 'everyday' when r.reading <> fa and coalesce(u.score, 0) >= {COMMON} then 'cleared' else 'kept' end as outcome
    from v left join r on r.en = lower(v.en) left join u on u.word = r.reading left join w on w.word = r.reading left join t on t.word = r.reading and t.typed = lower(v.en)"""
)
def loanword_guard(spark: SparkSession, d: str) -> DataFrame:
    """Why a loanword that both judges accepted is left out: taken before, a translation, a Persian homograph, or read as an everyday word.

    A reading is everyday if it is common and either seldom typed at all or also typed this way; a common one that is
    typed often, and never this way, is cleared.
    """
    v = loans(spark, d).where("a = 'accept' and b = 'accept'").withColumns({"nth": F.row_number().over(Window.partitionBy(F.lower("en")).orderBy("loan_id")), "key": F.lower("en")})
    words = persian_words(spark, d).select("word", "n", W.persian_skeleton(F.col("word")).alias("skeleton")).where("skeleton is not null")
    top = words.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("reading"))
    asked = v.where(F.col("en").rlike(r"\A[A-Za-z]+\z")).select("key").distinct().withColumn("skeleton", W.latin_skeleton(F.col("key")))
    said = typed(spark, d)
    read = asked.join(top, "skeleton").select("key", "reading")
    read = read.join(unigram_logquant(spark, d).select(F.col("word").alias("reading"), (F.col("score") / 255).alias("score")), "reading", "left")
    read = read.join(said.groupBy(F.col("word").alias("reading")).agg(F.sum("n").alias("typed_n")), "reading", "left")
    read = read.join(said.select(F.col("word").alias("reading"), F.col("typed").alias("key"), F.col("n").alias("as_entry")), ["reading", "key"], "left")
    common = (F.col("reading") != F.col("fa")) & (F.coalesce("score", F.lit(0.0)) >= COMMON)
    everyday = common & ((F.coalesce("typed_n", F.lit(0)) < EVIDENCE) | (F.coalesce("as_entry", F.lit(0)) > 0))
    outcome = F.when(F.col("nth") > 1, "taken").when(F.col("category") == "english", "translation").when(F.col("key").isin(*sorted(HOMOGRAPHS)), "homograph").when(everyday, "everyday").when(common, "cleared").otherwise("kept")
    return v.join(read, "key", "left").select("loan_id", outcome.alias("outcome"))


@query(
    """with again as (select loan_id, arg_max(lower(trim(verdict)), (judged_at, verdict)) as verdict from loan_review where judge = 'j05' group by 1)
    select l.loan_id, case when l.category = 'tech' then coalesce(again.verdict, lower(trim(l.claude))) else lower(trim(l.claude)) end as claude from loanwords l left join again on again.loan_id = l.loan_id"""
)
def review_merge(spark: SparkSession, d: str) -> DataFrame:
    """The second review of one category takes the place of the first."""
    again = table(spark, d, "loan_review").where("judge = 'j05'").groupBy("loan_id").agg(F.max_by(F.lower(F.trim("verdict")), F.struct("judged_at", "verdict")).alias("verdict"))
    first = F.lower(F.trim("claude"))
    return table(spark, d, "loanwords").join(again, "loan_id", "left").select("loan_id", F.when(F.col("category") == "tech", F.coalesce("verdict", first)).otherwise(first).alias("claude"))


@query("select id, lead(id) over (order by sha256(id)) is null as is_last, case when row_number() over (order by sha256(id), id) % 3 = 0 then 'test' else 'dev' end as part from (select id from chat_test order by sha256(id), id limit 300)")
def chat_select(spark: SparkSession, d: str) -> DataFrame:
    """The 300 messages with the least hash, every third to test."""
    top = table(spark, d, "chat_test").select("id", F.sha2("id", 256).alias("h")).orderBy("h", "id").limit(300)
    w = Window.orderBy("h", "id")  # 300 rows
    return top.select("id", F.lead("id").over(w).isNull().alias("is_last"), F.when(F.row_number().over(w) % 3 == 0, "test").otherwise("dev").alias("part"))


@query(
    r"""select worker, count(*) as n, count(*) filter (where ok) as n_kept, count(distinct persona) filter (where ok) as n_personas from
    (select worker, persona, coalesce(persona is not null and regexp_full_match(trim(lower(latin), ' '), '[a-z'' ]+') and len(string_split(trim(latin, ' '), ' ')) = len(string_split(trim(persian, ' '), ' ')), false) as ok from example) group by worker"""
)
def typed_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each worker that pass: a known persona, letters only, as many words on both sides."""
    ok = F.coalesce(F.col("persona").isNotNull() & F.trim(F.lower("latin")).rlike(r"\A[a-z' ]+\z") & (F.size(F.split(F.trim("latin"), " ")) == F.size(F.split(F.trim("persian"), " "))), F.lit(False))
    rows = table(spark, d, "example").select("worker", "persona", ok.alias("ok"))
    return rows.groupBy("worker").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_kept"), F.count_distinct(F.when(F.col("ok"), F.col("persona"))).alias("n_personas"))


@query("select word, count(*) as n from (select trim(fa, ' ') as word from loanwords where fa is not null union all select trim(persian, ' ') from example where persian is not null) where word <> '' and not regexp_matches(word, '[ \t\n\f\r]') group by word")
def lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    """Single-word entries of the loanwords and the corpus."""
    words = table(spark, d, "loanwords").select(F.trim("fa").alias("word")).unionByName(table(spark, d, "example").select(F.trim("persian").alias("word")))
    return words.where((F.col("word") != "") & ~F.col("word").rlike("[ \t\n\f\r]")).groupBy("word").agg(F.count("*").alias("n"))


SHA_SQL = "substr(sha256(coalesce({0}, '') || chr(9) || coalesce({1}, '')), 1, 12)"


@query(
    f"""with k as (select {SHA_SQL.format('latin', 'persian')} as sha from example), r as (select distinct {SHA_SQL.format("trim(latin, ' ')", "trim(persian, ' ')")} as sha from example where split = 'test')
    select (select count(*) from k) as n, (select count(*) from k where sha in (select sha from r)) as n_attached, (select count(*) from r where sha not in (select sha from k)) as n_stale"""
)
def attach_reference(spark: SparkSession, d: str) -> DataFrame:
    """Rows that find a second reference by the hash of their content, and references of which the row has changed since: here those taken without blanks at the ends."""
    sha = lambda a, b: W.content_id(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    rows = table(spark, d, "example")
    refs = rows.where("split = 'test'").select(sha(F.trim("latin"), F.trim("persian")).alias("sha")).distinct()
    keyed_rows = rows.select(sha(F.col("latin"), F.col("persian")).alias("sha"))
    counts = C.attached(keyed_rows, refs.withColumn("hit", F.lit(1)), "sha").agg(F.count("*").alias("n"), F.count("hit").alias("n_attached"))
    return counts.crossJoin(C.stale(keyed_rows, refs, "sha").agg(F.count("*").alias("n_stale")))
