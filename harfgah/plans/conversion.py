"""The whole engine, its channel, the speller and the codecs, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.engine import Engine, tables_from
from harfgah.operators import channel, speller
from harfgah.operators.corpus import log_quantised
from harfgah.plans import corpus as P
from harfgah.plans import words as T
from harfgah.plans.registry import Registry
from harfgah.session import cut, table
from harfgah.sources import codecs

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def engine(spark: SparkSession, d: str) -> Engine:
    """Words, pairs and typed vowels of the examples; of the loanwords those that both judges accepted, with two spellings at most; their Persian side as lexicon."""
    taken = cut(P.loans(spark, d).where("a = 'accept' and b = 'accept' and en is not null and fa is not null").select(F.lower("en").alias("typed"), "fa"))
    loans = taken.groupBy("typed").agg(F.slice(F.array_sort(F.collect_set("fa")), 1, 2).alias("forms"))
    counts = cut(log_quantised(P.counts(spark, d), P.TABLE_WORDS))
    return Engine(tables_from(counts, loans, P.top_pairs(spark, d), P.TABLE_WORDS, P.vowel_table(spark, d), taken.select(F.col("fa").alias("word")).distinct()))


@query()
def transliterate_full(spark: SparkSession, d: str) -> DataFrame:
    """Every document through the whole engine."""
    return _transliterated(spark, d, "documents", "doc_id", "text")


@query()
def transliterate_chat(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation message through the whole engine."""
    return _transliterated(spark, d, "chat_test", "id", "input")


def _transliterated(spark: SparkSession, d: str, name: str, key: str, text: str) -> DataFrame:
    out = engine(spark, d).transliterate(table(spark, d, name), key, text)
    return out.select(key, "result.text", "result.alternatives", "result.confidence", F.size("result.spans").alias("n_spans"))


@query()
def word_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every different Latin word with its three best spellings."""
    found = engine(spark, d).words(T.latin_words(spark, d))
    return found.select("word", F.posexplode(F.slice("candidates", 1, 3)).alias("ord", "c")).select("word", "ord", "c.output", "c.probability")


@query()
def channel_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well each typed form fits its word, and the labels that the alignment gives."""
    pairs = P.typed(spark, d).where(F.col("typed").rlike(r"\A[a-z']+\z") & F.col("word").rlike(r"\A[ء-ی]+\z"))
    return channel.aligned_steps(pairs, "typed", "word").select("latin", "fa", F.round("score", 4).alias("score"), F.size("steps").alias("n_steps"), F.array_join("labels", "|").alias("labels"))


@query()
def synthetic_typings(spark: SparkSession, d: str) -> DataFrame:
    """Up to six typings of every different Persian word, with labels."""
    return speller.synthetic(T.persian_words(spark, d), "word").select("persian", "variant", "latin", F.array_join("labels", "|").alias("labels"))


@query(f"select 'frequency' as name, (row_number() over (order by word) - 1)::integer as place, word from ({P.ORACLES['unigram_logquant']}) where regexp_full_match(word, '[ء-ی]+')")
def front_decode(spark: SparkSession, d: str) -> DataFrame:
    """The frequency table's words, encoded to bytes and decoded again."""
    words = [r["word"] for r in P.unigram_logquant(spark, d).where(F.col("word").rlike(r"\A[ء-ی]+\z")).select("word").collect()]  # of twenty-five thousand at most
    rows = spark.createDataFrame([("frequency", bytearray(codecs.words_to_bytes(words)))], "name string, data binary")
    return codecs.decoded(rows, "name", "data", "words")
