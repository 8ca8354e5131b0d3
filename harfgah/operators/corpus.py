"""Builders of the statistics: counts, associations, guards, splits and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harfgah.functions.words import hash_share
from harfgah.operators.order import indexed


def unigrams(words: DataFrame, word: str = "word") -> DataFrame:
    return words.where(F.col(word) != "").groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))


def log_quantised(counts: DataFrame, top: int) -> DataFrame:
    """The top words by count (ties by word) with a byte of log frequency, 1 to 255, 255 for the commonest."""
    kept = counts.orderBy(F.desc("n"), "word").limit(top)
    peak = counts.agg(F.max("n").alias("peak"))
    score = F.bround(255 * F.log1p("n") / F.log1p("peak"))
    return kept.crossJoin(F.broadcast(peak)).select("word", "n", F.least(F.greatest(score, F.lit(1)), F.lit(255)).cast("int").alias("score"))


def coverage(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: share of the tokens whose word was kept."""
    return counts.join(kept.select("word", F.lit(1).alias("kept")), "word", "left").agg(
        F.count("*").alias("n_words"), F.sum("n").alias("n_tokens"), F.round(F.sum(F.when(F.col("kept") == 1, F.col("n"))) / F.sum("n"), 6).alias("coverage")
    )


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words as strings, one blank apart."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def without_shared_ngrams(rows: DataFrame, evals: DataFrame, key: str, words: str, n: int) -> DataFrame:
    """Rows that share no run of n words with an evaluation row; both have a column of words."""
    grams = evals.select(F.explode(ngrams(F.col(words), n)).alias("gram")).distinct()
    hit = rows.select(key, F.explode(F.array_distinct(ngrams(F.col(words), n))).alias("gram")).join(grams, "gram", "left_semi").select(key).distinct()
    return rows.join(hit, key, "left_anti")


def adjacent(words: DataFrame, key: str, column: str) -> DataFrame:
    """head, tail of every two neighbouring words; made inside the row's array, without a shuffle."""
    w = F.col(column)
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.element_at(w, i).alias("head"), F.element_at(w, i + 1).alias("tail")))
    return words.where(F.size(w) > 1).select(F.inline(pairs))


def pmi(pairs: DataFrame, counts: DataFrame, least: int, top: int, clip: float = 6.0, vocabulary: int = 25_000) -> DataFrame:
    """Pairs of vocabulary words seen least times or more with positive pointwise mutual information, clipped; the top by count."""
    vocab = counts.orderBy(F.desc("n"), "word").limit(vocabulary)
    seen = pairs.groupBy("head", "tail").agg(F.count("*").alias("n_pair"))
    totals = seen.agg(F.sum("n_pair").alias("all_pairs")).crossJoin(counts.agg(F.sum("n").alias("all_words")))
    head = vocab.select(F.col("word").alias("head"), F.col("n").alias("n_head"))
    tail = vocab.select(F.col("word").alias("tail"), F.col("n").alias("n_tail"))
    scored = seen.where(F.col("n_pair") >= least).join(head, "head").join(tail, "tail").crossJoin(F.broadcast(totals))
    value = F.log((F.col("n_pair") / F.col("all_pairs")) / ((F.col("n_head") / F.col("all_words")) * (F.col("n_tail") / F.col("all_words"))))
    return scored.withColumn("pmi", F.round(F.least(value, F.lit(clip)), 6)).where("pmi > 0").select("head", "tail", "n_pair", "pmi").orderBy(F.desc("n_pair"), "head", "tail").limit(top)


def stale(rows: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """References whose row isn't there as it was: their content hash is no row's."""
    return refs.join(rows.select(key).distinct(), key, "left_anti")


def attached(rows: DataFrame, refs: DataFrame, key: str, refuse: bool = False) -> DataFrame:
    """rows with the columns of the reference of the same content hash; refuse: a stale reference is an error, not a row left out."""
    if refuse and (n := stale(rows, refs, key).count()):
        raise ValueError(f"{n} references are of rows that have changed")
    return rows.join(refs, key, "left")


def word_ids(words: DataFrame, word: str) -> DataFrame:
    """Each different word with its place in alphabetical order."""
    return indexed(words.select(F.col(word).alias("word")).distinct(), ["word"], "id")


def front_coded(words: DataFrame, word: str) -> DataFrame:
    """Sorted words as the length of what each shares with the one before it, and the rest."""
    ids = word_ids(words, word)
    before = ids.select((F.col("id") + 1).alias("id"), F.col("word").alias("before"))
    both = ids.join(before, "id", "left")
    shared = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length("word"), F.length(F.coalesce("before", F.lit("")))), F.lit(1))),
        F.lit(0),
        lambda a, i: F.when((a == i - 1) & (F.col("before").substr(F.lit(1), i) == F.col("word").substr(F.lit(1), i)) & (F.length("before") >= i) & (F.length("word") >= i), i).otherwise(a),
    )
    return both.select("id", "word", F.least(shared, F.lit(254)).alias("shared")).withColumn("rest", F.expr("substr(word, shared + 1)"))


def hash_rank(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The n rows with the least md5 of seed and key: a uniform draw that anyone can repeat."""
    return df.withColumn("_rank", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("_rank", key).limit(n).drop("_rank")


def upsampled(rows: DataFrame, key: str, times: DataFrame) -> DataFrame:
    """rows repeated round by round up to a target number; times: one row with target. Row i comes again at i + n, i + 2n, ..."""
    placed = indexed(rows, [key], "i")
    n = rows.agg(F.count("*").alias("n"))
    spread = placed.crossJoin(F.broadcast(times.crossJoin(n)))
    copies = F.when(F.col("i") < F.col("target"), F.ceil((F.col("target") - F.col("i")) / F.col("n"))).otherwise(0)
    return spread.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("i", "n", "target", "copies")


def split_shares(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("share", hash_share(F.col(key)))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each group: the first in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
