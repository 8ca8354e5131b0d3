"""The queries of this package: name to a function of the session and the tables' folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.llm import bpe, collapse, consensus, leaks, lookalikes, overlap, packing, repetition, terms
from harfgah.session import cut, table


def _evals(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name: table(spark, d, name).select("id", "input", "expected", F.lit(name).alias("eval_set"))
    return of("chat_test").unionByName(of("authored"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "example").where("split = 'train'")


SIDES = {"input": "latin", "expected": "persian"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(_evals(spark, d), _train(spark, d), SIDES, "id", "example_id")
    return pairs.select(F.col("id").alias("eval_id"), "example_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation set, split and source: pairs, records on both sides, and how much of them is covered."""
    pairs = overlap.overlaps(_evals(spark, d), table(spark, d, "example"), SIDES, "id", "example_id", ("split", "source"), exact=True)
    sets = _evals(spark, d).select("id", "eval_set")
    return (
        pairs.join(sets, "id")
        .groupBy("eval_set", "split", "source")
        .agg(F.count("*").alias("n_pairs"), F.countDistinct("id").alias("n_eval"), F.countDistinct("example_id").alias("n_examples"), F.sum(F.col("same").cast("int")).alias("n_same"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    )


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation record: training records that overlap it, and the greatest coverage."""
    pairs = overlap.overlaps(_evals(spark, d), _train(spark, d), SIDES, "id", "example_id", exact=True)
    return pairs.groupBy(F.col("id").alias("eval_id")).agg(F.count("*").alias("n_examples"), F.round(F.max("coverage"), 6).alias("coverage"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = table(spark, d, "example").select("example_id", "latin", "persian", none.alias("payload"))
    return rows.unionByName(table(spark, d, "example_raw").select("example_id", none.alias("latin"), none.alias("persian"), F.coalesce("payload", F.lit("")).alias("payload")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse.Collapsed(_records(spark, d), "example_id", payload="payload").copies()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each different record, with the number of its copies."""
    return collapse.Collapsed(_records(spark, d), "example_id", payload="payload").groups()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "example").select(F.col("persian").alias("text")).unionByName(table(spark, d, "chat_test").select(F.col("expected").alias("text")))


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return terms.marked(terms.term_counts(texts), texts.agg(F.count("*").alias("n_all")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where("mark is not null").select("term", "mark")


def _looks(spark: SparkSession, d: str, detail: bool = False) -> DataFrame:
    rows = table(spark, d, "normalization").select(F.col("norm_id").alias("key"), F.col("input").alias("text"))
    return lookalikes.forms(rows.unionByName(table(spark, d, "chat_test").select(F.col("id").alias("key"), F.col("expected").alias("text"))), "key", "text", detail)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(cut(_looks(spark, d)))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of normalization (input and output) and chat_test.expected in its consistent form."""
    out = lookalikes.forms(table(spark, d, "normalization").select(F.concat(F.lit("output:"), "norm_id").alias("key"), F.col("output").alias("text")), "key", "text", True)
    return _looks(spark, d, True).unionByName(out)


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    loan, review, span = (table(spark, d, x) for x in ("loanwords", "loan_review", "judge_calibration"))
    edges = [
        *(consensus.votes(loan.select("loan_id", F.lit(x).alias("judge"), F.col(x).alias("label")), "loan_id", "judge", "label") for x in ("claude", "luna")),
        consensus.votes(review, "loan_id", "judge", "verdict", "judged_at"),
        consensus.votes(span, "span_key", "judge", "verdict", "judged_at"),
    ]
    kinds = loan.select(F.col("loan_id").alias("item"), F.lit("loan").alias("kind"))
    kinds = kinds.unionByName(review.select(F.col("loan_id").alias("item"), F.lit("loan").alias("kind"))).unionByName(span.select(F.col("span_key").alias("item"), F.lit("span").alias("kind")))
    return consensus.consensus(edges[0].unionByName(edges[1]).unionByName(edges[2]).unionByName(edges[3]), kinds.distinct())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items.select("item_id", "verdict")


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items.select("item_id", "kind", "verdict", "n_votes", *(F.round(x, 4).alias(x) for x in ("agreement", "pair_agreement", "confidence")))


def p5_judges(spark: SparkSession, d: str) -> DataFrame:
    """Each judge's votes and reliability, with the rounds that it took and how much any reliability still moved in the last."""
    c = _consensus(spark, d)
    return c.judges.join(F.broadcast(c.rounds)).select("judge", "n_votes", "rounds", F.round("last_change", 6).alias("last_change"), *(F.round(x, 4).alias(x) for x in ("reliability", "accepts_right", "rejects_right")))


def _leaks(spark: SparkSession, d: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return leaks.leaks(table(spark, d, "chat_test"), _train(spark, d), ["expected", "input"], ["latin", "persian"], "id", "example_id", carry)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("eval_id"), "example_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item and source: training records into which its question, its answer or both leaked."""
    count = lambda c: F.sum(c.cast("int"))
    answer, question = F.col("leaked_expected"), F.col("leaked_input")
    return _leaks(spark, d, ("source",)).groupBy(F.col("id").alias("eval_id"), "source").agg(F.count("*").alias("n_examples"), count(question).alias("n_question"), count(answer).alias("n_answer"), count(question & answer).alias("n_both"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text, encoded and decoded again."""
    return bpe.decoded(bpe.encoded(table(spark, d, "documents")))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.stored_sizes(bpe.encoded(table(spark, d, "documents"), ids=False)))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(repetition.repetition(table(spark, d, "documents"), lengths=(repetition.RUN,))).select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.with_shares(repetition.repetition(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_records, p2_found, p2_groups, p3_found, p3_terms, p4_found, p4_forms, p5_found, p5_items, p5_judges, p6_found, p6_items, p7_ids, p7_texts, p8_packed, p8_fill, p9_found, p9_shares)
}
