"""Sources: lines of JSON, tables with tabs, sentences of three kinds of file, word lists with affixes."""

from __future__ import annotations

from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.functions.fold import fold_column
from harfgah.operators.corpus import first_by
from harfgah.session import scratch
from harfgah.sources import schemas


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; a line that isn't JSON stops the read instead of becoming a row of nulls."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows; an absent category is gold, absent alternatives are none, a null reference stays null."""
    rows = json_lines(spark, path, schemas.EVALUATION)
    return rows.withColumns({"category": F.coalesce("category", F.lit("gold")), "alternatives": F.coalesce("alternatives", F.array().cast("array<string>"))})


def training(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.TRAINING)


def lexical(spark: SparkSession, path: str) -> DataFrame:
    """A table with tabs and a header row; quotes are ordinary characters."""
    return spark.read.schema(schemas.LEXICAL).csv(path, sep="\t", header=True, quote="", mode="FAILFAST", enforceSchema=False)


def sentences(spark: SparkSession, path: str, column: str = "text") -> DataFrame:
    """text: a column of a parquet file; text, or words joined, of JSON lines; else lines, without those that begin with #."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path).select(F.col(column).alias("text"))
    if path.endswith((".jsonl", ".json")):
        rows = json_lines(spark, path, "text string, words array<string>")
        return rows.select(F.coalesce("text", F.array_join("words", " ")).alias("text"))
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.where((F.trim("text") != "") & ~F.startswith("text", F.lit("#")))


def pairs(spark: SparkSession, path: str, first: int, second: int, header: bool = False) -> DataFrame:
    """typed, persian of two columns of tables with tabs: short lines are left out, and of lines with the same typing in lower case the first one is kept.

    header: each file's first line is one. Quotes are ordinary characters.
    """
    schema = ", ".join(f"c{i} string" for i in range(max(first, second) + 1))
    lines = spark.read.schema(schema).csv(path, sep="\t", header=header, quote="", escape="", mode="PERMISSIVE").withColumn("_at", F.monotonically_increasing_id())
    rows = lines.select("_at", F.trim(F.trim(F.trim(f"c{first}"), F.lit("."))).alias("typed"), F.trim(f"c{second}").alias("persian"))
    rows = rows.where("typed <> '' and persian <> ''").withColumn("typed", F.lower("typed"))
    return first_by(rows, ["typed"], [F.asc("_at")]).drop("_at")


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """typed, persian of lines with a blank between the two; of lines with the same typing the last one counts, lines without a blank don't."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.instr("value", " ").alias("at"), "value").where("at > 1")
    rows = lines.select("_at", F.expr("left(value, at - 1)").alias("typed"), F.expr("substr(value, at + 1)").alias("persian"))
    return rows.groupBy("typed").agg(F.max_by("persian", "_at").alias("persian"))


def fetched(spark: SparkSession, url: str, timeout: float = 60.0) -> str:
    """The lines of an address, written as one text file to the shared folder; its path, for the readers above.

    For tables that fit the driver; an answer that isn't a success stops.
    """
    with urlopen(url, timeout=timeout) as answer:  # noqa: S310
        lines = answer.read().decode("utf-8").splitlines()
    path = scratch(spark, "fetched")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def markers(spark: SparkSession, path: str) -> DataFrame:
    """word (folded) and written of a list of one word a line: ! marks a word of written register, # a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and line not like '#%'")
    return lines.select(fold_column(F.regexp_replace("line", "^!+", "")).alias("word"), F.startswith("line", F.lit("!")).alias("written")).distinct()


def clean_cell(c: Column) -> Column:
    """A cell of a table with tabs: tabs and line ends are one blank each run, none at the ends; a missing cell is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\n]+", " "), r"^\s+|\s+$", "")


def hunspell_words(spark: SparkSession, path: str) -> DataFrame:
    """stem, flags (two letters each) of word lists; each file's first line is a count."""
    # word lists are small files: each is taken whole, as only then its first line is known
    files = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    lines = files.select(F.explode(F.slice("lines", 2, 1 << 30)).alias("value")).where("trim(value) <> ''")
    parts = F.split(F.trim("value"), "/")
    flags = F.coalesce(F.regexp_extract_all(F.get(parts, F.lit(1)), F.lit(".."), 0), F.array().cast("array<string>"))
    return lines.select(F.trim(F.get(parts, F.lit(0))).alias("stem"), flags.alias("flags")).where("stem <> ''")


def hunspell_affixes(spark: SparkSession, path: str) -> DataFrame:
    """kind, flag, strip, add, next, condition of the rules of an affix file; '0' strips nothing."""
    c = F.split(F.trim("value"), r"[ \t]+")
    rows = spark.read.text(path).select(c.alias("c")).where(F.get("c", F.lit(0)).isin("PFX", "SFX") & (F.size("c") >= 5))
    add = F.split(F.get("c", F.lit(3)), "/")
    at = lambda i: F.get("c", F.lit(i))
    return rows.select(at(0).alias("kind"), at(1).alias("flag"), F.when(at(2) == "0", "").otherwise(at(2)).alias("strip"), F.get(add, F.lit(0)).alias("add"), F.coalesce(F.regexp_extract_all(F.get(add, F.lit(1)), F.lit(".."), 0), F.array().cast("array<string>")).alias("next"), at(4).alias("condition"))


def expanded(words: DataFrame, affixes: DataFrame, depth: int = 3) -> DataFrame:
    """form: every stem, and every form that its flags allow, through rules that lead to further rules, depth deep."""
    level = words.select(F.col("stem").alias("form"), F.explode("flags").alias("flag"))
    out = words.select(F.col("stem").alias("form"))
    for _ in range(depth):
        made = level.join(affixes, "flag")
        suffix = F.col("kind") == "SFX"
        fits = F.when(suffix, F.endswith("form", "strip")).otherwise(F.startswith("form", "strip"))
        bare = F.when(suffix, F.expr("left(form, length(form) - length(strip))")).otherwise(F.expr("substr(form, length(strip) + 1)"))
        made = made.where(fits).select(F.when(suffix, F.concat(bare, "add")).otherwise(F.concat("add", bare)).alias("form"), "next").distinct()
        out = out.unionByName(made.select("form"))
        level = made.select("form", F.explode("next").alias("flag"))
    return out.distinct()
