"""Sources, sinks and compact forms: tables written to the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harfgah.functions import words as W
from harfgah.functions.tables import CHAT_WORDS, CORRESPONDENCES, WRITTEN_WORDS
from harfgah.operators import channel
from harfgah.operators import tensors as M
from harfgah.plans import candidates as D
from harfgah.plans import corpus as P
from harfgah.plans import model
from harfgah.plans import words as T
from harfgah.plans.registry import Registry
from harfgah.plans.sqltools import leak_key_sql, match_key_sql, normal_sql, quoted, split_sql, values_sql
from harfgah.session import cut, scratch, table
from harfgah.sources import codecs, readers, sinks

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("select latin, labels, persian, is_final as final from example")
def jsonl_training(spark: SparkSession, d: str) -> DataFrame:
    """Training examples as lines of JSON."""
    path = scratch(spark, "training")
    table(spark, d, "example").select("latin", "labels", "persian", F.col("is_final").alias("final")).write.json(path)
    return readers.training(spark, path)


@query("select id, coalesce(category, 'gold') as category, input, expected, alternatives from chat_test union all select id, 'gold', input, expected, alternatives from authored")
def jsonl_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows as lines of JSON, those without a category being gold."""
    path = scratch(spark, "evaluation")
    rows = table(spark, d, "chat_test").select("id", "category", "input", "expected", "alternatives")
    rows.unionByName(table(spark, d, "authored").select("id", "input", "expected", "alternatives"), allowMissingColumns=True).write.json(path)
    return readers.evaluation(spark, path).select("id", "category", "input", "expected", "alternatives")


@query("select form, text, count(*) as n from (select unnest(['parquet', 'json', 'lines']) as form, fa as text from loanwords) where form <> 'lines' or (trim(text, ' ') <> '' and not starts_with(text, '#')) group by all")
def sentence_sources(spark: SparkSession, d: str) -> DataFrame:
    """The same sentences as a parquet column, as lines of JSON and as lines of text."""
    rows, path = table(spark, d, "loanwords").select(F.col("fa").alias("text")), scratch(spark, "sentences")
    rows.write.parquet(f"{path}/s.parquet")
    rows.write.option("ignoreNullFields", "false").json(f"{path}/s.jsonl")
    rows.where("text is not null").write.text(f"{path}/s.txt")
    read = [readers.sentences(spark, f"{path}/s.{end}").withColumn("form", F.lit(form)) for form, end in (("parquet", "parquet"), ("json", "jsonl"), ("lines", "txt"))]
    return read[0].unionByName(read[1]).unionByName(read[2]).groupBy("form", "text").agg(F.count("*").alias("n"))


CELLS = ("en", "fa", "category", "claude", "luna", "claude_reason", "luna_reason")


@query("select " + ", ".join(f"nullif(regexp_replace(regexp_replace(coalesce({c}, ''), '[\t\n]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') as {c}" for c in CELLS) + " from loanwords")
def tsv_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Loanwords as a table with tabs and a header, cells cleaned; an empty cell comes back as none."""
    path = scratch(spark, "lexical")
    clean = table(spark, d, "loanwords").select(*(readers.clean_cell(F.col(c)).alias(c) for c in CELLS))
    clean.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="")
    return readers.lexical(spark, path)


@query("select lower(en) as typed, min(fa) as persian from loanwords where regexp_full_match(en, '[A-Za-z]+') and regexp_full_match(fa, '[ء-ی]+') group by 1")
def tsv_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from two columns of a table with tabs in several files, each with a header; the first line of a typing counts."""
    path = scratch(spark, "pairs")
    rows = table(spark, d, "loanwords").where(F.col("en").rlike(r"\A[A-Za-z]+\z") & F.col("fa").rlike(r"\A[ء-ی]+\z")).select("loan_id", F.initcap("en").alias("en"), "fa")
    # of a typing the least spelling comes first, in one file
    rows.repartition(3, F.lower("en")).sortWithinPartitions(F.lower("en"), "fa").write.csv(path, sep="\t", header=True, quote="")
    return readers.pairs(spark, path, 1, 2, header=True)


@query("select typed, max(persian) as persian from (select lower(en) as typed, fa as persian from loanwords where regexp_full_match(en, '[A-Za-z]+') and fa <> '') group by typed")
def pair_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pairs from lines with a blank between typing and spelling; the last line of a typing counts."""
    path = scratch(spark, "pairs")
    rows = table(spark, d, "loanwords").where(F.col("en").rlike(r"\A[A-Za-z]+\z") & (F.col("fa") != "")).select(F.lower("en").alias("en"), "fa")
    rows.repartition(3, "en").sortWithinPartitions("en", "fa").select(F.concat_ws(" ", "en", "fa").alias("value")).write.text(path)
    return readers.pair_list(spark, path)


# stripped, added, flags that follow
RULES = {"aa": ("", "ها", "cc"), "bb": ("", "تر", "dd"), "cc": ("", "ی", "ee"), "dd": ("", "ین", ""), "ee": ("", "م", ""), "ff": ("ه", "گان", "")}


@query(
    f"""with recursive rules(flag, strip, add, next) as {values_sql([(k, *v) for k, v in RULES.items()], 'flag, strip, add, next').replace('as t(', 'as t(').join(['(select * from ', ')'])},
    stems as (select word, case when ends_with(word, 'ه') then ['aa', 'ff'] else ['aa', 'bb'] end as flags from {T.PERSIAN_WORDS_SQL} where n >= 3 and regexp_full_match(word, '[ء-ی]+')),
    e(form, flag, depth) as (select word, unnest(flags), 0 from stems union all select left(e.form, length(e.form) - length(strip)) || add, next, depth + 1 from e join rules r on r.flag = e.flag where depth < 3 and ends_with(e.form, strip))
    select distinct form from e"""
)
def affix_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Every form of a word list under its affix file: endings and theirs, three deep at most."""
    path = scratch(spark, "affixes")
    stems = T.persian_words(spark, d).where("n >= 3").where(F.col("word").rlike(r"\A[ء-ی]+\z"))
    lines = stems.select(F.concat("word", F.when(F.col("word").endswith("ه"), "/aaff").otherwise("/aabb")).alias("value"))
    # a word list is a file with its count ahead
    n = spark.createDataFrame([(0,)], "at int").select(F.lit(0).alias("at"), F.lit(str(stems.count())).alias("value"))
    n.unionByName(lines.select(F.lit(1).alias("at"), "value")).coalesce(1).sortWithinPartitions("at").select("value").write.text(f"{path}/words")
    rules = [f"SFX {flag} Y 1" for flag in RULES] + [f"SFX {flag} {strip or 0} {add}{'/' + after if after else ''} ." for flag, (strip, add, after) in RULES.items()]
    spark.createDataFrame([(x,) for x in rules], "value string").write.text(f"{path}/rules")
    return readers.expanded(readers.hunspell_words(spark, f"{path}/words"), readers.hunspell_affixes(spark, f"{path}/rules"))


def _artifact(spark: SparkSession, name: str, data: bytes, kind: str) -> DataFrame:
    rows = spark.createDataFrame([(name, bytearray(data))], "name string, data binary")
    return codecs.decoded(rows, "name", "data", kind)


#: The letters that the compact forms are made of here.
SPELLED = r"\A[ء-ی]+\z"


@query(f"select 'frequency' as name, word, score / 255 as score from ({P.ORACLES['unigram_logquant']}) where regexp_full_match(word, '[ء-ی]+')")
def frequency_artifact(spark: SparkSession, d: str) -> DataFrame:
    """The frequency table as bytes, and read from them."""
    rows = P.unigram_logquant(spark, d).where(F.col("word").rlike(SPELLED)).select("word", "score").collect()  # of twenty-five thousand at most
    return _artifact(spark, "frequency", codecs.frequencies_to_bytes({r["word"]: r["score"] for r in rows}), "frequencies")


@query(f"select 'bigram' as name, head, tail, greatest(1, least(255, round_even(255 * pmi / 6, 0))) / 255 as score from {P.PMI_SQL} where regexp_full_match(head, '[ء-ی]+') and regexp_full_match(tail, '[ء-ی]+')")
def bigram_artifact(spark: SparkSession, d: str) -> DataFrame:
    """The pair table as bytes, and read from them."""
    score = F.greatest(F.lit(1), F.least(F.lit(255), F.bround(255 * F.col("pmi") / 6))).cast("int")
    rows = P.top_pairs(spark, d).where(F.col("head").rlike(SPELLED) & F.col("tail").rlike(SPELLED)).select("head", "tail", score.alias("score")).collect()  # of thirty thousand at most
    return _artifact(spark, "bigram", codecs.pairs_to_bytes({(r["head"], r["tail"]): r["score"] for r in rows}), "pairs")


KEPT_WORDS_SQL = f"(select word from {P.UNIGRAMS_SQL} order by n desc, word limit {P.TABLE_WORDS})"


@query(f"select 'vowels' as name, word, vowels from {P.CONFUSABLE_SQL} where word in {KEPT_WORDS_SQL}")
def vowel_artifact(spark: SparkSession, d: str) -> DataFrame:
    """The vowels of the frequency table's words as bytes, and read from them."""
    known = P.unigram_logquant(spark, d).select("word")
    rows = P.vowel_table(spark, d).join(known, "word", "left_semi").collect()  # of twenty-five thousand at most
    return _artifact(spark, "vowels", codecs.vowels_to_bytes({r["word"]: r["vowels"] for r in rows}), "vowels")


@query(f"select 'said' as name, word, typed as said, regexp_extract_all(typed, '[aeo]', 0) as short_vowels from (select word, arg_max(typed, (n, typed)) as typed from {P.TYPED_SQL} where regexp_full_match(typed, '[a-z]+') and regexp_full_match(word, '[ء-ی]+') group by word) where word in {KEPT_WORDS_SQL}")
def pronunciation_artifact(spark: SparkSession, d: str) -> DataFrame:
    """How each word of the frequency table is typed most, as lines with tabs, and read from them, with its short vowels."""
    said = P.typed(spark, d).where(F.col("typed").rlike(r"\A[a-z]+\z") & F.col("word").rlike(SPELLED)).groupBy("word").agg(F.max_by("typed", F.struct("n", "typed")).alias("typed"))
    rows = said.join(P.unigram_logquant(spark, d).select("word"), "word", "left_semi").collect()  # of twenty-five thousand at most
    return _artifact(spark, "said", codecs.pronunciations_to_bytes({r["word"]: r["typed"] for r in rows}), "pronunciations")


SIX_SQL = f"(select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 31 as s from {model.VECS_SQL})"


@query(f"select vec_id, array_to_string(list_transform(v, lambda x: substr('{M.SIX_BIT}', greatest(-31, least(31, round_even(x / s, 0)))::integer + 32, 1)), '') as letters, list_transform(v, lambda x: round(greatest(-31, least(31, round_even(x / s, 0))) * s, 9)) as weights from {SIX_SQL}")
def six_bit_codes(spark: SparkSession, d: str) -> DataFrame:
    """Each row as six-bit codes of one letter each, and the numbers that the letters stand for; a zero has the sign of the row's number, as in the SQL."""
    rows = model.vecs(spark, d).select("vec_id", "v", M.row_scale(F.col("v"), 31).alias("s"), M.letters_of(M.row_codes(F.col("v"), 31)).alias("letters"))
    # neither a letter nor F.round keeps the sign of a zero
    signed = lambda w, x: F.when((w == 0) & x.isNotNull(), 0.0 * x).otherwise(w)
    return rows.select("vec_id", "letters", F.zip_with(M.codes_of(F.col("letters")), F.col("v"), lambda c, x: signed(F.round(c * F.col("s"), 9), x)).alias("weights"))


@query("select fa, latin, pos, role, w::double as w from (select * from " + values_sql([(fa, "|".join(us), "|".join(pos), role, float(w)) for fa, us, pos, role, w in CORRESPONDENCES], "fa, l, p, role, w") + ") s, lateral (select string_split(l, '|') as latin, string_split(p, '|') as pos)")
def rules_export(spark: SparkSession, d: str) -> DataFrame:
    """The correspondences as lines of JSON with a manifest, and read from them."""
    path = scratch(spark, "rules")
    rules = D.D.correspondences(spark)
    sinks.write_json_with_manifest(rules, path)
    return readers.json_lines(spark, path, "fa string, latin array<string>, pos array<string>, role string, w double")


MARKED_SQL = f"""(select distinct {match_key_sql('w')} as word, written from (select unnest([{', '.join(map(quoted, CHAT_WORDS))}]) as w, false as written union all select unnest([{', '.join(map(quoted, WRITTEN_WORDS))}]), true))"""


@query(
    f"""with m as (select coalesce(list(word) filter (where not written), []) as chat_words, coalesce(list(word) filter (where written), []) as written_words from {MARKED_SQL}),
    e as (select example_id, list_filter(string_split({leak_key_sql('persian')}, ' '), lambda w: w <> '') as w from example where persian is not null)
    select example_id, len(w)::bigint as n_words, list_has_any(w, chat_words) and not list_has_any(w, written_words) as chat, coalesce(ends_with(w[-1], 'ه'), false) as he from e, m"""
)
def register_flags(spark: SparkSession, d: str) -> DataFrame:
    """A chat marker and none of written register, by a file of markers; a last word in he."""
    path = scratch(spark, "markers")
    spark.createDataFrame([("# markers",), *((w,) for w in CHAT_WORDS), *((f"!{w}",) for w in WRITTEN_WORDS)], "value string").write.text(path)
    # as many rows as the file has
    marks = readers.markers(spark, path).groupBy().agg(*(F.coalesce(F.collect_set(F.when(F.col("written") == F.lit(k), F.col("word"))), F.array().cast("array<string>")).alias(name) for k, name in ((False, "chat_words"), (True, "written_words"))))
    rows = P.keyed(spark, d).select("example_id", F.filter("w", lambda x: x != "").alias("w")).crossJoin(F.broadcast(marks))
    chat = F.arrays_overlap("w", "chat_words") & ~F.arrays_overlap("w", "written_words")
    return rows.select("example_id", F.size("w").cast("long").alias("n_words"), chat.alias("chat"), F.coalesce(F.endswith(F.try_element_at("w", F.lit(-1)), F.lit("ه")), F.lit(False)).alias("he"))


SENTENCE_SQL = f"(select example_id, list_filter(list_transform(string_split_regex(regexp_replace({normal_sql('persian')}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\x{{200c}}\\x{{0600}}-\\x{{06ff}}]|[\\x{{060c}}\\x{{061b}}\\x{{061f}}\\x{{066a}}-\\x{{066c}}\\x{{06d4}}]', ' ', 'g'), '[ \\t\\n\\f\\r]+'), lambda w: {normal_sql('w')}), lambda w: w <> '') as words from example)"


@query(f"select example_id, array_to_string(words, ' ') as words, 'ch-' || substr(sha256(array_to_string(words, ' ')), 1, 10) as sentence_id from {SENTENCE_SQL} where len(words) > 0 and len(list_filter(words, lambda w: not regexp_full_match(w, '[ء-غف-يپچژکگی\\x{{200c}}\\x{{0654}}]+'))) = 0")
def persian_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The words of every example that is all of Persian words, and the id of its content."""
    rows = table(spark, d, "example").select("example_id", F.array_join(W.sentence_words(F.col("persian")), " ").alias("words")).where("words is not null")
    return rows.withColumn("sentence_id", F.concat(F.lit("ch-"), W.content_id(F.col("words"), length=10)))


REPAIR_SQL = f"""(with s as (select line_id, arg_min(latin, example_id) as latin, arg_min(persian, example_id) as persian, arg_min(split, example_id) as split from example where line_id is not null and latin is not null and persian is not null group by line_id)
 select e.example_id, e.latin, e.persian, s.latin as source_latin, s.persian as source_persian, s.split from example e left join s on s.line_id = e.line_id where e.split = 'dev' and e.latin is not null and e.persian is not null)"""


def _span_sql(whole: str, part: str) -> str:
    a, b = split_sql(whole), split_sql(part)
    return f"len({b}) <= len({a}) and len(list_filter(range(len({a}) - len({b}) + 1), lambda i: ({a})[i + 1 : i + len({b})] = {b})) > 0"


@query(
    f"""select example_id, case when split is distinct from 'dev' then 'stale' when not ({_span_sql('source_latin', 'latin')}) then 'input' when not ({_span_sql('source_persian', 'persian')}) then 'expected'
    when {normal_sql('persian')} <> persian then 'form' when len({split_sql('latin')}) < 2 then 'short' else 'kept' end as outcome from {REPAIR_SQL}"""
)
def repair_check(spark: SparkSession, d: str) -> DataFrame:
    """Dev rows held against the first delivery of their line: a changed source, words that don't stand in it, or a form that isn't normal is refused; too short ones are left out."""
    rows = table(spark, d, "example").where("latin is not null and persian is not null")
    first = rows.where("line_id is not null").groupBy("line_id").agg(*(F.min_by(c, "example_id").alias(f"source_{c}") for c in ("latin", "persian", "split")))
    own = rows.where("split = 'dev'").join(first, "line_id", "left")
    stands = lambda c: W.has_span(W.split_blank(F.col(f"source_{c}")), W.split_blank(F.col(c)))
    outcome = (
        F.when(F.coalesce(F.col("source_split") != "dev", F.lit(True)), "stale")
        .when(~stands("latin"), "input")
        .when(~stands("persian"), "expected")
        .when(W.normalize_column(F.col("persian")) != F.col("persian"), "form")
        .when(F.size(W.split_blank(F.col("latin"))) < 2, "short")
        .otherwise("kept")
    )
    return own.select("example_id", outcome.alias("outcome"))


@query()
def channel_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Emissions after three rounds of best alignments over all typed pairs, drawn toward the rules."""
    pairs = cut(P.typed(spark, d).where(F.col("typed").rlike(r"\A[a-z']+\z") & F.col("word").rlike(r"\A[ء-ی]+\z")))
    found = channel.fitted(pairs, "typed", "word", "n")
    return spark.createDataFrame([(fa, pos, unit, round(p, 6)) for (fa, pos), of in found.items() for unit, p in of.items()], "fa string, position string, unit string, log_p double")
