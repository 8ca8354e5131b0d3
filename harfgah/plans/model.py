"""Tensor and model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harfgah.operators import tensors as M
from harfgah.operators.order import indexed
from harfgah.plans import candidates as D
from harfgah.plans import words as T
from harfgah.plans.registry import Registry
from harfgah.session import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

VECS_SQL = "(select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"
LETTERS = "abcdefghijklmnopqrstuvwxyz'"


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", M.doubles(F.col("embedding")).alias("v"))


@query(f"select vec_id, round(s, 9) as scale, list_transform(v, lambda x: greatest(-127, least(127, round_even(x / s, 0)))::integer) as codes from (select *, list_max(list_transform(v, lambda x: abs(x))) / 127 as s from {VECS_SQL})")
def quantize_rows(spark: SparkSession, d: str) -> DataFrame:
    return vecs(spark, d).select("vec_id", F.round(M.row_scale(F.col("v"), 127), 9).alias("scale"), M.row_codes(F.col("v"), 127).alias("codes"))


@query(f"select label, count(*) as n, round(max(e), 9) as max_error from (select label, list_max(list_transform(v, lambda x: abs(x - s * greatest(-31, least(31, round_even(x / s, 0)))))) as e from (select *, list_max(list_transform(v, lambda x: abs(x))) / 31 as s from {VECS_SQL})) group by label")
def dequantize_error(spark: SparkSession, d: str) -> DataFrame:
    """The greatest error that six-bit codes leave."""
    return vecs(spark, d).withColumn("e", M.coded_error(F.col("v"), 31)).groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("e"), 9).alias("max_error"))


@query(f"select vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 1e-5), 6)) as normed from {VECS_SQL}")
def rms_norm(spark: SparkSession, d: str) -> DataFrame:
    return vecs(spark, d).select("vec_id", F.transform(M.rms_norm(F.col("v")), lambda x: F.round(x, 6)).alias("normed"))


@query(f"select vec_id, list_transform(v, lambda x: round(exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))), 6)) as p from {VECS_SQL}")
def softmax_rows(spark: SparkSession, d: str) -> DataFrame:
    return vecs(spark, d).select("vec_id", F.transform(M.softmax(F.col("v")), lambda x: F.round(x, 6)).alias("p"))


CENTRES_SQL = f"(select label, list(round(m, 9) order by i) as c from (select label, i, avg(x) as m from (select label, unnest(v) as x, unnest(range(len(v))) as i from {VECS_SQL}) group by label, i) group by label)"


@query(f"select vec_id, centre, round(score, 6) as score from (select vec_id, c.label as centre, list_sum(list_transform(list_zip(v, c.c), lambda z: z[1] * z[2])) as score, row_number() over (partition by vec_id order by round(list_sum(list_transform(list_zip(v, c.c), lambda z: z[1] * z[2])), 6) desc, c.label) as k from {VECS_SQL} e, {CENTRES_SQL} c) where k = 1")
def dot_top1(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's best label by the dot product with the mean vector of each label: an affine layer and its arg max.

    The labels' means are the weights; they go to every row in one row of a map, as a model's weights do.
    """
    rows = vecs(spark, d)
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.round("m", 9).alias("m")))), lambda x: x["m"]).alias("c"))
    weights = centres.agg(F.collect_list(F.struct("label", "c")).alias("w"))
    scored = rows.crossJoin(F.broadcast(weights)).withColumn("best", F.array_min(F.transform("w", lambda w: F.struct((-F.round(M.dot(F.col("v"), w["c"]), 6)).alias("s"), w["label"].alias("label")))))
    return scored.select("vec_id", F.col("best.label").alias("centre"), F.round(-F.col("best.s"), 6).alias("score"))


@query(f"select label, round(avg(list_sum(list_transform(v, lambda x: greatest(x, 0)))), 6) as relu_sum, count(*) as n from {VECS_SQL} group by label")
def relu_sums(spark: SparkSession, d: str) -> DataFrame:
    return vecs(spark, d).groupBy("label").agg(F.round(F.avg(M.total(F.transform("v", lambda x: F.greatest(x, F.lit(0.0))))), 6).alias("relu_sum"), F.count("*").alias("n"))


def scan_sql(gate: str, value: str) -> str:
    return f"list_reduce(list_concat([[0.0::double]], list_transform(list_zip({gate}, {value}), lambda z: [z[1], z[2]])), lambda h, x: list_append(h, h[len(h)] * x[1] + (1 - x[1]) * x[2]))[2:]"


GATES_SQL = f"(select vec_id, list_transform(v, lambda x: 1 / (1 + exp(-4 * x))) as g, list_transform(v, lambda x: greatest(x, 0)) as u from {VECS_SQL})"


@query(f"select vec_id, list_transform({scan_sql('g', 'u')}, lambda x: round(x, 6)) as forward, list_reverse(list_transform({scan_sql('list_reverse(g)', 'list_reverse(u)')}, lambda x: round(x, 6))) as backward from {GATES_SQL}")
def convex_scan(spark: SparkSession, d: str) -> DataFrame:
    """h = gate h + (1 - gate) value along each vector and back, gate and value both from the vector."""
    gate, value = F.transform("v", lambda x: 1 / (1 + F.exp(-4 * x))), F.transform("v", lambda x: F.greatest(x, F.lit(0.0)))
    rows = vecs(spark, d).select("vec_id", gate.alias("g"), value.alias("u"))
    made = rows.select("vec_id", M.convex_scan(F.col("g"), F.col("u")).alias("forward"), M.convex_scan(F.col("g"), F.col("u"), back=True).alias("backward"))
    return made.select("vec_id", *(F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("forward", "backward")))


@query("select event_id, round(coalesce(lag(value, 2) over w, 0), 4) as before_2, round(coalesce(lag(value) over w, 0), 4) as before_1, round(coalesce(lead(value) over w, 0), 4) as after_1, round(coalesce(lead(value, 2) over w, 0), 4) as after_2, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 6) as near from events window w as (partition by user_id order by ts, event_id)")
def neighbourhood_window(spark: SparkSession, d: str) -> DataFrame:
    """Two neighbours on each side, 0 beyond the ends."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = lambda k: F.round(F.coalesce((F.lag("value", k) if k > 0 else F.lead("value", -k)).over(w), F.lit(0.0)), 4)
    return table(spark, d, "events").select("event_id", at(2).alias("before_2"), at(1).alias("before_1"), at(-1).alias("after_1"), at(-2).alias("after_2"), F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6).alias("near"))


@query(f"select word, list_transform(string_split(word, ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz''', c)::integer) as ids from {T.LATIN_WORDS_SQL}")
def encode_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.split("word", ""), lambda c: F.coalesce(F.try_element_at(_places(), c), F.lit(0)))
    return T.latin_words(spark, d).select("word", ids.alias("ids"))


def _places():
    return F.create_map(*(x for i, c in enumerate(LETTERS) for x in (F.lit(c), F.lit(i + 1))))


@query(f"select vec_id, list_transform(list_filter(list_zip(range(len(v)), v), lambda z: z[2] >= list_sort(v, 'desc')[4] and z[2] >= 0.2), lambda z: z[1])::integer[] as kept, (list_position(v, list_max(v)) - 1)::integer as best from {VECS_SQL}")
def top_k_floor(spark: SparkSession, d: str) -> DataFrame:
    """Places of the four greatest numbers of a row that are no less than a floor; and the greatest."""
    fourth = F.get(F.sort_array("v", asc=False), 3)
    kept = F.filter(F.transform("v", lambda x, i: F.when((x >= fourth) & (x >= 0.2), i)), lambda i: i.isNotNull())
    return vecs(spark, d).select("vec_id", kept.alias("kept"), (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("best"))


@query()
def model_decode(spark: SparkSession, d: str) -> DataFrame:
    """Three outputs of every different Latin word by the sequence model with fixed untrained weights."""
    weights = M.Weights.random(LETTERS, ["", *"ابپتثجچحخدذرزسشعغفقکگلمنوهی"])
    return M.decoded(T.latin_words(spark, d), "word", weights).withColumn("log_prob", F.round("log_prob", 4))


@query(f"select typed, output, round(exp(s - max(s) over w) / sum(exp(s)) over w * exp(max(s) over w), 6) as probability, round(least(1, greatest(0, exp(max(s) over w / length(typed)))), 6) as confidence from (select *, round(ln(greatest(probability, 1e-6)), 9) as s from {D.LISTS_SQL} where typed <> '') window w as (partition by typed)")
def hypothesis_scores(spark: SparkSession, d: str) -> DataFrame:
    """Log probabilities of a word's hypotheses as shares that add up to one, and the best one's mean over the typed letters as confidence."""
    rows = D.lists(spark, d).where("typed <> ''").withColumn("s", F.round(F.log(F.greatest("probability", F.lit(1e-6))), 9))
    w = Window.partitionBy("typed")
    e = F.exp(F.col("s") - F.max("s").over(w))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(F.max("s").over(w) / F.length("typed"))))
    return rows.select("typed", "output", F.round(e / F.sum(e).over(w), 6).alias("probability"), F.round(confidence, 6).alias("confidence"))


@query(f"select typed, output, row_number() over (partition by typed order by s desc, ord) - 1 as ord from (select *, round(ln(greatest(probability, 1e-6)), 6) + case when output in (select fa from loanwords where fa is not null) then 1.5 else 0 end as s from {D.LISTS_SQL})")
def lexicon_snap(spark: SparkSession, d: str) -> DataFrame:
    """Readings ranked anew with a bonus for lexicon words."""
    lex = table(spark, d, "loanwords").where("fa is not null").select(F.col("fa").alias("output")).distinct().withColumn("hit", F.lit(1.5))
    rows = D.lists(spark, d).join(lex, "output", "left").withColumn("s", F.round(F.log(F.greatest("probability", F.lit(1e-6))), 6) + F.coalesce("hit", F.lit(0.0)))
    return rows.select("typed", "output", (F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("s"), "ord")) - 1).cast("long").alias("ord"))


HYBRID_SQL = f"""with r as (select typed, replace(output, '‌', '') as output, probability from {D.LISTS_SQL} where ord < 2), m as (select typed, word as output, n / sum(n) over (partition by typed) as p from {D.P.TYPED_SQL} where length(word) > 2)
 select typed, output, round(coalesce(ln(greatest(r.probability, 1e-6)), -12) + 0.25 * ln(greatest(coalesce(m.p, 0), 1e-3)), 6) as score from r full join m using (typed, output)"""


@query(HYBRID_SQL)
def hybrid_pool(spark: SparkSession, d: str) -> DataFrame:
    """Readings of two sources in one pool: those of one count little in the other."""
    r = D.lists(spark, d).where("ord < 2").select("typed", F.replace("output", F.lit("‌"), F.lit("")).alias("output"), "probability")
    m = D.P.typed(spark, d).where(F.length("word") > 2)
    m = m.select("typed", F.col("word").alias("output"), (F.col("n") / F.sum("n").over(Window.partitionBy("typed"))).alias("p"))
    score = F.coalesce(F.log(F.greatest("probability", F.lit(1e-6))), F.lit(-12)) + 0.25 * F.log(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(1e-3)))
    return r.join(m, ["typed", "output"], "full").select("typed", "output", F.round(score, 6).alias("score"))


@query("select bucket, count(*) as n, min(length(latin)) as shortest, max(length(latin)) as longest from (select latin, (row_number() over (order by length(latin), example_id) - 1) // 64 as bucket from example where latin is not null) group by bucket")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 64 lines of like length."""
    rows = indexed(table(spark, d, "example").where("latin is not null").select("example_id", F.length("latin").cast("long").alias("size")), ["size", "example_id"])
    return rows.groupBy(F.floor(F.col("row_index") / 64).alias("bucket")).agg(F.count("*").alias("n"), F.min("size").alias("shortest"), F.max("size").alias("longest"))


LABELLED_SQL = "(select example_id, split, source, unnest(labels) as label, unnest(string_split(lower(latin), '')) as letter, unnest(list_concat([''], string_split(lower(latin), '')[:-2])) as before from example where len(labels) = length(latin) and latin <> '')"


@query(
    f"""with l as materialized (select * from {LABELLED_SQL}), best as (select before, letter, arg_max(label, (n, label)) as guess from (select before, letter, label, count(*) as n from l where split = 'train' group by all) group by all)
    select source, round(avg(ok::integer), 6) as char_accuracy, round(avg(whole::integer), 6) as row_accuracy, sum(n)::bigint as n_chars, count(*) as n_rows from
    (select example_id, source, bool_and(guess is not distinct from label) as whole, avg((guess is not distinct from label)::integer) as ok, count(*) as n from l left join best using (before, letter) where split is distinct from 'train' group by all) group by source""".replace("round(avg(ok::integer), 6)", "round(sum(ok * n) / sum(n), 6)")
)
def batch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Labels of held-out rows by what a letter after its neighbour mostly stood for in training: accuracy by letter and by row."""
    rows = table(spark, d, "example").where((F.size("labels") == F.length("latin")) & (F.col("latin") != ""))
    letters = F.regexp_extract_all(F.lower("latin"), F.lit("(?s:.)"), 0)
    l = rows.select("example_id", "split", "source", F.inline(F.arrays_zip(F.col("labels").alias("label"), letters.alias("letter"), F.slice(F.concat(F.array(F.lit("")), letters), 1, F.size(letters)).alias("before"))))  # noqa: E741
    # letters and their neighbours: as few as an alphabet squared
    counts = l.where("split = 'train'").groupBy("before", "letter", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("before", "letter").agg(F.max_by("label", F.struct("n", "label")).alias("guess"))
    held = l.where(~F.col("split").eqNullSafe("train")).join(best, ["before", "letter"], "left")
    by_row = held.groupBy("example_id", "source").agg(F.count_if(F.col("guess") == F.col("label")).alias("right"), F.count("*").alias("n"))
    return by_row.groupBy("source").agg(F.round(F.sum("right") / F.sum("n"), 6).alias("char_accuracy"), F.round(F.avg((F.col("right") == F.col("n")).cast("int")), 6).alias("row_accuracy"), F.sum("n").alias("n_chars"), F.count("*").alias("n_rows"))


CODED_SQL = "list_transform(v, lambda x: greatest(-127, least(127, round_even(x / s, 0))) * s)"
DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


@query(
    f"""with w as (select label, c, list_max(list_transform(c, lambda x: abs(x))) / 127 as s from {CENTRES_SQL}), q as (select label, c, list_transform(c, lambda x: greatest(-127, least(127, round_even(x / s, 0))) * s) as k from w)
    select q.label, count(*) as n, round(max(abs({DOT_SQL.format(a='v', b='c')} - {DOT_SQL.format(a='v', b='k')})), 6) as worst, count(*) filter (where abs({DOT_SQL.format(a='v', b='c')} - {DOT_SQL.format(a='v', b='k')}) > 0.002) as n_over from {VECS_SQL} e, q group by q.label"""
)
def parity(spark: SparkSession, d: str) -> DataFrame:
    """Scores by weights and by their eight-bit codes: the worst difference of each output, and how many are over the tolerance."""
    rows = vecs(spark, d)
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 9).alias("m"))
    weights = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    weights = weights.select("label", "c", M.bound(M.row_scale(F.col("c"), 127), lambda s: F.transform("c", lambda x: s * F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x / s))))).alias("k"))
    # one row of a model's weights
    model = weights.agg(F.collect_list(F.struct("label", "c", "k")).alias("w"))
    gaps = rows.select("v").crossJoin(F.broadcast(model)).select(F.inline(F.transform("w", lambda w: F.struct(w["label"].alias("label"), F.abs(M.dot(F.col("v"), w["c"]) - M.dot(F.col("v"), w["k"])).alias("gap")))))
    return gaps.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("gap"), 6).alias("worst"), F.count_if(F.col("gap") > 0.002).alias("n_over"))


SWAPS = [("ص", "س"), ("ث", "س"), ("ط", "ت"), ("ذ", "ز"), ("ض", "ز"), ("ظ", "ز"), ("ق", "غ"), ("ح", "ه")]
_pairs = SWAPS + [(b, a) for a, b in SWAPS]


@query(
    f"""with w as {T.PERSIAN_WORDS_SQL}, s as (select * from {D.values_sql(_pairs, 'a, b')}), c as (select word, i, b, left(word, i - 1) || b || substr(word, i + 1) as output from (select word, unnest(generate_series(1, length(word))) as i from w), s where substr(word, i, 1) = a)
    select word, output from (select c.word, c.output, row_number() over (partition by c.word order by c.i, c.b) as k from c join w on w.word = c.output) where k = 1"""
)
def homophone_snap(spark: SparkSession, d: str) -> DataFrame:
    """Words that are another word with one homophone letter replaced: the first such place."""
    words = T.persian_words(spark, d).select("word")
    swaps = F.create_map(*(x for a in sorted({a for a, _ in _pairs}) for x in (F.lit(a), F.array(*(F.lit(b) for x_, b in sorted(_pairs) if x_ == a)))))
    places = F.flatten(F.transform(F.split("word", ""), lambda c, i: F.transform(F.coalesce(F.try_element_at(swaps, c), F.array().cast("array<string>")), lambda b: F.struct(i.alias("i"), b.alias("b")))))
    made = words.select("word", F.inline(places)).withColumn("output", F.concat(F.expr("left(word, i)"), "b", F.expr("substr(word, i + 2)")))
    return made.join(words.withColumnRenamed("word", "output"), "output", "left_semi").groupBy("word").agg(F.min(F.struct("i", "b", "output")).alias("x")).select("word", "x.output")


@query(
    f"""with t as (select (select min(vec_id) from embeddings) as own, (select list(m order by i) from (select i, round(avg(x), 9) as m from (select unnest(v) as x, unnest(range(len(v))) as i from {VECS_SQL}) group by i)) as mean),
    b as (select vec_id, case when vec_id = own then list_transform(list_zip(v, mean), lambda z: z[1] + 0.5 * (z[2] - z[1])) else v end as v from {VECS_SQL}, t)
    select a.vec_id = own as trained, count(*) as n_rows, count(*) filter (where a.v <> b.v) as n_changed, round(max(list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))), 6) as most from {VECS_SQL} a join b using (vec_id), t group by 1"""
)
def surgery_check(spark: SparkSession, d: str) -> DataFrame:
    """One row of weights trained, a step toward the mean of all, and the others frozen: which rows moved, and how far."""
    rows = vecs(spark, d)
    mean = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 9).alias("m"))
    task = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean")).crossJoin(rows.agg(F.min("vec_id").alias("own")))
    step = F.zip_with("v", "mean", lambda x, m: x + 0.5 * (m - x))
    after = rows.crossJoin(F.broadcast(task)).select("vec_id", "own", F.when(F.col("vec_id") == F.col("own"), step).otherwise(F.col("v")).alias("w"))
    both = rows.join(after, "vec_id")
    moved = F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b)))
    return both.groupBy((F.col("vec_id") == F.col("own")).alias("trained")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("v") != F.col("w")).alias("n_changed"), F.round(F.max(moved), 6).alias("most"))
