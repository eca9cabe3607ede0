"""Queries that measure: precision and recall, calibration, retrieval, roll-ups, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import measures
from quire.plans.registry import query, table

#: A plain score of quality in [0, 1]: the share of characters that are no marks, in hundredths; the predictions that are measured here.
_SCORE_SQL = "CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor(100.0 * length(regexp_replace(text, '[#*$%&|!<>]', '', 'g')) / length(text)) AS INTEGER) END"
_PRED = f"p AS (SELECT d.doc_id, lang, source, {_SCORE_SQL} AS score, quality FROM documents d JOIN labels USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, score, quality) of the labelled documents."""
    score = F.when(F.length("text") == 0, 0).otherwise(F.floor(F.lit(100.0) * F.length(F.regexp_replace("text", "[#*$%&|!<>]", "")) / F.length("text")).cast("int"))
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", score.alias("score"), "quality")


_PRF = "count(*) FILTER (score >= 99 AND quality = 1) AS tp, count(*) FILTER (score >= 99 AND quality = 0) AS fp, count(*) FILTER (score < 99 AND quality = 1) AS fn"
_RATIOS = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1"


@query(f"WITH {_PRED}, g AS (SELECT lang, {_PRF} FROM p GROUP BY lang) SELECT *, {_RATIOS} FROM g")
def g10_prf_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 by language."""
    return measures.prf(predictions(spark, sf_dir), F.col("score") >= 99, F.col("quality") == 1, "lang")


@query(f"WITH {_PRED}, g AS (SELECT lang, {_PRF} FROM p GROUP BY ROLLUP (lang)) SELECT coalesce(lang, 'all') AS lang, tp, fp, fn, {_RATIOS} FROM g")
def g12_micro_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts summed before ratios, by language and over all."""
    rolled = predictions(spark, sf_dir).rollup("lang").agg(*measures.confusion(F.col("score") >= 99, F.col("quality") == 1))
    return measures.ratios(rolled.withColumn("lang", F.coalesce("lang", F.lit("all"))))


@query(f"WITH {_PRED}, g AS (SELECT lang, {_PRF} FROM p GROUP BY lang), r AS (SELECT {_RATIOS} FROM g) SELECT round(avg(f1), 6) AS macro_f1, count(*) AS languages FROM r")
def g10_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of F1 over languages."""
    return g10_prf_by_language(spark, sf_dir).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("languages"))


@query(f"WITH {_PRED} SELECT least(9, score // 10) AS bin, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives, round(avg(score / 100.0), 6) AS mean_score, round(avg(CAST(quality AS DOUBLE)), 6) AS rate FROM p GROUP BY 1")
def g17_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal bins of the score with rates."""
    return measures.bins(predictions(spark, sf_dir))


@query(
    f"""WITH {_PRED}, b AS (SELECT CAST(least(9, score // 10) AS INTEGER) AS bin, sum(quality) AS p, count(*) AS n FROM p GROUP BY 1), m AS (SELECT j.bin AS j, k.bin AS k, (SELECT sum(p) / CAST(sum(n) AS DOUBLE) FROM b WHERE bin BETWEEN j.bin AND k.bin) AS mean FROM b j JOIN b k ON j.bin <= k.bin)
    SELECT i.bin, max(low) AS rate FROM b i JOIN (SELECT x.bin, m.j, min(mean) AS low FROM b x JOIN m ON m.j <= x.bin AND m.k >= x.bin GROUP BY x.bin, m.j) l ON l.bin = i.bin GROUP BY i.bin"""
)
def g17_calibrated_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the ten bins pooled to non-decreasing ones."""
    rows = predictions(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("score") / 10)).cast("int").alias("bin")).agg(F.sum("quality").alias("positives"), F.count("*").alias("n"))
    return measures.pooled_bins(rows)


@query(f"WITH {_PRED}, c AS (SELECT score, count(*) AS n, sum(quality) AS tp FROM p GROUP BY score), w AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS kept, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(n) OVER () AS total FROM c) SELECT score AS threshold, CAST(kept AS BIGINT) AS kept, tp / CAST(kept AS DOUBLE) AS precision, kept / CAST(total AS DOUBLE) AS coverage FROM w")
def w14_precision_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and coverage at each distinct threshold; only the at most 101 distinct scores meet in one task."""
    return measures.curve(predictions(spark, sf_dir))


@query(
    f"""WITH {_PRED}, c AS (SELECT score, count(*) AS n, sum(quality) AS tp FROM p GROUP BY score),
    w AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS kept, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(tp) OVER () AS all_tp FROM c)
    SELECT max(score) AS accept, CAST(max(score) - 10 AS INTEGER) AS review FROM (SELECT score, tp / CAST(all_tp AS DOUBLE) AS recall, max(tp / CAST(all_tp AS DOUBLE)) OVER () AS best FROM w WHERE tp / CAST(kept AS DOUBLE) >= 0.9) WHERE recall = best"""
)
def g18_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the best recall at a precision of 0.9 or more."""
    c = measures.curve(predictions(spark, sf_dir)).where("precision >= 0.9").withColumn("recall", F.col("precision") * F.col("kept"))
    best = c.agg(F.max(F.struct(F.round("recall", 6), "threshold")).alias("b"))
    return best.select(F.col("b.threshold").alias("accept"), (F.col("b.threshold") - 10).cast("int").alias("review"))


@query(f"WITH {_PRED}, s AS (SELECT *, least(9, score // 10) AS bin FROM p), b AS (SELECT bin, count(*) AS n, avg(score / 100.0) AS conf, avg(CAST(quality AS DOUBLE)) AS acc FROM s GROUP BY bin) SELECT round((SELECT avg(pow(score / 100.0 - quality, 2)) FROM p), 6) AS brier, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b")
def g17_brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and expected calibration error, from sums by bin."""
    rows = predictions(spark, sf_dir).withColumns({"c": F.col("score") / 100.0, "bin": F.least(F.lit(9), F.floor(F.col("score") / 10))})
    by = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("conf"), F.avg(F.col("quality").cast("double")).alias("acc"), F.sum(F.pow(F.col("c") - F.col("quality"), 2)).alias("sq"))
    return by.agg(F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"))


#: The first user turn of a conversation asks; its answers are the chunks, and the turn right after it is the gold.
_RETRIEVAL = r"""a AS (SELECT conv_id, turn AS asked, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
h AS (SELECT a.*, array_to_string(regexp_extract_all(a.text, '[\x{4e00}-\x{9fff}]'), '') AS cjk, (SELECT min(regexp_extract(g.text, '[A-Za-z]{4,}')) FROM conversations g WHERE g.conv_id = a.conv_id AND g.turn = a.asked + 1) AS word FROM a),
q AS (SELECT conv_id, asked, word, list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), list_concat(list_transform(range(length(cjk) - 1), lambda i: substr(cjk, i + 1, 2)), list_transform(range(length(cjk) - 2), lambda i: substr(cjk, i + 1, 3)), list_transform(range(length(cjk) - 3), lambda i: substr(cjk, i + 1, 4)))) AS terms FROM h),
e AS (SELECT c.conv_id, c.turn, asked, word, terms, lower(concat_ws(chr(10), text, role)) AS low FROM conversations c JOIN q USING (conv_id) WHERE c.turn <> asked),
s AS (SELECT conv_id, turn, asked, coalesce(list_sum(list_transform(terms, lambda w: (length(low) - length(replace(low, w, ''))) // length(w))), 0) + CASE WHEN word <> '' AND contains(low, lower(word)) THEN 25 ELSE 0 END AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(score, 0) DESC, turn) AS rank FROM s)"""


@query(f"WITH {_RETRIEVAL} SELECT conv_id, turn, CAST(coalesce(score, 0) AS BIGINT) AS score, rank FROM r")
def w11_retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns ranked for their conversation's first question by counts of all its terms, and what it expects."""
    return measures.retrieval(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "score", "rank")


@query(f"WITH {_RETRIEVAL}, g AS (SELECT conv_id, min(rank) FILTER (turn = asked + 1) AS place FROM r GROUP BY conv_id) SELECT count(*) AS queries, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN place IS NULL THEN 0.0 ELSE 1.0 / place END), 6) AS mrr, round(avg(CASE WHEN place <= 5 THEN 1.0 / log2(place + 1) ELSE 0.0 END), 6) AS ndcg_5 FROM g")
def g13_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at k, mean reciprocal rank and nDCG of the turn after the question."""
    place = measures.retrieval(table(spark, sf_dir, "conversations")).groupBy("conv_id").agg(F.min(F.when(F.col("turn") == F.col("asked") + 1, F.col("rank"))).alias("place"))
    p = F.col("place")
    hit = lambda k: F.round(F.avg(F.when(p <= k, 1.0).otherwise(0.0)), 6)
    return place.agg(F.count("*").alias("queries"), hit(1).alias("recall_1"), hit(3).alias("recall_3"), hit(5).alias("recall_5"), F.round(F.avg(F.when(p.isNull(), 0.0).otherwise(1.0 / p)), 6).alias("mrr"), F.round(F.avg(F.when(p <= 5, 1.0 / F.log2(p + 1)).otherwise(0.0)), 6).alias("ndcg_5"))


@query("WITH w AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(lower(p_type) || ' widget', ' ')) AS b FROM part) SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END AS jaccard FROM w")
def g16_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two label sets; 1.0 if both are empty."""
    a, b = F.split("p_name", " "), F.split(F.concat(F.lower("p_type"), F.lit(" widget")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", measures.jaccard(a, b).alias("jaccard"))


@query("WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS predicted, ['red', 'small', 'widget'] AS gold FROM part), g AS (SELECT sum(len(list_intersect(predicted, gold))) AS tp, sum(len(list_filter(predicted, lambda x: NOT list_contains(gold, x)))) AS fp, sum(len(list_filter(gold, lambda x: NOT list_contains(predicted, x)))) AS fn FROM t) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall FROM g")
def g15_tag_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags against gold tags."""
    got, gold = F.array_distinct(F.split("p_name", " ")), F.array(*map(F.lit, ("red", "small", "widget")))
    sums = table(spark, sf_dir, "part").agg(F.sum(F.size(F.array_intersect(got, gold))).alias("tp"), F.sum(F.size(F.array_except(got, gold))).alias("fp"), F.sum(F.size(F.array_except(gold, got))).alias("fn"))
    return sums.select("*", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


@query("SELECT event_type AS metric, arg_max(value, event_id) AS latest, CASE WHEN arg_max(value, event_id) >= 10 THEN 'pass' ELSE 'fail' END AS gate, count(*) AS runs FROM events GROUP BY event_type")
def g28_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each metric against its gate."""
    last = F.max_by("value", "event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(last.alias("latest"), F.when(last >= 10, "pass").otherwise("fail").alias("gate"), F.count("*").alias("runs"))


@query(f"WITH {_PRED} SELECT source, lang, count(*) FILTER (score < 99 AND quality = 1) AS missed, count(*) FILTER (score >= 99 AND quality = 0) AS wrong, 2 * count(*) FILTER (score < 99 AND quality = 1) + count(*) FILTER (score >= 99 AND quality = 0) AS gain, row_number() OVER (ORDER BY 2 * count(*) FILTER (score < 99 AND quality = 1) + count(*) FILTER (score >= 99 AND quality = 0) DESC, source, lang) AS rank FROM p GROUP BY source, lang QUALIFY rank <= 20")
def g19_gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty groups with most to gain (a top-k report)."""
    wrong = predictions(spark, sf_dir).groupBy("source", "lang").agg(F.count_if((F.col("score") < 99) & (F.col("quality") == 1)).alias("missed"), F.count_if((F.col("score") >= 99) & (F.col("quality") == 0)).alias("wrong"))
    top = wrong.withColumn("gain", 2 * F.col("missed") + F.col("wrong")).orderBy(F.desc("gain"), "source", "lang").limit(20)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("gain"), "source", "lang")))
