"""Measures of predictions, scores and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as t


def confusion(predicted: Column, gold: Column) -> list[Column]:
    return [F.count_if(predicted & gold).alias("tp"), F.count_if(predicted & ~gold).alias("fp"), F.count_if(~predicted & gold).alias("fn")]


def ratios(counts: DataFrame) -> DataFrame:
    """counts(tp, fp, fn) with precision, recall and f1; 0.0 where a ratio has no base."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": t.safe_ratio(tp, tp + fp), "recall": t.safe_ratio(tp, tp + fn), "f1": t.safe_ratio(2.0 * tp, 2 * tp + fp + fn)})


def prf(rows: DataFrame, predicted: Column, gold: Column, *by: str) -> DataFrame:
    return ratios(rows.groupBy(*by).agg(*confusion(predicted, gold)))


def bins(rows: DataFrame) -> DataFrame:
    """Ten equal bins of rows(score in hundredths, quality)."""
    bin_ = F.least(F.lit(9), F.floor(F.col("score") / 10)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("positives"), F.round(F.avg(F.col("score") / 100.0), 6).alias("mean_score"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("rate"))


def curve(rows: DataFrame) -> DataFrame:
    """(threshold, kept, precision, coverage) at each distinct score, from the highest down."""
    counts = rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("quality").alias("tp"))
    down = W.orderBy(F.desc("score"))
    all_ = W.partitionBy()
    summed = counts.withColumns({"kept": F.sum("n").over(down), "hits": F.sum("tp").over(down), "total": F.sum("n").over(all_)})
    return summed.select(F.col("score").alias("threshold"), "kept", (F.col("hits") / F.col("kept")).alias("precision"), (F.col("kept") / F.col("total")).alias("coverage"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.array_union(a, b)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(union))


def retrieval_terms(c: Column) -> Column:
    """All terms of a question, repeats included: runs of Latin letters and digits, and every run of 2 to 4 of its CJK characters put together."""
    cjk = F.array_join(F.regexp_extract_all(c, F.lit(f"({t.CJK})"), F.lit(1)), "")
    grams = F.flatten(F.transform(F.array(cjk), lambda x: t.substring_grams(x)))  # bound once, not once a gram
    return F.concat(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), grams)


def retrieval_score(terms: Column, searchable: Column, expected: Column) -> Column:
    """How often the terms occur in a lower-case text, each without overlaps, and 25 for each expected term that it holds."""
    count = lambda s, w: F.floor((F.length(s) - F.length(F.replace(s, w, F.lit("")))) / F.length(w)).cast("long")
    found = F.transform(F.array(searchable), lambda s: F.aggregate(terms, F.lit(0).cast("long"), lambda a, w: a + count(s, w)) + 25 * F.size(F.filter(expected, lambda w: F.contains(s, F.lower(w)))).cast("long"))
    return found[0]


def retrieval(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, asked, score, rank): the other turns of each conversation ranked for its first user turn; what it expects is the first word of four letters or more of the turn after it.

    A turn is searched by its text and its role. Conversations without a user turn have no rows; equal scores stand in order of turns.
    """
    asks = turns.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("asked"), F.min_by("text", "turn").alias("text"))
    gold = turns.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("word")).groupBy("_c", "_t").agg(F.min("word").alias("word"))
    asks = asks.join(gold, (F.col("conv_id") == F.col("_c")) & (F.col("asked") + 1 == F.col("_t")), "left")
    asks = asks.select("conv_id", "asked", retrieval_terms(F.coalesce("text", F.lit(""))).alias("terms"), F.filter(F.array(F.coalesce("word", F.lit(""))), lambda w: w != "").alias("expected"))
    searchable = F.lower(F.concat_ws("\n", "text", "role"))
    scored = turns.join(asks, "conv_id").where("turn <> asked").select("conv_id", "turn", "asked", retrieval_score(F.col("terms"), searchable, F.col("expected")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "turn")))


def split_checks(ids: DataFrame, splits: DataFrame) -> DataFrame:
    """(overlap, uncovered): how many ids(doc_id) stand in several of splits(doc_id, split), and in none. Sets of ids meet by id; repeated rows count once."""
    held = splits.groupBy("doc_id").agg(F.count_distinct("split").alias("n"))
    return ids.select("doc_id").distinct().join(held, "doc_id", "left").agg(F.count_if(F.col("n") > 1).alias("overlap"), F.count_if(F.col("n").isNull()).alias("uncovered"))


def pooled_bins(bins: DataFrame) -> DataFrame:
    """(bin, rate): non-decreasing rates of bins(bin, positives, n): each is the greatest, over starts at or before it, of the least mean to any end at or after it. A few bins meet in one row."""
    held = F.array_sort(F.collect_list(F.struct("bin", "positives", "n")))
    mean = lambda b, j, k: F.aggregate(F.slice(b, j + 1, k - j + 1), F.lit(0.0), lambda a, x: a + x["positives"]) / F.aggregate(F.slice(b, j + 1, k - j + 1), F.lit(0.0), lambda a, x: a + x["n"])
    least = lambda b, j, i: F.array_min(F.transform(F.sequence(i, F.size(b) - 1), lambda k: mean(b, j, k)))
    rates = F.transform("b", lambda x, i: F.struct(x["bin"].alias("bin"), F.array_max(F.transform(F.sequence(F.lit(0), i), lambda j: least(F.col("b"), j, i))).alias("rate")))
    return bins.where("n > 0").agg(held.alias("b")).select(F.explode(rates).alias("x")).select("x.bin", "x.rate")
