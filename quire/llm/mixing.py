"""Mixing sources to target weights along a time-varying curriculum.

Targets share the whole number of words by weight, capped at a multiple of what a source has. Within a source, documents stand in hashed
order, epoch after epoch; the words up to the target are taken. Each source's weight is a schedule over training time [0, 1]; its
integral, scaled to the target, is the source's cumulative demand, and the inverse of that demand gives each document its position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SPACE, carried, restored, written

#: Fixed weights, repeated over the sources in code point order.
WEIGHTS = (1.0, 2.0, 3.0)
#: Relative weight at the start and at the end of training of each of those; linear between. Its integral is rescaled to the target.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Documents in a bucket of one source, about, and buckets in a group: buckets, and groups of them, are what is ordered and summed in one task.
BUCKET_ROWS, GROUP = 2_000, 1_024


def word_count(text: Column) -> Column:
    """Words of a text as BIGINT; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, SPACE), ""))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, place, weight, target) from sizes(source, source_size), one row a source.

    Sources are placed by code point with null last; weights repeat along them. A target stops at `most` times its source's size; what is
    above is reshared among the others by weight, until none is above. Sources are sorted in ranges and numbered within each, whatever their
    number; only sums and the ranges' sizes come to the driver.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranged = written(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    ranges = sorted((r["p"], r["count"]) for r in ranged.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
    before = {p: sum(n for q, n in ranges if q < p) for p, _ in ranges}
    offset = F.create_map(*[F.lit(x) for p in before.items() for x in p])[F.shiftright("at", 33)] if before else F.lit(0)
    place = (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + offset + 1).cast("long")
    rows = written(ranged.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("at"))
    cap = F.col("source_size") * F.lit(float(most))
    whole = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words for a unit of weight
    while True:
        capped = F.col("weight") * F.lit(level) >= cap
        got, free = rows.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        rise = (whole - (got or 0.0)) / free if free else level
        if rise <= level:
            break
        level = rise
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def _position(share: Column, start: Column, end: Column) -> Column:
    """Time t at which the integral of a line from start to end, rescaled to 1 at t = 1, reaches the share."""
    slope, area = (end - start) / 2, (start + end) / 2
    return F.when(F.abs(slope) < 1e-12, share).otherwise((-start + F.sqrt(start * start + 4 * slope * share * area)) / (2 * slope))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[tuple[float, float], ...] = RAMPS, most: float = 3.0, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies, positions), a row for each row of docs.

    taken: words the mix takes, over all epochs; the last document of a source is taken in part, so a source's taken words are its
    target rounded down. copies: the same in whole documents, each epoch rounded to the nearer (a document without words counts as taken
    while its place lies before the target). positions: a training position in [0, 1] for each epoch in which words are taken. Order
    within a source is by the MD5 of doc_id as text, so reruns agree; repeated rows follow each other and each count. Null sources form one
    source, null texts have no words, an empty table gives an empty result. A bucket of a source holds about BUCKET_ROWS rows, where ids differ: rows of one id, and those without, share a bucket.
    Other columns play no part, whatever their names.
    """
    sized = written(_sized(docs.select("doc_id", "source", "text"), size).drop("text"))
    return _mixed(sized, sized, docs.count(), weights, ramps, most).drop("_tie")


def _sized(docs: DataFrame, size: Callable[[Column], Column]) -> DataFrame:
    """docs with size, _order and _tie."""
    return docs.withColumns({"size": size(F.col("text")), "_order": F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")), "_tie": F.xxhash64("text")})


def _mixed(sized: DataFrame, again: DataFrame, count: int, weights: tuple[float, ...], ramps: tuple[tuple[float, float], ...], most: float) -> DataFrame:
    """The plan of mix() beside the columns of `again`; `sized` has the same rows, without texts."""
    buckets = max(1, -(-count // BUCKET_ROWS))
    bucket = F.shiftright(F.coalesce(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long"), F.lit(0)) * buckets, 32)  # rises with the order
    totals = written(sized.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum")))
    planned = targets(totals.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most)
    ramp = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in ramps]), ((F.col("place") - 1) % len(ramps) + 1).cast("int"))
    planned = planned.withColumns({"_start": ramp[0], "_end": ramp[1]})
    group = F.expr(f"_bucket div {GROUP}")
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    groups = totals.groupBy("source", group.alias("_group")).agg(F.sum("_sum").alias("_all")).withColumn("_ahead", F.coalesce(F.sum("_all").over(before("source").orderBy("_group")), F.lit(0)))
    groups = groups.select(F.col("source").alias("_gs"), F.col("_group").alias("_g"), "_ahead")
    inner = totals.withColumn("_group", group).withColumn("_offset", F.coalesce(F.sum("_sum").over(before("source", "_group").orderBy("_bucket")), F.lit(0)))
    starts = inner.join(groups, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_g"))).select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), (F.col("_offset") + F.col("_ahead")).alias("_offset"))
    begun = again.withColumn("_bucket", bucket).withColumn("_in", F.coalesce(F.sum("size").over(before("source", "_bucket").orderBy("_order", "doc_id", "size", "_tie")), F.lit(0)))
    begun = begun.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_at", F.col("_in") + F.col("_offset"))
    plan = planned.select(F.col("source").alias("_p"), "source_size", "target", "_start", "_end")
    rows = begun.select(*again.columns, "_at").join(plan, F.col("source").eqNullSafe(F.col("_p")))
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("int"))
    whole = F.floor("target")
    first = lambda e: e * F.col("source_size") + F.col("_at")
    takes = F.transform(epochs, lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - first(e))))
    begins = F.filter(epochs, lambda e: F.when(F.col("size") > 0, first(e) < whole).otherwise(first(e) <= whole))
    share = lambda e: F.least(F.lit(1.0), first(e) / F.greatest(F.col("target"), F.lit(1.0)))
    copies = F.when(F.col("size") == 0, F.least(F.size(begins), F.lit(1))).otherwise(F.size(F.filter("_takes", lambda t: 2 * t >= F.col("size"))))
    return rows.withColumn("_takes", takes).select(
        *[c for c in again.columns if c != "_order"], "source_size", "target",
        F.aggregate("_takes", F.lit(0).cast("long"), lambda a, t: a + t).alias("taken"),
        copies.cast("int").alias("copies"),
        F.transform(begins, lambda e: _position(share(e), F.col("_start"), F.col("_end"))).alias("positions"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, ramps: tuple[tuple[float, float], ...] = RAMPS, most: float = 3.0, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """The documents that the mix takes, whole, a row for each copy, sorted over all partitions by training position; columns of docs.

    Each row has a plan of its own, which travels with its text, so repeated rows are taken as often as mix() says of each.
    """
    own = ("doc_id", "source", "text")
    narrow = _sized(docs.select(*own), size).drop("text")
    plan = _mixed(narrow, _sized(carried(docs, *own), size), docs.count(), weights, ramps, most)
    order = ["position", F.xxhash64("doc_id"), "_tie"]
    taken = plan.where("copies > 0").select(*own, "rest", "_tie", F.explode(F.slice("positions", 1, F.col("copies"))).alias("position"))
    return restored(taken.repartitionByRange(*order).sortWithinPartitions(*order), docs, own)
