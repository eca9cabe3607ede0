"""Which values stand in which texts, either way round, by an index of grams: candidates by a value's rarest gram, then verified."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import released, written

#: Lengths from which a value is looked up by the least hashes of its stretches of that length; shorter values by all of their length.
TIERS = (8, 16, 32)
GRAM = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a filter of keys at most (8 MB, sent to every task) and bits for a key. A filter that is too full lets more keys pass; no result depends on it.
MOST_BITS, BITS_A_KEY = 1 << 26, 16


def normalized(text: str | None) -> str:
    """Compatibility form, case folded, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").casefold() if c.isalnum())


def tier(n: int) -> int:
    """The tier of a text of n characters."""
    return max((t for t in TIERS if t <= n), default=n)


def grams(text: str, at: int) -> np.ndarray:
    """Distinct hashes of a text by tier: of all stretches of a short tier, or the least gram of each stretch of a long one. A text that holds another of the tier has all of its hashes."""
    size = at if at < TIERS[0] else GRAM
    if len(text) < at:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashes = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        hashes = (hashes ^ codes[k : k + len(hashes)]) * _MIX
        hashes ^= hashes >> np.uint64(29)
    if at >= TIERS[0]:
        reach, width = at - size + 1, 1
        while 2 * width <= reach:
            hashes, width = np.minimum(hashes[:-width], hashes[width:]), 2 * width
        hashes = np.minimum(hashes[: len(hashes) - reach + width], hashes[reach - width :])
    return np.unique(hashes).view(np.int64)


def _places(tiers: np.ndarray, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each (tier, key) in a filter of that many bits, a power of two."""
    mixed = (keys.view(np.uint64) + tiers.astype(np.uint64)) * _MIX
    mixed ^= mixed >> np.uint64(32)
    return mixed & np.uint64(bits - 1), (mixed * _MIX >> np.uint64(20)) & np.uint64(bits - 1)


def _filter(keyed: DataFrame) -> np.ndarray:
    """A Bloom filter of rows(id, tier, key), made in tasks and put together by words in Spark: what reaches the driver is MOST_BITS at most."""
    n = keyed.count()
    bits = max(1 << 10, min(MOST_BITS, 1 << (BITS_A_KEY * max(n, 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            for place in _places(np.asarray(batch.column(0)), np.asarray(batch.column(1)), bits):
                own[place] = True
        words = np.packbits(own).view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["at", "word"])

    words = np.zeros(bits // 64, np.int64)
    found = keyed.select("tier", "key").mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return words.view(np.uint8)


def _passes(seen: np.ndarray, tiers: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter may hold; those it does hold always pass."""
    one, two = _places(tiers, keys, 8 * len(seen))
    bit = lambda at: seen[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1
    return (bit(one) & bit(two)).astype(bool)


def _keyed(rows: DataFrame, tiers: list[int] | None, seen: Broadcast | None = None, whole: bool = False) -> DataFrame:
    """(id, tier, key) of rows(id, norm): each text by its own tier, or by all of `tiers`.

    With a filter `seen`, only keys that pass it; with `whole` too, none of a text that has a key which does not.
    """
    ids = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                for t in tiers if tiers is not None else [tier(len(text))]:
                    key = grams(text, t) if text else np.empty(0, np.int64)
                    if seen is not None and len(key):
                        fine = _passes(seen.value, np.full(len(key), t, np.int32), key)
                        key = key[fine] if not whole or fine.all() else key[:0]
                    if len(key):
                        held.append((k, t, key))
                        size += len(key)
                if held and (size > 1 << 18 or k == batch.num_rows - 1):
                    n = [len(key) for _, _, key in held]
                    which, tier_of = (np.repeat([x[j] for x in held], n) for j in (0, 1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(tier_of.astype(np.int32)), pa.array(np.concatenate([x[2] for x in held]))], names=["id", "tier", "key"])
                    held, size = [], 0

    return rows.select("id", "norm").mapInArrow(run, f"id {ids}, tier int, key bigint")


def _inside(values: DataFrame, texts: DataFrame, few: str) -> DataFrame:
    """(value_id, text_id): values(id, norm) that stand in texts(id, norm); few: which of both has fewer characters, `values` or `texts`.

    Each value is looked up by the one of its keys that the fewest texts hold, so a gram that most texts hold makes candidates only for values that have no other.
    The smaller side's keys are written first; a filter of them keeps the other side's keys that cannot meet them from being written and exchanged at all.
    """
    tiers = sorted(r["t"] for r in values.where("norm <> ''").select(F.when(F.length("norm") >= TIERS[0], F.array_max(F.filter(F.array(*map(F.lit, TIERS)), lambda t: t <= F.length("norm")))).otherwise(F.length("norm")).alias("t")).distinct().collect())  # TIERS and shorter lengths at most
    if not tiers:
        return values.select(F.col("id").alias("value_id")).join(texts.select(F.col("id").alias("text_id")), F.lit(False))
    send = values.sparkSession.sparkContext.broadcast
    if few == "values":
        wanted = written(_keyed(values, None))
        held = written(_keyed(texts, tiers, send(_filter(wanted))))
    else:
        held = written(_keyed(texts, tiers))
        wanted = written(_keyed(values, None, send(_filter(held)), whole=True))
    known = held.join(wanted.select("tier", "key").distinct(), ["tier", "key"], "left_semi").groupBy("tier", "key").agg(F.count("*").alias("n"))
    rated = wanted.join(known, ["tier", "key"], "left").groupBy(F.col("id").alias("value_id"), "tier").agg(F.min(F.struct("n", "key")).alias("least"), F.count_if(F.col("n").isNull()).alias("unknown"))
    rarest = rated.where("unknown = 0").select("value_id", "tier", F.col("least.key").alias("key"))
    pairs = rarest.join(held.select(F.col("id").alias("text_id"), "tier", "key"), ["tier", "key"]).select("value_id", "text_id")
    both = pairs.join(values.select(F.col("id").alias("value_id"), F.col("norm").alias("v")), "value_id").join(texts.select(F.col("id").alias("text_id"), F.col("norm").alias("t")), "text_id")
    found = written(both.where(F.contains("t", F.col("v"))).select("value_id", "text_id"))
    released(wanted, held)
    return found


def leaks(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(value_id, text_id, way): pairs of values(id, text) and texts(id, text) of which one holds the other once both are normalised; way is `value_in_text`, `text_in_value` or `equal`.

    Texts without a letter or digit, and nulls, leak nothing. Ids are taken to be distinct; a null id takes no part.
    """

    def shaped(rows: DataFrame) -> DataFrame:
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalized(x) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "norm"])

        return written(rows.where("id is not null").select("id", "text").mapInArrow(run, f"id {kind}, norm string"))

    a, b = shaped(values), shaped(texts)
    n, m = (x.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()[0] for x in (a, b))
    on = _inside(a, b, "values" if n <= m else "texts").withColumn("on", F.lit(True))
    back = _inside(b, a, "texts" if n <= m else "values").select(F.col("text_id").alias("value_id"), F.col("value_id").alias("text_id")).withColumn("back", F.lit(True))
    every = on.join(back, ["value_id", "text_id"], "full")
    return every.select("value_id", "text_id", F.when(F.col("on") & F.col("back"), "equal").when(F.col("on"), "value_in_text").otherwise("text_in_value").alias("way"))
