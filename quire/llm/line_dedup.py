"""Line deduplication by pairwise alignment of documents that share lines.

Lines are hashed, and windows of neighbouring lines that just reach the words of a block; each window shared by several documents links its
later holders to the first holder (one link a holder, so a passage that a third of all documents hold costs one row a document, never all
pairs). A common run of enough words holds, for each of its lines, a window around that line, so links lose no run. Each linked pair is
aligned with patience diff over the whole documents; common blocks of enough words are deleted from the later document, and what is left is aligned again until
no such block comes up. A shared window that all these alignments leave standing, because its lines stand elsewhere or were parted by a deletion, is an
anchor: the stretch around it that both documents hold is aligned by itself and deleted too. The first holder of a line keeps it, so no line is lost everywhere. A first holder meets its later ones in
batches, so that its lines travel once a batch and not once a pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried, raw_texts, restored, small_batches, written


#: Odd, so that its powers have inverses modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def window_ranges(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and past-last line of a text's shortest ranges of lines that hold `least` words, from each line on and back from each line."""
    n = len(lines)
    until = np.r_[0, np.cumsum(words)]
    on, back = np.searchsorted(until, until[:-1] + least), np.searchsorted(until, until[1:] - least, "right") - 1
    low = np.r_[np.arange(n)[on <= n], back[back >= 0]]
    high = np.r_[on[on <= n], np.arange(1, n + 1)[back >= 0]]
    if not len(low):
        return np.empty(0, np.int64), low, high
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum(lines.astype(np.uint64) * power[:n])]
    return ((sums[high] - sums[low]) * inverse[low]).view(np.int64), low, high


def windows(lines: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Distinct hashes of window_ranges."""
    return np.unique(window_ranges(lines, words, least)[0])


def _lines(docs: DataFrame, block_words: int) -> DataFrame:
    """(doc_id, _text, lines ARRAY<BIGINT>, words ARRAY<INT>, windows ARRAY<BIGINT>): hash and number of words of each line of each text, its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [x.split(b"\n") for x in raw_texts(batch.column(1))]
            hashes = [np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64) for lines in split]
            words = [np.array([len(x.split()) for x in lines], np.int64) for lines in split]
            found = [windows(*x, block_words) for x in zip(hashes, words, strict=True)]
            columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array([x.astype(np.int32) for x in words], pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "_text", "lines", "words", "windows"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(run, f"doc_id {ids}, _text bigint, lines array<bigint>, words array<int>, windows array<bigint>")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second parts increase."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    found, k = [], at[-1] if at else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def _numbered(a: Sequence[int], lo: int, hi: int, b: Sequence[int], low: int, high: int) -> list[tuple[int, int]]:
    """(i, j) of the k-th place of a line in a[lo:hi] and its k-th place in b[low:high], by i."""
    places: dict[int, list[int]] = {}
    for j in range(high - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    return [(i, places[a[i]].pop()) for i in range(lo, hi) if places.get(a[i])]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines: equal ends first, then lines that are unique on both sides, then between these.

    Where no line is unique on both sides, equal lines are anchors by their number: the first of one side with the first of the other, and so on.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            found.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            found.append((hi, high))
        if lo >= hi or low >= high:
            continue
        here, there = Counter(a[lo:hi]), Counter(b[low:high])
        where = {x: j for j, x in enumerate(b[low:high], low) if there[x] == 1}
        anchors = _increasing([(i, where[x]) for i, x in enumerate(a[lo:hi], lo) if here[x] == 1 and x in where])
        if not anchors:
            anchors = _increasing(_numbered(a, lo, hi, b, low, high))
            if not anchors:
                continue
        found += anchors
        for (i, j), (i2, j2) in zip([(lo - 1, low - 1), *anchors], [*anchors, (hi, high)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(found)


class Anchors:
    """Where the windows of a document stand, by hash and number of lines, each at its first place."""

    def __init__(self, lines: Sequence[int], words: Sequence[int], least: int):
        self.lines, self.least = lines, least
        found, low, high = window_ranges(np.array(lines, np.int64), np.array(words, np.int64), least)
        self.at = {(h, j - i): i for h, i, j in zip(found[::-1].tolist(), low[::-1].tolist(), high[::-1].tolist(), strict=True)}


def _blocks(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of the second side in which aligned pairs go on line by line on both."""
    out: list[list[int]] = []
    for i, j in pairs:
        if out and out[-1][1:] == [i, j]:
            out[-1][1:] = [i + 1, j + 1]
        else:
            out.append([j, i + 1, j + 1])
    return [(low, high) for low, _, high in out]


def shared_blocks(anchors: Anchors, b: Sequence[int], words: Sequence[int]) -> list[tuple[int, int]]:
    """Ranges [from, to) of b's lines that stand unbroken in the first document too, in runs that hold enough words: all such lines of b.

    Whole alignments first, each over what the last one left; then, for each window of b that still stands and that the first document holds, an
    alignment of the longest stretch around it that both hold.
    """
    a, least = anchors.lines, anchors.least
    until, gone, left = [0, *accumulate(words)], [False] * len(b), list(b)

    def deleted(pairs: list[tuple[int, int]]) -> bool:
        some = False
        for low, high in _blocks(pairs):
            if until[high] - until[low] >= least and not all(gone[low:high]):
                some = True
                for j in range(low, high):
                    gone[j], left[j] = True, (1 << 64) + j  # equal to no line of any document
        return some

    while deleted(patience(a, left)):
        pass
    found, lows, highs = window_ranges(np.array(b, np.int64), np.array(words, np.int64), least)
    for h, low, high in zip(found.tolist(), lows.tolist(), highs.tolist(), strict=True):
        i = anchors.at.get((h, high - low))
        if i is not None and not all(gone[low:high]):
            end = i + high - low
            if list(a[i:end]) != list(b[low:high]):
                continue
            while i > 0 and low > 0 and a[i - 1] == b[low - 1]:
                i, low = i - 1, low - 1
            while end < len(a) and high < len(b) and a[end] == b[high]:
                end, high = end + 1, high + 1
            deleted([(i + x, low + y) for x, y in patience(a[i:end], b[low:high])])
    edges = [j for j, (x, y) in enumerate(zip([False, *gone], [*gone, False], strict=True)) if x != y]
    return list(zip(edges[::2], edges[1::2], strict=True))


def _united(ranges: list[dict]) -> list[dict]:
    """Maximal ranges that these cover, in order."""
    out: list[dict] = []
    for x in sorted(ranges, key=lambda r: r["from"]):
        if out and x["from"] <= out[-1]["to"]:
            out[-1]["to"] = max(out[-1]["to"], x["to"])
        else:
            out.append({"from": x["from"], "to": x["to"]})
    return out


def repeated_blocks(docs: DataFrame, block_words: int = 30, batch_pairs: int = 4096) -> DataFrame:
    """(doc_id, _text, ranges): for each document that loses lines, the maximal line ranges that earlier documents hold, in order. _text is xxhash64 of its text.

    A first holder's pairs are dealt over as many batches as all pairs fill with batch_pairs each.
    """
    small_batches(docs.sparkSession)
    lines = written(_lines(docs, block_words).dropDuplicates(["doc_id", "_text"]))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")
    seeds = lines.select(row.alias("row"), F.explode("windows").alias("window"))
    # written, so that the join deals both its sides itself and can split a window that very many documents hold
    held = written(seeds.groupBy("window").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first <> last").select(F.col("window").alias("_window"), "first"))
    pairs = written(seeds.join(held, F.col("window") == F.col("_window")).where("row <> first").select("row", "first").distinct())
    n = max(1, -(-pairs.count() // batch_pairs))
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    sides = lines.select(row.alias("of"), "lines", "words")
    firsts = pairs.select("first", "part").distinct().join(sides, F.col("first") == F.col("of")).select("first", "part", F.lit(0).alias("kind"), F.lit(None).cast(sides.schema["of"].dataType).alias("row"), "lines", "words")
    later = pairs.join(sides, F.col("row") == F.col("of")).select("first", "part", F.lit(1).alias("kind"), "row", "lines", "words")
    both = firsts.unionByName(later).repartition("first", "part").sortWithinPartitions("first", "part", "kind").select("kind", "row.doc_id", "row._text", "lines", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        anchors = Anchors([], [], block_words)
        for batch in batches:
            keep, found = [], []
            for i, (what, lines, words) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if what == 0:
                    anchors = Anchors(lines, words, block_words)
                    continue
                blocks = shared_blocks(anchors, lines, words)
                if blocks:
                    keep.append(i)
                    found.append([{"from": i, "to": j} for i, j in blocks])
            own = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), pa.array(found, kind)], names=["doc_id", "_text", "ranges"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    found = both.mapInArrow(run, f"doc_id {ids}, _text bigint, ranges array<struct<from:int,to:int>>")
    # one row a pair, and a document has no more pairs than windows, two a line at most
    every = found.groupBy("doc_id", "_text").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_united(x) for x in batch.column(2).to_pylist()], batch.column(2).type)], names=["doc_id", "_text", "ranges"])

    return every.mapInArrow(unite, f"doc_id {ids}, _text bigint, ranges array<struct<from:int,to:int>>")


_OWN = ("doc_id", "text", "n_chars")


def line_dedup(docs: DataFrame, block_words: int = 30) -> DataFrame:
    """docs without the lines that stand in a run of `block_words` words or more which an earlier document holds unbroken too.

    Documents are ordered by doc_id (null last), then by a hash of the text. All rows and columns stay: a text of which every line goes becomes empty, a null
    text stays null, n_chars (if there is one) follows the text, and rows that repeat both id and text are one document with one
    result. Added columns, in place of any of those names: `lines_removed` and `words_removed` (BIGINT).
    """
    return restored(_deduplicated(docs, block_words), docs, _OWN, "lines_removed", "words_removed")


def deduplicated(docs: DataFrame, block_words: int = 30) -> DataFrame:
    """The same with exactly the columns of docs."""
    return restored(_deduplicated(docs, block_words), docs, _OWN)


def _deduplicated(docs: DataFrame, block_words: int) -> DataFrame:
    """carried(docs) after deduplication, with lines_removed and words_removed."""
    blocks = repeated_blocks(docs, block_words).select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "ranges")
    joined = carried(docs, *_OWN).withColumn("_text", F.xxhash64("text")).join(blocks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    lines = F.split("text", "\n")
    # ranges are apart and in order: what stays is what lies between one's end and the next one's start
    ends, starts = F.concat(F.array(F.lit(0)), F.transform("ranges", lambda r: r["to"])), F.concat(F.transform("ranges", lambda r: r["from"]), F.array(F.size(lines)))
    part = lambda x, low, high: F.slice(x, low + 1, high - low)
    split = F.transform(F.array(lines), lambda x: F.struct(F.flatten(F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: part(x, z["a"], z["b"]))).alias("kept"), F.flatten(F.transform("ranges", lambda r: part(x, r["from"], r["to"]))).alias("lost")))[0]
    joined = joined.withColumn("_split", F.when(F.col("ranges").isNotNull(), split))
    kept = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join("_split.kept", "\n"))
    lost = F.coalesce("_split.lost", F.array().cast("array<string>"))
    out = joined.withColumns({"text": kept, "_lost": lost}).withColumns({"lines_removed": F.size("_lost").cast("long"), "words_removed": F.size(F.array_remove(F.split(F.array_join("_lost", " "), r"[\x20\x09-\x0D]+"), "")).cast("long")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("ranges").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
