"""Removal of byte strings that an earlier document holds too, by suffix arrays over the text that documents share.

A string of `length` bytes has one least hash among its grams of `gram` bytes, so equal strings carry equal keys. Neighbouring strings of one key
make a stretch. What a batch of documents shares is found in two exchanges: keys are counted by ranges of their hash, then stretches whose key
several documents have go, each distinct one once a batch with the least of its doc_ids, to a task for their key. There a suffix array with
common prefixes finds equal strings, and each batch gets back the first holder of every string it sent. A key that very many
stretches carry is replaced by a hash of the whole string, so that what differs is dealt over all tasks. Nothing depends on
how documents fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import carried, packed, raw_texts, restored, small_batches, unpacked, written
from quire.llm.suffixes import common_prefixes, padded, suffix_array

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null doc_id, which comes last.
LAST = (1 << 63) - 1
#: Texts are scanned in parts of so many strings, and a stretch has so many at most.
PART, LONGEST = 1 << 15, 1 << 12
#: Documents are scanned together up to so many bytes.
GROUP = 1 << 19
_PARCEL = pa.schema([("place", pa.int32()), ("uid", pa.int64()), ("parcel", pa.binary())])
_ANSWER = pa.schema([("uid", pa.int64()), ("place", pa.int32()), ("answer", pa.binary())])
_KEYS = pa.schema([("uid", pa.int64()), ("keys", pa.binary())])


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    out = np.empty(len(text) - 7, np.uint64)
    for k in range(min(8, len(out))):
        out[k::8] = text[k : k + (len(text) - k) // 8 * 8].view("<u8")
    return out


def _hashes(text: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the `size` bytes (8 at least) from each place on, or from the places `at`."""
    n = len(text) - size + 1
    eights = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1)) if at is not None else None
    words = _eights(text) if at is None else None
    out = np.full(n if at is None else len(at), size, np.uint64)
    for step in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out ^= words[step : step + n] if at is None else eights[at + step].view("<u8").ravel()
        out *= _MIX
        out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def keys(text: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of `length` bytes of a text the least hash of its grams."""
    if len(text) < length:
        return np.empty(0, np.uint64)
    out = []
    for low in range(0, len(text) - length + 1, PART):
        least, width, reach = _hashes(text[low : low + PART + length - 1], gram), 1, length - gram + 1
        while 2 * width <= reach:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        out.append(np.minimum(least[: len(least) - reach + width], least[reach - width :]))
    return np.concatenate(out)


def stretches(text: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that lie one after the other with these sizes, each run of strings of one key, LONGEST strings at most: its document's number, its first and past-last place and its key."""
    n = np.maximum(sizes - length + 1, 0)
    begins = (np.cumsum(sizes) - sizes)[n > 0]
    if not len(begins):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    key, past = keys(text, length, gram), begins + n[n > 0]
    edge = np.zeros(len(key) + 1, bool)
    edge[1:-1] = key[1:] != key[:-1]
    edge[begins] = edge[past] = True
    starts = begins[0] + np.flatnonzero(edge[begins[0] : -1])
    ends = np.r_[starts[1:], len(key)]
    doc = np.searchsorted(begins, starts, side="right") - 1
    within = starts < past[doc]  # the strings of others begin in one document and end in the next
    starts, ends, doc = starts[within], ends[within], np.flatnonzero(n > 0)[doc[within]]
    if (ends - starts).max() > LONGEST:
        times = -(-(ends - starts) // LONGEST)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, ends, doc = np.repeat(starts, times) + LONGEST * step, np.repeat(ends, times), np.repeat(doc, times)
        ends = np.minimum(starts + LONGEST, ends)
    return doc, starts, ends, key[starts]


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(uid, ids, hashes, sizes, texts): documents in batches of about batch_bytes of text, a row each; uid is the batch's own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, hashes, texts = zip(*held, strict=True)
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = [[(part << 32) + turn], [packed(np.array(ids, np.int64))], [packed(np.array(hashes, np.int64))], [packed(np.array([len(x) for x in texts], np.int64))], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["uid", "ids", "hashes", "sizes", "texts"])

        for batch in batches:
            for i, h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                if held and size + len(raw) > batch_bytes:
                    yield out()
                    held, size, turn = [], 0, turn + 1
                held.append((LAST if i is None else i, h, raw))
                size += len(raw)
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "uid bigint, ids binary, hashes binary, sizes binary, texts binary")


def _texts(row: dict) -> Iterator[tuple[int, int, bytes]]:
    """(id, hash, text) of a batch's documents."""
    (ids,), (hashes,), (sizes,) = (unpacked(row[x], "i8") for x in ("ids", "hashes", "sizes"))
    raw, at = zstandard.ZstdDecompressor().decompress(row["texts"]) if sizes.sum() else b"", 0
    for i, h, n in zip(ids.tolist(), hashes.tolist(), sizes.tolist(), strict=True):
        yield i, h, raw[at : at + n]
        at += n


def _groups(row: dict) -> Iterator[tuple[int, np.ndarray, bytes, np.ndarray]]:
    """(number of the first, ids, text, sizes) of a batch's documents, GROUP bytes or one document at a time, so that small ones share what a step costs."""
    (ids,), (sizes,) = (unpacked(row[x], "i8") for x in ("ids", "sizes"))
    raw, low, at = zstandard.ZstdDecompressor().decompress(row["texts"]) if sizes.sum() else b"", 0, 0
    ends = np.cumsum(sizes)
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, at + GROUP, side="right")))
        yield low, ids[low:high], raw[at : int(ends[high - 1])], sizes[low:high]
        low, at = high, int(ends[high - 1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        few = max(1, min(256, (1 << 20) * batch.num_rows // max(1, batch.nbytes)))  # some MB at a time
        for k in range(0, batch.num_rows, few):
            yield from batch.slice(k, few).to_pylist()


def _together(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is binary in record batches of a MB or 256 rows: one for each would cost more than a small parcel."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= 1 << 20 or len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _parcels(places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, which) for each place that occurs."""
    order = np.argsort(places, kind="stable")
    kinds, starts = np.unique(places[order], return_index=True)
    yield from zip(kinds.tolist(), np.split(order, starts[1:]), strict=True)


def _place(key: np.ndarray, n: int) -> np.ndarray:
    """A task for each key; keys are least hashes, so their upper bits are mixed again."""
    return ((key * _MIX) >> np.uint64(33)).astype(np.int64) % n


def _counted(batches: DataFrame, length: int, gram: int, places: int, hot: int) -> DataFrame:
    """(uid, keys): for each batch those of its keys that several of all documents hold, and whether `hot` stretches or more carry them."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(rows):
            own = []
            for _, _, raw, sizes in _groups(row):
                doc, _, _, key = stretches(np.frombuffer(raw, np.uint8), sizes, length, gram)
                order = np.argsort(key, kind="stable")  # documents stay in order, so one document's equal keys stand together
                key, doc = key[order], doc[order]
                own.append(key[np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)]])
            key, n = np.unique(np.concatenate(own), return_counts=True)
            if not len(key):
                continue
            parts = [(p, packed(key[which], np.minimum(n[which], 65535).astype(np.uint16))) for p, which in _parcels(_place(key, places))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([row["uid"]] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["place", "uid", "parcel"])

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        for _, held in _by_place(rows):
            found = [unpacked(x["parcel"], "u8", "u2") for x in held]
            key, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([x[1] for x in found]).astype(np.float64), len(key)).astype(np.int64)[back]
            at = 0
            for x, (own, _) in zip(held, found, strict=True):
                mine = n[at : at + len(own)]
                at += len(own)
                if (mine > 1).any():
                    yield x["uid"], packed(own[mine > 1], (mine[mine > 1] >= hot).astype(np.uint8))

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(counted(rows), _KEYS)

    sent = batches.mapInArrow(send, "place int, uid bigint, parcel binary")
    return sent.repartition(_tasks(places), "place").sortWithinPartitions("place").mapInArrow(count, "uid bigint, keys binary")


def _tasks(places: int) -> int:
    """Tasks for so many places: a few places each, one after the other."""
    return -(-places // 4)


def _by_place(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by place, those of a place together: the parcels of its keys, which is a bounded share of all."""
    held: list[dict] = []
    for row in _rows(rows):
        if held and held[0]["place"] != row["place"]:
            yield held[0]["place"], held
            held = []
        held.append(row)
    if held:
        yield held[0]["place"], held


def _shared(row: dict, length: int, gram: int, places: int) -> Iterator[tuple[int, int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, id, text, places, starts, ends) for each document of a batch joined with its shared keys that has shared stretches: the place of each one's key, its first and past-last string."""
    found = [unpacked(x, "u8", "u1") for x in row["keys"] or []]
    if not found:
        return
    known = np.concatenate([x[0] for x in found])
    order = np.argsort(known)
    known, hot = known[order], np.concatenate([x[1] for x in found])[order] > 0
    for low, ids, raw, sizes in _groups(row):
        text = np.frombuffer(raw, np.uint8)
        doc, starts, ends, key = stretches(text, sizes, length, gram)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        fine = known[at] == key
        doc, starts, ends, by, split = doc[fine], starts[fine], ends[fine], key[fine], hot[at[fine]]
        if split.any():  # each string of a hot key by itself, under a hash of all its bytes
            n = np.where(split, ends - starts, 1)
            one = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ends, by, doc, split = np.repeat(ends, n), np.repeat(by, n), np.repeat(doc, n), np.repeat(split, n)
            starts, ends = one, np.where(split, one + 1, ends)
            by[split] = _hashes(text, length, one[split])
        place, begins = _place(by, places), np.cumsum(sizes) - sizes
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)], strict=True) if len(doc) else ():
            i = int(doc[s])
            b = int(begins[i])
            yield low + i, int(ids[i]), raw[b : b + int(sizes[i])], place[s:e], starts[s:e] - b, ends[s:e] - b


def _sendings(row: dict, length: int, gram: int, places: int) -> tuple[dict[int, dict[bytes, list[int]]], list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
    """What a batch sends: for each place its distinct stretches, each with its number there and the least doc_id, in a fixed order; and for each document
    (its number, its id, places, numbers there, starts) of its stretches."""
    sent: dict[int, dict[bytes, list[int]]] = {}
    uses = []
    for i, doc, raw, at, starts, ends in _shared(row, length, gram, places):
        numbers = np.empty(len(at), np.int64)
        for j, (p, s, e) in enumerate(zip(at.tolist(), starts.tolist(), (ends + length - 1).tolist(), strict=True)):
            there = sent.get(p)
            if there is None:
                there = sent[p] = {}
            known = there.get(raw[s:e])
            if known is None:
                known = there[raw[s:e]] = [len(there), doc]
            elif doc < known[1]:
                known[1] = doc
            numbers[j] = known[0]
        uses.append((i, doc, at, numbers, starts))
    return sent, uses


def _gathered(lows: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups that lie one after the other, each from its low on with its size: the places of the members of the chosen groups, and the sizes of these."""
    n = sizes[chosen]
    return np.repeat(lows[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges that these ranges cover, touching ones together."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    heads = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]]) if len(starts) else order
    return starts[heads], reach[np.r_[heads[1:], len(starts)] - 1] if len(starts) else reach


def _first_holders(stretch: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct stretches with their least doc_ids, runs of strings with one first holder: how many each stretch has, the past-last string of each run, and its least doc_id of all that hold the string."""
    text, begins = padded(stretch, length)
    sizes = np.array([len(x) - length + 1 for x in stretch], np.int64)
    owner = np.repeat(np.arange(len(stretch)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = begins[owner] + within
    order = suffix_array(text, places, length)
    number = np.zeros(len(text), np.int64)  # of each place among the strings
    number[places] = np.arange(len(places))
    holder = least[owner[number[order]]]
    heads = np.flatnonzero(common_prefixes(text, order, length) < length)
    lows = np.minimum.reduceat(holder, heads)
    first = np.empty(len(places), np.int64)
    first[number[order]] = np.repeat(lows, np.diff(np.r_[heads, len(order)]))
    edge = np.flatnonzero(np.r_[(first[1:] != first[:-1]) | (owner[1:] != owner[:-1]), True])
    return np.bincount(owner[edge], minlength=len(stretch)), within[edge] + 1, first[edge]


def _answered(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(uid, place, answer) for parcels of stretches sorted by place."""
    for place, held in _by_place(rows):
        known: dict[bytes, int] = {}
        least: list[int] = []
        own = []
        for x in held:
            sizes, docs, raw = unpacked(x.pop("parcel"), "i8", "i8", "u1")
            raw, at, numbers = raw.tobytes(), 0, []
            for n, doc in zip(sizes.tolist(), docs.tolist(), strict=True):
                k = known.setdefault(raw[at : at + n], len(least))
                if k == len(least):
                    least.append(doc)
                elif doc < least[k]:
                    least[k] = doc
                at += n
                numbers.append(k)
            own.append((x["uid"], np.array(numbers, np.int64)))
        n, ends, first = _first_holders(list(known), np.array(least, np.int64), length)
        lows = np.cumsum(n) - n  # once a place, not once a batch
        for uid, numbers in own:
            at, sizes = _gathered(lows, n, numbers)
            yield uid, place, packed(sizes, ends[at], first[at])


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 16, batch_bytes: int = 8 << 20, place_bytes: int = 4 << 20, hot: int = 4096) -> DataFrame:
    """(doc_id, text_hash, n_bytes, spans, kept), a row for each row of docs: spans are the maximal byte ranges [from, to) covered by strings of `length` bytes that also
    start in a document with a smaller doc_id; kept is what remains, as BINARY. text_hash is xxhash64 of the text.

    doc_id is read as BIGINT; null comes last, as 2^63 - 1, and is returned as null. Rows of one doc_id are never earlier than one another. A null text is empty.
    gram (8 to length) is the size of what keys hash, place_bytes the text behind one task's keys on average, hot in how many documents a key may occur before its strings
    are dealt out one by one; none of these changes a result.
    """
    small_batches(docs.sparkSession)
    batches = written(_batches(docs, batch_bytes))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = int(total // place_bytes) + 1
    found = _counted(batches, length, gram, places, hot)
    shared = written(found.groupBy("uid").agg(F.collect_list("keys").alias("keys")))  # of one batch, so no more than its text
    known = batches.join(shared, "uid", "left")

    def parcelled(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for row in _rows(rows):
            sent, _ = _sendings(row, length, gram, places)
            for p, there in sent.items():
                yield p, row["uid"], packed(np.array([len(x) for x in there], np.int64), np.array([x for _, x in there.values()], np.int64), np.frombuffer(b"".join(there), np.uint8))

    parcels = known.where("keys is not null").mapInArrow(lambda rows: _together(parcelled(rows), _PARCEL), "place int, uid bigint, parcel binary").repartition(_tasks(places), "place").sortWithinPartitions("place")
    answers = parcels.mapInArrow(lambda rows: _together(_answered(rows, length), _ANSWER), "uid bigint, place int, answer binary")
    answers = written(answers.groupBy("uid").agg(F.collect_list(F.struct("place", "answer")).alias("answers")))

    def settle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for row in _rows(rows):
            sent, uses = _sendings(row, length, gram, places)
            counts = {p: len(x) for p, x in sent.items()}
            sent = {}
            answers = {x["place"]: unpacked(x["answer"], "i8", "i8", "i8") for x in row.pop("answers") or []}
            base, total = np.zeros(places, np.int64), 0  # number of each place's first stretch among all that the batch sent
            for p, n in counts.items():
                base[p], total = total, total + n
            n, ends, first = (np.concatenate([answers[p][k] for p in counts]) if counts else np.empty(0, np.int64) for k in range(3))
            begins, lows = np.r_[0, ends[:-1]][: len(ends)], np.cumsum(n) - n  # once a batch, not once a document
            begins[lows] = 0
            gone: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, doc, at, numbers, starts in uses:
                which, sizes = _gathered(lows, n, base[at] + numbers)
                which, start = which[first[which] < doc], np.repeat(starts, sizes)[first[which] < doc]
                gone[i] = _covered(start + begins[which], start + ends[which] + length - 1)
            uses = []
            docs_of, none = list(_texts(row)), np.empty(0, np.int64)
            for low in range(0, len(docs_of), 256):
                ids, hashes, sizes, spans, kept = [], [], [], [], []
                for i, (doc, h, raw) in enumerate(docs_of[low : low + 256], low):
                    merged = [x.tolist() for x in gone.get(i, (none, none))]
                    ids.append(None if doc == LAST else doc)
                    hashes.append(h)
                    sizes.append(len(raw))
                    spans.append([{"from": s, "to": e} for s, e in zip(*merged, strict=True)])
                    kept.append(b"".join(raw[a:b] for a, b in zip([0, *merged[1]], [*merged[0], len(raw)], strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "n_bytes", "spans", "kept"])

    schema = "doc_id bigint, text_hash bigint, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary"
    return known.join(answers, "uid", "left").mapInArrow(settle, schema)


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with what stays of each text: text without its repeated spans (bytes that are no whole character any more are replaced), and the
    columns `spans` and `bytes_removed` in place of any of those names. All rows stay; a null text stays null, equal rows get equal results."""
    found = repeated_spans(docs, length).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_of"), "spans", "n_bytes", "kept")
    rows = carried(docs, "doc_id", "text").withColumn("_text", F.xxhash64("text"))
    joined = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    kept = F.when(F.col("text").isNull() | (F.size("spans") == 0), F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    out = joined.withColumns({"text": kept, "bytes_removed": F.col("n_bytes") - F.octet_length("kept")})
    return restored(out, docs, ("doc_id", "text"), "spans", "bytes_removed")
