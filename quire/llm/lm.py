"""Scoring of texts by a causal self-attention language model over subword ids, learnt from the training fold of the corpus.

1. One pass over the texts deals documents to blocks of bounded size as they are read. A block gives its distinct words with their training
   counts, each document as a sequence of word numbers, and every training document as a sequence of subwords.
2. Word counts are summed over all blocks, and each distinct word of the corpus is encoded once.
3. Subword and subword pair counts of the whole corpus follow from the word counts; they are the model's tables.
4. Attention is trained on the windows of these sequences: on a warm-up sample in one task, then in parallel on all of them, where they were
   written, and the parallel weights are averaged.
5. Each block gets its words' counts and subwords by an equality join and scores its documents: overlapping windows give every subword one log
   probability; a word's probability is mixed with its corpus frequency.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.attention import DOCUMENT, VOCABULARY, Attention, Counts, Shape, windows
from quire.llm.common import held_out, least_by_hash, small_batches, written
from quire.llm.subwords import all_word_ids, begins_word

#: Bytes of text in a block (and one document more): what a task holds at once stays the same at any size of the corpus.
BLOCK_BYTES = 24 << 20
#: Bytes of subwords that one network learns from before the next begins (and one document more), however long the documents are.
TRAINER_BYTES = 24 << 20
#: Words in one row of a block's list.
LISTED = 4096
#: Stands for the end of a document among words; no word holds white space.
END = b" "


def _words(raw: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case."""
    return raw.lower().split()


def _planes(x: np.ndarray) -> bytes:
    """Unsigned numbers, all their lowest bytes first, then all the next: the number of bytes of each, then the bytes. Compresses well."""
    n = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + x.view(np.uint8).reshape(len(x), -1).T[:n].tobytes()


def _numbers(raw: bytes, kind: str) -> np.ndarray:
    """The numbers of _planes."""
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(kind).ravel()


def cut(ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, share: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Windows of documents with `sizes` ids laid end to end (a row of window + 1 ids each), one in `share` of them from `first` of each document on, and which places of each are scored: over all, each place once, as in scoring."""
    begin, scored = windows(sizes, shape)
    start = np.cumsum(sizes) - sizes
    of = np.searchsorted(start, begin, side="right") - 1
    mine = ((begin - start[of]) // shape.step - first[of]) % share == 0
    padded = np.append(ids, np.zeros(shape.window + 1, ids.dtype))
    return padded[begin[mine, None] + np.arange(shape.window + 1)], scored[mine]


#: The mark that begins a document, as a word number.
_MARK = np.zeros(1, "<u4")


class Block:
    """Words of some documents, numbered as they come; the end of a document is word 0."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.number[END]
        self.trained: list[np.ndarray] = []
        self.flat, self.length = np.array([DOCUMENT], np.uint16), np.ones(1, np.int64)
        self.size = 0

    def add(self, raw: bytes, held: bool) -> tuple[list[bytes], np.ndarray]:
        """The document's words, and their numbers with the end."""
        return _words(raw), self.add_all(pa.array([raw], pa.large_binary()), [held])[0]

    def add_all(self, raw: pa.Array, held: list[bool]) -> list[np.ndarray]:
        """Numbers of the words of each of some documents (large_binary), with the end. Distinct words are looked up once, and new ones encoded together."""
        found = pc.ascii_split_whitespace(pc.ascii_lower(raw.view(pa.large_string())))
        sizes, old = np.asarray(pc.list_value_length(found)), len(self.number)
        coded = found.flatten().dictionary_encode()
        at, distinct = np.asarray(coded.indices), coded.dictionary.cast(pa.large_binary()).to_pylist()
        known = np.fromiter((self.number[w] if w else 0 for w in distinct), "<u4", len(distinct))
        # white space at the ends of a text gives empty words, which count as nothing; number 0 is left for the end
        sizes = np.add.reduceat(np.append(known[at] > 0, False).astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0)
        flat = known[at]
        flat = np.insert(flat[flat > 0], np.cumsum(sizes), 0)
        self.trained.append(flat[np.repeat(~np.array(held, bool), sizes + 1)])
        ids, length = all_word_ids([w for w, n in zip(distinct, known.tolist(), strict=True) if n >= old])
        self.flat, self.length = np.append(self.flat, ids), np.append(self.length, length)
        self.size += int(pc.sum(pc.binary_length(raw)).as_py()) + len(raw)
        return np.split(flat, np.cumsum(sizes + 1)[:-1])

    @property
    def ids(self) -> list[np.ndarray]:
        """Subwords of each word, by number."""
        return np.split(self.flat, np.cumsum(self.length)[:-1])

    def all_subwords(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """The subwords of each of some documents after the mark."""
        sizes, begin = np.array([len(x) + 1 for x in numbers]), np.cumsum(self.length) - self.length
        words = np.concatenate([y for x in numbers for y in (_MARK, x)])
        n = self.length[words]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(begin[words] - (ends - n), n) + np.arange(n.sum())]
        return np.split(flat, ends[np.cumsum(sizes) - 1][:-1])

    def subwords(self, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
        """The document's subwords after the mark."""
        return self.all_subwords([numbers])[0]

    def stretches(self, words: list[bytes], numbers: np.ndarray, first: int, share: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """The document's windows as training cuts them, and the first scored place and the one after the last of each."""
        ids = self.subwords(words, numbers)
        rows, scored = cut(ids, np.array([len(ids)]), np.array([first]), share, shape)
        low = scored.argmax(axis=1)
        return rows, np.stack([low, low + scored.sum(axis=1)], axis=1)

    def listed(self) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Words in order of their numbers, and how often each stands in training documents, some thousands at a time."""
        words = list(self.number)
        n = np.bincount(np.concatenate(self.trained), minlength=len(words)) if self.trained else np.zeros(len(words), np.int64)
        for i in range(0, len(words), LISTED):
            yield words[i : i + LISTED], n[i : i + LISTED]


_PARTS = {"block": pa.int64(), "doc_id": None, "numbers": pa.binary(), "o": pa.int64(), "subwords": pa.binary(), "first": pa.int32(), "words": pa.list_(pa.binary()), "counts": pa.list_(pa.int64())}


def _parts(dealt: DataFrame, kind: str) -> DataFrame:
    """Rows of documents (numbers is not null) and of lists of words (words is not null) of each block; a training document's subwords stand beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, doc_type = Block(), TaskContext.get().partitionId(), pa.int64()

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {k: t or doc_type for k, t in _PARTS.items()}
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.array([at] * n, t) if k == "block" else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

        def lists() -> Iterator[pa.RecordBatch]:
            for i, (words, n) in enumerate(block.listed()):
                yield rows(1, first=pa.array([i * LISTED], pa.int32()), words=pa.array([words], pa.list_(pa.binary())), counts=pa.array([n], pa.list_(pa.int64())))

        for batch in batches:
            doc_type = batch.schema.field(0).type
            raw, held = batch.column(1).cast(pa.large_binary()).fill_null(b""), batch.column(2).to_pylist()
            start, size = 0, block.size
            for i, n in enumerate(pc.binary_length(raw).to_pylist(), 1):
                size += n + 1
                full = size >= BLOCK_BYTES
                if full or i == len(raw):
                    own, kept = batch.slice(start, i - start), held[start:i]
                    numbers = block.add_all(raw.slice(start, i - start), kept)
                    learnt = iter(block.all_subwords([x for x, h in zip(numbers, kept, strict=True) if not h]) if not all(kept) else [])
                    subwords = [None if h else _planes(next(learnt)) for h in kept]
                    yield rows(len(kept), doc_id=own.column(0), o=own.column(3), numbers=pa.array(list(map(_planes, numbers)), pa.binary()), subwords=pa.array(subwords, pa.binary()))
                    start = i
                if full:
                    yield from lists()
                    block, at, size = Block(), at + (1 << 24), 0
        if block.size:
            yield from lists()

    schema = f"block bigint, doc_id {kind}, numbers binary, o bigint, subwords binary, first int, words array<binary>, counts array<bigint>"
    return dealt.select("doc_id", "text", "held_out", "o").mapInArrow(run, schema)


def _vocabulary(listed: DataFrame) -> DataFrame:
    """(word, n, ids): each distinct word with its training count and, encoded once, its subwords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            flat, length = all_word_ids([w for w in words if w != END])
            ends = [i for i, w in enumerate(words) if w == END]
            if ends:  # the end is one id, the mark
                at = ends[0]
                flat, length = np.insert(flat, length[:at].sum(), DOCUMENT), np.insert(length, at, 1)
            offsets = np.concatenate([[0], 2 * np.cumsum(length)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(flat.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=["word", "n", "ids"])

    return listed.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(run, "word binary, n bigint, ids binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all values of a binary column, end to end, and how many each has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u2").astype(np.int32), np.diff(ends) // 2


def _tables(vocabulary: DataFrame, shape: Shape) -> Counts:
    """The model's tables from the counts of all training words. What reaches the driver is bounded by the subword vocabulary and by shape.rows squared."""
    words = vocabulary.where("n > 0").select("n", "ids")

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(VOCABULARY)
        for batch in batches:
            ids, lengths = _flat(batch.column(1))
            sums += np.bincount(ids, np.repeat(np.asarray(batch.column(0)), lengths), VOCABULARY)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used].astype(np.int64))], names=["id", "n"])

    unigram = np.zeros(VOCABULARY)
    for r in words.mapInArrow(unigrams, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        unigram[r["id"]] = r["n"]
    row, m = Counts.rows_of(unigram, begins_word(), shape), shape.rows

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of a square of m + 1: pairs inside words; the last column for the ends of words, the last row for their beginnings."""
        sums = np.zeros((m + 1) * (m + 1))
        for batch in batches:
            ids, lengths = _flat(batch.column(1))
            at, weight = row[ids].astype(np.int64), np.repeat(np.asarray(batch.column(0)), lengths).astype(float)
            end = np.cumsum(lengths) - 1
            last, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
            last[end], first[end - lengths + 1] = True, True
            after = np.where(last, m, np.append(at[1:], 0))
            np.add.at(sums, np.r_[at * (m + 1) + after, m * (m + 1) + at[first]], np.r_[weight, weight[first]])
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used].astype(np.int64))], names=["cell", "n"])

    cells = words.mapInArrow(pairs, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    square = np.zeros((m + 1) * (m + 1))
    square[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    square = square.reshape(m + 1, m + 1)
    return Counts.of(unigram, begins_word(), square[:m, :m], square[:m, m], square[m, :m], shape)


def _trained(net: Attention, rows: DataFrame, epochs: int, rate: float, share: int, docs: int) -> Attention:
    """The average of networks that each learn from these weights, weighed by windows: a task's rows(subwords) make one for every `docs` documents or TRAINER_BYTES. Averaged in Spark; its size is the network's."""
    shape = net.shape

    def learnt(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        own = Attention(net.counts, shape)
        own.p = {k: v.copy() for k, v in net.p.items()}
        each = [_numbers(x, "<u2") for x in held]
        ids, scored = cut(np.concatenate(each), np.array([len(x) for x in each]), np.array([crc32(x) for x in held]), share, shape)
        own.train(ids, scored, epochs, rate)
        weight = float(len(ids))
        for k, v in own.p.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * v.size), pa.array(np.arange(v.size)), pa.array(v.ravel().astype(float) * weight), pa.array(np.full(v.size, weight))], names=["name", "pos", "v", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(x)
                size += len(x)
                if len(held) >= docs or size >= TRAINER_BYTES:
                    yield from learnt(held)
                    held, size = [], 0
        if held:
            yield from learnt(held)

    found = rows.mapInArrow(run, "name string, pos bigint, v double, w double").groupBy("name", "pos").agg((F.sum("v") / F.sum("w")).alias("v"), F.sum("w").alias("w")).where("w > 0").toPandas()
    for name, own in found.groupby("name"):
        net.p[name].ravel()[own["pos"].to_numpy(np.int64)] = own["v"].to_numpy(np.float32)
    return net


def fit_attention(learning: DataFrame, counts: Counts, shape: Shape, warm_docs: int, trainer_docs: int, share: int) -> Attention:
    """Trains on learning(o, subwords), every training document.

    First in one task on those of the warm_docs documents that are least by hash, in 4 rounds; then on all of them in parallel where they stand,
    nothing is moved for it, trainer_docs documents a network.
    """
    net = Attention(counts, shape)
    warm = least_by_hash(learning, F.col("o"), warm_docs, learning.count(), "subwords")
    net = _trained(net, warm.repartition(1).sortWithinPartitions("o", "subwords").select("subwords"), 4, 8e-3, share, warm_docs)
    return _trained(net, learning.select("subwords"), 1, 1e-3, share, trainer_docs)


class Scorer:
    """The words of one block, with what a model needs to score its documents."""

    def __init__(self, n: np.ndarray, ids: np.ndarray, length: np.ndarray, total: int, distinct: int, mix: float):
        self.n, self.ids, self.length = n, ids, length
        self.begin = np.cumsum(length) - length
        self.base = np.log10((n + 1) / (total + distinct + 1))
        self.share = np.log(np.maximum(mix * n / max(total, 1), 1e-300))
        self.mix = mix

    def sequence(self, words: np.ndarray) -> np.ndarray:
        """Subword ids of a sequence of word numbers."""
        n = self.length[words]
        return self.ids[np.repeat(self.begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def scores(self, net: Attention, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of documents that are given end to end as word numbers, each with its end.

        A word's probability is that of its subwords, of which the first is known to begin a word and the last is followed by one that does, so
        the probabilities of all words (and the end) after any beginning add up to 1 at most.
        """
        first = np.cumsum(sizes) - sizes
        lead = np.insert(flat, first, 0)  # every document begins with the mark; the mark that ends it is its last word
        n = self.length[lead]
        begins = np.cumsum(n) - n
        marks = first + np.arange(len(sizes))
        log, opening = net.log_probs(self.sequence(lead), np.add.reduceat(n, marks))
        by_word = np.delete(np.add.reduceat(log, begins), marks)
        before = np.delete(opening[begins], marks)
        after = np.append(before[1:], 0.0)
        after[first + sizes - 1] = 0.0  # nothing follows the end
        score = np.logaddexp(by_word - before + after + np.log(1 - self.mix), self.share[flat]) / np.log(10)
        return sizes, np.add.reduceat((self.n[flat] > 0).astype(np.int64), first), np.add.reduceat(self.base[flat], first), np.add.reduceat(score, first)


def lm_scores(docs: DataFrame, fold: tuple[int, int] = (7, 2), mix: float = 0.3, shape: Shape | None = None, share: int = 1, warm_docs: int = 1500, trainer_docs: int = 6000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    score: log10 probability of the text's words and its end. A word's probability is mix * count / train_tokens + (1 - mix) * the attention
    model's probability of its subwords and of the word's end after them. base_score, n_known and train_tokens follow exact counts of the
    training fold. Attention learns from every place of every training document once (one in `share` of their windows), after a warm-up on
    warm_docs of them, at every size of the corpus. Null and empty texts
    are one token, the end. A null doc_id is in the training fold. Repeated rows each count and each return. Without training documents
    counts are zero and the model is untrained. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shape = shape or Shape()
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text", held_out(F.col("doc_id"), *fold).alias("held_out"), F.xxhash64("doc_id", "text").alias("o"))
    parts = written(_parts(dealt, kind), compression="zstd")
    lists = parts.where("words is not null")
    listed = lists.select("block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x")).select("block", (F.col("first") + F.col("i")).alias("i"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    vocabulary = written(_vocabulary(listed), compression="zstd")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    net = fit_attention(parts.where("subwords is not null").select("o", "subwords"), _tables(vocabulary, shape), shape, warm_docs, trainer_docs, share)
    n_blocks = max(1, lists.where("first = 0").count())
    none = lambda t: F.lit(None).cast(t)
    given = listed.drop("n").join(vocabulary, "word").select("block", F.lit(0).alias("kind"), "i", "n", "ids", none(kind).alias("doc_id"), none("binary").alias("numbers"))
    asked = parts.where("numbers is not null").select("block", F.lit(1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("n"), none("binary").alias("ids"), "doc_id", "numbers")
    model = spark.sparkContext.broadcast(net)  # its size is the shape's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, scorer = None, [], None
        for batch in batches:
            block, what = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(what) != 0)) + 1 if len(batch) else []
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                rows = batch.slice(low, high - low)
                if not len(rows):
                    continue
                if what[low] == 0:
                    if block[low] != now:
                        now, words = block[low], []
                    words.append((np.asarray(rows.column(2)), np.asarray(rows.column(3)), *_flat(rows.column(4))))
                    scorer = None
                    continue
                if scorer is None:
                    i, n, ids, length = (np.concatenate(c) for c in zip(*words, strict=True))
                    order, words = np.argsort(i), []
                    begin, length = (np.cumsum(length) - length)[order], length[order]
                    ids = ids[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
                    scorer = Scorer(n[order], ids, length, total, distinct, mix)
                numbers = [_numbers(x, "<u4") for x in rows.column(6).to_pylist()]
                group = np.cumsum([len(x) for x in numbers]) // 50_000
                found = []
                for g in np.unique(group):
                    own = [numbers[k] for k in np.flatnonzero(group == g)]
                    found.append(scorer.scores(model.value, np.concatenate(own).astype(np.int64), np.array([len(x) for x in own])))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(5), *columns], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    place = F.pmod("block", F.lit(n_blocks)).cast("int")
    both = given.unionByName(asked).repartitionById(n_blocks, place).sortWithinPartitions("block", "kind")
    out = both.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
