"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks that cover the whole text; each filter is max-pooled over a chunk; a
small dense layer gives each chunk a logit, and the chunks' mean and least logits are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import sigmoid
from quire.llm.common import held_out, labelled_texts, raw_texts, small_batches


@dataclass(frozen=True)
class Shape:
    """Sizes of the network. A chunk starts every `step` bytes, so neighbours overlap by chunk - step bytes."""

    dim: int = 6
    width: int = 12
    stride: int = 3
    filters: int = 24
    hidden: int = 16
    chunk: int = 516
    step: int = 480

    @property
    def places(self) -> int:
        return (self.chunk - self.width) // self.stride + 1


def chunk_bytes(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts (uint8, zero-padded, one row each; an empty text has one of zeros) and the text of each."""
    counts = np.array([max(1, -(-max(len(x) - (shape.chunk - shape.step), 1) // shape.step)) for x in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    room = counts * shape.step + shape.chunk - shape.step
    flat = np.frombuffer(b"".join(x.ljust(int(r), b"\0") for x, r in zip(texts, room, strict=True)), np.uint8)
    begin = np.repeat(np.cumsum(room) - room, counts) + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * shape.step
    return flat[begin[:, None] + np.arange(shape.chunk)], owner


class ByteCnn:
    """The network; weights are float32 arrays in `p`."""

    def __init__(self, shape: Shape, seed: int = 7):
        r, s = np.random.default_rng(seed), shape
        g = lambda *n, scale: (r.standard_normal(n) * scale).astype(np.float32)
        self.shape = s
        self.p = {"embed": g(256, s.dim, scale=0.5), "conv": g(s.width * s.dim, s.filters, scale=(s.width * s.dim) ** -0.5), "bias": np.zeros(s.filters, np.float32), "dense": g(s.filters, s.hidden, scale=s.filters**-0.5), "dense_bias": np.zeros(s.hidden, np.float32), "out": g(s.hidden, 1, scale=s.hidden**-0.5), "out_bias": np.zeros(1, np.float32), "combine": np.array([0.7, 0.3, 0.0], np.float32)}

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest answer in each chunk, and where it is."""
        s, n = self.shape, len(chunks)
        x = self.p["embed"][chunks].reshape(n, -1)
        windows = np.lib.stride_tricks.as_strided(x, (n, s.places, s.width * s.dim), (x.strides[0], s.stride * s.dim * 4, 4))
        return windows, np.matmul(windows.reshape(n * s.places, -1), self.p["conv"]).reshape(n, s.places, s.filters)

    def chunk_logits(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.maximum(top + self.p["bias"], 0)
        h = np.maximum(a @ self.p["dense"] + self.p["dense_bias"], 0)
        return a, h, (h @ self.p["out"])[:, 0] + self.p["out_bias"][0]

    def combine(self, logits: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Logit of each text from its chunks: weights of the mean and of the least, and a bias."""
        count = np.bincount(owner, minlength=n)
        mean = np.bincount(owner, logits, n) / count
        starts = np.r_[0, np.cumsum(count)[:-1]]
        least = np.minimum.reduceat(logits, starts)
        c = self.p["combine"]
        return c[0] * mean + c[1] * least + c[2], mean, least, count

    def scores(self, texts: list[bytes], rows: int = 128) -> np.ndarray:
        """Probability of label 1 of each text; memory is that of `rows` chunks at a time, whatever a text's length."""
        if not texts:
            return np.zeros(0)
        chunks, owner = chunk_bytes(texts, self.shape)
        tops = np.concatenate([self.pooled(chunks[i : i + rows])[1].max(axis=1) for i in range(0, len(chunks), rows)])
        return sigmoid(self.combine(self.chunk_logits(tops)[2].astype(float), owner, len(texts))[0])

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = 700, batch_chunks: int = 160, rate: float = 4e-3, seed: int = 3) -> None:
        """Adam on the log loss of whole texts, a few texts a step; gradients pass through each filter's largest place only.

        There are as many steps of as many chunks at every size of the sample, which is gone through as often as that takes.
        """
        s, p = self.shape, self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        v2 = {k: np.zeros_like(v) for k, v in p.items()}
        t, order = 0, np.random.default_rng(seed)
        sizes = np.array([max(1, len(x) // s.step + 1) for x in texts])
        while t < steps:
            todo = order.permutation(len(texts))
            groups = np.split(todo, np.flatnonzero(np.diff(np.cumsum(sizes[todo]) // batch_chunks)) + 1)
            for group in groups[: steps - t]:
                chunks, owner = chunk_bytes([texts[i] for i in group], s)
                tops, wins = [], []
                for i in range(0, len(chunks), 128):
                    windows, answer = self.pooled(chunks[i : i + 128])
                    best = answer.argmax(axis=1)
                    tops.append(np.take_along_axis(answer, best[:, None], axis=1)[:, 0])
                    at = (best * s.stride)[:, :, None] + np.arange(s.width)
                    wins.append(np.take_along_axis(chunks[i : i + 128, None, :], at, axis=2))
                top, win = np.concatenate(tops), np.concatenate(wins)  # chunks x filters (x width)
                a, h, logits = self.chunk_logits(top)
                text_logit, mean, least, count = self.combine(logits, owner, len(group))
                d = ((sigmoid(text_logit) - y[group]) / len(group)).astype(np.float32)
                c = p["combine"]
                lowest = np.zeros(len(owner), np.float32)
                first = np.unique(np.where(logits == least[owner], owner, -1), return_index=True)
                lowest[first[1][first[0] >= 0]] = 1
                dl = (d[owner] * (c[0] / count[owner] + c[1] * lowest)).astype(np.float32)
                dh = dl[:, None] * p["out"][:, 0] * (h > 0)
                da = (dh @ p["dense"].T) * (a > 0)
                we = p["embed"][win]  # chunks x filters x width x dim
                dwe = da[:, :, None] * p["conv"].T[None]
                grads = {
                    "combine": np.array([d @ mean, d @ least, d.sum()], np.float32), "out": (h.T @ dl)[:, None], "out_bias": np.array([dl.sum()], np.float32), "dense": a.T @ dh, "dense_bias": dh.sum(axis=0),
                    "bias": da.sum(axis=0), "conv": np.einsum("cf,cfk->kf", da, we.reshape(*we.shape[:2], -1), optimize=True),
                    "embed": np.stack([np.bincount(win.ravel(), dwe.reshape(*we.shape)[..., k].ravel(), 256) for k in range(s.dim)], axis=1),
                }
                t += 1
                step = rate * min(1.0, t / 30) * (1 - 0.9 * t / steps)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 3_000, fold: tuple[int, int] = (5, 0), shape: Shape | None = None, steps: int = 700) -> ByteCnn:
    """The network fitted to whole texts of at most `sample_rows` labelled rows (least by a hash of doc_id, outside the held-out fold).

    Training is one Spark task, which streams the sample and gives back the weights alone (a few thousand numbers).
    """
    small_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, label, *fold, sample_rows)
    shape = shape or Shape()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += raw_texts(batch.column(0))
            y += batch.column(1).to_pylist()
        net = ByteCnn(shape)
        if 0 < sum(y) < len(y):
            net.train(texts, np.array(y, np.float32), steps)
        yield pa.RecordBatch.from_arrays([pa.array(list(net.p)), pa.array([v.astype("<f4").tobytes() for v in net.p.values()])], names=["name", "weights"])

    rows = sample.select("text", "label", F.xxhash64("doc_id").alias("o"), "doc_id").repartition(1).sortWithinPartitions("o", "doc_id").select("text", "label")
    net = ByteCnn(shape)
    for r in rows.mapInArrow(run, "name string, weights binary").collect():
        net.p[r["name"]] = np.frombuffer(r["weights"], "<f4").reshape(net.p[r["name"]].shape).copy()
    return net


def score(docs: DataFrame, net: ByteCnn, threshold: float = 0.3, fold: tuple[int, int] = (5, 0)) -> DataFrame:
    """docs with held_out, score and predicted. Null and empty texts are one chunk of zero bytes; every row returns once. Columns of docs of those three names are replaced."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_texts(batch.column(batch.schema.get_field_index("text")))
            order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
            found, group, size = np.zeros(len(raw)), [], 0
            for i in order:
                group.append(i)
                size += len(raw[i]) + 1
                if size > 1 << 20:
                    found[group] = net.scores([raw[k] for k in group])
                    group, size = [], 0
            if group:
                found[group] = net.scores([raw[k] for k in group])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    out = docs.select(rest).mapInArrow(run, docs.select(rest).schema.add("score", "double"))
    return out.withColumns({"held_out": held_out(F.col("doc_id"), *fold), "predicted": (F.col("score") >= threshold).cast("int")})
