"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features: densities of a seed lexicon, of a lexicon and of word stems learnt from the training labels, hits that only show once disguises
are undone, nearness of hits to second-person words, and rates of capitals, punctuation and disguise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Boosted, calibrated, fit_boosted, isotonic
from quire.llm.common import held_out, labelled_texts, raw_texts, small_batches

#: Fixed words: common insults of the four languages, lower case.
SEEDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown ugly jerk liar vermin filth filthy "
    "imbecile cretin dimwit halfwit useless hateful "
    "dumm dummkopf trottel abschaum widerlich wertlos versager "
    "imbécile crétin débile ordure dégoûtant pathétique minable "
    "estúpido imbécil basura escoria asqueroso patético inútil idiota".split()
)
#: Fixed words: second person in the four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner sie ihr tu te toi ton ta tes vous votre vos tú ti usted tus vosotros".split())

#: Lower case, and a space for every ASCII byte that is no letter.
_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
#: Fixed disguises of letters.
_LEET = bytes.maketrans(b"013457@$!|ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastasiiabcdefghijklmnopqrstuvwxyz")
_DROPPED = b"#%&()*+,-./:;<=>?[\\]^_`{}~\"'2689"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_PUNCTUATION = b"!?.,;:'\"()-"
_MARKS = b"#*$%&|<>@^~_=+"

NAMES = ("learnt_rate", "learnt_hits", "learnt_weight", "seed_rate", "disguised_rate", "disguised_hits", "stem_rate", "stem_hits", "stem_most", "second_rate", "near_second", "capital_share", "shout_share", "exclaim_rate", "question_rate", "punctuation_rate", "mark_rate", "mixed_rate", "digit_share")


class Stems:
    """Learnt word beginnings, looked up by their first four bytes."""

    def __init__(self, stems: list[bytes]):
        self.stems: dict[bytes, tuple[bytes, ...]] = {}
        for x in sorted(stems):
            self.stems[x[:4]] = (*self.stems.get(x[:4], ()), x)

    def hits(self, words: list[bytes]) -> list[bytes]:
        """The stem of each word that has one."""
        stems = self.stems
        return [x for w in words if w[:4] in stems for x in stems[w[:4]] if w.startswith(x)]


def features(raw: bytes, lexicon: dict[bytes, float], stems: Stems, seeds: frozenset[bytes], second: frozenset[bytes]) -> list[float]:
    """The dense features of one text, in the order of NAMES; all zero for a text without words."""
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    plain = raw.translate(_PLAIN).split()
    hits = [i for i, w in enumerate(plain) if w in lexicon]
    weight = sum(lexicon[plain[i]] for i in hits)
    seeded = sum(w in seeds for w in plain)
    opened = raw.translate(_LEET, _DROPPED).split()
    shown = sum(w in lexicon or w in seeds for w in opened)
    disguised = max(0, shown - sum(w in lexicon or w in seeds for w in plain))
    stemmed = stems.hits(plain)
    most = max(Counter(stemmed).values(), default=0)
    persons = [i for i, w in enumerate(plain) if w in second]
    near = 0
    if hits and persons:
        at = np.searchsorted(persons, hits)
        p = np.array(persons)
        gaps = np.minimum(np.abs(p[np.minimum(at, len(p) - 1)] - hits), np.abs(p[np.maximum(at - 1, 0)] - hits))
        near = int((gaps <= 5).sum())
    capitals = size - len(raw.translate(None, _CAPITALS))
    letters = size - len(raw.translate(None, _LETTERS))
    digits = size - len(raw.translate(None, b"0123456789"))
    shouts = sum(len(w) > 2 and w.isupper() for w in words)
    mixed = sum(not w.isalpha() and w.isalnum() for w in words) if digits else 0
    return [
        len(hits) / n, math.log1p(len(hits)), weight / n, seeded / n, disguised / n, math.log1p(disguised), len(stemmed) / n, math.log1p(len(stemmed)), most / n * math.log1p(most), len(persons) / n, near / n,
        capitals / max(letters, 1), shouts / n, raw.count(b"!") / n, raw.count(b"?") / n,
        (size - len(raw.translate(None, _PUNCTUATION))) / n, (size - len(raw.translate(None, _MARKS))) / n, mixed / n, digits / size,
    ]


def learnt_lexicon(sample: DataFrame, limit: int = 400, share: float = 0.02, odds: float = 3.0, stem_odds: float = 1.5) -> tuple[dict[bytes, float], Stems]:
    """Words, and word beginnings of 5 to 8 letters, that mark label 1 in a bounded sample(text, label).

    Each is held by `share` of the documents with label 1 (5 at least), and is rarer in the others by `odds` or `stem_odds` (logarithms). Counted in
    Spark; what passes, `limit` of either kind at most by weight, comes to the driver. A stem that begins with another is left out.
    """
    n0, n1 = (int(x or 0) for x in sample.agg(F.sum(1 - F.col("label")), F.sum("label")).first())
    if not n1:
        return {}, Stems([])
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_distinct(F.split(low, r"[\x00-\x60\x7B-\x7F]+"))
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))

    def marking(what: DataFrame, least: float) -> dict[bytes, float]:
        counts = what.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        found = counts.where(F.col("a") >= max(5, share * n1)).withColumn("weight", weight).where(F.col("weight") >= least)
        return {r["word"].encode(): float(r["weight"]) for r in found.orderBy(F.desc("weight"), "word").limit(limit).collect()}

    begins = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(5), F.lit(8)), lambda k: F.when(F.length(w) >= k, F.substring(w, 1, k))))))
    stems = marking(sample.select("label", F.explode(begins).alias("word")).where("word is not null"), stem_odds)
    shortest = [x for x in stems if not any(x != y and x.startswith(y) for y in stems)]
    return marking(sample.select("label", F.explode(words).alias("word")).where("word <> ''"), odds), Stems(shortest)


@dataclass
class Toxicity:
    """A fitted scorer: lexicon, trees and calibration knots. Its size is bounded by fit's parameters."""

    lexicon: dict[bytes, float]
    stems: Stems
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]
    informed: bool = True

    def scores(self, raw: list[bytes]) -> np.ndarray:
        seeds, second = (frozenset(w.encode() for w in s) for s in (SEEDS, SECOND))
        x = np.array([features(t, self.lexicon, self.stems, seeds, second) for t in raw]).reshape(-1, len(NAMES))
        return calibrated(self.trees.raw(x), self.knots)


def tells_apart(found: np.ndarray, y: np.ndarray, deviations: float = 3.0) -> bool:
    """Whether label 1 has higher scores than label 0 beyond chance: a rank sum so many standard deviations above its mean. Without rows of both labels, no."""
    ones, zeros = int((y > 0.5).sum()), int((y <= 0.5).sum())
    if not ones or not zeros:
        return False
    _, at, n = np.unique(found, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    above = ranks[y > 0.5].sum() - ones * (ones + 1) / 2 - ones * zeros / 2
    ties = (n.astype(float) ** 3 - n).sum() / ((ones + zeros) * max(ones + zeros - 1, 1))
    spread = np.sqrt(ones * zeros / 12 * max(ones + zeros + 1 - ties, 0))
    return bool(spread > 0 and above > deviations * spread)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = 12_000, fold: tuple[int, int] = (4, 2)) -> Toxicity:
    """Learns from at most `sample_rows` labelled rows, the least by a hash of doc_id, none of the held-out fold.

    A quarter of the sample, by another hash, is kept from the trees and calibrates them. Features are made in Spark tasks; only they,
    19 numbers a sampled row, come to the driver. Without labels of both kinds every score is the constant prior. The model is `informed` if it tells
    the labels of that quarter apart beyond chance; a caller that drops documents by its scores should ask.
    """
    small_batches(docs.sparkSession)
    sample = labelled_texts(docs, labels, label, *fold, sample_rows)
    lexicon, stems = learnt_lexicon(sample.where(F.xxhash64("doc_id", F.lit(1)) % 4 != 0))
    seeds, second = (frozenset(w.encode() for w in s) for s in (SEEDS, SECOND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x, lexicon, stems, seeds, second) for x in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2), batch.column(3)], names=["x", "label", "part", "o"])

    rows = sample.select("text", "label", (F.xxhash64("doc_id", F.lit(1)) % 4 == 0).alias("part"), F.xxhash64("doc_id").alias("o")).mapInArrow(run, "x array<double>, label int, part boolean, o bigint").toPandas().sort_values("o")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    y, late = rows["label"].to_numpy(float), rows["part"].to_numpy(bool)
    trees = fit_boosted(x[~late], y[~late])
    late_scores = trees.raw(x[late])
    return Toxicity(lexicon, stems, trees, isotonic(late_scores, y[late]), tells_apart(late_scores, y[late]))


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.3, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """docs with held_out, score and predicted. Null and empty texts have features of zero and so one common score; rows all stay. Columns of docs of those three names are replaced.

    One pass over whole texts in Arrow batches, without a shuffle; the model travels with the task.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(raw_texts(batch.column(batch.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    schema = docs.select(rest).schema.add("score", "double")
    out = docs.select(rest).mapInArrow(run, schema)
    return out.withColumns({"held_out": held_out(F.col("doc_id"), *fold), "predicted": (F.col("score") >= threshold).cast("int")})
