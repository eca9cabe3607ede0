"""Quality rules: text statistics and a decision list learnt from labels by sequential covering.

Rules are grown as conjunctions of thresholds on two thirds of a labelled sample, pruned on the rest, and emitted in order as one Spark
conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, labelled_texts, raw_texts, small_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits", "n_ends", "n_distinct", "n_marked_ends")
_SPACE, _SYMBOLS, _CAPITALS, _DIGITS, _ENDS = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".!?"
_MARKED = frozenset(b"#*$%&!|")

#: Derived statistics that rules may test: name and SQL expression over the counts.
RATES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "end_rate": "n_ends / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "marked_share": "n_marked_ends / greatest(n_words, 1)",
    "words_in_line": "n_words / greatest(n_lines, 1)",
    "words": "cast(n_words as double)",
}


def _counts(texts: list[bytes]) -> np.ndarray:
    """COUNTS of each text, a row for a text. Repeated windows are found for all texts of a chunk at once."""
    numbers: dict[bytes, int] = {}
    split = [x.split() for x in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    ids = np.array([numbers.setdefault(w, len(numbers)) for words in split for w in words], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(ids) > 2:
        base = len(numbers) + 1
        pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        inside = doc[:-2] == doc[2:]
        key = np.unique(pair[:-1] * base + ids[2:], return_inverse=True)[1] * np.int64(len(texts)) + doc[:-2]
        key[~inside] = -1
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.zeros(len(ids), bool)
        at = np.flatnonzero((times[where] > 1) & inside)
        for k in range(3):
            twice[at + k] = True
        out[:, 4] = np.bincount(doc, twice, len(texts))
        order = np.unique(doc * base + ids) // base
        out[:, 9] = np.bincount(order, minlength=len(texts))
    else:
        out[:, 9] = [len(set(x)) for x in split]
    for k, (raw, words) in enumerate(zip(texts, split, strict=True)):
        size = lambda gone, x=raw: len(x) - len(x.translate(None, gone))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        points = len(raw.decode("utf-8", "replace"))
        out[k, :4] = len(words), points - size(_SPACE), size(_SYMBOLS), len(lines) - len(set(lines))
        out[k, 5:9] = len(lines), size(_CAPITALS), size(_DIGITS), size(_ENDS)
        out[k, 10] = sum(w[-1] in _MARKED for w in words)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the COUNTS (BIGINT) in place of columns of those names and of `text`. Null texts count nothing."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text" and c not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_texts(batch.column(0))
            found = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *(_counts(raw[i:j]) for i, j in chunks(batch, raw, 1 << 20))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in np.ascontiguousarray(found.T))], names=[*rest, *COUNTS])

    schema = docs.select(rest).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return docs.select("text", *rest).mapInArrow(run, schema)


Test = tuple[str, str, float]  # statistic, "<=" or ">", threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests under which documents are rejected, with its training precision and cover."""

    tests: tuple[Test, ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(f"({RATES[name]}) {op} {threshold!r}D" for name, op, threshold in self.tests)


@dataclass(frozen=True)
class RuleList:
    """Ordered rules; the first that holds rejects, and what none rejects is kept."""

    rules: tuple[Rule, ...]

    def verdict(self) -> Column:
        """The number of the first rule that holds, from 1, as an ordered conditional expression; 0 if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(F.expr(rule.sql()), F.lit(k)) if out is None else out.when(F.expr(rule.sql()), F.lit(k))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _holds(x: np.ndarray, tests: list[tuple[int, bool, float]]) -> np.ndarray:
    held = np.ones(len(x), bool)
    for j, above, t in tests:
        held &= (x[:, j] > t) if above else (x[:, j] <= t)
    return held


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> list[tuple[int, bool, float]]:
    """Adds the test with the largest information gain on the covered rows, until no row of the other kind is left."""
    tests: list[tuple[int, bool, float]] = []
    held = np.ones(len(x), bool)
    while len(tests) < most and (y[held] == 0).any():
        p, n = int(y[held].sum()), int(held.sum())
        best, chosen = 1e-9, None
        for j in range(x.shape[1]):
            order = np.argsort(x[held, j], kind="stable")
            v, t = x[held, j][order], y[held][order]
            ends = np.flatnonzero(v[:-1] < v[1:])
            if not len(ends):
                continue
            below = np.cumsum(t)[ends]
            for above, pos, size in ((False, below, ends + 1), (True, p - below, n - ends - 1)):
                gain = pos * (np.log2((pos + 1e-9) / size) - np.log2((p + 1e-9) / n))
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = gain[k], (j, above, float((v[ends[k]] + v[ends[k] + 1]) / 2))
        if chosen is None:
            break
        tests.append(chosen)
        held = _holds(x, tests)
    return tests


def learn(x: np.ndarray, y: np.ndarray, names: list[str], precision: float = 0.85, least: int = 10, max_tests: int = 5, max_rules: int = 16) -> RuleList:
    """Sequential covering of y = 1. x: a row a document; every third row prunes.

    A grown rule is cut back to the leading tests that are most precise on the pruning rows (worth: (p - n) / (p + n), the shorter at a tie). It
    stays if it covers `least` rows with at least `precision` on all rows; else covering ends.
    """
    rules: list[Rule] = []
    late = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and y[left & ~late].sum() >= 1:
        tests = _grow(x[left & ~late], y[left & ~late], max_tests)
        if not tests:
            break

        def worth(k: int, tests: list = tests) -> float:
            held = _holds(x[left & late], tests[:k])
            p = float(y[left & late][held].sum())
            return (2 * p - held.sum()) / held.sum() if held.any() else -1.0

        tests = tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]
        held = _holds(x, tests) & left
        if held.sum() < least or y[held].mean() < precision:
            break
        rules.append(Rule(tuple((names[j], ">" if above else "<=", t) for j, above, t in tests), float(y[held].mean()), int(held.sum())))
        left &= ~held
    return RuleList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 12_000, fold: tuple[int, int] = (5, 0), **options) -> RuleList:
    """The decision list from at most `sample_rows` labelled rows (least by a hash of doc_id, outside the held-out fold).

    Statistics are counted in Spark; the sampled rows' rates alone, 11 numbers a row, come to the driver. Without labels there are no rules.
    """
    sample = statistics(labelled_texts(docs, labels, label, *fold, sample_rows))
    rows = sample.select("doc_id", "label", *[F.expr(e).alias(n) for n, e in RATES.items()]).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return learn(rows[list(RATES)].to_numpy(float), 1 - rows["label"].to_numpy(int), list(RATES), **options)


def apply_rules(docs: DataFrame, rules: RuleList, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """statistics(docs) with base_failed, rule (number of the rule that rejects, 0: none) and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in repeated windows; such documents are not
    kept whatever the rules say. Null and empty texts have no words and fail the base. Every row returns once.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rated = statistics(docs).withColumns({"base_failed": failed, "rule": rules.verdict()})
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
