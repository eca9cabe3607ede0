"""Canonical forms that have no built-in expression: sorted JSON and folded labels, in Arrow batches."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed keys that say how a conversion ran and not what it gave.
OPERATIONAL_KEYS = (
    "task_id", "package_id", "created_at", "started_at", "finished_at", "duration", "duration_ms", "absolute_path", "zip_path", "mapping_id", "candidate_id",
    "review_id", "chunk_id", "source_chunk_ids", "input_mode", "mapping_input_name", "execution_option_warnings",
)
_LABEL_MARKS = re.compile(r"[\s:：\-_/（）()]+")


@F.pandas_udf(StringType())
def normalize_label(labels: pd.Series) -> pd.Series:
    """A label in NFKC without white space and marks; null stays null."""
    return labels.map(lambda x: None if x is None else _LABEL_MARKS.sub("", unicodedata.normalize("NFKC", x)))


def _plain(value: object, dropped: frozenset[str]) -> object:
    if isinstance(value, dict):
        return {k: _plain(v, dropped) for k, v in value.items() if k not in dropped}
    if isinstance(value, list):
        return [_plain(v, dropped) for v in value]
    return value.replace("\r\n", "\n").replace("\r", "\n") if isinstance(value, str) else value


def canonical_json(payload: Column, dropped: tuple[str, ...] = ()) -> Column:
    """JSON with sorted keys, compact separators and plain line ends, without the keys `dropped` at any depth; null where it is no JSON."""
    gone = frozenset(dropped)

    @F.pandas_udf(StringType())
    def run(payloads: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else json.dumps(_plain(json.loads(x), gone), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return payloads.map(one)

    return run(payload)
