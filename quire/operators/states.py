"""Records kept by appending: latest rows, state machines, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """The last row of each key; an aggregate with partial results, so a hot key is a row a task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def drift(frozen: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): missing, unexpected, changed or same, by a full outer join."""
    a, b = frozen.select(F.col(key).alias("_a"), F.col(value).alias("_x")), actual.select(F.col(key).alias("_b"), F.col(value).alias("_y"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_x") != F.col("_y"), "changed").otherwise("same")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def packs(pairs: DataFrame) -> DataFrame:
    """(target, aliases): sorted distinct aliases of each target."""
    return pairs.groupBy("target").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def collisions(pairs: DataFrame) -> DataFrame:
    """(alias, targets): aliases that several targets claim."""
    return pairs.groupBy("alias").agg(F.count_distinct("target").alias("targets")).where("targets > 1")
