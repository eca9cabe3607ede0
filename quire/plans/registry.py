"""All queries of the library outside the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "c03_chunk_source_block"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with DuckDB SQL for its rows where there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from quire.plans import content, contracts, evaluation, extraction, governance, mapping, packages, policy, projections, structure, summaries, values  # noqa: E402, F401
