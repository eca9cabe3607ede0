"""Tables that outlive a stage: written to the folder that every executor shares, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quire-"))
    return _own_dir[0]


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here, and a lost executor costs only a read. options: of the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables that written() made, once everything that reads them is written itself; other DataFrames are left alone."""
    for df in tables:
        path = df.__dict__.pop("_written_to", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
