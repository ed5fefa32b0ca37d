"""Readers and writers with explicit schemas; sinks that a stream's batches can call again without harm."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A partitioned read on a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), **options).load()


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def large_rows(spark: SparkSession) -> None:
    """Parquet's writer looks at the size of a page and of a row group after each row at first, not only after 100 rows, which is
    hundreds of MB of a task's memory where a row has some MB. Holds for the session; what is written has the same rows."""
    for part in ("page", "block"):
        spark.conf.set(f"parquet.{part}.size.row.check.min", "1")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; under a local folder where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="spark-slotline-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/ledger-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read back: cuts lineage and outlives a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
