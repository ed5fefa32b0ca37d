"""Tables that are merged into by batches, laid out in buckets of a key's place.

Every bucket has versions; a batch writes new versions of the buckets that it touches and reads those alone, as they were
before it. A manifest a batch says which version of each bucket counts, so a batch that is run again overwrites its own
versions and readers never see half of one. Where the bucket is a range of an order that batches follow (slots, blocks),
what a batch costs stays level however long the table's history is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def by_range(column: str, bits: int) -> Callable[[DataFrame], Column]:
    """Buckets of 2**bits consecutive values."""
    return lambda df: F.shiftright(df[column].cast("bigint"), bits)


def by_hash(columns: list[str], buckets: int) -> Callable[[DataFrame], Column]:
    return lambda df: F.pmod(F.xxhash64(*[df[c] for c in columns]), F.lit(buckets)).cast("bigint")


class BucketedTable:
    """``bucket(frame)`` gives each row's bucket. Merges add and change rows; a touched bucket keeps one row at least."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket: Callable[[DataFrame], Column]) -> None:
        self.spark, self.path, self.schema, self.bucket = spark, path, schema, bucket

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch; as many numbers as it touches."""
        return sorted(r[0] for r in batch.select(self.bucket(batch)).distinct().collect())

    def manifest(self, before: int | None = None) -> DataFrame:
        """bucket, version as of the last batch, or of the last one before ``before``."""
        try:
            known = self.spark.read.schema("bucket bigint, version bigint, batch bigint").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], "bucket bigint, version bigint")
        known = known if before is None else known.where(F.col("batch") < before)
        last = known.agg(F.max("batch")).first()[0]
        return known.where(F.col("batch") == F.lit(last)).select("bucket", "version")

    def read(self, touched: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of these buckets (of all, if None): only their files are listed and opened."""
        known = self.manifest(before)
        known = known if touched is None else known.where(F.col("bucket").isin(touched))
        paths = [f"{self.path}/rows/bucket={b}/version={v}" for b, v in known.collect()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, touched: list[int], number: int) -> None:
        """``rows``: all rows of the touched buckets, brought together by bucket, so that files grow with buckets and not with buckets
        times tasks. The manifest comes last: it is what makes the versions count."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        placed = rows.withColumns({"bucket": self.bucket(rows), "version": F.lit(number)})
        placed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/rows")
        kept = self.manifest(number).where(~F.col("bucket").isin(touched)) if touched else self.manifest(number)
        new = self.spark.createDataFrame([(b, number) for b in touched], "bucket bigint, version bigint")
        kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")

    def merge(self, batch: DataFrame, number: int, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``rule(stored rows, batch)`` over the touched buckets, as they were before batch ``number``."""
        touched = self.touched(batch)
        if touched:
            self.write(rule(self.read(touched, number), batch), touched, number)
