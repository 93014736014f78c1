"""A table that takes change sets by key: buckets by a hash of the key, of which a change set rewrites those it touches.

The table is a folder of Parquet buckets. A change set (rows with `op`, delete or anything else for an upsert) is reduced to the
last row of each key, the touched buckets are read and merged, the result is settled beside the table, and dynamic partition
overwrite puts it in their place; buckets that lost all rows are removed. Applying a change set twice gives the same table, so
a batch that Spark repeats after a failure does no harm. One writer at a time; readers that list the folder during a write may
see buckets of either state.

Defined results: null keys are keys like others; of several changes of a key the last in `order` counts; deleting a key that
isn't there changes nothing; an empty change set leaves the table as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, StructType

from sparkloom.session import settle

BUCKETS = 64


class KeyedTable:
    """A folder, its columns (DDL text or a schema) and the columns that are its key."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _folder(self, bucket: int | None = None):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if bucket is None else f"{self.path}/bucket={bucket}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        whole = StructType([*self.schema.fields]).add("bucket", IntegerType())
        files, where = self._folder()
        return self.spark.read.schema(whole).parquet(self.path) if files.exists(where) else self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def apply(self, changes: DataFrame, order: Sequence[str | Column]) -> list[int]:
        """Merge a change set; gives the buckets that were rewritten."""
        columns = self.schema.names
        last = Window.partitionBy(*self.keys).orderBy(*order)
        #: ordered from the last change on
        final = changes.withColumn("__at", F.row_number().over(last)).where(F.col("__at") == 1).select(*columns, (F.col("op") == "delete").alias("__gone"), self._bucket().alias("bucket"))
        final = settle(final)
        touched = sorted(r["bucket"] for r in final.select("bucket").distinct().collect())  # `buckets` numbers at most
        if not touched:
            return []
        old = self._stored().where(F.col("bucket").isin(touched)).alias("o")
        same = F.col("o.bucket") == F.col("c.bucket")
        for k in self.keys:
            same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"c.{k}"))
        kept = old.join(final.select("bucket", *self.keys).alias("c"), same, "left_anti")
        merged = settle(kept.select(*columns, "bucket").unionByName(final.where(~F.col("__gone")).select(*columns, "bucket")))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        filled = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
        for b in touched:
            if b not in filled:
                files, where = self._folder(b)
                files.delete(where, True)
        return touched


def write_changes(stream: DataFrame, table: KeyedTable, order: Sequence[str | Column], checkpoint: str) -> DataStreamWriter:
    """A stream of change sets into a keyed table, a batch at a time; start it with a trigger."""
    return stream.writeStream.foreachBatch(lambda batch, _: table.apply(batch, order) and None).option("checkpointLocation", checkpoint)
