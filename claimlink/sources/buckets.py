"""Stored tables whose rows are replaced bucket by bucket."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Buckets:
    """Rows dealt to n buckets by the hash of a key. `folder/version=V/bucket=B` holds all rows of bucket B as of version V.

    Whoever writes version V reads what is below V, so a job that is repeated with its version replaces what it wrote before, and one
    that breaks off leaves the versions below as they were. A version holds the buckets that changed only; the others' files stay.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, n: int = 64) -> None:
        self.spark, self.folder, self.key, self.n = spark, folder.rstrip("/"), key, n

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def of(self, keys: DataFrame) -> list[int]:
        """The buckets of these keys: n numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version=*/bucket=*")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        out: dict[int, list[int]] = {}
        for status in found or []:
            version, bucket = (int(p.split("=")[1]) for p in status.getPath().toString().rsplit("/", 2)[1:])
            out.setdefault(bucket, []).append(version)
        return {b: sorted(v) for b, v in out.items()}

    def paths(self, buckets: Iterable[int] | None = None, below: int | None = None) -> list[str]:
        """Where the last version (below a version) of these buckets, by default of all, lies."""
        wanted = None if buckets is None else set(buckets)
        last = {b: max((v for v in vs if below is None or v < below), default=None) for b, vs in self.versions().items() if wanted is None or b in wanted}
        return [f"{self.folder}/version={v}/bucket={b}" for b, v in sorted(last.items()) if v is not None]

    def read(self, schema: T.StructType, buckets: Iterable[int] | None = None, below: int | None = None) -> DataFrame:
        paths = self.paths(buckets, below)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def schema(self) -> T.StructType | None:
        """That of the files, null where there are none."""
        paths = self.paths()
        return self.spark.read.parquet(paths[0]).schema if paths else None

    def write(self, rows: DataFrame, version: int, buckets: Iterable[int]) -> None:
        """Writes rows, all there is in these buckets, as their new version. A bucket with many rows is written by several tasks."""
        to = f"{self.folder}/version={version}"
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(to)
        there = {b for b, vs in self.versions().items() if version in vs}
        for empty in set(buckets) - there:  # else the version before would still count
            self.spark.createDataFrame([], rows.schema).repartition(1).write.mode("overwrite").parquet(f"{to}/bucket={empty}")

    def sweep(self, version: int) -> None:
        """Deletes what neither a reader nor a repetition of this version needs: of each bucket, versions before the last one below it."""
        for bucket, versions in self.versions().items():
            for old in [v for v in versions if v < version][:-1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version={old}/bucket={bucket}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
