"""Tables stored in key buckets, so that a batch rewrites only the buckets it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedlake.session import materialize
from feedlake.sources.sinks import delete_folder, folder_names, read_latest, versions, write_next

MANIFEST = "bucket INT, version BIGINT"


@dataclass(frozen=True)
class BucketTable:
    """A table below ``path``, dealt into ``buckets`` by a hash of ``key``.

    A version holds the files of the buckets it changed; its manifest names the version of every
    bucket that has rows. The manifest is written last, so readers see a version as a whole.
    Writing a version again replaces it. A manifest has one row per bucket, so it may be read by the driver.
    """

    path: str
    key: str
    schema: str
    buckets: int = 256

    def bucket(self, key: str | None = None) -> Column:
        """The bucket of a row by the column named ``key``."""
        return F.pmod(F.xxhash64(key or self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, spark: SparkSession, below: int | None = None) -> dict[int, int]:
        """Bucket to version, of the newest version or the newest before ``below``."""
        rows = read_latest(spark, f"{self.path}/manifest", MANIFEST, below).collect()
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, spark: SparkSession, below: int | None = None, only: set[int] | None = None) -> DataFrame:
        """All rows, or those of the buckets ``only``; no other file is opened."""
        held = self.manifest(spark, below)
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame, key: str | None = None) -> set[int]:
        """Buckets that the keys of ``rows`` lie in."""
        return {r[0] for r in rows.select(self.bucket(key)).distinct().collect()}

    def lookup(self, keys: DataFrame, below: int | None = None) -> DataFrame:
        """Rows whose key is among the distinct ``keys``, read from their buckets only."""
        spark = keys.sparkSession
        return self.read(spark, below, self.touched(keys)).join(keys.select(self.key), self.key, "left_semi")

    def get(self, spark: SparkSession, value) -> DataFrame:
        """The rows of one key.

        One bucket is opened; it is sorted by the key and has Bloom filters on it, and the key is compared in its
        stored type, so the filter is pushed down and skips row groups.
        """
        one = spark.createDataFrame([(value,)], f"{self.key} {self._key_type()}")
        same = F.col(self.key) == F.lit(value).cast(self._key_type())
        return self.read(spark, None, self.touched(one)).where(same)

    def _key_type(self) -> str:
        return dict(self._fields())[self.key]

    def _fields(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(self.schema)]

    def typed(self, rows: DataFrame) -> DataFrame:
        """The table's columns of ``rows``, in the table's types."""
        return rows.select(*(F.col(name).cast(kind) for name, kind in self._fields()))

    def upsert(self, rows: DataFrame, version: int, gone: DataFrame | None = None, keys: DataFrame | None = None) -> set[int]:
        """Version ``version``: ``rows`` replace those with their key, keys of ``gone`` are left out.

        ``rows`` has unique keys. Returns the buckets written. A bucket may be larger than a task: Spark
        splits it by size. With ``keys``, a stored table with the keys of ``rows``, the rows are made once,
        as they are written, and not stored in between.
        """
        spark = rows.sparkSession
        rows = self.typed(rows)
        if keys is None:
            keys = rows = materialize(rows)
        out = keys.select(F.col(self.key).cast(self._key_type()))
        if gone is not None:
            gone = materialize(gone.select(self.key).distinct())
            out = out.unionByName(gone)
        touched = self.touched(out)
        held = self.manifest(spark, version)
        if touched:
            kept = self.read(spark, version, touched).join(out, self.key, "left_anti")
            whole = kept.unionByName(rows).withColumn("bucket", self.bucket())
            dealt = whole.hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
            filters = {f"parquet.bloom.filter.enabled#{self.key}": "true"}
            dealt.write.mode("overwrite").options(**filters).partitionBy("bucket").parquet(f"{self.path}/v={version}")
            written = {int(n.partition("=")[2]) for n in folder_names(spark, f"{self.path}/v={version}") if n.startswith("bucket=")}
            held = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(written, version)
        write_next(spark.createDataFrame(sorted(held.items()), MANIFEST).coalesce(1), f"{self.path}/manifest", version)
        return touched

    def drop_unused(self, spark: SparkSession, keep: int = 2) -> list[int]:
        """Delete versions that none of the newest ``keep`` manifests names; returns them."""
        known = versions(spark, f"{self.path}/manifest")
        used = {v for n in known[-keep:] for v in self.manifest(spark, n + 1).values()}
        stored = [int(n[2:]) for n in folder_names(spark, self.path) if n.startswith("v=")]
        old = sorted(v for v in stored if v not in used and v not in known[-keep:])
        for v in known[:-keep]:
            delete_folder(spark, f"{self.path}/manifest/v={v}")
        for v in old:
            delete_folder(spark, f"{self.path}/v={v}")
        return old
