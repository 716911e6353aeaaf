"""Keyed parquet tables of which a merge rewrites only what it touches.

Rows lie in buckets of their key's hash. A merge reads and rewrites the buckets of the
incoming keys under a new version folder, then commits a manifest that names the folder of
every bucket. Readers follow the newest committed manifest, so a merge that fails half-way is
never seen, and one that is repeated under the same tag changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.session import persist_table
from rivalry.sources.sinks import merge_records

BUCKETS = 64


class KeyedTable:
    """A table below ``path`` with one row per key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifests(self) -> list:
        """(version, tag, bucket, folder) of all commits; at most ``buckets`` rows each, empty before the first."""
        try:
            return self.spark.read.schema("version int, tag string, bucket int, folder int").json(f"{self.path}/manifest/*").collect()
        except AnalysisException:  # no such path yet
            return []

    def current(self, rows: list | None = None) -> dict[int, int]:
        """Bucket -> version folder that holds it."""
        rows = self.manifests() if rows is None else rows
        newest = max((r["version"] for r in rows), default=-1)
        return {r["bucket"]: r["folder"] for r in rows if r["version"] == newest and r["bucket"] >= 0}

    def create(self, df: DataFrame, tag: str = "create") -> None:
        if not self.manifests():
            df.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")  # also an empty table keeps its columns
            self._write(self._numbered(df).repartition("bucket"), tag, 0, {})

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        held = {b: v for b, v in self.current().items() if buckets is None or b in buckets}
        by_folder: dict[int, list[int]] = {}
        for b, v in held.items():
            by_folder.setdefault(v, []).append(b)
        schema = self.spark.read.parquet(f"{self.path}/columns").schema
        if not by_folder:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}/bucket={b}" for b in sorted(bs)])
                 for v, bs in sorted(by_folder.items())]
        return reduce(DataFrame.unionByName, parts).select(*schema.names)

    def merge(self, incoming: DataFrame, tag: str, order: str | None = None) -> list[int]:
        """Replaces or adds the incoming rows; returns the buckets rewritten, none for a tag that is already in."""
        rows = self.manifests()
        if any(r["tag"] == tag for r in rows):
            return []
        incoming = persist_table(incoming)  # read for its buckets and again for the merge
        touched = [r[0] for r in incoming.select(self._bucket()).distinct().collect()]  # at most `buckets` rows
        # the rows are dealt out by bucket once: merging by (bucket, key) and writing both read that exchange
        old, new = (self._numbered(d) for d in (self.read(touched), incoming))
        merged = merge_records(old, new, ["bucket", *self.keys], order, deal="bucket")
        self._write(merged, tag, max(r["version"] for r in rows) + 1, self.current(rows))
        return sorted(touched)

    def _numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", self._bucket())

    def _write(self, df: DataFrame, tag: str, version: int, held: dict[int, int]) -> None:
        """``df`` is dealt out by bucket. Data first, then the manifest; both are overwritten when a failed attempt is repeated."""
        folder = f"{self.path}/data/version={version}"
        df.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = [r[0] for r in self.spark.read.schema("bucket int").parquet(folder).distinct().collect()]  # at most `buckets` rows
        rows = [(version, tag, b, v) for b, v in sorted((held | {b: version for b in written}).items())]
        commit = self.spark.createDataFrame(rows or [(version, tag, -1, version)], "version int, tag string, bucket int, folder int")
        commit.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{version:09d}")
