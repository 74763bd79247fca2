"""A keyed snapshot in buckets: a merge reads and writes only the buckets that its keys fall into.

Rows lie in a fixed number of buckets by the hash of their key; rows without a whole key, which match nothing, have further buckets of
their own. A version is one small file that names the folder, rows and first and last key of each bucket. A merge writes new
folders for the buckets it touches and publishes a version that keeps the others, so readers of an older version are not disturbed and
a merge that fails before its version leaves nothing behind that a reader sees. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stampbook.operators import changes

#: Buckets in which rows without a whole key are spread by their values.
BARE = 8


class Buckets:
    """The snapshot below ``root``; made once by ``create``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, place = self._fs(), self._path(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """key, n, schema, and buckets: {bucket: [folder, rows, first key, last key]} of a version (the last)."""
        version = self.versions()[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:09d}.json", wholetext=True).first().value)

    def _publish(self, content: dict) -> None:
        fs, number = self._fs(), (self.versions() or [-1])[-1] + 1
        draft, target = self._path(f"{self.root}/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/versions/{number:09d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.mkdirs(self._path(f"{self.root}/versions"))
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"version {number} was written by another writer")

    @staticmethod
    def bucket(df: DataFrame, key: list[str], n: int, columns: list[str]) -> Column:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        bare = F.pmod(F.xxhash64(*columns), F.lit(BARE)) + n
        return F.when(whole, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(n))).otherwise(bare).cast("int")

    def _write(self, df: DataFrame, key: list[str], n: int) -> dict[str, list]:
        """Writes rows by bucket; {bucket: [folder, rows, first key, last key]}. One file per bucket and version, or few where a
        bucket is large."""
        folder = f"{self.root}/rows/{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket(df, key, n, df.columns))
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        ends = F.struct(*[F.col(k).cast("string") for k in key])
        stored = self.spark.read.schema(rows.schema).parquet(folder).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.to_json(F.min(ends)).alias("a"), F.to_json(F.max(ends)).alias("b"))
        return {str(r["_bucket"]): [f"{folder}/_bucket={r['_bucket']}", r.n, r.a, r.b] for r in stored.collect()}  # one row per bucket

    def create(self, df: DataFrame, key: list[str], n: int = 256) -> None:
        if self.versions():
            raise ValueError(f"{self.root} holds a snapshot")
        self._publish({"key": key, "n": n, "schema": df.schema.json(), "buckets": self._write(df, key, n)})

    def _rows(self, content: dict, buckets: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(content["schema"]))
        folders = [content["buckets"][b][0] for b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        content = self.manifest(version)
        return self._rows(content, sorted(content["buckets"]))

    def merge(self, inc: DataFrame, update: list[str], **options) -> DataFrame:
        """Merges ``inc`` into a new version by ``changes.merge`` (same options); counts per ``accion`` over the touched buckets.

        Rows of other buckets are neither read nor written: all of them are ``sin_cambio``.
        """
        content = self.manifest()
        key, n = content["key"], content["n"]
        held = [c for c in json.loads(content["schema"])["fields"]]
        columns = [c["name"] for c in held]
        mine = self.bucket(inc, key, n, [c for c in inc.columns if c in columns])
        touched = sorted(str(r.b) for r in inc.select(mine.alias("b")).distinct().collect())  # n buckets at most
        cur = self._rows(content, [b for b in touched if b in content["buckets"] and int(b) < n])
        merged = changes.merge(cur, inc, key, update, **options)
        folder = f"{self.root}/merged/{uuid.uuid4().hex}"
        merged.write.parquet(folder)
        merged = self.spark.read.schema(merged.schema).parquet(folder)
        added = self._write(merged.drop("accion").select(columns), key, n)
        kept = {b: x for b, x in content["buckets"].items() if b not in touched or int(b) >= n}
        for b in [b for b in added if int(b) >= n]:  # rows without a whole key only come in addition
            if b in kept:
                old = self._rows(content, [b]).unionByName(self._rows({**content, "buckets": added}, [b]))
                added |= self._write(old, key, n)
        self._publish({**content, "buckets": {**kept, **added}})
        return changes.action_counts(merged)
