"""Batches that count once they are committed, and their compaction.

A writer first writes the folders of a batch and then publishes one small commit that names them: readers see all of a batch or
nothing. A batch that failed before its commit is written again under its number. Compaction folds the committed batches into a base
and publishes that like a batch; from then on readers open the base and what came later, however many batches there were.

Commits are files ``<root>.commits/<number>.json`` (a base: ``<number>.base.json``), moved into place as a whole. One writer at a
time, as batch numbers are its own count.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Batches:
    """The committed batches below ``root``; parts of a batch (``data``, ``errors``) lie in folders of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = f"{self.root}.commits"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[tuple[int, bool, str]]:
        """(number, is a base, path) of all commits, by number; a base follows the batch of its number."""
        fs, log = self._fs(), self._path(self.log)
        if not fs.exists(log):
            return []
        found = [str(s.getPath().toString()) for s in fs.listStatus(log)]
        named = [(p.rsplit("/", 1)[-1], p) for p in found if p.endswith(".json") and "/." not in p]
        return sorted((int(name.split(".")[0]), ".base." in name, p) for name, p in named)

    def _current(self) -> list[tuple[int, bool, str]]:
        commits = self._commits()
        last = max((i for i, c in enumerate(commits) if c[1]), default=0)
        return commits[last:]

    def last(self) -> int:
        """Number of the last committed batch; -1 before the first."""
        return max((c[0] for c in self._commits()), default=-1)

    def folder(self, number: int, part: str) -> str:
        return f"{self.root}/{part}/batch={number}" if part != "data" else f"{self.root}/batch={number}"

    def publish(self, number: int, folders: dict[str, str], rows: dict[str, int], base: bool = False) -> bool:
        """Makes a written batch visible; False if its number is taken (a repeated attempt that had been committed)."""
        fs, text = self._fs(), json.dumps({"number": number, "folders": folders, "rows": rows})
        target = self._path(f"{self.log}/{number:012d}{'.base' if base else ''}.json")
        fs.mkdirs(self._path(self.log))
        if fs.exists(target):
            return False
        draft = self._path(f"{self.log}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        return bool(fs.rename(draft, target))

    def commits(self) -> list[dict]:
        """Contents of the last base and of the batches after it."""
        paths = [p for _, _, p in self._current()]
        if not paths:
            return []
        texts = self.spark.read.text(paths, wholetext=True).collect()  # one small file per batch since the last compaction
        return sorted((json.loads(r.value) for r in texts), key=lambda c: c["number"])

    def read(self, part: str = "data") -> DataFrame | None:
        """Rows of a part of all committed batches with ``batch``, the number of the batch each came with; None if there are none."""
        folders = [(c["number"], c["folders"][part]) for c in self.commits() if part in c["folders"]]
        base = [f for _, f in folders if f.startswith(f"{self.root}.base/")]
        plain = [f for _, f in folders if f not in base]
        frames = [self.spark.read.parquet(f) for f in base]
        if plain:
            above = plain[0].rsplit("/", 1)[0]
            frames.append(self.spark.read.option("basePath", above).parquet(*plain).withColumn("batch", F.col("batch").cast("long")))
        return None if not frames else frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1], allowMissingColumns=True)

    def compact(self, key: list[str], parts: tuple[str, ...] = ("data",), clean: bool = True) -> int:
        """Folds all committed batches into a base that holds the latest row of each key; returns the number it reaches.

        Readers that began before go on with the old folders; ``clean`` removes those (leave it out while such readers run).
        """
        old, reach = self._current(), self.last()
        contents = self.commits()
        if len(contents) < 2:
            return reach
        folders = {}
        for part in parts:
            rows = self.read(part)
            if rows is not None:
                folders[part] = f"{self.root}.base/{part}-{reach}-{uuid.uuid4().hex}"
                latest(rows, key).write.parquet(folders[part])
        if not self.publish(reach, folders, {}, base=True):
            return reach
        if clean:
            fs = self._fs()
            for c in contents:
                for folder in c["folders"].values():
                    fs.delete(self._path(folder), True)
            for _, _, path in old:
                fs.delete(self._path(path), False)
        return reach


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The row of the highest ``batch`` of every key, with that batch."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*", "batch")
