"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as the small Parquet files that their tasks write. Runs of similar size (of one tier) are merged
into files near the target size. A version of the store is a manifest, a JSON file that lists its shards. Where rename
refuses a name that exists, the manifest is written under a temporary name and renamed; on object stores it is put under
its name on the condition that there is none. Either way a version appears whole or not at all, and a writer that lost the
race fails instead of overwriting. Readers see one version; replaced files stay for a while, then expire() removes them.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, growth: float = 4.0):
        """fan_in: runs of a tier that make a merge due; growth: ratio of sizes from a tier to the next."""
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.growth = target_bytes, fan_in, growth
        self.fs, self.to_path = common.hadoop_fs(spark, self.path)

    # versions

    def version(self) -> int:
        """Of the last manifest; 0 where there is none."""
        at = self.to_path(self.path)
        if not self.fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(at)]
        return max([0, *(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"path", "bytes"}]}; an empty store has no shards."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self.to_path(f"{self.path}/manifest-{version:012d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw)

    def commit(self, base: int, schema: str, shards: list[dict]) -> int:
        """Make `shards` version base + 1; fails if that version is there already."""
        version = base + 1
        name = self.to_path(f"{self.path}/manifest-{version:012d}.json")
        body = bytearray(json.dumps({"version": version, "schema": schema, "shards": shards}).encode())
        try:
            if name.toUri().getScheme() in ("file", "hdfs", "viewfs", None):  # rename never replaces a file there
                draft = self.to_path(f"{self.path}/.draft-{uuid.uuid4().hex}")
                self._put(draft, body)
                won = not self.fs.exists(name) and self.fs.rename(draft, name)
                self.fs.delete(draft, False)
            else:  # an object store shows an object whole or not at all; overwrite=False makes the put conditional
                self._put(name, body)
                won = True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            won = False
        if not won:
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def _put(self, at, body: bytearray) -> None:
        out = self.fs.create(at, False)
        out.write(body)
        out.close()

    def expire(self, keep_seconds: float = 7 * 86400.0) -> int:
        """Delete files that the last version doesn't list and that are older than `keep_seconds`: those that a merge
        replaced, for readers of older versions, and those of writers that failed. Returns how many."""
        kept = {s["path"] for s in self.manifest()["shards"]}
        limit, gone = (time.time() - keep_seconds) * 1000, 0
        for folder in self.fs.listStatus(self.to_path(self.path)):
            if folder.isDirectory() and folder.getPath().getName().startswith("run-"):
                for f in self.fs.listStatus(folder.getPath()):
                    if f.getPath().getName().startswith("part-") and f.getPath().toString() not in kept and f.getModificationTime() <= limit:
                        self.fs.delete(f.getPath(), False)
                        gone += 1
        return gone

    # shards

    def _written(self, folder: str) -> list[dict]:
        files = sorted((f.getPath().toString(), f.getLen()) for f in self.fs.listStatus(self.to_path(folder)) if f.getPath().getName().startswith("part-"))
        return [{"path": p, "bytes": n} for p, n in files]

    def _folder(self) -> str:
        return f"{self.path}/run-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> int:
        """Add arrivals; every task's part becomes a shard. Rows stay as they are, repeated ones and nulls too."""
        now = self.manifest()
        folder = self._folder()
        rows.write.parquet(folder)
        return self.commit(now["version"], now["schema"] or rows.schema.json(), now["shards"] + self._written(folder))

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / 65536, self.growth)))

    def due(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: from the smallest tier up, where a tier holds fan_in shards, neighbours by size fill a group
        up to the target. Shards at or near the target stay."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < 0.75 * self.target_bytes:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        groups = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fan_in:
                continue
            group, size = [], 0
            for s in sorted(own, key=lambda s: (s["bytes"], s["path"])):
                if group and size + s["bytes"] > 1.25 * self.target_bytes:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s["bytes"]
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, per_job: int = 256) -> int:
        """Merge until no tier is due; returns the last version.

        A group is read as one partition and written as one file, without a shuffle; a job writes many groups. Replaced
        files stay until expire(), so that readers of older versions aren't disturbed.
        """
        while True:
            now = self.manifest()
            groups = self.due(now["shards"])[:per_job]
            if not groups:
                return now["version"]
            read = self._reader(now["schema"])
            folder = self._folder()
            parts = [read.parquet(*[s["path"] for s in g]).coalesce(1) for g in groups]
            reduce(DataFrame.union, parts).write.parquet(folder)
            gone = {s["path"] for g in groups for s in g}
            self.commit(now["version"], now["schema"], [s for s in now["shards"] if s["path"] not in gone] + self._written(folder))

    @staticmethod
    def _schema(schema: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(schema))

    def _reader(self, schema: str):
        return self.spark.read.schema(self._schema(schema))

    def read(self, version: int | None = None, name: str | None = None) -> DataFrame:
        """All rows of a version; with their shard's file in a column `name`, which the rows mustn't have, where one is given."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("the store has no version")
        if not now["shards"]:
            rows = self.spark.createDataFrame([], self._schema(now["schema"]))
        else:
            rows = self._reader(now["schema"]).parquet(*[s["path"] for s in now["shards"]])
        if name is None:
            return rows
        if name.lower() in {c.lower() for c in rows.columns}:
            raise ValueError(f"the rows have a column {name} of their own")
        return rows.select("*", F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1).alias(name))


def shard(rows: DataFrame, path: str | None = None, name: str | None = None, **settings) -> tuple[ShardStore, DataFrame]:
    """Append rows to a (new) store, compact it and read it back. An empty table gives an empty read of its schema."""
    spark = rows.sparkSession
    store = ShardStore(spark, path or common.fresh_dir(spark, "shards"), **settings)
    store.append(rows)
    store.compact()
    return store, store.read(name=name)
