"""Stores of several tables whose readers always see one state.

A store is a folder: each table of each version lies in a folder of its own that
nothing writes again, and a manifest for each version, numbered upwards, names
these folders and the state that the version was made from.  Readers take the
manifest with the highest number.  A manifest comes into being by the rename of
a finished file to a name that is not there, so a failed write leaves readers
where they were, and of two writers of one version one fails.  The folder must
be on a file system whose rename is atomic and refuses a name that exists
(HDFS, a mounted folder).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Manifest = dict


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of a version, the newest by default; None for a store that has none."""
        versions = self._versions()
        if not versions:
            return None
        text = self.spark.read.text(f"{self.root}/manifests/{version or versions[-1]:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _switch(self, after: Manifest | None, **content) -> Manifest:
        made = {"version": (after["version"] if after else 0) + 1, **content}
        fresh = self._path(f"{self.root}/manifests/new-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        final = self._path(f"{self.root}/manifests/{made['version']:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            self._fs.delete(fresh, False)
            raise FileExistsError(f"version {made['version']} of {self.root} has been written by another job")
        return made

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, dict]:
        out = {}
        for name, df in tables.items():
            folder = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folder}")
            out[name] = {"schema": df.schema.json(), "folders": [folder]}
        return out

    def replace(self, tables: dict[str, DataFrame], state: str = "") -> Manifest:
        """A version with exactly these tables; they may be made from tables of the store itself.  No tables: an empty store."""
        now = self.manifest()
        return self._switch(now, state=state, batches=[], tables=self._write(tables))

    def append(self, tables: dict[str, DataFrame], batch: str, state: str = "") -> Manifest:
        """A version with these rows added.  A batch that a version of the store already holds is not written again."""
        now = self.manifest()
        if now and batch in now["batches"]:
            return now
        held = now["tables"] if now else {}
        written = self._write(tables)
        for name, new in written.items():
            if name in held and held[name]["schema"] != new["schema"]:
                raise ValueError(f"table {name} has another schema")
        joined = {n: {"schema": t["schema"], "folders": t["folders"] + written.get(n, {"folders": []})["folders"]} for n, t in held.items()}
        return self._switch(now, state=state, batches=[*(now["batches"] if now else []), batch], tables={**written, **joined})

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """A table of a version, the newest by default.  Pass one manifest to several reads and they see one state."""
        from pyspark.sql.types import StructType

        manifest = manifest or self.manifest()
        if not manifest or name not in manifest["tables"]:
            raise KeyError(f"{self.root} has no table {name}")
        table = manifest["tables"][name]
        return self.spark.read.schema(StructType.fromJson(json.loads(table["schema"]))).parquet(*(f"{self.root}/{f}" for f in table["folders"]))

    def fresh(self, state: str, make: Callable[[], dict[str, DataFrame]]) -> Manifest:
        """The newest version if it was made from ``state``, else a new one from ``make()``."""
        now = self.manifest()
        return now if now and now["state"] == state else self.replace(make(), state)

    def clean(self, keep: int = 2) -> None:
        """Deletes folders that none of the newest ``keep`` versions names; for times without writers or readers of older ones."""
        versions = self._versions()
        used = {f for v in versions[-keep:] for t in self.manifest(v)["tables"].values() for f in t["folders"]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:012d}.json"), False)
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in used:
                self._fs.delete(s.getPath(), True)


def state_of(records: DataFrame) -> str:
    """A key of a table's rows, whatever their order and partitions: their number and two sums of their digests.

    Arrays, maps and structs count by their JSON.
    """
    row = F.to_json(F.struct(*sorted(records.columns)), {"ignoreNullFields": "false"})
    halves = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return "/".join(str(x) for x in records.agg(F.count("*"), *halves).first())
