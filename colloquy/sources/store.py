"""A table of the latest row of each key, kept by writers that may run side by side.

Rows are Parquet in bucket folders by the hash of the key. What is in the table is said by a manifest: one large set of
files, the base, and the few sets of changes since it. A new manifest has the next number and is put in its place by one
rename that fails where another writer was faster; that one then starts from the other's manifest. So readers see all
of a change or nothing, and a writer that dies leaves files that no manifest names. Merging writes a new base beside
the old one, whose files go with the merge after, when no reader needs them any more.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKET, VERSION = "bucket", "version"
# Hours after which files that no manifest names are those of a writer that died.
LEFT_BEHIND = 24


class Taken(Exception):
    """Another writer was faster."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self) -> dict[str, Any]:
        """The latest one; that of an empty table has number 0."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "base": None, "changes": [], "applied": {}, "retired": [], "schema": None, "buckets": None}
        lines = self._files.open(self._at(f"manifest/{numbers[-1]:012d}.json"))
        try:
            return json.loads(bytes(lines.readAllBytes()).decode())
        finally:
            lines.close()

    def _put(self, manifest: dict[str, Any]) -> None:
        """Writes the manifest of a number that is still free."""
        hadoop = self._jvm.org.apache.hadoop.fs
        draft = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(draft.toUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(draft, self._at(f"manifest/{manifest['number']:012d}.json"), no_options)
        except Exception as error:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Taken from None
            raise

    def change(self, edit: Callable[[dict[str, Any]], dict[str, Any] | None]) -> dict[str, Any] | None:
        """Puts what `edit` makes of the latest manifest in its place, again and again while others are faster; nothing
        happens where it makes none."""
        while True:
            now = self.manifest()
            then = edit(dict(now))
            if then is None:
                return None
            then["number"] = now["number"] + 1
            try:
                self._put(then)
                return then
            except Taken:
                continue

    def _write(self, rows: DataFrame, key: str, kind: str, buckets: int) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        bucketed = rows.withColumn(BUCKET, F.pmod(F.hash(key), F.lit(buckets)))
        # A file per bucket, and a bucket's rows in the order of their keys.
        sorted_ = bucketed.repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, key)
        sorted_.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        return folder

    def append(self, rows: DataFrame, key: str, writer: str, batch: int, buckets: int = 32) -> bool:
        """Rows that take the place of those of equal key, at most one a key. The same batch of a writer counts once,
        however often it is tried."""
        seen = self.manifest()
        if seen["applied"].get(writer, -1) >= batch:
            return False
        # The first writer's number of buckets holds for the table.
        folder = self._write(rows, key, "changes", seen["buckets"] or buckets)
        schema = json.loads(rows.schema.json())

        def edit(now):
            if now["applied"].get(writer, -1) >= batch:
                return None
            now["changes"] = [*now["changes"], {"folder": folder, VERSION: now["number"] + 1}]
            now["applied"] = {**now["applied"], writer: batch}
            return {**now, "schema": now["schema"] or schema, "buckets": now["buckets"] or buckets}

        return self.change(edit) is not None

    def _rows(self, manifest: dict[str, Any], folder: str) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"]).add(BUCKET, T.IntegerType())
        root = f"{self.path}/data/{folder}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(root)

    def read(self, key: str) -> DataFrame | None:
        """The table as it is now, or none where nothing was written. With no change since the last merge it is a scan;
        else changes, which are few, are looked up by key."""
        return self._latest(self.manifest(), key)

    def _latest(self, manifest: dict[str, Any], key: str) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        names = T.StructType.fromJson(manifest["schema"]).names
        parts = [
            self._rows(manifest, c["folder"]).withColumn(VERSION, F.lit(c[VERSION])) for c in manifest["changes"]
        ]
        base = None if manifest["base"] is None else self._rows(manifest, manifest["base"])
        if not parts:
            return base.select(*names)
        changed = parts[0]
        for part in parts[1:]:
            changed = changed.unionByName(part)
        state = [n for n in names if n != key]
        last = changed.groupBy(key).agg(F.max_by(F.struct(*state), VERSION).alias("_state")).select(key, "_state.*")
        if base is None:
            return last.select(*names)
        fresh = last.select(F.col(key).alias("_key"))
        kept = base.join(fresh, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        return kept.select(*names).unionByName(last.select(*names))

    def merge(self, key: str) -> bool:
        """One base of all there is. Changes that are written meanwhile stay changes; where another merge was faster this
        one counts for nothing."""
        seen = self.manifest()
        if not seen["changes"]:
            return False
        folder = self._write(self._latest(seen, key), key, "base", seen["buckets"])
        merged = [c["folder"] for c in seen["changes"]]
        gone = []

        def edit(now):
            if now["base"] != seen["base"]:
                return None
            gone[:] = now["retired"]
            retired = merged if now["base"] is None else [*merged, now["base"]]
            left = [c for c in now["changes"] if c["folder"] not in merged]
            return {**now, "base": folder, "changes": left, "retired": retired}

        then = self.change(edit)
        if then is None:
            gone[:] = [folder]
        self._drop(gone)
        if then is not None:
            self._tidy()
        return then is not None

    def _drop(self, folders: list[str]) -> None:
        for folder in folders:
            self._files.delete(self._at(f"data/{folder}"), True)

    def _tidy(self) -> None:
        """Drops manifests but the last few, and files that a writer left behind."""
        for number in self._numbers()[:-10]:
            self._files.delete(self._at(f"manifest/{number:012d}.json"), False)
        now = self.manifest()
        named = {now["base"], *now["retired"], *(c["folder"] for c in now["changes"])}
        before = (time.time() - LEFT_BEHIND * 3600) * 1000
        for status in self._files.listStatus(self._at("data")):
            name = status.getPath().getName()
            if name not in named and status.getModificationTime() < before:
                self._drop([name])
