"""A dataset that is replaced part by part: new files first, then a manifest that says which of them count.

A part is what is replaced as a whole: the rows of a run, or the rows of a bucket of keys. Every
replacement writes its rows to a folder of its own and then a new manifest version with the
folder of each part. Readers take the newest complete version, so they see all of a replacement
or nothing of it, and a task or a driver that dies leaves files that no manifest names. A writer
that finds its version taken fails instead of losing the other's rows.

Spark lists, writes and reads everything, so the folder may be on any store that it knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from matlink.operators.graph import cut

_PART, _FOLDER = "_part", "_folder"


class Conflict(RuntimeError):
    """Another writer made the same version."""


class ReplacingSink:
    """The dataset at path, replaced by values of a column (replace) or by keys (replace_keys)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, where = self._files(f"{self.path}/manifest/*/_SUCCESS")
        found = fs.globStatus(where) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def _manifest(self, version: int | None) -> tuple[int, dict[str, str], StructType | None]:
        """Version, folder of each part, and schema of the rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}, None
        rows = self.spark.read.schema("part string, folder string, schema string").json(f"{self.path}/manifest/{version}").collect()
        schema = next((StructType.fromJson(json.loads(r.schema)) for r in rows if r.schema), None)
        return version, {r.part: r.folder for r in rows if r.part is not None}, schema

    def _rows(self, version: int | None, parts: set[str] | None) -> DataFrame:
        version, folders, schema = self._manifest(version)
        if schema is None:
            raise ValueError(f"no complete version at {self.path}")
        folders = {p: f for p, f in folders.items() if parts is None or p in parts}
        if not folders:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema.fields, StructField(_FOLDER, StringType()), StructField(_PART, StringType())])
        paths = [f"{self.path}/data/{_FOLDER}={f}" for f in sorted(set(folders.values()))]
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths)
        live = self.spark.createDataFrame(list(folders.items()), "p string, f string")
        kept = rows.join(F.broadcast(live), (F.col(_PART) == F.col("p")) & (F.col(_FOLDER) == F.col("f")), "left_semi")
        return kept.select(*(F.col(f"`{n}`") for n in schema.names))

    def read(self, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """All rows of a version, the newest unless one is given, or those of parts. ValueError if nothing was ever written."""
        return self._rows(version, None if parts is None else set(map(str, parts)))

    def _commit(self, version: int, folders: dict[str, str], schema: StructType) -> int:
        rows = [(None, None, schema.json()), *((p, f, None) for p, f in sorted(folders.items()))]
        made = self.spark.createDataFrame(rows, "part string, folder string, schema string").coalesce(1)
        try:
            made.write.mode("errorifexists").json(f"{self.path}/manifest/{version + 1}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise Conflict(f"version {version + 1} of {self.path} was made by another writer") from e
            raise
        return version + 1

    def _swap(self, rows: DataFrame, part: Column, parts: Iterable[str] | None) -> int:
        """Writes rows by part and lets the parts that they have, or parts, point to them alone."""
        version, folders, schema = self._manifest(None)
        if schema is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in rows.schema]:
            raise ValueError(f"rows are {rows.schema.simpleString()}, the dataset is {schema.simpleString()}")
        folder = uuid.uuid4().hex
        where = f"{self.path}/data/{_FOLDER}={folder}"
        value = part.cast("string")
        marked = rows.withColumn(_PART, F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("a row without a part"))))
        # Spark splits the shuffle's large partitions here, so one task needn't write a part of a third of all rows
        marked.hint("rebalance", F.col(_PART)).write.partitionBy(_PART).parquet(where)
        there = StructType([*rows.schema.fields, StructField(_PART, StringType())])
        new = {r[0] for r in self.spark.read.schema(there).parquet(where).select(_PART).distinct().collect()}
        gone = new if parts is None else set(map(str, parts))
        if new - gone:
            raise ValueError(f"rows of other parts: {', '.join(sorted(new - gone)[:5])}")
        return self._commit(version, {p: f for p, f in folders.items() if p not in gone} | dict.fromkeys(new, folder), rows.schema)

    def replace(self, rows: DataFrame, column: str, parts: Iterable[str] | None = None) -> int:
        """Replaces the parts that rows hold values of, or parts, whether rows has any of them or not; others stay.

        A null value is an error, and so are rows of another schema than those before.
        """
        return self._swap(rows, F.col(f"`{column}`"), parts)

    def replace_keys(self, rows: DataFrame, keys: list[str], buckets: int = 64) -> int:
        """Deletes the rows whose keys rows holds, then adds rows: both in one version. Nulls are keys like others.

        Only the buckets (a hash of the keys) that rows touches are written again. The number of buckets
        must be the same in all calls on a dataset.
        """
        rows = cut(rows)
        bucket = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("string")
        touched = {r[0] for r in rows.select(bucket.alias("b")).distinct().collect()}
        new = rows
        if self.versions():
            known = rows.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
            same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            new = self._rows(None, touched).join(known, same, "left_anti").unionByName(rows)
        return self._swap(new, bucket, touched)

    def drop(self, parts: Iterable[str]) -> int:
        """Removes parts, as of a cancelled run; without any of them the version stays."""
        version, folders, schema = self._manifest(None)
        gone = set(map(str, parts)) & set(folders)
        return self._commit(version, {p: f for p, f in folders.items() if p not in gone}, schema) if gone else version

    def parts(self, version: int | None = None) -> list[str]:
        return sorted(self._manifest(version)[1])

    def vacuum(self) -> int:
        """Deletes all but the newest version, and what was never finished; how many folders of rows went.

        No reader of an older version, and no writer, may be at work. A version whose writer died
        before its end is in the way of later ones until then.
        """
        version, folders, _ = self._manifest(None)
        kept = {f"{_FOLDER}={f}" for f in folders.values()}
        gone = 0
        for found, keep in ((f"{self.path}/data/*", kept), (f"{self.path}/manifest/*", {str(version)})):
            fs, where = self._files(found)
            for path in (f.getPath() for f in fs.globStatus(where) or []):
                if path.getName() not in keep:
                    fs.delete(path, True)
                    gone += found.endswith("data/*")
        return gone
