"""Stored tables as versions of parquet folders, with key-based writes that can be repeated.

A write makes a new version beside the old ones and ends with a commit file that says which parts of the
table it replaces and which it holds rows of. Large tables are parted by year, and a merge reads and writes
only the years it touches; rows of new keys are added as files of their own. So a failed write changes
nothing, and readers never see half of one. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlens.schema import TABLES

COMMIT, PART, EVERY, STAGING = "_COMMIT", "part", "*", "_staging"
VERSIONS_A_PART = 64  # a part spread over as many versions is written as one again


def upserted(existing: DataFrame, staged: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows of staged, and those of existing whose keys it lacks."""
    return existing.join(staged.select(*keys), list(keys), "left_anti").unionByName(staged, allowMissingColumns=True)


def inserted(existing: DataFrame, staged: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows of existing, and those of staged whose keys are new."""
    return existing.unionByName(staged.join(existing.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replaced(existing: DataFrame, staged: DataFrame, partition: Iterable[str]) -> DataFrame:
    """Rows of staged, and those of existing in partitions (such as symbols) that it does not touch."""
    touched = staged.select(*partition).distinct()
    return existing.join(touched, list(partition), "left_anti").unionByName(staged, allowMissingColumns=True)


class Catalog:
    """The tables below one folder, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, name: str) -> list[int]:
        """Numbers of all versions, finished or not."""
        fs, path = self._path(name)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def _commit(self, name: str, version: int, commit: dict[str, list[str]]) -> None:
        fs, path = self._path(name, f"v={version}", COMMIT)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()

    def _committed(self, name: str, version: int) -> dict[str, list[str]] | None:
        fs, path = self._path(name, f"v={version}", COMMIT)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text else None

    def _current(self, name: str) -> dict[str, list[int]]:
        """The versions that hold rows of each part of the table."""
        held: dict[str, list[int]] = {}
        for version in self._versions(name):
            if commit := self._committed(name, version):
                for part in [*held] if commit["replaced"] == [EVERY] else commit["replaced"]:
                    held.pop(part, None)
                for part in commit["held"]:
                    held.setdefault(part, []).append(version)
        return held

    @contextmanager
    def staged(self, frame: DataFrame) -> Iterator[DataFrame]:
        """frame, written beside the tables while it is used: it is computed once, and what was fetched over the
        network isn't fetched again where an executor is lost later."""
        fs, path = self._path(STAGING, uuid.uuid4().hex)
        frame.write.parquet(path.toString())
        try:
            yield self.spark.read.schema(frame.schema).parquet(path.toString())
        finally:
            fs.delete(path, True)

    @staticmethod
    def schema(name: str) -> T.StructType:
        if name not in TABLES:
            raise ValueError(f"no table {name}; there are {', '.join(TABLES)}")
        return TABLES[name].schema

    def read(self, name: str, parts: Iterable[str] | None = None) -> DataFrame:
        """The table, or some years of one that is parted by year; empty before its first write. Columns that
        older files lack are null, or false where a boolean that must not be null was added."""
        schema = self.schema(name)
        wanted = None if parts is None else set(parts)
        paths = [f"{self.root}/{name}/v={v}/{PART}={p}" for p, versions in sorted(self._current(name).items()) if wanted is None or p in wanted for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).parquet(*paths)
        if name == "fundamentals_quarterly":
            out = out.withColumn("announcement_date_is_estimated", F.coalesce("announcement_date_is_estimated", F.lit(False)))
        return out

    def newest(self, name: str) -> int:
        """The number of the last finished version, 0 before the first."""
        return max((v for v in self._versions(name) if self._committed(name, v)), default=0)

    def added(self, name: str, since: int) -> DataFrame | None:
        """The rows that came after a version, read from the files that were added for them; None if anything was
        replaced since then or the version is not known."""
        newer = {v: c for v in self._versions(name) if v > since and (c := self._committed(name, v))}
        if not since or since > self.newest(name) or any(c["replaced"] for c in newer.values()):
            return None
        paths = [f"{self.root}/{name}/v={v}/{PART}={p}" for v, c in newer.items() for p in c["held"]]
        return self.spark.read.schema(self.schema(name)).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema(name))

    def _part(self, name: str) -> Column:
        by = TABLES[name].by_year
        return F.coalesce(F.year(by).cast("string"), F.lit("none")) if by else F.lit("all")

    def _shaped(self, name: str, frame: DataFrame) -> DataFrame:
        have = set(frame.columns)
        return frame.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema(name)))

    def _write(self, name: str, frame: DataFrame, replaced: list[str]) -> None:
        version = max(self._versions(name), default=0) + 1
        self._shaped(name, frame).withColumn(PART, self._part(name)).write.partitionBy(PART).parquet(f"{self.root}/{name}/v={version}")
        fs, path = self._path(name, f"v={version}")
        held = sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{PART}="))
        self._commit(name, version, {"replaced": replaced, "held": held})
        self._drop_old(name, version)

    def _drop_old(self, name: str, newest: int) -> None:
        """Deletes versions of which no part is current, but for the one before the newest, which readers may be on."""
        keep = {newest, newest - 1, *(v for versions in self._current(name).values() for v in versions)}
        for version in self._versions(name):
            if version not in keep:
                fs, path = self._path(name, f"v={version}")
                fs.delete(path, True)

    def write(self, name: str, frame: DataFrame) -> None:
        """Makes frame the table; columns go by name, missing ones are null, others are dropped."""
        self._write(name, frame, [EVERY])

    def _touched(self, name: str, staged: DataFrame) -> list[str]:
        """The years that rows of staged are in."""
        return sorted(row[0] for row in staged.select(self._part(name)).distinct().collect())

    def _merge(self, name: str, staged: DataFrame, merged) -> None:
        """Reads and rewrites only the parts that staged has rows of; a table from before it was parted by year is
        written whole, once."""
        if not TABLES[name].by_year or "all" in self._current(name):
            self.write(name, merged(self.read(name), staged, TABLES[name].keys))
        elif touched := self._touched(name, staged):
            self._write(name, merged(self.read(name, touched), staged, TABLES[name].keys), touched)

    def upsert(self, name: str, staged: DataFrame, *, mostly_new: bool = False) -> None:
        """mostly_new: looks for the keys of staged first, and only adds files where none is stored. That
        evaluates staged once more, and is for rows at hand."""
        if mostly_new and TABLES[name].by_year:
            keys = list(TABLES[name].keys)
            if self.read(name, self._touched(name, staged)).join(staged.select(*keys), keys, "left_semi").isEmpty():
                self.append(name, staged)
                return
        self._merge(name, staged, upserted)

    def insert(self, name: str, staged: DataFrame) -> None:
        self._merge(name, staged, inserted)

    def replace(self, name: str, staged: DataFrame, partition: Iterable[str] = ("symbol",)) -> None:
        """Of a table that is parted by year, only years in which the touched partitions differ from what is
        stored are written; rows are compared whole, in one aggregation of both sides. Partitions of which
        nothing is stored yet are added as files of their own."""
        if not TABLES[name].by_year or "all" in self._current(name):
            self.write(name, replaced(self.read(name), staged, partition))
            return
        new, by = self._shaped(name, staged), list(partition)
        touched = new.select(*by).distinct()
        old = self.read(name).join(touched, by, "left_semi")
        if old.isEmpty():
            if not new.isEmpty():
                self.append(name, new)
            return
        sides = new.withColumn("_side", F.lit(1)).unionByName(old.withColumn("_side", F.lit(-1)))
        differing = sides.groupBy(*new.columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0")
        if parts := self._touched(name, differing):
            kept = self.read(name, parts).join(touched, by, "left_anti")
            self._write(name, kept.unionByName(new.filter(self._part(name).isin(parts))), parts)

    def append(self, name: str, staged: DataFrame) -> None:
        """Adds files beside the stored ones; parts that have become spread over many versions are written as one."""
        crowded = [part for part, versions in self._current(name).items() if len(versions) >= VERSIONS_A_PART]
        self._write(name, self.read(name, crowded).unionByName(staged, allowMissingColumns=True) if crowded else staged, crowded)
