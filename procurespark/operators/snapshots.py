"""Durable snapshots: the tables of a run are written apart and come into force together.

A store is a folder of data folders, one for each run, and of numbered manifests that
name each table's folders. The highest manifest that can be read holds. A unit of work writes its
tables to a folder of its own; committing writes the next manifest aside and renames it to its number,
which fails if that number is taken. So readers see all tables of a run or none, a manifest that
was torn by other means is passed over, and of two runs that began from one manifest the second fails.

A table may be kept in buckets by a hash of its key. A run then rewrites only the buckets that
its rows fall into; the next manifest names the other buckets' folders as they are.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procurespark.storage import age_of, names_in, publish, read_file, remove

BUCKET = "_bucket"
#: Seconds for which folders that no manifest names are left alone: a run may still be writing them.
GRACE = 7 * 24 * 3600


def bucket_of(key: str, n: int) -> Column:
    """The bucket of a row, from 0: the first 32 bits of a hash of its key."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % n).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None):
        """``schemas`` are those of tables that no run has written yet."""
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas or {}

    def _path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:08d}.json"

    def numbers(self) -> list[int]:
        """The numbers of all manifests, those that can't be read too."""
        names = (n.removesuffix(".json") for n in names_in(self.spark, f"{self.root}/manifests") if n.endswith(".json"))
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, version: int) -> dict | None:
        try:
            held = json.loads(read_file(self.spark, self._path(version)))
        except ValueError:
            return None
        return held if isinstance(held, dict) and isinstance(held.get("tables"), dict) else None

    def versions(self) -> list[int]:
        """The numbers of the manifests that can be read."""
        return [n for n in self.numbers() if self._read(n) is not None]

    def newest(self) -> int:
        """The number of the manifest in force, 0 if there is none; only as many are read as are torn."""
        return next((n for n in reversed(self.numbers()) if self._read(n) is not None), 0)

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """What a version says of each table (``folders``; in buckets also ``key`` and ``n``), the newest if none is given."""
        version = self.newest() if version is None else version
        if not version:
            return {}
        held = self._read(version)
        if held is None:
            raise ValueError(f"manifest {version} of {self.root} can't be read")
        return held["tables"]

    def folders(self, entry: dict, buckets: list[int] | None = None) -> list[str]:
        return [f for k, f in entry["folders"].items() if buckets is None or int(k) in buckets]

    def load(self, name: str, entry: dict | None, buckets: list[int] | None = None) -> DataFrame:
        paths = self.folders(entry, buckets) if entry else []
        schema = StructType.fromJson(entry["schema"]) if entry else self.schemas[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; one that was never written is empty."""
        return self.load(name, self.manifest(version).get(name))

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Forgets all but the newest ``keep`` manifests and deletes folders that none of these names; returns how many.

        Torn manifests older than the newest kept one go too. Folders younger than ``grace`` seconds
        stay, as a run that hasn't committed may be writing them.
        """
        kept = self.versions()[-max(1, keep) :]
        if not kept:
            return 0
        named = {f for v in kept for entry in self.manifest(v).values() for f in self.folders(entry)}
        for version in self.numbers():
            if version < kept[-1] and version not in kept:
                remove(self.spark, self._path(version))
        gone = 0
        for run in names_in(self.spark, f"{self.root}/data"):
            folder = f"{self.root}/data/{run}"
            if time.time() - age_of(self.spark, folder) < grace:
                continue
            tables = [f"{folder}/{t}" for t in names_in(self.spark, folder)]
            for table in tables:
                parts = [table, *(f"{table}/{b}" for b in names_in(self.spark, table) if b.startswith(f"{BUCKET}="))]
                free = [p for p in parts if p not in named]
                if len(free) == len(parts):
                    remove(self.spark, table)
                    gone += 1
                else:
                    for p in free[1:] if table not in named else []:
                        remove(self.spark, p)
                        gone += 1
            if not names_in(self.spark, folder):
                remove(self.spark, folder)
        return gone


class Work:
    """Tables written by one run; they can be read back before they are in force."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.newest()
        self.next = max(store.numbers(), default=0) + 1
        self.held = store.manifest(self.base)
        self.folder, self.written, self.files = f"{store.root}/data/{uuid.uuid4().hex}", {}, 0
        self.aside: list[str] = []

    def entry(self, name: str) -> dict | None:
        return self.written.get(name) or self.held.get(name)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.store.load(name, self.entry(name), buckets)

    def _new_folder(self, name: str) -> str:
        self.files += 1
        return f"{self.folder}/{self.files}-{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table once and returns it as written; a table may be replaced again in one run."""
        path = self._new_folder(name)
        df.write.parquet(path)
        self.written[name] = {"folders": {"0": path}, "schema": df.schema.jsonValue()}
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table that isn't in buckets; what is there stays as it is."""
        path, old = self._new_folder(name), self.entry(name)
        df.write.parquet(path)
        folders = old["folders"] if old else {}
        self.written[name] = {"folders": folders | {str(len(folders)): path}, "schema": df.schema.jsonValue()}

    def scratch(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` computed once and written aside; it is read back while the work lasts and is part of no version."""
        path = self._new_folder(name)
        df.write.parquet(path)
        self.aside.append(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def write_buckets(self, name: str, df: DataFrame, key: str, n: int, only: list[int] | None = None) -> DataFrame:
        """Writes a table in ``n`` buckets by ``key``, or only those in ``only`` of one that is there, and returns what it wrote."""
        path, old = self._new_folder(name), self.entry(name)
        # Rebalanced, so that a large bucket is written by many tasks and small ones share one.
        df.withColumn(BUCKET, bucket_of(key, n)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        made = {f.split("=")[1]: f"{path}/{f}" for f in names_in(self.store.spark, path) if f.startswith(f"{BUCKET}=")}
        kept = {k: f for k, f in old["folders"].items() if int(k) not in only} if only is not None else {}
        self.written[name] = {"folders": kept | made, "key": key, "n": n, "schema": df.schema.jsonValue()}
        return self.read(name, [int(k) for k in made])

    def merge(self, name: str, new: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], key: str | None = None, n: int = 64) -> list[int]:
        """Brings the buckets that ``new`` falls into up to date; ``apply`` makes them from what they hold and from ``new``. Returns which.

        Rows that ``apply`` brings together must have one ``key``, which both sides have. A table that isn't there
        yet gets ``n`` buckets.
        """
        entry = self.entry(name)
        parted = entry is not None and "key" in entry
        key, n = (entry["key"], entry["n"]) if parted else (key, n)
        touched = sorted(r[0] for r in new.select(bucket_of(key, n)).distinct().collect())  # at most n
        if touched or not parted:
            self.write_buckets(name, apply(self.read(name, touched if parted else None), new), key, n, touched if parted else None)
        return touched

    def commit(self) -> int:
        held = json.dumps({"tables": self.held | self.written}, indent=1)
        publish(self.store.spark, self.store._path(self.next), held.encode())
        for path in self.aside:
            remove(self.store.spark, path)
        return self.next

    def rollback(self) -> None:
        remove(self.store.spark, self.folder)


@contextmanager
def unit_of_work(store: Store, dry_run: bool = False) -> Iterator[Work]:
    """What is written inside comes into force at the end; nothing does after an error or in a dry run."""
    work = Work(store)
    try:
        yield work
        if not dry_run:
            work.commit()
    except BaseException:
        work.rollback()
        raise
    if dry_run:
        work.rollback()
