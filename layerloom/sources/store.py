"""Tables of a library that change together: buckets of episodes, staged folders and one manifest.

Every table is parted by a bucket of the episode. A change writes the buckets that it touches into new folders, which no
manifest names yet; then one new manifest, numbered one higher than the one it was made from, names for each table and
bucket the folder that counts. A reader takes the highest manifest, so it sees all of a change or nothing of it, and a job that
dies between two writes leaves what was there. Two changes that started from the same manifest cannot both be committed:
the later one fails and may be made again. Repeating a change leaves the same rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


class Store:
    """Tables below ``path``; ``schemas`` are DDL by table, each with an ``episode_id long``."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.path, self.schemas, self.buckets = spark, path.rstrip("/"), schemas, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("episode_id"), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit())

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """(number, folder of each table and bucket); number 0 is the empty library."""
        numbers = self._manifests()
        if not numbers:
            return 0, {t: {} for t in self.schemas}
        text = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}.json", wholetext=True).first()[0]
        return numbers[-1], json.loads(text)

    def read(self, table: str, at: dict[str, dict[str, str]] | None = None, buckets: list[int] | None = None) -> DataFrame:
        folders = (at or self.manifest()[1]).get(table, {})
        paths = sorted({f"{self.path}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def _commit(self, number: int, folders: dict[str, dict[str, str]]) -> None:
        to = self._path(f"{self.path}/manifests/{number:012d}.json")
        draft = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            self._fs.delete(draft, False)
            raise Conflict(f"manifest {number} is there already")

    def change(self, scope: DataFrame, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], between: Callable[[str], None] | None = None) -> None:
        """For the episodes of ``scope`` (episode_id), puts what ``make`` returns, by table, in place of their rows.

        ``make`` gets the present rows of these episodes. Tables that it leaves out stay. ``between`` is called with a table's
        name after its rows are written, before they count (tests stop a job there).
        """
        number, at = self.manifest()
        ids = scope.select(F.col("episode_id").cast("long").alias("episode_id")).where("episode_id IS NOT NULL").distinct()
        touched = sorted(r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect())  # BUCKETS numbers at most
        if not touched:
            return
        now = {t: self.read(t, at, touched) for t in self.schemas}
        fresh = make({t: rows.join(ids, "episode_id", "left_semi") for t, rows in now.items()})
        folders = {t: dict(f) for t, f in at.items()}
        job = uuid.uuid4().hex
        for table, rows in fresh.items():
            names = now[table].columns
            kept = now[table].join(ids, "episode_id", "left_anti").unionByName(rows.select(names).join(ids, "episode_id", "left_semi").select(names))
            folder = f"{table}/{job}"
            kept.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))}
            mine = folders.setdefault(table, {})
            for b in touched:
                mine.pop(str(b), None)
                if f"bucket={b}" in there:
                    mine[str(b)] = f"{folder}/bucket={b}"
            if between:
                between(table)
        self._commit(number + 1, folders)

    def vacuum(self, keep: int = 2) -> int:
        """Removes folders that none of the last ``keep`` manifests names, and the manifests before those; returns how many folders went. Only while no change is under way."""
        numbers = self._manifests()
        named = set()
        for n in numbers[-keep:]:
            text = self.spark.read.text(f"{self.path}/manifests/{n:012d}.json", wholetext=True).first()[0]
            named |= {f.rsplit("/", 1)[0] for folders in json.loads(text).values() for f in folders.values()}
        gone = 0
        for table in self.schemas:
            folder = self._path(f"{self.path}/{table}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else ():
                if f"{table}/{s.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(s.getPath(), True))
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        return gone
