"""Immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small Parquet shards. Shards of similar size form a tier; when a tier has enough of them they are merged
into files of the target size. The manifest lists the live shards of a version. A new version is a file that is written
aside and renamed to its number, which fails if another writer was first; readers take the highest number, so they
see a version whole or not at all. A version's file holds what it adds to the one before and takes from it; every sixteenth is whole, so that
a commit costs what it changes and a reader reads sixteen files at most. That holds where a rename does not replace an existing file: on HDFS and on local and other
POSIX file systems through Hadoop, not on object stores, where a rename is a copy and the store needs one writer. Files that
no manifest names are left over from failed writers and are swept on request.

The rows are stored as they are: nulls, ties, repeated rows and columns of any name stay, and an empty arrival is a version without
new rows. The manifest holds the columns, so a store without rows gives an empty table; columns that a later arrival adds are null
in the rows before it.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import fresh

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Shards whose sizes lie within this factor are of one tier.
TIER_FACTOR = 4
FLOOR_BYTES = 1 << 20
#: Times that a writer starts over when another one commits first.
ATTEMPTS = 5
#: Every so many versions the manifest is whole.
WHOLE_EVERY = 16


@dataclass(frozen=True)
class Shard:
    path: str  # within the store
    bytes: int
    arrival: int  # the latest it holds


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def tier_of(size: int) -> int:
    return max(0, math.floor(math.log(max(size, 1) / FLOOR_BYTES, TIER_FACTOR)) + 1)


def plan_merges(shards: list[Shard], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """The tiers with ``fan_in`` shards or more below three quarters of the target, each with its shards in the order of arrival."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < 0.75 * target:
            tiers.setdefault(tier_of(s.bytes), []).append(s)
    return [sorted(run, key=lambda s: (s.arrival, s.path)) for _, run in sorted(tiers.items()) if len(run) >= fan_in]


class ShardStore:
    """A store in a folder that the cluster shares. Its files are reached by Spark's readers, writers and file systems alone."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self.jvm = spark._jvm
        self.hadoop = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.hadoop)

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _read(self, version: int) -> dict:
        stream = self.fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """The version (0: nothing committed yet) and its shards."""
        if version is None:
            version = max(self.versions(), default=0)
        live: dict[str, Shard] = {}
        for v in range(max(1, version - version % WHOLE_EVERY), version + 1):
            change = self._read(v)
            for path in change["gone"]:
                del live[path]
            live |= {x["path"]: Shard(**x) for x in change["added"]}
        return version, list(live.values())

    def schema(self, version: int | None = None) -> StructType:
        """The columns of all arrivals up to a version, the last one by default."""
        version = max(self.versions(), default=0) if version is None else version
        return StructType.fromJson(self._read(version)["schema"]) if version else StructType()

    def commit(self, base: int, shards: list[Shard], before: list[Shard] | None = None, schema: StructType | None = None) -> int:
        """Make ``shards`` the version after ``base``, whose shards are ``before``; raises Conflict if there is one already. The columns
        of ``schema`` that the store does not have yet are added."""
        version = base + 1
        before = [] if version % WHOLE_EVERY == 0 else self.manifest(base)[1] if before is None else before
        known, own = self.schema(base), {s.path for s in shards}
        held, had = {s.path for s in before}, {f.name for f in known}
        columns = StructType([*known, *(f for f in schema or () if f.name not in had)])
        change = {"added": [asdict(s) for s in shards if s.path not in held], "gone": [s.path for s in before if s.path not in own], "schema": columns.jsonValue()}
        aside = self._path(f"manifests/aside-{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(change).encode()))
        finally:
            stream.close()
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")  # do not overwrite
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.hadoop)
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(self._path(f"manifests/v{version:08d}.json")), none)
        except Exception as e:
            self.fs.delete(aside, False)
            raise Conflict(f"version {version} is there already") from e
        return version

    def _files(self, folder: str, arrival: int) -> list[Shard]:
        path = self._path(folder)
        files = [(f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(path)] if self.fs.exists(path) else []
        return [Shard(f"{folder}/{n}", int(size), arrival) for n, size in sorted(files) if n.endswith(".parquet")]

    def _arrive(self, folder: str, schema: StructType) -> int:
        """Commit the files of ``folder`` as the next arrival."""
        for attempt in range(ATTEMPTS):
            version, live = self.manifest()
            try:
                return self.commit(version, live + self._files(folder, max((s.arrival for s in live), default=0) + 1), live, schema)
            except Conflict:  # the files are written: only their place in the order changes
                if attempt == ATTEMPTS - 1:
                    self.fs.delete(self._path(folder), True)
                    raise
        raise AssertionError

    def append(self, df: DataFrame) -> int:
        """Write ``df`` as new shards and commit them beside the live ones; an empty ``df`` adds no rows but counts as an arrival."""
        folder = f"shards/a-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self._arrive(folder, df.schema)

    def append_parts(self, df: DataFrame, part: Column, parts: int):  # noqa: ANN201
        """The rows as ``parts`` arrivals by ``part`` (0 to ``parts`` - 1), written in one pass; yields the version after each commit."""
        root = f"shards/p-{uuid.uuid4().hex}"
        (name,) = fresh(df, "part")
        df.withColumn(name, part).write.partitionBy(name).parquet(f"{self.root}/{root}")
        for i in range(parts):
            yield self._arrive(f"{root}/{name}={i}", df.schema)

    def compact(self) -> int:
        """Merge until no tier has ``fan_in`` shards to merge; the merges of all tiers are one commit. Whole files are read and joined end
        to end: no row is shuffled. Where another writer commits first, the merged files are deleted and the merges are planned anew."""
        for attempt in range(ATTEMPTS):
            version, live = self.manifest()
            while runs := plan_merges(live, self.target, self.fan_in):
                before, made = live, []
                for run in runs:
                    files = max(1, round(sum(s.bytes for s in run) / self.target))
                    made.append(folder := f"shards/c-{uuid.uuid4().hex}")
                    self.read(run).coalesce(files).write.parquet(f"{self.root}/{folder}")
                    gone = set(run)
                    live = [s for s in live if s not in gone] + self._files(folder, max(s.arrival for s in run))
                try:
                    version = self.commit(version, live, before)
                except Conflict:
                    for folder in made:
                        self.fs.delete(self._path(folder), True)
                    if attempt == ATTEMPTS - 1:
                        raise
                    break
            else:
                return version
        raise AssertionError

    def read(self, shards: list[Shard] | None = None) -> DataFrame:
        """The rows of the given shards, or of the live ones; an empty table where there are none."""
        schema = self.schema()
        if not schema.fields:
            raise ValueError("nothing was committed to the store")
        shards = self.manifest()[1] if shards is None else shards
        if not shards:
            return self.spark.createDataFrame([], schema)
        # without the folders' names as columns
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{s.path}" for s in shards])

    def sweep(self, keep_versions: int = 1, leftovers: bool = True) -> int:
        """Delete the shards that none of the last ``keep_versions`` manifests names, and the manifests that these do not need; the number of shards.
        With ``leftovers`` all other shards go, which is for times when nobody writes or reads older versions; without, only those that an
        earlier manifest names, so that files which are still to be committed stay. What is swept is not read again by the next sweep."""
        versions = self.versions()
        if not versions:
            return 0
        kept = versions[-keep_versions:]
        named = {s.path for v in kept for s in self.manifest(v)[1]}
        older = {x["path"] for v in versions for x in self._read(v)["added"]} - named
        if leftovers:
            at = self.fs.listFiles(self._path("shards"), True)
            start = len(self.fs.makeQualified(self._path("")).toString()) + 1
            while at.hasNext():
                name = at.next().getPath().toString()[start:]
                if name.endswith(".parquet") and name not in named:
                    older.add(name)
        gone = sum(bool(self.fs.delete(self._path(name), False)) for name in older)
        for v in versions:
            if v < kept[0] - kept[0] % WHOLE_EVERY:
                self.fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        return gone

    def placed(self, key: str, *columns) -> DataFrame:  # noqa: ANN002
        """Each live row's ``key``, the given columns, its shard's path, and the version."""
        version, live = self.manifest()
        where = F.regexp_extract(F.col("_metadata.file_path"), r"(shards/[0-9a-z-]+/(?:[^/]+/)?[^/]+)$", 1) if live else F.lit("")
        return self.read(live).select(key, *columns, where.alias("shard"), F.lit(version).cast("long").alias("version"))
