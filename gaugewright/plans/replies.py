"""A cache of replies that outlives the job: a folder of parts that writers only ever add to.

Each write is a part of its own, named by its time, so that writers never meet and none loses what another adds; a reader takes the newest
row of each key over all whole parts. Compaction writes the newest rows as one more part and then deletes the parts it has read: a
reader that comes between finds rows twice, which changes nothing. A part counts once its writer has finished (``_SUCCESS``).
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "key string, reply string, written_at long"
#: Parts beyond which a write compacts.
MOST_PARTS = 32


class ReplyCache:
    """``root`` is a folder that the cluster shares; it is reached by Spark's readers, writers and file systems alone."""

    def __init__(self, spark: SparkSession, root: str, most_parts: int = MOST_PARTS):
        self.spark, self.root, self.most_parts = spark, root.rstrip("/"), most_parts

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def parts(self, as_of: int | None = None) -> list[str]:
        """The whole parts, oldest first; with ``as_of`` (milliseconds) those written by then."""
        top = self._path("")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(top) if f.isDirectory())
        return [n for n in names if n.startswith("part-") and (as_of is None or int(n[5:18]) <= as_of) and fs.exists(self._path(f"{n}/_SUCCESS"))]

    def _newest(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], COLUMNS)
        rows = self.spark.read.schema(COLUMNS).parquet(*[f"{self.root}/{p}" for p in parts])
        newest = rows.groupBy("key").agg(F.max(F.struct("written_at", "reply")).alias("r"))
        return newest.select("key", "r.reply", "r.written_at")

    def read(self, as_of: int | None = None) -> DataFrame:
        """``key``, ``reply`` and ``written_at``: the newest reply of each key, of equally old ones the greatest."""
        return self._newest(self.parts(as_of))

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{time.time_ns() // 1_000_000:013d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def put(self, replies: DataFrame) -> None:
        """Add replies (``key``, ``reply``); rows without either are left out. An empty table adds nothing."""
        rows = replies.where(F.col("key").isNotNull() & F.col("reply").isNotNull()).select("key", "reply", F.lit(time.time_ns() // 1_000_000).alias("written_at"))
        if rows.isEmpty():
            return
        self._write(rows)
        if len(self.parts()) > self.most_parts:
            self.compact()

    def compact(self) -> int:
        """Make one part of all there are; the number of parts that went. Parts that are added meanwhile stay."""
        old = self.parts()
        if len(old) < 2:
            return 0
        self._write(self._newest(old))
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(bool(fs.delete(self._path(p), True)) for p in old)

    def forget(self, before: int) -> int:
        """Drop replies written before a time (milliseconds); the number of parts that this rewrote."""
        old = self.parts()
        if not old:
            return 0
        self._write(self._newest(old).where(F.col("written_at") >= before))
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(bool(fs.delete(self._path(p), True)) for p in old)
