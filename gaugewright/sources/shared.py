"""Tables that a job writes and reads again, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="gaugewright-"))
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: this cuts the lineage, survives
    lost executors, and keeps what comes after from running ``df`` again.

    The table stays until ``forget`` or ``forget_all``: a result that is still to be computed may read it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    _TABLES.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` in four parts a core, for costly work on each row: a small file of many rows is else read, and worked on, by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path in _TABLES:
            _TABLES.remove(path)
            _delete(df.sparkSession, path)


def forget_all(spark: SparkSession) -> int:
    """Delete all tables that ``written`` has left in this driver: for the end of a job, when its results are saved."""
    gone = len(_TABLES)
    while _TABLES:
        _delete(spark, _TABLES.pop())
    return gone


def tables() -> frozenset[str]:
    """The paths of the tables that ``written`` has left so far."""
    return frozenset(_TABLES)


def forget_new(spark: SparkSession, before: frozenset[str], *kept: DataFrame) -> int:
    """Delete the tables that were written since ``before`` was taken, but for the ``kept`` ones: for the end of a step whose result is written."""
    stay = before | {getattr(df, "_written_path", None) for df in kept}
    gone = [path for path in _TABLES if path not in stay]
    for path in gone:
        _TABLES.remove(path)
        _delete(spark, path)
    return len(gone)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
