"""Named tables of datasets and experiments in a folder, as CSV, JSON lines or Parquet, or in memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("datasets", "experiments")


class FolderCatalog:
    """``root/datasets/<name>`` and ``root/experiments/<name>``. Reached by Spark and Hadoop's file systems alone, so any store works."""

    def __init__(self, spark: SparkSession, root: str, form: str = "jsonl"):
        if form not in ("csv", "jsonl", "parquet"):
            raise ValueError(f"unknown form {form!r}")
        self.spark, self.root, self.form = spark, root.rstrip("/"), form

    def _path(self, kind: str, name: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return f"{self.root}/{kind}/{name}"

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, kind: str = "datasets") -> list[str]:
        fs, p = self._fs(f"{self.root}/{kind}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def save(self, df: DataFrame, name: str, kind: str = "datasets") -> None:
        """Overwrite a table. In CSV, arrays, maps and structs become JSON."""
        path = self._path(kind, name)
        if self.form == "parquet":
            df.write.mode("overwrite").parquet(path)
        elif self.form == "jsonl":
            df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        else:
            nested = (T.ArrayType, T.MapType, T.StructType)
            flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string") for f in df.schema])
            flat.write.mode("overwrite").options(header=True, quoteAll=True, escape='"', emptyValue="").csv(path)

    def malformed(self, name: str, kind: str = "datasets") -> int:
        """How many lines of a JSON-lines table ``load`` leaves out; blank lines are none."""
        if self.form != "jsonl":
            raise ValueError("only JSON lines can be malformed")
        lines = self.spark.read.text(self._path(kind, name)).where(F.trim("value") != "")
        whole = F.try_parse_json("value")
        return lines.where(whole.isNull() | (F.schema_of_variant(whole).startswith("OBJECT") == F.lit(False))).count()

    def load(self, name: str, kind: str = "datasets", schema: str | None = None) -> DataFrame:
        """A table; one that is not there raises FileNotFoundError. CSV values are strings; malformed JSON lines are dropped
        (``malformed`` counts them)."""
        path = self._path(kind, name)
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise FileNotFoundError(f"no {kind[:-1]} named {name!r}")
        if self.form == "parquet":
            return self.spark.read.parquet(path)
        if self.form == "csv":
            return self.spark.read.options(header=True, multiLine=True, escape='"').csv(path, schema=schema)
        reader = self.spark.read.option("mode", "DROPMALFORMED")
        return revived(reader.json(path, schema=schema))


# ISO 8601 as the standard library writes it.
_ISO = {"timestamp": r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?$", "date": r"^\d{4}-\d\d-\d\d$"}


def _leaves(kind: T.DataType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The paths to the strings of a type: field names, and ``[]`` into arrays and into the values of maps."""
    if isinstance(kind, T.StringType):
        return [path]
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in _leaves(f.dataType, (*path, f.name))]
    if isinstance(kind, T.ArrayType):
        return _leaves(kind.elementType, (*path, "[]"))
    if isinstance(kind, T.MapType):
        return _leaves(kind.valueType, (*path, "[]"))
    return []


def _tested(column: Column, kind: T.DataType, path: tuple[str, ...], test, all_of: bool) -> Column:  # noqa: ANN001
    """Whether ``test`` holds for all strings at a path of a value, or for any."""
    if isinstance(kind, T.StringType):
        return test(column)
    if isinstance(kind, T.StructType):
        return _tested(column.getField(path[0]), kind[path[0]].dataType, path[1:], test, all_of)
    items, inner = (column, kind.elementType) if isinstance(kind, T.ArrayType) else (F.map_values(column), kind.valueType)
    each = F.forall if all_of else F.exists
    return F.coalesce(each(items, lambda x: _tested(x, inner, path[1:], test, all_of)), F.lit(all_of))


def _rebuilt(column: Column, kind: T.DataType, path: tuple[str, ...], casts: dict[tuple[str, ...], str]) -> Column:
    """A value with the strings at the paths of ``casts`` cast; structs, arrays and maps around them are put together again."""
    if not any(p[: len(path)] == path for p in casts):
        return column
    if isinstance(kind, T.StringType):
        return column.cast(casts[path])
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_rebuilt(column.getField(f.name), f.dataType, (*path, f.name), casts).alias(f.name) for f in kind])
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _rebuilt(x, kind.elementType, (*path, "[]"), casts))
    return F.transform_values(column, lambda _, x: _rebuilt(x, kind.valueType, (*path, "[]"), casts))


def revived(df: DataFrame) -> DataFrame:
    """Strings at any depth (in structs, arrays and the values of maps) whose values are all ISO timestamps, or all dates, become such; one
    that is not, anywhere in the table, leaves all of its place as strings, since a place has one type."""
    paths = [p for f in df.schema for p in _leaves(f.dataType, (f.name,))]
    if not paths:
        return df
    checks = []
    for i, (name, *rest) in enumerate(paths):
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        there = F.coalesce(F.max(_tested(column, kind, tuple(rest), lambda x: x.isNotNull(), False)), F.lit(False))
        for form, pattern in _ISO.items():
            fits = F.every(F.coalesce(_tested(column, kind, tuple(rest), lambda x, p=pattern: x.isNull() | x.rlike(p), True), F.lit(True)))
            checks.append((F.coalesce(fits, F.lit(False)) & there).alias(f"{form} {i}"))
    found = df.agg(*checks).first()
    casts = {path: form for i, path in enumerate(paths) for form in _ISO if found[f"{form} {i}"]}
    return df.select(*[_rebuilt(F.col(f"`{f.name}`"), f.dataType, (f.name,), casts).alias(f.name) for f in df.schema]) if casts else df


class MemoryCatalog:
    """Tables by name in the session. DataFrames never change, so loads are isolated from saves."""

    def __init__(self) -> None:
        self.tables: dict[tuple[str, str], DataFrame] = {}

    def save(self, df: DataFrame, name: str, kind: str = "datasets") -> None:
        self.tables[kind, name] = df

    def malformed(self, name: str, kind: str = "datasets") -> int:
        """How many lines of a JSON-lines table ``load`` leaves out; blank lines are none."""
        if self.form != "jsonl":
            raise ValueError("only JSON lines can be malformed")
        lines = self.spark.read.text(self._path(kind, name)).where(F.trim("value") != "")
        whole = F.try_parse_json("value")
        return lines.where(whole.isNull() | (F.schema_of_variant(whole).startswith("OBJECT") == F.lit(False))).count()

    def load(self, name: str, kind: str = "datasets") -> DataFrame:
        if (kind, name) not in self.tables:
            raise FileNotFoundError(f"no {kind[:-1]} named {name!r}")
        return self.tables[kind, name]

    def names(self, kind: str = "datasets") -> list[str]:
        return sorted(n for k, n in self.tables if k == kind)


class Registry:
    """Catalog makers by name, with aliases; deleting a name deletes its aliases."""

    def __init__(self) -> None:
        self.makers: dict = {}
        self.aliases: dict[str, str] = {}

    def register(self, name: str, maker, aliases: tuple[str, ...] = ()) -> None:  # noqa: ANN001
        self.makers[name] = maker
        self.aliases |= dict.fromkeys(aliases, name)

    def __getitem__(self, name: str):  # noqa: ANN204
        name = self.aliases.get(name, name)
        if name not in self.makers:
            raise KeyError(f"unknown catalog {name!r}; known: {', '.join(sorted(self.makers))}")
        return self.makers[name]

    def __delitem__(self, name: str) -> None:
        del self.makers[name]
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}


registry = Registry()
for _form in ("csv", "jsonl", "parquet"):
    registry.register(f"local/{_form}", lambda spark, root, form=_form: FolderCatalog(spark, root, form))
registry.register("inmemory", lambda *_: MemoryCatalog(), ("memory",))


def approved(testset: DataFrame) -> DataFrame:
    """The approved rows of an annotated test set."""
    return testset.where(F.col("approval_status") == "approved")


def annotations(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """The annotated samples of one metric from a JSON file keyed by metric; an unknown metric is an error."""
    df = spark.read.option("multiLine", True).json(path)
    if metric not in df.columns:
        raise ValueError(f"no annotations for {metric!r}; there are: {', '.join(df.columns)}")
    return df.select(F.explode(F.col(f"`{metric}`")).alias("a")).select("a.*")
