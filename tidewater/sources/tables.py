"""Table scans and sinks, and a lazy query over a catalog table with array payloads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicates import predicate


def read_table(spark: SparkSession, path: str, index_col: str | None = None, schema: str | None = None) -> DataFrame:
    """Parquet or CSV by suffix; ``index_col`` leaves out a stored row index. Give a schema for large CSV: without one
    the file is read twice."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    elif path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    else:
        raise ValueError(f"neither Parquet nor CSV: {path}")
    return df.drop(*[c for c in (index_col, "Unnamed: 0", "_c0") if c])


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet or CSV by suffix, replacing what is there."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if path.rstrip("/").endswith(".parquet"):
        writer.parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"neither Parquet nor CSV: {path}")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or no rows of this schema where it does not exist (a log or metadata file that a session lacks)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_index(spark: SparkSession, path: str, index_col: str) -> DataFrame:
    """A table whose stored row index becomes its first column, under the name ``index_col``."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    stored = next((c for c in (index_col, "Unnamed: 0", "_c0") if c in df.columns), None)
    if stored is None:
        raise ValueError(f"{path} has no row index")
    return df.select(F.col(f"`{stored}`").alias(index_col), *[F.col(f"`{c}`") for c in df.columns if c != stored])


def write_rows(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """:func:`write_table` that refuses an empty table (ValueError)."""
    if df.isEmpty():
        raise ValueError(f"no rows to write to {path}")
    write_table(df, path, partition_by)


def scan_sessions(spark: SparkSession, path: str, subjects: list[int] | None = None, sessions: list[int] | None = None, **equal: object) -> DataFrame:
    """One scan of a table that is partitioned by subject and session (and whatever ``equal`` names: a value or a list);
    filters on partitions prune files. FileNotFoundError where the table or all of the asked partitions are missing."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(path) from e
    for name, wanted in {"subject": subjects, "session": sessions, **equal}.items():
        if wanted is not None:
            df = df.where(F.col(name).isin(wanted) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    if (subjects or sessions) and df.select("subject", "session").isEmpty():
        raise FileNotFoundError(f"{path}: nothing for subjects {subjects}, sessions {sessions}")
    return df


def scan_files(spark: SparkSession, folder: str, pattern: str, name: str = "id", glob: str = "*") -> DataFrame:
    """A folder of files as id (the first group of ``pattern`` in the file's name), path, length: the listing only, contents
    are read when a query asks for the column content. Files that do not match are left out."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    found = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    return df.where(found != "").select(found.try_cast("long").alias(name), "path", "length", "content")


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns that one of them lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def newest(sets: DataFrame, created: str, keep: list[str], **equal: object) -> DataFrame:
    """Of the parameter sets that equal the given values the one created last (ties: the greatest ``keep``)."""
    for name, value in equal.items():
        sets = sets.where(F.col(name).eqNullSafe(value))
    return sets.orderBy(F.desc(created), *[F.desc(c) for c in keep]).limit(1)


def missing_keys(expected: DataFrame, present: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Of each group how many keys are expected, there and missing, the share that is there, and the missing ones in order
    (a list of absences, for reports over a bounded set of expected keys)."""
    marks = present.select(*on).distinct().withColumn("__there", F.lit(True))
    both = expected.select(*{*by, *on}).distinct().join(marks, on, "left")
    rest = [c for c in on if c not in by]
    gone = F.array_sort(F.collect_list(F.when(F.col("__there").isNull(), F.struct(*rest) if len(rest) > 1 else F.col(rest[0]))))
    return both.groupBy(*by).agg(F.count("*").alias("expected"), F.count("__there").alias("present"), (F.count("*") - F.count("__there")).alias("missing"), (F.count("__there") / F.count("*")).alias("rate"), gone.alias("missing_keys"))


class CatalogQuery:
    """A query over a catalog, one row for each item; each step gives a narrower one and nothing is read before ``load``.

    The payload is a column of the catalog, or a table of its own (``items``) with the same ``keys`` (the file and the
    place in it): then ``load`` joins only the catalog's matching keys to it. Filters on the catalog reach its scan, and
    payload columns that are not asked for are not read.
    """

    def __init__(self, catalog: DataFrame, payload: str | None = None, items: DataFrame | None = None, keys: tuple[str, ...] = ("file", "place")):
        self.df, self.payload, self.items, self.keys = catalog, payload, items, keys

    def _narrower(self, df: DataFrame) -> CatalogQuery:
        return CatalogQuery(df, self.payload, self.items, self.keys)

    def where(self, condition: str, **bound: object) -> CatalogQuery:
        """A predicate string (:mod:`tidewater.sources.predicates`)."""
        return self._narrower(self.df.where(predicate(self.df, condition, **bound)))

    def only(self, **equal: object) -> CatalogQuery:
        """Equality filters; those that are None are left out."""
        df = self.df
        for name, value in equal.items():
            df = df if value is None else df.where(F.col(name) == value)
        return self._narrower(df)

    def __len__(self) -> int:
        return self.df.count()

    def files(self) -> int:
        """How many files the query's items are in."""
        return self.df.select(self.keys[0]).distinct().count()

    def metadata(self) -> DataFrame:
        return self.df.drop(self.payload) if self.payload else self.df

    def load(self, picks: list[int] | list[str] | None = None, columns: list[str] | None = None, decimate: int = 1, must_match: bool = False) -> DataFrame:
        """The rows with their payload. Of an array payload: elements ``picks`` (from 0), or every ``decimate``-th. Of a
        table of items: its columns ``picks`` (all, if None); a catalog row whose item is not there is an error that
        names its key. With ``must_match`` a query of no rows is a ValueError."""
        if must_match and self.df.isEmpty():
            raise ValueError("the query matches nothing")
        df = self.df
        if self.items is not None:
            names = list(picks) if picks is not None else [c for c in self.items.columns if c not in self.keys]
            there = self.items.select(*self.keys, F.struct(*names).alias("__item"))
            lost = F.concat(F.lit("no item for "), *[F.concat(F.lit(f" {k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in self.keys])
            df = df.join(there, list(self.keys), "left").withColumn("__item", F.when(F.col("__item").isNull(), F.raise_error(lost)).otherwise(F.col("__item")))
            return df.select(*(columns or self.df.columns), *[F.col(f"__item.{n}").alias(n) for n in names])
        if self.payload and isinstance(df.schema[self.payload].dataType, T.ArrayType):
            x = F.col(self.payload)
            if picks is not None:
                x = F.array(*[F.get(x, F.lit(i)) for i in picks])
            elif decimate > 1:
                x = F.filter(x, lambda _, i: i % decimate == 0)
            df = df.withColumn(self.payload, x)
        return df.select(*columns, *([self.payload] if self.payload else [])) if columns else df
