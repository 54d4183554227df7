"""A session's tables as one: those that are there, those that are not, and their loaders composed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import enrich, intervals
from . import tables


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the candidates that is there, or None."""
    return next((p for p in paths if exists(spark, p)), None)


@dataclass
class Session:
    """Tables by name; ``missing`` names those that a session lacks. ``session["events"]`` of a missing one is a KeyError that says so."""

    subject: int
    session: int
    tables: dict[str, DataFrame] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"subject {self.subject}, session {self.session} has no {name}")
        return self.tables[name]

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


def load_session(spark: SparkSession, folder: str, subject: int, session: int, names: list[str], required: tuple[str, ...] = ()) -> Session:
    """The named tables of one session, each ``folder``/name.parquet partitioned by subject and session: a scan of its partition.
    A table or partition that is not there is missing; one that is ``required`` is a FileNotFoundError."""
    out = Session(subject, session)
    for name in names:
        try:
            out.tables[name] = tables.scan_sessions(spark, f"{folder}/{name}.parquet", [subject], [session])
        except FileNotFoundError:
            if name in required:
                raise
            out.missing.append(name)
    return out


def load_sessions(spark: SparkSession, folder: str, wanted: DataFrame, names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The named tables of many sessions (``wanted``: subject, session), each one scan, and which of them have what: subject,
    session, name, present. Sessions are joined, not looped over."""
    found, marks = {}, None
    for name in names:
        try:
            rows = spark.read.parquet(f"{folder}/{name}.parquet").join(F.broadcast(wanted.select("subject", "session").distinct()), ["subject", "session"], "left_semi")  # a list of sessions
            there = rows.select("subject", "session").distinct().withColumn("present", F.lit(True))
            found[name] = rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            there = wanted.select("subject", "session", F.lit(True).alias("present")).limit(0)
        part = wanted.select("subject", "session").distinct().join(there, ["subject", "session"], "left").select("subject", "session", F.lit(name).alias("name"), F.coalesce("present", F.lit(False)).alias("present"))
        marks = part if marks is None else marks.unionByName(part)
    return found, marks


def enriched_events(session: Session, by: list[str], key: list[str], trials: str = "trials", log: str = "log", events: str = "events", mode: str = "strict") -> DataFrame:
    """A session's events in their trials, with the log where there is one (else their columns alone)."""
    if log in session.tables:
        return enrich.enrich(session[events], session[trials], session[log], by, key, mode)
    return enrich.place_in_trials(session[events], session[trials], by, key, mode)


def pilot_events(files: list[DataFrame], trials: DataFrame, by: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """Events of a pilot's files as one table, in the trials that they begin in."""
    return intervals.contained(tables.concat_tables(files), trials, by, start, end, low, high, "start")


def non_blank(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text is neither null nor blank."""
    return df.where(F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s", " ")) != "")


def with_overrides(df: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with an array of each key: that of ``overrides``, else its own, else an empty one. Of several overrides of a key
    the smallest counts."""
    first = overrides.groupBy(key).agg(F.min(value).alias("__v"))
    own = F.col(value) if value in df.columns else F.lit(None)
    empty = F.array().cast(overrides.schema[value].dataType)
    return df.join(first, key, "left").withColumn(value, F.coalesce("__v", own, empty)).drop("__v")


def load_captions(logs: list[DataFrame], key: str, text: str, overrides: DataFrame | None = None, name: str = "captions") -> DataFrame:
    """Captions of all logs: rows with a text, which is read as a printed list or as one caption; those of a key in ``overrides`` (key,
    ``name``) are replaced."""
    said = non_blank(tables.concat_tables(logs), text)
    out = said.withColumn(name, messages.captions(F.col(text)))
    return out if overrides is None else with_overrides(out, overrides, key, name)


def with_existing(df: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is in the listing, and the keys of the others, each once."""
    there = listing.select(key).distinct()
    return df.join(there, key, "left_semi"), df.select(key).distinct().join(there, key, "left_anti")


def collected(results: DataFrame, keys: list[str], arrays: Mapping[str, Column]) -> DataFrame:
    """Arrays of results as a long table: keys, place, and a column for each array (null where it is shorter)."""
    zipped = F.arrays_zip(*[v.alias(n) for n, v in arrays.items()])
    return results.select(*keys, F.posexplode(zipped).alias("place", "__r")).select(*keys, "place", *[F.col(f"__r.{n}").alias(n) for n in arrays])
