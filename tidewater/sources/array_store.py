"""Stores of arrays in NumPy's files, as a Spark data source: ``key=value`` folders of ``.npz`` chunks (or ``.npy`` arrays).

A file holds arrays of equal first dimension, one row for each place in it. Keys are read from the names of folders.
A partition of a scan is a file or, with ``rows``, so many rows of one: filters on keys are pushed into the listing, so files
that they rule out are not even opened, only the asked arrays are read, and of a stored (not compressed) array only the
partition's bytes. The sink writes the same layout: a task writes chunks under hidden names, which the commit shows.

Folders are local (or mounted everywhere), or addresses that pyarrow's filesystems know (``file:``, ``hdfs:``, ``s3:``); the
driver lists them and executors read them.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

PUSH = "spark.sql.python.filterPushdown.enabled"
#: Bytes of rows that a reader gives on at once, and rows of a written chunk.
BATCH_BYTES, CHUNK = 8 << 20, 4096


def _at(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Path and keys of each visible file."""
    from pyarrow import fs

    system, root = _at(path)
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path[len(root) :].strip("/").split("/")
        if f.type == fs.FileType.File and f.path.endswith((".npz", ".npy")) and not any(p.startswith((".", "_")) for p in parts):
            yield f.path, {k: unquote(v) for k, _, v in (p.partition("=") for p in parts[:-1] if "=" in p)}


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type, and where the values begin."""
    version = np.lib.format.read_magic(stream)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    if kind.hasobject or not shape:
        raise ValueError("arrays of objects and single values are not read")
    return shape, fortran, kind, stream.tell()


class _Open:
    """A file's arrays by name."""

    def __init__(self, system, path: str):
        self.stream = system.open_input_file(path)
        self.zip = zipfile.ZipFile(self.stream) if path.endswith(".npz") else None
        self.names = [n.removesuffix(".npy") for n in self.zip.namelist()] if self.zip else ["value"]

    def member(self, name: str):
        return self.zip.open(f"{name}.npy") if self.zip else self.stream

    def header(self, name: str):
        self.stream.seek(0)
        return _header(self.member(name))

    def rows(self, name: str, start: int, n: int) -> np.ndarray:
        if not self.zip:
            self.stream.seek(0)
        m = self.member(name)
        shape, fortran, kind, at = _header(m)
        if fortran and len(shape) > 1:
            return np.frombuffer(m.read(), kind).reshape(shape, order="F")[start : start + n]
        width = kind.itemsize * int(np.prod(shape[1:]))
        m.seek(at + start * width)
        return np.frombuffer(m.read(n * width), kind).reshape(-1, *shape[1:])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.stream.close()


def _spark_type(shape: tuple[int, ...], kind: np.dtype) -> T.DataType:
    one: T.DataType = {"i": T.LongType(), "u": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType(), "U": T.StringType()}[kind.kind]
    for _ in shape[1:]:
        one = T.ArrayType(one)
    return one


def _arrow(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The array as a column: lists of lists beyond one dimension."""
    if x.ndim == 1:
        return pa.array(x.tolist() if x.dtype.kind == "U" else x).cast(kind)
    n, width = x.shape[:2]
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), _arrow(x.reshape(n * width, *x.shape[2:]), kind.value_type)).cast(kind)


def _numpy(column: pa.Array, name: str) -> np.ndarray:
    """A column as an array; lists of unequal length and nulls are an error."""
    if column.null_count:
        raise ValueError(f"{name} has nulls")
    if not pa.types.is_list(column.type) and not pa.types.is_large_list(column.type):
        return np.array(column.to_pylist(), dtype="U") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)
    widths = set(np.diff(column.offsets.to_numpy()).tolist())
    if len(widths) > 1:
        raise ValueError(f"{name} has lists of unequal lengths")
    inner = _numpy(column.flatten(), name)
    return inner.reshape(len(column), widths.pop() if widths else 0, *inner.shape[1:])


@dataclass
class Stretch(InputPartition):
    path: str
    keys: dict[str, str]
    start: int = 0
    rows: int = -1


_TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, keys: list[str], rows: int):
        self.path, self.schema, self.keys, self.rows, self.tests = path, schema, keys, rows, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.keys:
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def _value(self, key: str, text: str):
        return int(text) if isinstance(self.schema[key].dataType, (T.LongType, T.IntegerType)) else text

    def partitions(self) -> list[Stretch]:
        out: list[Stretch] = []
        for path, keys in _files(self.path):
            if not all(_TESTS[kind](self._value(k, keys[k]), v) for kind, k, v in self.tests):
                continue
            n = -1
            if self.rows:
                with _Open(_at(self.path)[0], path) as f:
                    n = f.header(f.names[0])[0][0]
            out += [Stretch(path, keys, at, min(self.rows, n - at)) for at in range(0, n, self.rows)] if self.rows else [Stretch(path, keys)]
        return out or [Stretch("", {})]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = to_arrow_schema(self.schema)
        arrays = [c for c in schema.names if c not in self.keys]
        with _Open(_at(self.path)[0], partition.path) as f:
            heads = {c: f.header(c) for c in (arrays or f.names[:1])}
            n = next(iter(heads.values()))[0][0] - partition.start if partition.rows < 0 else partition.rows
            width = sum(kind.itemsize * int(np.prod(shape[1:])) for shape, _, kind, _ in heads.values())
            step = max(1, BATCH_BYTES // max(1, width))
            for at in range(0, n, step):
                m = min(step, n - at)
                columns = [pa.array([self._value(c, partition.keys[c])] * m, schema.field(c).type) if c in self.keys else _arrow(f.rows(c, partition.start + at, m), schema.field(c).type) for c in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, keys: list[str], chunk: int, overwrite: bool):
        self.path, self.keys, self.chunk, self.overwrite = path, keys, chunk, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _at(self.path)
        held: dict[tuple, list[pa.Table]] = {}
        files: list[tuple[str, str]] = []

        def flush(key: tuple) -> None:
            rows = pa.concat_tables(held.pop(key)).combine_chunks()
            folder = "/".join([root.rstrip("/"), *(f"{k}={quote(str(v), safe='')}" for k, v in zip(self.keys, key, strict=True))])
            system.create_dir(folder, recursive=True)
            name = f"part-{uuid.uuid4().hex}.npz"
            arrays = {c: _numpy(rows[c].chunk(0) if rows[c].num_chunks else rows[c].combine_chunks(), c) for c in rows.column_names}
            with system.open_output_stream(f"{folder}/.{name}") as out:
                np.savez(out, **arrays)
            files.append((f"{folder}/.{name}", f"{folder}/{name}"))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = table.select(self.keys).group_by(self.keys).aggregate([]).to_pylist() if self.keys else [{}]
            for kind in kinds:
                mask = np.ones(table.num_rows, bool)
                for k, v in kind.items():
                    if v is None:
                        raise ValueError(f"{k} is a key and has nulls")
                    mask &= np.array(table[k].to_pylist(), dtype=object) == v
                key = tuple(kind.values())
                some = table.filter(pa.array(mask)).drop_columns(self.keys)
                for at in range(0, some.num_rows, self.chunk):
                    held.setdefault(key, []).append(some.slice(at, self.chunk))
                    if sum(t.num_rows for t in held[key]) >= self.chunk:
                        flush(key)
            if sum(t.nbytes for ts in held.values() for t in ts) > 8 * BATCH_BYTES:  # many keys in one task: shorter chunks
                for key in list(held):
                    flush(key)
        for key in list(held):
            flush(key)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _at(self.path)
        old = [p for p, _ in _files(self.path)] if self.overwrite else []
        for message in messages:
            for hidden, shown in message.files if message else ():
                system.move(hidden, shown)
        for p in old:
            system.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _at(self.path)
        for message in messages:
            for hidden, _ in message.files if message else ():
                system.delete_file(hidden)


class ArrayStore(DataSource):
    """Format ``arrays``. Options: path; arrays (names with commas; all, if absent); rows (of a partition; whole files,
    if absent); keys and chunk (of the sink)."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> T.StructType:
        first = next(_files(self.options["path"]), None)
        if first is None:
            raise FileNotFoundError(self.options["path"])
        asked = [a for a in self.options.get("arrays", "").split(",") if a]
        with _Open(_at(self.options["path"])[0], first[0]) as f:
            heads = [(a, *f.header(a)) for a in asked or f.names]
        keys = [T.StructField(k, T.LongType() if v.lstrip("-").isdigit() else T.StringType()) for k, v in first[1].items()]
        return T.StructType(keys + [T.StructField(a, _spark_type(shape, kind)) for a, shape, _, kind, _ in heads])

    def reader(self, schema: T.StructType) -> ArrayReader:
        first = next(_files(self.options["path"]), (None, {}))
        return ArrayReader(self.options["path"], schema, [k for k in first[1] if k in schema.names], int(self.options.get("rows", 0)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], [k for k in self.options.get("keys", "").split(",") if k], int(self.options.get("chunk", CHUNK)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark push filters to it."""
    spark.conf.set(PUSH, "true")
    spark.dataSource.register(ArrayStore)


def read_arrays(spark: SparkSession, path: str, arrays: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """The store's keys and arrays (all, or those named); ``rows`` splits files into partitions of so many rows."""
    register(spark)
    reader = spark.read.format("arrays")
    reader = reader.option("arrays", ",".join(arrays)) if arrays else reader
    return (reader.option("rows", rows) if rows else reader).load(path)


def write_arrays(df: DataFrame, path: str, keys: list[str], chunk: int = CHUNK, mode: str = "overwrite") -> None:
    """All columns but ``keys`` as arrays, in files of ``chunk`` rows at most in the folders of their keys."""
    register(df.sparkSession)
    df.write.format("arrays").option("keys", ",".join(keys)).option("chunk", chunk).mode(mode).save(path)
