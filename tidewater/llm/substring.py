"""Substring dedup over a log-structured fingerprint index (operator 1).

The index is a list of immutable runs: Parquet tables of the fingerprints of all windows seen so far, cut into buckets
by value and sorted in each. A new batch is handled in three steps:

1. every window of 13 words becomes a 64-bit fingerprint, sent to its bucket with the number of the document group
   that it starts in; a group is a stretch of ``GROUP_DOCS`` document ids, and a map task sends each fingerprint once
   for a group, so that a passage in a third of all documents costs a bucket one entry for a group, not for a document;
2. each bucket merge-joins its sorted fingerprints with the runs, which are sorted already, and with the batch itself:
   sorted by the first 40 bits, matches are verified by the other 24, which come from an independent hash. A group learns
   which of its windows start in the history or in an earlier group. What is new becomes the next run;
3. each group decides about its own documents with that and with its own windows in document order, and cuts out
   the words that removed windows cover.

Runs beyond ``FANOUT`` are compacted: merged bucket by bucket into one. Batches must come in ascending document ids. Each
run carries its window and number of buckets; opening runs of others is an error, as their fingerprints would not meet.
Groups have fewer ids where texts are long, so that one has some ``GROUP_BYTES`` of text; rows of one id stay together.

Defined results: null and empty texts have no words; documents of fewer than 13 words lose nothing; repeated rows of
one doc_id do not remove each other's words; documents with a null doc_id lose nothing and take nothing; texts are
read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_dir, written
from .words import Words, mix, slices, text_column

WINDOW = 13
GROUP_DOCS = 2048
GROUP_BYTES = 16 << 20
#: Windows of a bucket, for which an index is laid out.
BUCKET_WINDOWS = 1_000_000
#: Windows that a map task sorts and sends at once.
SENT_AT_ONCE = 1_000_000
FANOUT = 2
HISTORY = -1
_Q1, _Q2 = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F


def pack(keys: np.ndarray) -> bytes:
    """Sorted fingerprints as the first one and the byte planes of the differences; high planes that are zero are left out."""
    if not len(keys):
        return b""
    diff = keys[1:] - keys[:-1]
    used = (int(diff.max()).bit_length() + 7) // 8 if len(diff) else 0
    planes = diff.view(np.uint8).reshape(-1, 8)[:, :used].T
    return keys[:1].tobytes() + bytes([used]) + np.ascontiguousarray(planes).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if n:
        used, planes = raw[8], np.frombuffer(raw, np.uint8, offset=9)
        out[1:].view(np.uint8).reshape(-1, 8)[:, :used] = planes.reshape(used, n - 1).T if used else 0
        out[0] = np.frombuffer(raw, np.uint64, 1)[0]
        out = np.cumsum(out, dtype=np.uint64)
    return out


def _unpacked(table: pa.Table) -> np.ndarray:
    """All fingerprints of the rows (n, keys), row by row."""
    sets = [unpack(raw, n) for raw, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def window_fingerprints(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each window: 40 bits to sort and find, 24 bits of a second hash to verify."""
    h = w.hashes()
    at, one = w.windows(h, window, _Q1)
    _, two = w.windows(mix(h ^ np.uint64(_Q2)), window, _Q2)
    return at, (one & np.uint64(0xFFFFFFFFFF000000)) | (two >> np.uint64(40))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def _rows(lead: list[tuple], keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*lead, strict=True)) or [[] for _ in names[:-2]]
    kinds = {"kind": pa.int32(), "bucket": pa.int32(), "grp": pa.int64()}
    arrays = [pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([len(k) for k in keys], pa.int32()), pa.array([pack(k) for k in keys], pa.binary())], names=names)


class FingerprintIndex:
    """Runs of window fingerprints in ``path`` (a shared folder). ``runs`` opens an index that was left there."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = WINDOW, buckets: int = 64, group_docs: int = GROUP_DOCS, fanout: int = FANOUT, runs: list[str] | None = None):
        self.spark, self.path = spark, path or shared_dir(spark)
        self.window, self.buckets, self.group_docs, self.fanout = window, buckets, group_docs, fanout
        self.runs = list(runs or [])
        for run in self.runs:
            found = self.spark.read.parquet(run)
            made = found.select("window", "buckets").distinct().limit(2).collect() if {"window", "buckets"} <= set(found.columns) else None
            if made is None or any((r["window"], r["buckets"]) != (window, buckets) for r in made):
                raise ValueError(f"{run} has windows and buckets {[tuple(r) for r in made or []]}, this index {(window, buckets)}")

    def _stamped(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what an index must agree with."""
        return rows.withColumns({"window": F.lit(self.window), "buckets": F.lit(self.buckets)})

    # -- step 1
    def _windows(self, docs: DataFrame) -> DataFrame:
        window, buckets, group_docs = self.window, self.buckets, self.group_docs

        def sent(k: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
            """Each fingerprint of a group once, by bucket and group, sorted."""
            order = np.lexsort((k, g)) if (g != g[0]).any() else np.argsort(k)
            k, g = k[order], g[order]
            once = np.ones(len(k), bool)
            once[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
            k, g = k[once], g[once]
            b = _bucket(k, buckets)
            cut = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (g[1:] != g[:-1])]))
            return _rows([(int(b[i]), int(g[i])) for i in cut], np.split(k, cut[1:]), ["bucket", "grp", "n", "keys"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, groups, held = [], [], 0
                for part in slices(batch):
                    w = Words(text_column(part))
                    at, k = window_fingerprints(w, window)
                    keys.append(k)
                    groups.append(np.floor_divide(part.column(0).to_numpy(zero_copy_only=False), group_docs)[w.doc[at]])
                    held += len(k)
                    if held > SENT_AT_ONCE:
                        yield sent(np.concatenate(keys), np.concatenate(groups))
                        keys, groups, held = [], [], 0
                if held:
                    yield sent(np.concatenate(keys), np.concatenate(groups))

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
        return rows.mapInArrow(run, "bucket int, grp long, n int, keys binary")

    def _history(self) -> DataFrame:
        out = self.spark.createDataFrame([], "bucket int, n int, keys binary")
        for run in self.runs:
            out = out.unionByName(self.spark.read.parquet(run).select("bucket", "n", "keys"))
        return out

    # -- step 2
    def _merge_join(self, fresh: DataFrame, keep: bool) -> DataFrame:
        """kind 0: windows that a group finds in the runs or in earlier groups; kind 1: the next run."""
        schema = "kind int, bucket int, grp long, n int, keys binary"

        def run(fresh: pa.Table, history: pa.Table) -> pa.Table:
            if not fresh.num_rows:
                return pa.Table.from_batches([_rows([], [], ["kind", "bucket", "grp", "n", "keys"])])
            bucket, n = fresh.column("bucket")[0].as_py(), fresh.column("n").to_pylist()
            groups = np.repeat(fresh.column("grp").to_numpy(), n)
            keys = _unpacked(fresh)
            order = np.lexsort((groups, keys))
            keys, groups = keys[order], groups[order]
            past = np.sort(_unpacked(history), kind="stable")  # merges runs that are sorted
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]  # both parts of the fingerprint: found, and verified
            known = np.zeros(len(keys), bool)
            if len(past):
                known = past[np.minimum(np.searchsorted(past, keys), len(past) - 1)] == keys
            again = known | (groups != groups[new][np.cumsum(new) - 1])
            again[1:] &= new[1:] | (groups[1:] != groups[:-1])
            back_k, back_g = keys[again], groups[again]
            order = np.argsort(back_g, kind="stable")
            back_k, back_g = back_k[order], back_g[order]
            cut = np.flatnonzero(np.concatenate([[True], back_g[1:] != back_g[:-1]])) if len(back_g) else np.zeros(0, int)
            lead, out = [(0, bucket, int(back_g[i])) for i in cut], np.split(back_k, cut[1:]) if len(cut) else []
            if keep:
                run_keys = keys[new & ~known]
                chunks = np.array_split(run_keys, max(1, len(run_keys) // 200_000)) if len(run_keys) else []
                lead, out = lead + [(1, bucket, HISTORY)] * len(chunks), [*out, *chunks]
            return pa.Table.from_batches([_rows(lead, out, ["kind", "bucket", "grp", "n", "keys"])])

        def alone(fresh: pa.Table) -> pa.Table:
            return run(fresh, fresh.slice(0, 0))

        if not self.runs:
            return fresh.groupBy("bucket").applyInArrow(alone, schema)
        return fresh.groupBy("bucket").cogroup(self._history().groupBy("bucket")).applyInArrow(run, schema)

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket. The old runs' files stay for readers that have them open."""

        def run(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            keys = np.sort(_unpacked(table), kind="stable")  # merges runs that are sorted
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            chunks = np.array_split(keys, max(1, len(keys) // 200_000))
            return pa.Table.from_batches([_rows([(bucket,)] * len(chunks), chunks, ["bucket", "n", "keys"])])

        if len(self.runs) > 1:
            merged = self._history().groupBy("bucket").applyInArrow(run, "bucket int, n int, keys binary")
            self.runs = [written(self._stamped(merged), "run", folder=self.path)]

    # -- step 3
    def _cut_out(self, docs: DataFrame, found: DataFrame, text: bool) -> DataFrame:
        window, group_docs = self.window, self.group_docs

        def run(docs: pa.Table, found: pa.Table) -> pa.Table:
            foreign = np.sort(_unpacked(found))
            docs = docs.sort_by("doc_id").combine_chunks()
            batch = docs.to_batches()[0] if docs.num_rows else pa.RecordBatch.from_pylist([], schema=docs.schema)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            # the group's own windows, in slices: first the fingerprints, then the cutting
            parts = list(slices(batch))
            keys, owner = [], []
            at = 0
            for part in parts:
                w = Words(text_column(part))
                first, k = window_fingerprints(w, window)
                keys.append(k)
                owner.append(ids[at + w.doc[first]])
                at += part.num_rows
            k, own = (np.concatenate(keys), np.concatenate(owner)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(k, kind="stable")  # equal ones stay in document order
            new = np.ones(len(k), bool)
            new[1:] = k[order][1:] != k[order][:-1]
            first_id = np.empty(len(k), np.int64)
            first_id[order] = own[order][new][np.cumsum(new) - 1]
            gone = own > first_id
            if len(foreign):
                place = np.minimum(np.searchsorted(foreign, k), len(foreign) - 1)
                gone |= foreign[place] == k
            out, base = [], 0
            for part, size in zip(parts, map(len, keys), strict=True):
                w = Words(text_column(part))
                first, _ = w.windows(np.zeros(len(w.starts), np.uint64), window, 1)
                out.append(_kept(part, w, first[gone[base : base + size]], window, text))
                base += size
            return pa.Table.from_batches(out) if out else _kept(batch, Words(text_column(batch)), np.zeros(0, int), window, text).schema.empty_table()

        grouped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("grp", F.expr(f"cast(floor(doc_id / {group_docs}) as long)"))
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
        with_id = grouped.where("doc_id is not null").groupBy("grp").cogroup(found.select("grp", "n", "keys").groupBy("grp")).applyInArrow(run, schema)

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield _kept(part, Words(text_column(part)), np.zeros(0, int), window, text)

        return with_id.unionByName(grouped.where("doc_id is null").select("doc_id", "text").mapInArrow(plain, schema))

    def dedup(self, docs: DataFrame, *, keep: bool = True, text: bool = False) -> DataFrame:
        """The batch's documents without the words that earlier documents have: doc_id, n_words, n_removed, kept_sha256,
        and with ``text`` the kept words themselves. ``keep``: the batch's windows become a run of the index."""
        path = written(self._stamped(self._merge_join(self._windows(docs), keep)), "merged", by="kind", folder=self.path)
        merged = self.spark.read.schema("bucket int, grp long, n int, keys binary, window int, buckets int, kind int").parquet(path)  # without rows there is no file to infer it from
        if keep and not merged.where("kind = 1").isEmpty():
            self.runs.append(f"{merged.inputFiles()[0].rpartition('/kind=')[0]}/kind=1")
        out = self._cut_out(docs, merged.where("kind = 0"), text)
        if len(self.runs) > self.fanout:
            self.compact()
        return out


def _kept(part: pa.RecordBatch, w: Words, gone: np.ndarray, window: int, text: bool) -> pa.RecordBatch:
    cover = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + window, -1)
    keep = np.cumsum(cover)[:-1] == 0
    joined, place = w.joined(keep)
    cut = place[w.first]
    pieces = [joined[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
    n = np.diff(w.first)
    arrays = [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n - np.diff(kept), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if text:
        arrays.append(pa.array([bytes(p).decode() for p in pieces], pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def layout(docs: DataFrame, bucket_windows: int = BUCKET_WINDOWS) -> tuple[int, int]:
    """Buckets for an index that is to hold windows of as many bytes as ``docs`` has, and ids for a group."""
    size, first, last = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.min("doc_id"), F.max("doc_id")).first()
    each = (size or 0) / max(1, (last or 0) - (first or 0) + 1)  # bytes for an id
    return max(16, -(-(size or 0) // (6 * bucket_windows))), int(max(1, min(GROUP_DOCS, GROUP_BYTES // max(1, each))))


def remove_repeats(docs: DataFrame, *, shares: tuple[float, ...] = (0.05, 0.1, 0.2), window: int = WINDOW, text: bool = False) -> DataFrame:
    """Dedup a whole table as batches in ascending doc_id through a new index. ``shares``: the shares of documents at
    which a batch ends (about: by approximate quantiles of doc_id); every batch but the last becomes a run, and a third run
    brings the first compaction."""
    buckets, group_docs = layout(docs)
    index = FingerprintIndex(docs.sparkSession, window=window, buckets=buckets, group_docs=group_docs)
    cuts = docs.agg(F.percentile_approx("doc_id", F.lit(list(shares)), 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    out = None
    for low, high in zip(edges, edges[1:], strict=False):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        done = index.dedup(batch, keep=high is not None, text=text)
        out = done if out is None else out.unionByName(done)
    if cuts:  # comparisons leave out null ids
        lone = index._cut_out(docs.where("doc_id is null"), docs.sparkSession.createDataFrame([], "grp long, n int, keys binary"), text)
        out = out.unionByName(lone)
    return out
