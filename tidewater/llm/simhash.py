"""SimHash near-duplicates by anchor-point covering (operator 4).

Fingerprints: a bit is set if it is set in over half of the shingles' 64-bit hashes. Two fingerprints link at
``distance`` (4) or fewer differing bits.

Search: the 64 bits are cut into blocks, of which some choice of a few has 1 differing bit at most (of 3 blocks, 1). In a
choice the anchors are the words of a covering code of radius 1: a [15, 11] Hamming code on 15 of its bits, all values on
the others, so that every value has one anchor within 1. A fingerprint is at home at that anchor, and visits (is
replicated to) every anchor within radius + 1 = 2 bits of it: if two blocks differ in one bit, the second's value is
within 2 of the first's home. So comparing each anchor's home fingerprints with its visitors loses no link. How often a
fingerprint is replicated follows from the layout alone (45 times for 3 blocks). The layout follows from the number of
different fingerprints (``LAYOUTS``): more combined blocks make anchors finer, so that spread fingerprints have ``AT_HOME``
of them at an anchor at most, and the work grows with their number and not with its square.

Skew: equal fingerprints are merged before (exact copies cost one row), an anchor's visitors are salted over tasks,
and a task emits each fingerprint's link to the smallest one connected to it, not pairs. Links become components by
:func:`tidewater.llm.components.connected_components`.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows share a
component; a null doc_id links to nothing (component_id null); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import written
from .words import Words, slices, text_column

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: (blocks, taken at a time), from the coarsest anchors to the finest: 2 ** (64 * taken / blocks - 4) of them for a choice.
LAYOUTS = ((3, 1), (5, 2), (6, 3))
AT_HOME = 64
#: Tasks that share the visitors of one anchor; an anchor's home fingerprints go to each of them.
SALTS = 4
#: Pairs compared at once in a task.
PAIRS = 1 << 21


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of whole texts, and where each text's begin in them (one more entry than texts)."""
    import xxhash

    w = Words(texts)
    body = w.buf[: w.size]
    body[(body >= 65) & (body <= 90)] |= 0x20
    joined, place = w.joined()
    raw, n = bytes(joined), np.diff(w.first)
    shingles = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(shingles)])
    word = np.repeat(w.first[:-1] - begin[:-1], shingles) + np.arange(begin[-1])
    last = np.minimum(word + shingle, np.repeat(w.first[1:], shingles))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(raw[a:b], SEED) for a, b in zip(place[word].tolist(), (place[last] - 1).tolist(), strict=True)), np.uint64, len(word)), begin


def majority(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fingerprint of each text's shingle hashes."""
    shingles, out = np.diff(begin), np.zeros(len(begin) - 1, np.uint64)
    full = np.flatnonzero(shingles)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, begin[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > shingles[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of whole texts, as uint64."""
    return majority(*shingle_hashes(texts, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long). Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint(text_column(part), shingle).view(np.int64))], names=["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


def layout_for(n: int) -> tuple[int, int]:
    """The coarsest layout with ``AT_HOME`` of ``n`` spread fingerprints at an anchor at most (the finest, if none has)."""
    return next((x for x in LAYOUTS if n <= AT_HOME * 2.0 ** (64 * x[1] / x[0] - 4)), LAYOUTS[-1])


class Covering:
    """Anchors of 64-bit values, for links of ``distance`` bits: ``taken`` of ``blocks`` blocks at a time, of which some
    choice has ``slack`` differing bits at most."""

    def __init__(self, blocks: int = LAYOUTS[0][0], taken: int = LAYOUTS[0][1], distance: int = DISTANCE):
        low, rest = divmod(distance, blocks)
        self.slack = sum(([low] * (blocks - rest) + [low + 1] * rest)[:taken])  # the most even spread is the worst
        edges = [round(64 * i / blocks) for i in range(blocks + 1)]
        self.choices = [np.concatenate([np.arange(edges[b], edges[b + 1]) for b in c]) for c in combinations(range(blocks), taken)]
        # the code: positions 1..15 of a Hamming code are the first 15 bits of a choice
        self.patterns: list[list[np.ndarray]] = []
        for bits in self.choices:
            if len(bits) < 15:
                raise ValueError("a choice of blocks needs 15 bits at least")
            by: list[list[int]] = [[] for _ in range(16)]
            for weight in range(self.slack + 2):
                for flips in combinations(range(len(bits)), weight):
                    syndrome = 0
                    for f in flips:
                        syndrome ^= f + 1 if f < 15 else 0
                    by[syndrome].append(sum(1 << int(bits[f]) for f in flips))
            self.patterns.append([np.array(p, np.uint64) for p in by])

    def anchors(self, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each choice: its number, each fingerprint's home anchor, and (row, anchor) of all visits."""
        one = np.uint64(1)
        for k, bits in enumerate(self.choices):
            mask = np.uint64(sum(1 << int(b) for b in bits))
            x = fp & mask
            syndrome = np.zeros(len(fp), np.uint64)
            for f in range(15):
                syndrome ^= ((x >> np.uint64(bits[f])) & one) * np.uint64(f + 1)
            flip = np.concatenate([[0], [1 << int(b) for b in bits[:15]]]).astype(np.uint64)
            home = x ^ flip[syndrome.astype(np.int64)]
            rows, visited = [], []
            for s in range(16):
                at = np.flatnonzero(syndrome == s)
                rows.append(np.repeat(at, len(self.patterns[k][s])))
                visited.append((x[at][:, None] ^ self.patterns[k][s][None, :]).ravel())
            yield k, home, np.concatenate(rows), np.concatenate(visited)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the graph a-b to the smallest node connected to it."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = inv[: len(a)], inv[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _compare(key: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the links inside each anchor. Rows come sorted by key, whole anchors only."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(begin[1:], len(key))
    group = np.repeat(np.arange(len(begin)), end - begin)
    visits = np.flatnonzero(~home)
    first = np.searchsorted(visits, begin)
    count = np.searchsorted(visits, end) - first
    hosts = np.flatnonzero(home & (count[group] > 0))
    if not len(hosts):
        return
    work = np.cumsum(count[group[hosts]])
    at = 0
    while at < len(hosts):
        base = work[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(work, base + PAIRS, "right")))
        some = hosts[at:stop]
        n = count[group[some]]
        h = np.repeat(some, n)
        v = visits[np.repeat(first[group[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        near = (np.bitwise_count(fp[h] ^ fp[v]) <= distance) & (node[h] != node[v])
        if near.any():
            yield stars(node[h[near]], node[v[near]])
        at = stop


def links(reps: DataFrame, covering: Covering | None = None, distance: int = DISTANCE, salts: int = SALTS) -> DataFrame:
    """a, b: edges that connect the same fingerprints as all links do. ``reps``: fp, node, one row for each fingerprint (a
    written table: its rows are counted)."""
    code = covering or Covering(*layout_for(reps.count()), distance=distance)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                node = part.column(1).to_numpy(zero_copy_only=False)
                for k, home, row, visited in code.anchors(fp):
                    salt = (fp[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % salts
                    every = np.repeat(np.arange(len(fp)), salts)
                    rows = np.concatenate([every, row])
                    arrays = [np.concatenate([home[every], visited]).view(np.int64), np.concatenate([np.tile(np.arange(salts), len(fp)), salt]) * len(code.choices) + k, fp[rows].view(np.int64), node[rows], np.arange(len(rows)) < len(every)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["anchor", "part", "fp", "node", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(t)
            anchor, part, fp, node, home = (table.column(c).to_numpy() for c in ("anchor", "part", "fp", "node", "home"))
            key = np.cumsum(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
            for a, b in _compare(key, fp, node, home.astype(bool), distance):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last anchor of a batch may go on in the next
            anchor, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from out([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (int(anchor[0]), int(part[0])):
                yield from out(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from out(held)

    rows = reps.select("fp", F.col("node").cast("long").alias("node")).where("node is not null").mapInArrow(replicate, "anchor long, part long, fp long, node long, home boolean")
    return rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE, covering: Covering | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id (smallest id reachable over links, the row's own included)."""
    spark = docs.sparkSession
    prints = spark.read.parquet(written(fingerprints(docs, shingle, id_col, text_col), "fingerprints"))
    reps = prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).alias("node"))
    reps = spark.read.schema(reps.schema).parquet(written(reps, "distinct-fingerprints"))
    roots = connected_components(links(reps, covering, distance))
    classes = reps.join(roots, "node", "left").select(F.col("fp").alias("__fp"), F.coalesce("root", "node").alias("component_id"))
    joined = prints.join(classes, prints["fp"] == classes["__fp"], "left")
    return joined.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"))
