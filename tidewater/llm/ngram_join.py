"""N-gram Jaccard join by count-vector R-trees (operator 11): documents whose sets of three-word shingles link at
``100 * intersection >= PERCENT * union``, as components. Exact: no link between different sets is lost.

Points: shingles are hashed into groups, and a document is the vector of its groups' counts. Two sets share no more than
the sum of the smaller counts, group by group, and a link needs ``needed`` shingles in common. An R-tree packs the points of
a shard; a box (the largest counts and the range of sizes below it) whose summed minima with a query fall short holds no
partner, nor does such a point. What survives is verified on whole texts.

Shards: a tree over all documents would be met by all. But linked sets differ in ``m - 1`` shingles at most, where ``m``
follows from their size; so of ``m`` blocks into which shingles are hashed, one has the same content in both. A shard is a block and its
content within a class of sizes; documents near the upper end of a class enter the next one, too. Shards of one set are dropped.

Work: documents of one set are merged first (by a 128-bit digest), so copies cost a row. In a shard each point
is asked with the smallest one, its hub, over all shards once; what thereby becomes connected needs no more questions among itself. Only
points that are not connected with their hub are searched in the shard's tree, in tiles of ``TILE`` points, so that a shard of any
size is spread over tasks; pairs that are connected already are left out. Where survivors are many, a first round sends
stars of them, and the second only what these leave apart: a group of near copies costs its size, not its square.

Defined results: null and empty texts, and those without words, have the empty set and link to nothing; fewer than three
words are one shingle; rows of one id are one document (each row keeps its own set's size); a null id links to nothing and has a
null component; columns besides id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .near_copies import verified, whole_groups
from .simhash import shingle_hashes, stars
from .store import written
from .words import mix, slices, text_column

SHINGLE, PERCENT = 3, 90
#: Points of a shard that are searched in one task; points in a leaf and children of a box; cells of a comparison laid out at once.
TILE, LEAF, FAN, CELLS = 4096, 32, 8, 1 << 22
#: Parts of a tile for what is only compared with a hub: no tree is worth building for one query.
OF_HUB = 16
#: Survivors for each point of a tile from which on stars are sent first.
DENSE = 4
#: Bytes of text that are verified against one set in one group.
SHARE = 1 << 20
PRINTS = "id long, bytes long, size long, same binary, vector binary, own array<long>, above array<long>"


def needed(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that sets of these sizes must share to link."""
    return -(-percent * (a + b) // (100 + percent))


class Classes:
    """Classes of sizes: each begins at half as much again as the one before (more, where partners can be larger), and has enough blocks for its largest sets.
    Sets too small to differ and still link are left to the digest."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        lows = [next(s for s in range(1, 10**6) if s * percent >= 100 * (s - 1) > 0 and self._apart(s, percent) > 0) if percent < 100 else largest]
        while lows[-1] < largest:
            lows.append(max(-(-lows[-1] * 3 // 2), -(-lows[-1] * 100 // percent)))
        self.lows, self.percent = np.array(lows, np.int64), percent
        self.blocks = np.array([self._apart(high - 1, percent) + 1 for high in lows[1:]] + [1], np.int64)

    @staticmethod
    def _apart(size: int, percent: int) -> int:
        """Shingles by which two linked sets of this size at most can differ."""
        return 2 * size * (100 - percent) // (100 + percent)

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each set's own class (-1: none), and the next one if a partner can be there (else -1)."""
        own = np.searchsorted(self.lows, size, "right") - 1
        low = self.lows[np.minimum(own + 1, len(self.lows) - 1)]
        above = np.where((100 * size >= self.percent * low) & (size > 0), own + 1, -1)
        return own, above


def groups_of(size: np.ndarray) -> np.ndarray:
    """Groups of a set's vector: a power of two, about one for two shingles."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1) / 2 + 1e-9)).clip(0).astype(np.int64))


def _keys(row: np.ndarray, hashes: np.ndarray, kind: np.ndarray, classes: Classes) -> pa.Array:
    """For each text a list with a key for each block of class ``kind`` (-1: none): a hash of class, block and content.
    Rows and hashes come sorted, so a block's shingles lie together."""
    m = np.where(kind >= 0, classes.blocks[np.maximum(kind, 0)], 0)
    offsets = np.concatenate([[0], np.cumsum(m)])
    content = np.zeros(offsets[-1], np.uint64)
    use = m[row] > 0
    row, hashes = row[use], hashes[use]
    if len(row):
        block = ((hashes >> np.uint64(32)) * m[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = offsets[row] + block
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content[at[first]] = np.add.reduceat(mix(hashes + np.uint64(1)), first)
    number = np.arange(offsets[-1]) - np.repeat(offsets[:-1], m)
    keys = mix(content ^ mix((np.repeat(kind, m) * (1 << 32) + number + 1).astype(np.uint64)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))


def prints(texts: pa.Array, classes: Classes, shingle: int = SHINGLE) -> list[pa.Array]:
    """Of whole texts: bytes, size and digest of the set, its count vector, keys in the own class and in the one above."""
    hashes, begin = shingle_hashes(texts, shingle)
    row = np.repeat(np.arange(len(texts)), np.diff(begin))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[once], hashes[once]
    size = np.bincount(row, minlength=len(texts))
    ends = np.concatenate([[0], np.cumsum(size)])
    same = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    wide = groups_of(size)
    place = np.concatenate([[0], np.cumsum(wide)])
    counts = np.bincount(place[row] + (hashes & (wide[row] - 1).astype(np.uint64)).astype(np.int64), minlength=place[-1])
    vectors = [counts[a:b].astype(np.uint8 if counts[a:b].max() < 256 else np.uint32).tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    own, above = classes.of(size)
    return [pc.binary_length(texts).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.binary()), pa.array(vectors, pa.binary()), _keys(row, hashes, own, classes), _keys(row, hashes, above, classes)]


def points(vectors: list[bytes], size: np.ndarray) -> np.ndarray:
    """Count vectors side by side, folded to the groups of the smallest set among them."""
    wide = groups_of(size)
    low = int(wide.min())
    return np.stack([np.frombuffer(v, np.uint8 if len(v) == w else np.uint32).reshape(-1, low).sum(0) for v, w in zip(vectors, wide.tolist(), strict=True)]).astype(np.int32)


class CountTree:
    """An R-tree over count vectors, packed once: points are halved at the middle of the coordinate that spreads most
    until a leaf is left, and ``FAN`` neighbours at a time get a box."""

    def __init__(self, vectors: np.ndarray, size: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        self.order = np.arange(len(size))
        todo = [(0, len(size))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                continue
            some = vectors[self.order[a:b]]
            spread = some.max(0) - some.min(0)
            middle = (a + b) // 2
            self.order[a:b] = self.order[a:b][np.argsort(some[:, int(spread.argmax())], kind="stable")]
            todo += [(a, middle), (middle, b)]
        # from the points up: largest counts, smallest and largest size
        self.levels = [(vectors[self.order], size[self.order], size[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            high, low, top = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(top, at)))

    def search(self, vectors: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point): pairs that the bound leaves."""
        n = len(self.levels[-1][1])
        query, box = np.repeat(np.arange(len(size)), n), np.tile(np.arange(n), len(size))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = self.levels[depth]
            fits = (100 * top[box] >= self.percent * size[query]) & (self.percent * low[box] <= 100 * size[query])
            query, box = query[fits], box[fits]
            enough, step = np.zeros(len(query), bool), max(1, CELLS // vectors.shape[1])
            for at in range(0, len(query), step):
                q, p = query[at : at + step], box[at : at + step]
                shared = np.minimum(vectors[q], high[p]).sum(1)
                enough[at : at + step] = shared >= needed(size[q], low[p], self.percent)
            query, box = query[enough], box[enough]
            if depth:
                below = len(self.levels[depth - 1][1])
                query, box = np.repeat(query, FAN), (box[:, None] * FAN + np.arange(FAN)).ravel()
                query, box = query[box < below], box[box < below]
        return query, self.order[box]


def _survivors(rows: pa.RecordBatch, percent: int, stars_first: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one group that the bound leaves and that are not connected yet: side 0 asks side 1, or all others where
    there is no side 1. With ``stars_first``, stars of them where they are many (and True)."""
    node, side, size, label = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("node", "side", "size", "label"))
    vectors = points(rows.column(rows.schema.get_field_index("vector")).to_pylist(), size)
    asks = np.flatnonzero(side == 0)
    told = np.flatnonzero(side == 1) if side.any() else asks
    if not len(asks):
        return asks, asks, False
    q, p = CountTree(vectors[told], size[told], percent).search(vectors[asks], size[asks])
    a, b = asks[q], told[p]
    open_ = (label[a] != label[b]) & (node[a] != node[b])
    a, b = node[a[open_]], node[b[open_]]
    a, b = np.minimum(a, b), np.maximum(a, b)
    if stars_first and len(a) > DENSE * len(node):
        far, near = stars(a, b)
        return near, far, True
    return a, b, False


def _searched(rows: DataFrame, keys: list[str], percent: int, stars_first: bool = False) -> DataFrame:
    """a, b, dense: the survivors of groups by ``keys``; columns side, node, size, label, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, group in whole_groups(batches, len(keys), text="vector"):
            begin = np.searchsorted(group, np.arange(group[-1] + 2))
            found = [_survivors(some.slice(a, b - a), percent, stars_first) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            a, b, dense = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.repeat([x[2] for x in found], [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dense, pa.bool_())], names=["a", "b", "dense"])

    ordered = rows.select(*keys, "side", "node", "size", "label", "vector").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "a long, b long, dense boolean")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written and read: without rows there is no file to infer its columns from."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def _with_hubs(pairs: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """The pairs (hub, node) that the bound leaves. A hub's many members are dealt over parts, and it is sent to each."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    asked = pairs.join(parts, "hub").select("hub", F.expr("cast(pmod(xxhash64(node), parts) as int)").alias("part"), F.lit(1).alias("side"), "node")
    told = parts.select("hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("node"))
    rows = asked.unionByName(told).join(sets, "node").withColumn("label", F.col("node"))
    return _searched(rows, ["hub", "part"], percent)


def _among_the_rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, tile: int, stars_first: bool) -> DataFrame:
    """Survivors among the members of a shard that ``labels`` does not connect with its hub, and between these and the others."""
    of = lambda c, name: labels.select(F.col("node").alias(c), F.col("root").alias(name))
    named = members.where("node <> hub").join(of("node", "mine"), "node", "left").join(of("hub", "its"), "hub", "left")
    named = named.select("key", "node", F.coalesce("mine", "node").alias("label"), (F.coalesce("mine", "node") != F.coalesce("its", "hub")).alias("far"))
    n = lambda far: F.count_if(F.col("far") == far)
    tiles = lambda far: F.ceil(n(far) / tile).cast("int")
    count = named.groupBy("key").agg(n(True).alias("n_far"), n(False).alias("n_near"), tiles(True).alias("far_tiles"), tiles(False).alias("near_tiles"))
    # written, so that the join is not bound to the aggregation's partitions and a large shard can be split
    count = _kept(count.where("n_far > 1 or n_far = 1 and n_near > 0"), "open-shards")
    dealt = named.join(count, "key").withColumn("t", F.expr("cast(pmod(xxhash64(node), if(far, far_tiles, near_tiles)) as int)"))
    meets = F.expr("""if(far,
        concat(if(n_near > 0, transform(sequence(0, near_tiles - 1), i -> named_struct('kind', 0, 'i', i, 'j', t, 'side', 0)), array()),
               if(n_far > 1, transform(sequence(0, far_tiles - 1), u -> named_struct('kind', 1, 'i', least(t, u), 'j', greatest(t, u), 'side', cast(t > u as int))), array())),
        transform(sequence(0, far_tiles - 1), j -> named_struct('kind', 0, 'i', t, 'j', j, 'side', 1)))""")
    rows = dealt.join(sets, "node").select("key", "node", "label", "size", "vector", F.inline(meets))
    return _searched(rows, ["key", "kind", "i", "j"], percent, stars_first)


def join_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) of every row."""
    classes = Classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), *prints(text_column(part), classes, shingle)], names=[c.split()[0] for c in PRINTS.split(", ")])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = _kept(texts.toDF("id", "text").mapInArrow(run, PRINTS), "ngrams")
    some = found.where("id is not null and size > 0")
    first = F.min(F.struct("id", "bytes", "size", "vector", "own", "above")).alias("r")
    reps = _kept(some.groupBy("same").agg(first).select("same", F.col("r.id").alias("node"), "r.bytes", "r.size", "r.vector", F.concat("r.own", "r.above").alias("keys")), "sets")
    placed = reps.select(F.explode("keys").alias("key"), "node")
    hubs = placed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub <> other").drop("other")
    members = _kept(placed.join(_kept(hubs, "hubs"), "key"), "shards")
    sets = reps.select("node", "size", "vector")
    name = lambda pairs: pairs.join(reps.select(F.col("node").alias("a"), F.struct("same", F.col("node").alias("node")).alias("hub")), "a").join(reps.select(F.col("node").alias("b"), "same", F.col("bytes").alias("size")), "b").select(F.col("b").alias("node"), "same", "size", "hub")
    verify = lambda pairs: verified(name(pairs), texts, shingle, percent / 100, share)

    asked = _kept(members.where("node <> hub").select("hub", "node").distinct(), "pairs")
    links = _kept(verify(_with_hubs(asked, sets, percent, -(-tile // OF_HUB)).select("a", "b")), "links")
    tried = asked.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    labels = connected_components(links)
    for stars_first in (True, False):
        rest = _kept(_among_the_rest(members, labels, sets, percent, tile, stars_first), "survivors")
        tried, pairs = tried.union(rest.select("a", "b")), rest.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        links = _kept(links.union(verify(pairs)), "links")
        if not stars_first or rest.where("dense").isEmpty():
            break
        labels = connected_components(links)
    # rows of one id but of different sets are one document
    several = some.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("id")
    joined = some.join(several, "id").select("same", F.col("id").alias("b")).join(reps.select("same", F.col("node").alias("a")), "same").select("a", "b")
    final = connected_components(links.unionByName(joined))
    roots = reps.select("same", "node").join(final, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    linked = found.where("id is not null and size > 0").join(roots, "same").select("id", "size", "component_id")
    alone = found.where("id is null or size = 0").join(final.withColumnRenamed("node", "id"), "id", "left").select("id", "size", F.coalesce("root", "id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


ORACLE_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) end as s from d),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * a.n >= {PERCENT} * b.n and 100 * b.n >= {PERCENT} * a.n group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
walk as (select doc_id, doc_id as place from s union select walk.doc_id, l.y from walk join (select a as x, b as y from links union all select b, a from links) l on l.x = walk.place)
select doc_id, len(s)::bigint as n_shingles, component_id from s join (select doc_id, min(place) as component_id from walk group by doc_id) using (doc_id)"""
