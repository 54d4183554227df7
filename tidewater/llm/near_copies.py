"""Near copies: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more (the pipeline's near-dedup).

SimHash links of 4 bits (:mod:`tidewater.llm.simhash`) find a fifth of such pairs only: they differ in up to 14 of 64
bits, for which a covering by anchors replicates without bound. So candidates come from both the anchor-point covering
and bands of minima of the same shingle hashes (``BANDS`` x ``ROWS``; a pair at similarity 0.8 is missed with
probability (1 - 0.8^4)^16 = 0.0002), and every link is then checked exactly on whole texts:

1. documents with the same set of shingle hashes (by a 128-bit digest of the sorted set) are merged into a class; equal
   minima alone merge nothing, they only make candidates;
2. classes share a bucket if they share a band's minima or the covering links them (a star of links is a bucket). Each
   bucket's smallest class is its hub, and every other member is compared with it: work in proportion to the members. A hub with many members is
   copied to parts of ``SHARE`` bytes of text, so a group of copies of any size is spread over tasks;
3. what is known to be connected to its hub (by links to hubs, followed twice) needs no further comparison with others
   that are. Only members that are not (B) are compared with the rest: B with B and B with what is connected, in pairs of
   tiles of ``SHARE`` bytes, so a group of near copies of one text costs nothing here, and no link inside a bucket is lost;
4. links at the threshold or above make the final components.

Defined results: texts without words are copies of each other; texts of fewer words than a shingle are one shingle;
rows of one id are one document; documents with a null id link to nothing; extra columns are left alone.
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
from .simhash import links, majority, shingle_hashes, stars
from .store import written
from .words import mix, slices, text_column

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Bytes of text that are compared with a hub, or with another tile, in one group.
SHARE = 1 << 20
#: Cells of an incidence matrix that are laid out at once.
CELLS = 1 << 22
PRINTS = "id long, size long, fp long, same binary, keys array<long>"


def set_digests(hashes: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Of each text: a 128-bit digest of its sorted distinct shingle hashes."""
    return [hashlib.blake2b(np.unique(hashes[a:b]).tobytes(), digest_size=16).digest() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def signatures(hashes: np.ndarray, begin: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Of each text: a hash of each band's minima (texts, bands)."""
    full = np.flatnonzero(np.diff(begin))
    keys = np.zeros((len(begin) - 1, bands), np.uint64)
    factors = np.random.default_rng(11).integers(1, 1 << 63, (bands, rows, 2)).astype(np.uint64)
    for b in range(bands):
        for a, c in factors[b]:
            if len(full):
                low = np.minimum.reduceat(mix(hashes * (a | np.uint64(1)) + c), begin[:-1][full])
                keys[full, b] = mix(keys[full, b] ^ low) + np.uint64(b)
    return keys


def _prints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                texts = text_column(part)
                hashes, begin = shingle_hashes(texts, shingle)
                same, keys = set_digests(hashes, begin), signatures(hashes, begin)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                arrays = [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(majority(hashes, begin).view(np.int64)), pa.array(same, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "size", "fp", "same", "keys"])

    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, PRINTS)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int = 2 << 20, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches of whole groups (equal in their first ``keys`` columns) of about ``most`` bytes in column ``text``, one
    group at least; and the number of each row's group in its batch."""

    def cut(rows: pa.RecordBatch, begin: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(rows.column(rows.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False) + 8)])
        edges, at = np.append(begin, rows.num_rows), 0
        while at < len(begin):
            end = max(at + 1, int(np.searchsorted(size[edges], size[edges[at]] + most, "right")) - 1)
            yield rows.slice(edges[at], edges[end] - edges[at]), np.repeat(np.arange(end - at), np.diff(edges[at : end + 1]))
            at = end

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        new = np.zeros(rows.num_rows, bool)
        for k in range(keys):
            column = rows.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.flatnonzero(new)])
        if begin[-1]:
            yield from cut(rows.slice(0, begin[-1]), begin[:-1])
        held = rows.slice(begin[-1])
    if held is not None:
        yield from cut(held, np.zeros(1, int))


def _sets(rows: pa.RecordBatch, group: np.ndarray, side: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of the rows that are what their class is, each class once in a group and side; and the
    rows' numbers of shingles. Rows of one id but another text, and repeated rows, have none."""
    hashes, begin = shingle_hashes(text_column(rows), shingle)
    wanted, own = rows.column(rows.schema.get_field_index("same")).to_pylist(), set_digests(hashes, begin)
    seen: set[tuple] = set()
    use = np.zeros(rows.num_rows, bool)
    for i, (is_same, at) in enumerate(zip((a == b for a, b in zip(wanted, own, strict=True)), zip(group.tolist(), side.tolist(), own, strict=True), strict=True)):
        if is_same and at not in seen:
            seen.add(at)
            use[i] = True
    row = np.repeat(np.arange(rows.num_rows), np.diff(begin))
    row, hashes = row[use[row]], hashes[use[row]]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[once], hashes[once]
    return row, hashes, np.bincount(row, minlength=rows.num_rows)


def with_hubs(rows: pa.RecordBatch, group: np.ndarray, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of members (side 1) with the hub (side 0) of their group: node of the member, node of the hub."""
    side, node = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("side", "node"))
    row, hashes, size = _sets(rows, group, side, shingle)
    key = mix(hashes ^ mix(group[row].astype(np.uint64) + np.uint64(1)))
    of_hub = side[row] == 0
    hub_keys = np.sort(key[of_hub])
    hub = np.full(int(group[-1]) + 1, -1)
    at = np.flatnonzero((side == 0) & (size > 0))
    hub[group[at]] = at
    row, key = row[~of_hub], key[~of_hub]
    if not len(hub_keys) or not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(hub_keys, key), len(hub_keys) - 1)
    both = np.bincount(row[hub_keys[place] == key], minlength=rows.num_rows)
    member = np.flatnonzero((side == 1) & (size > 0) & (hub[group] >= 0))
    union = size[member] + size[hub[group[member]]] - both[member]
    member = member[both[member] >= similarity * union - 1e-9]
    return node[member], node[hub[group[member]]]


def similar(ids: np.ndarray, side: np.ndarray, of: np.ndarray, hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same ids as all links do: of rows on side 0 with those on side 1, or of all where there is no
    side 1. ``of``, ``hashes``: distinct shingles of the rows."""
    word = np.unique(hashes, return_inverse=True)[1]
    order = np.argsort(word, kind="stable")
    word, of = word[order], of[order]
    size = np.bincount(of, minlength=len(ids)).astype(np.float64)
    left = np.flatnonzero((side == 0) & (size > 0))
    right = np.flatnonzero((side == 1) & (size > 0)) if side.any() else left
    place = np.full((2, len(ids)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    both, width = np.zeros((len(left), len(right)), np.float32), max(1, CELLS // len(ids))
    words = int(word[-1]) + 1 if len(word) else 0
    for low in range(0, words, width):
        a, b = np.searchsorted(word, [low, low + width])
        cells = []
        for k, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, min(width, words - low)), np.float32)
            at = place[k, of[a:b]]
            m[at[at >= 0], (word[a:b] - low)[at >= 0]] = 1
            cells.append(m)
        both += cells[0] @ cells[1].T
    union = size[left][:, None] + size[right][None, :] - both
    x, y = np.nonzero((both >= similarity * union - 1e-9) & (ids[left][:, None] != ids[right][None, :]))
    return stars(ids[left[x]], ids[right[y]]) if len(x) else (x, y)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def buckets(reps: DataFrame) -> DataFrame:
    """band, key, node, same, size, hub (node and same of the bucket's smallest class) of the buckets of two classes or more.
    ``reps``: one row for each class. The covering's stars are a band of their own."""
    banded = reps.select("node", "same", "size", F.posexplode("keys").alias("band", "key"))
    firsts = reps.groupBy("fp").agg(F.min("node").alias("node"))
    firsts = reps.sparkSession.read.schema(firsts.schema).parquet(written(firsts, "fingerprints"))
    drawn = links(firsts).distinct()  # from a fingerprint's first class to the smallest one that a task connects it with
    keys = drawn.select("a", "b").unionByName(firsts.select(F.col("node").alias("a"), F.col("node").alias("b")))
    covered = reps.join(firsts.withColumnRenamed("node", "a"), "fp").join(keys, "a").select("node", "same", "size", F.lit(BANDS).alias("band"), F.col("b").alias("key"))
    members = banded.unionByName(covered)
    one = F.struct("node", "same")
    hubs = members.groupBy("band", "key").agg(F.min(one).alias("hub"), F.max(one).alias("other")).where("hub <> other").drop("other")
    return members.join(hubs, ["band", "key"])


def verified(members: DataFrame, texts: DataFrame, shingle: int, similarity: float, share: int) -> DataFrame:
    """a, b: the links of members (node, same, size: bytes of text, hub: struct of same and node) with their hubs."""
    pairs = members.where("same <> hub.same").select("node", "same", "size", F.col("hub.same").alias("hub"), F.col("hub.node").alias("hub_node")).distinct()
    parts = pairs.groupBy("hub", "hub_node").agg(F.ceil((F.sum("size") + 1) / share).cast("int").alias("parts"))
    asked = pairs.join(parts.drop("hub_node"), "hub").select("hub", F.expr("cast(pmod(xxhash64(same), parts) as int)").alias("part"), F.lit(1).alias("side"), "node", "same")
    told = parts.select("hub", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("side"), F.col("hub_node").alias("node"), F.col("hub").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, 2):
            yield _edges(*with_hubs(rows, group, shingle, similarity))

    rows = asked.unionByName(told).join(texts, "node").select("hub", "part", "side", "node", "same", "text")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(run, "a long, b long")


def _compared_with_the_rest(members: DataFrame, linked: DataFrame, texts: DataFrame, shingle: int, similarity: float, share: int) -> DataFrame:
    first = linked.groupBy("a").agg(F.min("b").alias("b"))
    home = first.join(first.toDF("b", "next"), "b", "left").select(F.col("a").alias("node"), F.coalesce("next", "b").alias("root"))  # connected, though perhaps not the smallest that is
    mine, hubs = home.select("node", F.col("root").alias("mine")), home.select(F.col("node").alias("hub_node"), F.col("root").alias("its"))
    named = members.where("same <> hub.same").select("band", "key", "node", "same", "size", F.col("hub.node").alias("hub_node")).join(mine, "node", "left").join(hubs, "hub_node", "left")
    direct = linked.select(F.col("a").alias("node"), F.col("b").alias("hub_node"), F.lit(True).alias("direct")).distinct()
    named = named.join(direct, ["node", "hub_node"], "left")
    named = named.withColumn("far", F.col("direct").isNull() & (F.coalesce("mine", "node") != F.coalesce("its", "hub_node")))
    size = lambda far: F.sum(F.when(F.col("far") == far, F.col("size")))
    tiles = lambda far: F.ceil((F.coalesce(size(far), F.lit(0)) + 1) / share).cast("int")
    count = named.groupBy("band", "key").agg(F.count_if("far").alias("n_far"), F.count_if(~F.col("far")).alias("n_near"), tiles(True).alias("far_tiles"), tiles(False).alias("near_tiles"))
    dealt = named.join(count.where("n_far > 1 or n_far = 1 and n_near > 0"), ["band", "key"])
    dealt = dealt.withColumn("t", F.expr("cast(pmod(xxhash64(same), if(far, far_tiles, near_tiles)) as int)"))
    meets = F.expr("""if(far,
        concat(if(n_near > 0, transform(sequence(0, near_tiles - 1), i -> named_struct('kind', 0, 'i', i, 'j', t, 'side', 1)), array()),
               if(n_far > 1, transform(sequence(0, far_tiles - 1), u -> named_struct('kind', 1, 'i', least(t, u), 'j', greatest(t, u), 'side', cast(t > u as int))), array())),
        transform(sequence(0, far_tiles - 1), j -> named_struct('kind', 0, 'i', t, 'j', j, 'side', 0)))""")
    keys = ["band", "key", "kind", "i", "j"]
    rows = dealt.select("band", "key", "node", "same", F.inline(meets)).join(texts, "node").select(*keys, "side", "node", "same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, len(keys)):
            side, node = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("side", "node"))
            row, hashes, _ = _sets(rows, group, side, shingle)
            begin = np.searchsorted(group, np.arange(group[-1] + 2))
            cells = np.searchsorted(row, begin)
            for a, b, c, d in zip(begin[:-1], begin[1:], cells[:-1], cells[1:], strict=True):
                yield _edges(*similar(node[a:b], side[a:b], row[c:d] - a, hashes[c:d], similarity))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id (smallest id reachable over links) for every row with an id."""
    spark = docs.sparkSession
    kept = lambda df, name: spark.read.schema(df.schema).parquet(written(df, name))  # without rows there is no file to infer it from
    prints = kept(_prints(docs, shingle, id_col, text_col), "signatures")
    first = F.min(F.struct("id", "size", "fp", "keys")).alias("r")
    reps = kept(prints.groupBy("same").agg(first).select("same", F.col("r.id").alias("node"), "r.size", "r.fp", "r.keys"), "classes")
    members = kept(buckets(reps), "buckets")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))
    linked = kept(verified(members, texts, shingle, similarity, share), "links")
    rest = _compared_with_the_rest(members, linked, texts, shingle, similarity, share)
    # rows of one id but different texts are one document
    several = prints.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("id")
    joined = prints.join(several, "id").select("same", F.col("id").alias("b")).join(reps.select("same", F.col("node").alias("a")), "same").select("a", "b")
    final = connected_components(linked.unionByName(rest).unionByName(joined))
    classes = reps.select("same", "node").join(final, "node", "left").select("same", F.coalesce("root", "node").alias("component_id"))
    return prints.join(classes, "same").select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each component left: that of the smallest id. Rows of one id are one document and stay
    or go together; documents with a null id all stay. All columns stay."""
    id_col = how.get("id_col", "doc_id")
    gone = components(docs, **how).where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
