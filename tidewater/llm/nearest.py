"""Nearest neighbours by additive quantisation (operator 5).

A vector is approximated by a sum of full-dimensional codewords, one of each residual codebook. Codebooks are trained
by k-means on the residuals of a bounded sample (``SAMPLE`` vectors of smallest hash). Encoding is a beam search: the
``BEAM`` best partial sums go on to the next codebook. With each code the norm of the sum is stored. A query's products
with all codewords are a lookup table, an approximate score is a sum of its entries; with the stored norm it also orders
by distance (``measure``). The best of all rows are scored exactly, in double precision: ``RERANK`` of them, times the root of
the rows over ``FULL`` where there are more.

Every row is indexed. Queries are searched against all rows in blocks: rows are dealt into blocks of about
``BLOCK_ROWS`` by id, queries into blocks of about ``BLOCK_QUERIES``, and each task meets one pair of blocks. Only ids,
codes and norms go to these tasks (some 40 bytes a row), and each query's best of a block come back (its share of the shortlist, six standard
deviations more and 20); the best of all blocks are then reranked by block of queries, for which each wanted vector is fetched once. What is fetched grows
with queries x shortlist, not with queries x rows. More than ``k + 1`` equal vectors of a block can't all be neighbours:
repeated rows of one id are removed, then those of the smallest ids stay, which loses nothing.

The shortlist grows with the table so that recall does not fall. On vectors without structure, the hardest case, 64
numbers each, recall at 20 of a shortlist of 200, 400, 800, 1600 is 0.994, 1, 1, 1 of 8,000 rows; 0.92, 0.98, 0.997, 1 of 50,000;
0.89, 0.96, 0.99, 1 of 100,000; 0.86, 0.93, 0.98, 0.996 of 200,000; 0.80, 0.91, 0.97, 0.99 of 400,000: 494, 699, 988 and 1,398 are taken there.
On vectors that the codes fit less well it is far lower (hundreds of numbers without structure; groups of different widths).

``exact`` therefore checks what was found (``_checked``): with each code the index holds how much of the vector the code leaves
out, along the sum of codewords and across it. That bounds a row's product with a query from above, and every row whose
bound reaches the k-th score found is scored exactly, so no row is missed, whatever the vectors. The better the codes fit, the
fewer rows remain; where they hardly fit, nearly all do, and the check costs rows x queries products. It ships whole vectors by blocks:
all rows once for every 4 x ``BLOCK_QUERIES`` queries.

Defined results: vectors null, with null or non-finite components or zero take no part, nor do rows without id; vectors
of each length are searched among their own (no product joins two lengths; more than ``LENGTHS`` lengths are an error);
a query's own id is never its neighbour; ties go to the smaller id; equal rows of one id count once; of an id with
several vectors each is a candidate and the smallest is its query; fewer candidates than ``k`` give fewer rows; no rows
give none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

SAMPLE, BOOKS, WORDS, BEAM, RERANK = 16_384, 16, 256, 4, 200
#: Rows for which ``RERANK`` is enough.
FULL = 8_192
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 1_024
#: Vectors of a block of the check, in bytes, unless these are fewer than ``LEAST_ROWS``.
BLOCK_BYTES, LEAST_ROWS = 8 << 20, 2_048
#: Lengths of vectors that one table may have.
LENGTHS = 64


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimensions), each by k-means on what the ones before leave."""
    rng, left = np.random.default_rng(seed), x.astype(np.float64)
    out = np.zeros((books, words, x.shape[1]))
    for b in range(books):
        c = left[rng.permutation(len(left))[:words]]
        c = np.concatenate([c, np.zeros((words - len(c), x.shape[1]))])
        for _ in range(rounds):
            near = (left @ c.T - (c * c).sum(1) / 2).argmax(1)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            head = np.flatnonzero(n)
            c[head] = np.add.reduceat(left[order], np.concatenate([[0], np.cumsum(n[head])[:-1]]), axis=0) / n[head, None]
        out[b] = c
        left = left - c[(left @ c.T - (c * c).sum(1) / 2).argmax(1)]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, books) by beam search, and the norm of each sum of codewords."""
    n, d = x.shape
    left, codes = x.astype(np.float64)[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for c in books:
        # |left - c|^2 = |left|^2 - 2 left.c + |c|^2
        cost = (left * left).sum(2)[:, :, None] - 2 * (left @ c.T) + (c * c).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        of, word = best // len(c), best % len(c)
        rows = np.arange(n)[:, None]
        left = left[rows, of] - c[word]
        codes = np.concatenate([codes[rows, of], word[:, :, None].astype(np.uint8)], axis=2)
    pick = (left * left).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, pick], np.linalg.norm(x - left[rows, pick], axis=1)


def approximate(table: np.ndarray, codes: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
    """Approximate inner products of one query (``table``: its products with the codewords) with coded rows (codes by
    book, a row each); with ``norms`` instead 2 q.x - |x|^2, which orders by distance."""
    s = table[0][codes[0]]
    for m in range(1, len(table)):
        s += table[m][codes[m]]
    return s if norms is None else 2 * s - norms * norms


def remainders(x: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the sums of codewords leave out of ``x``: its part along the sum (signed) and the length of the part across."""
    sums = books[np.arange(len(books)), codes].sum(1)
    unit = sums / np.where(norms > 0, norms, np.inf)[:, None]
    along = ((x - sums) * unit).sum(1)
    return along, np.linalg.norm(x - sums - along[:, None] * unit, axis=1)


def ceilings(s: np.ndarray, error: float, length: float, norms: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """No less than a query's inner products with rows whose codes give ``s``, within ``error``. ``length``: of the query.
    Along the sum of codewords the query is known by ``s``, and what it has across it has at most the length left."""
    per = 1 / np.where(norms > 0, norms, np.inf)
    known = np.maximum(np.abs(s) - error, 0) * per
    return s + error + (s * along + error * np.abs(along)) * per + np.sqrt(np.maximum(length * length - known * known, 0)) * across


def _distinct(ids: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """Places, by id, of the rows without repeated rows of one id and without all but the k + 1 smallest ids of a vector.
    ``same``: a digest of each row's vector."""
    _, group = np.unique(same, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.lexsort((ids, group))
    by = by[np.concatenate([[True], (np.diff(group[by]) != 0) | (np.diff(ids[by]) != 0)])]  # equal rows of one id count once, before ranks
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) > 0]))
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    keep = by[rank <= k]
    return keep[np.argsort(ids[keep], kind="stable")]


def _candidates(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, same: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, k: int, rerank: int, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its id, the ``rerank`` best rows of the block and their approximate scores. ``same``: a digest of
    each row's vector."""
    keep = _distinct(ids, same, k)
    ids, codes, norms = ids[keep], np.ascontiguousarray(codes[keep].T), norms[keep].astype(np.float32)
    most = min(rerank + 1, len(ids))
    for at in range(0, len(qid), 64):
        tables = np.einsum("qd,mwd->qmw", q[at : at + 64], books).astype(np.float32)
        for i, table in zip(qid[at : at + 64], tables, strict=True):
            s = approximate(table, codes, norms if measure == "distance" else None)
            bar = np.partition(s, len(s) - most)[len(s) - most]
            over = np.flatnonzero(s > bar)
            cand = np.concatenate([over, np.flatnonzero(s == bar)[: most - len(over)]])  # ids ascend: ties to the smaller
            cand = cand[ids[cand] != i]
            yield np.full(len(cand), i), ids[cand], s[cand]


def _reaching(qid: np.ndarray, q: np.ndarray, bars: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, along: np.ndarray, across: np.ndarray, books: np.ndarray, k: int, measure: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its id, the rows of the block (ids ascend) whose score reaches its bar, the best k of them, and their scores.
    A row that is ruled out by its ceiling is not scored; what can't be compared (overflow) is."""
    rows, queries = (x * x).sum(1), (q * q).sum(1)
    codes, rounding = np.ascontiguousarray(codes.T), 4 * (x.shape[1] + 4) * np.finfo(float).eps
    for at in range(0, len(qid), 64):
        some, own, bar = q[at : at + 64], qid[at : at + 64], bars[at : at + 64].copy()
        tables = np.einsum("qd,mwd->qmw", some, books).astype(np.float32)
        errors = (len(books) + 4) * (np.finfo(np.float32).eps * np.abs(tables).max(2).sum(1, dtype=float) + np.finfo(np.float32).tiny)

        def least(j: int, part: slice, at: int = at, bar: np.ndarray = bar) -> np.ndarray:
            """The least product at which a row reaches the bar, less rounding."""
            both = rows[part] + queries[at + j]
            return (bar[j] if measure == "product" else (bar[j] + both) / 2) - rounding * both

        open_ = np.empty((len(own), len(ids)), bool)
        for j, table in enumerate(tables):
            most = ceilings(approximate(table, codes).astype(float), errors[j], math.sqrt(queries[at + j]), norms, along, across)
            open_[j] = ~(most < least(j, slice(None))) & (ids != own[j])
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in own]
        left = np.flatnonzero(open_.any(0))
        for i in range(0, len(left), 4096):
            part = left[i : i + 4096]
            near = x[part]
            products = near @ some.T
            for j in np.flatnonzero(open_[:, part].any(1)):
                hit = np.flatnonzero(open_[j, part] & ~(products[:, j] < least(j, part)))
                score = (near[hit] * some[j]).sum(1) if measure == "product" else -((near[hit] - some[j]) ** 2).sum(1)
                v, s = np.concatenate([found[j][0], ids[part[hit]]]), np.concatenate([found[j][1], score])
                best = np.lexsort((v, -s))[:k]
                found[j] = v[best], s[best]
                if len(best) == k:
                    bar[j] = max(bar[j], s[best[-1]])
        for i, (v, s) in zip(own, found, strict=True):
            yield np.full(len(v), i), v, s


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of double) of the rows that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def shortlist(n: int, rerank: int = RERANK) -> int:
    """Rows that are scored exactly for each query of a table of ``n``."""
    return math.ceil(rerank * max(1.0, math.sqrt(n / FULL)))


def share_of(rerank: int, blocks: int) -> int:
    """Rows of one of ``blocks`` that can be among a query's ``rerank`` best: rows are dealt by hash, so hardly ever more."""
    even = rerank / blocks
    return rerank if blocks == 1 else min(rerank, math.ceil(even + 6 * math.sqrt(even) + 20))


def search(vectors: DataFrame, queries: Column, *, k: int = 20, sample: int = SAMPLE, books: int = BOOKS, words: int = WORDS, rerank: int = RERANK, measure: str = "product", exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row that fulfils ``queries`` (over vec_id). ``measure``:
    product (greatest inner product; score is it) or distance (smallest Euclidean; score is its negative square). ``exact``:
    check that no better row is left out."""
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).orderBy("d").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of over {LENGTHS} lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(rows.where(F.size("x") == d), queries, d, n, q, k, sample, books, words, max(rerank, k), measure, exact) for d, n, q in sizes if q]
    for f in found:
        out = f if len(found) == 1 else out.unionByName(f)
    return out


def _search(rows: DataFrame, queries: Column, d: int, n: int, n_queries: int, k: int, sample: int, books: int, words: int, rerank: int, measure: str, exact: bool) -> DataFrame:
    spark = rows.sparkSession
    rerank = shortlist(n, rerank)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(words, min(sample, (32 << 20) // (8 * d)))).toArrow()  # ``sample`` vectors and 32 MB at most
    learned = spark.sparkContext.broadcast(train(_matrix(some.column("x").combine_chunks(), d), books, words))  # books x words x d

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), d)
                codes, norms = encode(x, learned.value)
                along, across = remainders(x, learned.value, codes, norms)
                same = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x + 0.0]  # one zero, not two
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(along), pa.array(across), pa.array(same, pa.binary())], names=["vec_id", "x", "codes", "norm", "along", "across", "same"])

    index_at = written(rows.mapInArrow(code, "vec_id long, x array<double>, codes binary, norm double, along double, across double, same binary"), "codes")
    index = spark.read.parquet(index_at)
    row_blocks, query_blocks = -(-n // BLOCK_ROWS), max(1, -(-n_queries // BLOCK_QUERIES))
    of_block, rank_blocks = share_of(rerank, row_blocks), max(1, -(-n_queries * rerank * max(d, 64) // (BLOCK_QUERIES * RERANK * 64)))  # fewer of longer vectors
    salt = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = index.where(queries).groupBy("vec_id").agg(F.min("x").alias("x"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("near", pa.float32())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        get = lambda t, c: t.column(c).combine_chunks()
        got = list(_candidates(get(left, "vec_id").to_numpy(), _matrix(get(left, "x"), d), get(right, "vec_id").to_numpy(), _bytes(get(right, "same"), 16), _bytes(get(right, "codes"), books), get(right, "norm").to_numpy(), learned.value, k, of_block, measure))
        return pa.table([np.concatenate(c) for c in zip(*got, strict=True)], schema=out)

    ask = asked.select("vec_id", "x", salt("vec_id", query_blocks).alias("qb")).withColumn("rb", every(row_blocks))
    give = index.select("vec_id", "codes", "norm", "same", salt("vec_id", row_blocks).alias("rb")).withColumn("qb", every(query_blocks))
    near = ask.groupBy("qb", "rb").cogroup(give.groupBy("qb", "rb")).applyInArrow(meet, "query_id long, vec_id long, near float")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))
    pairs = near.withColumn("place", place).where(F.col("place") <= rerank).select("query_id", "vec_id").distinct()
    at = written(pairs, "candidates")
    pairs, again = (spark.read.schema("query_id long, vec_id long").parquet(at).withColumn("qb", salt("query_id", rank_blocks)) for _ in range(2))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        get = lambda t, c: t.column(c).combine_chunks()
        x, ids, asks = _matrix(get(right, "x"), d), get(right, "vec_id").to_numpy(), get(right, "asks").to_numpy(zero_copy_only=False).astype(bool)
        query, cand = get(left, "query_id").to_numpy(), get(left, "vec_id").to_numpy()
        own, rest = np.flatnonzero(asks)[np.argsort(ids[asks])], np.flatnonzero(~asks)
        rest = rest[np.argsort(ids[rest], kind="stable")]
        low, high = np.searchsorted(ids[rest], cand), np.searchsorted(ids[rest], cand, "right")  # an id can have several vectors
        times = high - low
        at = rest[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        query = np.repeat(query, times)
        me = own[np.searchsorted(ids[own], query)]
        score = np.empty(len(at))
        for i in range(0, len(at), 1 << 16):
            a, b = x[at[i : i + (1 << 16)]], x[me[i : i + (1 << 16)]]
            score[i : i + (1 << 16)] = (a * b).sum(1) if measure == "product" else -((a - b) ** 2).sum(1)
        order = np.lexsort((ids[at], -score, query))
        q, v, s = query[order], ids[at][order], score[order]
        new = np.concatenate([[True], q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else np.zeros(0, int)
        top = place < k
        return pa.table([q[top], (place[top] + 1).astype(np.int32), v[top], s[top]], schema=out)

    wanted = again.select("qb", "vec_id").distinct().join(index.select("vec_id", "x", "same").dropDuplicates(["vec_id", "same"]).drop("same"), "vec_id").select("qb", "vec_id", "x", F.lit(False).alias("asks"))
    wanted = wanted.unionByName(asked.select(salt("vec_id", rank_blocks).alias("qb"), "vec_id", "x", F.lit(True).alias("asks")))
    found = pairs.groupBy("qb").cogroup(wanted.groupBy("qb")).applyInArrow(rank, "query_id long, rank int, vec_id long, score double")
    return _checked(found, spark.read.parquet(index_at), asked, learned, d, n, n_queries, k, measure) if exact else found


def _checked(found: DataFrame, index: DataFrame, asked: DataFrame, learned: Broadcast, d: int, n: int, n_queries: int, k: int, measure: str) -> DataFrame:
    """The k best of all rows, as ``found`` has them or better: its k-th score is the bar that a row's ceiling must reach to be scored."""
    row_blocks, query_blocks = -(-n // min(BLOCK_ROWS, max(LEAST_ROWS, BLOCK_BYTES // (8 * d)))), max(1, -(-n_queries // (4 * BLOCK_QUERIES)))
    salt = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    bars = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    ask = asked.join(bars, "vec_id", "left").select("vec_id", "x", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"), salt(query_blocks).alias("qb")).withColumn("rb", every(row_blocks))
    give = index.withColumns({"rb": salt(row_blocks), "qb": every(query_blocks)})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        get = lambda t, c: t.column(c).combine_chunks()
        right = right.take(pa.array(_distinct(get(right, "vec_id").to_numpy(), _bytes(get(right, "same"), 16), k)))
        ids, norms, along, across = (get(right, c).to_numpy() for c in ("vec_id", "norm", "along", "across"))
        with np.errstate(over="ignore", invalid="ignore"):
            got = list(_reaching(get(left, "vec_id").to_numpy(), _matrix(get(left, "x"), d), get(left, "bar").to_numpy(), ids, _matrix(get(right, "x"), d), _bytes(get(right, "codes"), len(learned.value)), norms, along, across, learned.value, k, measure))
        return pa.table([np.concatenate(c) for c in zip(*got, strict=True)], schema=out)

    best = ask.groupBy("qb", "rb").cogroup(give.groupBy("qb", "rb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
