"""The exact check of op5: no row of a better score is left out, whatever the vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import nearest, queries


def vectors(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    if kind == "wide":  # many numbers without structure
        return rng.normal(size=(n, 256))
    if kind == "groups":  # far apart, each of its own width
        of = rng.integers(0, 12, n)
        return rng.normal(size=(12, 24))[of] * 3 + rng.normal(size=(n, 24)) * (10.0 ** rng.uniform(-5, 0, 12))[of][:, None]
    if kind == "lengths":
        return rng.normal(size=(n, 24)) * np.exp(3 * rng.normal(size=(n, 1)))
    return rng.normal(size=(n, 24)) * float(kind)  # so small or large that single precision can't hold the products


def best(x: np.ndarray, q: int, measure: str, k: int) -> list[tuple[int, float]]:
    s = (x * x[q]).sum(1) if measure == "product" else -((x - x[q]) ** 2).sum(1)
    return [(int(i), float(s[i])) for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:k]


def found(df) -> dict[int, list[tuple[int, float]]]:
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([f[0] for f in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [f[1:] for f in sorted(v)] for q, v in got.items()}


def test_the_query_finds_all_of_vectors_that_codes_fit_badly(spark, tmp_path):
    x = vectors("wide", 3000).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = found(queries.op5_nearest(spark, str(tmp_path)))
    assert got == {q: best(x.astype(float), q, "product", 20) for q in range(0, 3000, 20)}


@pytest.mark.parametrize("kind", ["groups", "lengths", "1e-30", "1e30"])
@pytest.mark.parametrize("measure", ["product", "distance"])
def test_exact_in_many_blocks(spark, monkeypatch, kind, measure):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 400)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 8)
    x = vectors(kind, 1500)
    x[40:80] = x[7]  # more copies than neighbours, queries among them
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = found(nearest.search(df, F.col("vec_id") % 20 == 0, k=10, sample=500, books=4, words=32, rerank=10, measure=measure, exact=True))
    assert got == {q: best(x, q, measure, 10) for q in range(0, 1500, 20)}


def test_exact_with_few_candidates_and_several_vectors_of_an_id(spark):
    data = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (20, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert found(nearest.search(df, F.col("vec_id") % 20 == 0, k=5, exact=True)) == {0: [(2, 3.0), (1, 2.0), (1, 0.0)]}


def test_ceilings_hold():
    x, q = vectors("lengths", 600), vectors("groups", 40)
    books = nearest.train(x[:300], 4, 32)
    codes, norms = nearest.encode(x, books)
    along, across = nearest.remainders(x, books, codes, norms)
    for v in q:
        s = nearest.approximate(np.einsum("d,mwd->mw", v, books), codes.T)
        assert (nearest.ceilings(s, 1e-9, float(np.linalg.norm(v)), norms, along, across) >= x @ v - 1e-9).all()
    # a query along a sum of codewords is known by its code: the bound is the product
    v = books[np.arange(4), codes[0]].sum(0)
    s = nearest.approximate(np.einsum("d,mwd->mw", v, books), codes[:1].T)
    assert np.isclose(nearest.ceilings(s, 0.0, float(np.linalg.norm(v)), norms[:1], along[:1], across[:1])[0], x[0] @ v)
