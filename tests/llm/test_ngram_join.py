"""The n-gram join against all pairs, and its tree's bound against plain sums."""

import random
import re

import numpy as np
import pytest

from tidewater.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def expected(rows):
    sets = [(i, _set(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 90 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünder", "日本", "The", "the", "a b"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for k in rng.sample(range(len(w)), n):
            w[k] = rng.choice(vocabulary)
        return w

    out = [(i, " ".join(words(rng.randint(1, 120)))) for i in range(60)]
    for group, (size, most) in enumerate([(200, 8), (400, 9), (12, 1), (60, 3)]):  # similarities on both sides of the limit
        base = words(size)
        out += [(100 * (group + 1) + i, " ".join(edited(base, rng.randint(0, most)))) for i in range(50)]
        out += [(100 * (group + 1) + 60 + i, " ".join(base[: size - i])) for i in range(min(size - 1, 30))]  # lengths across classes
    # copies of one text that are like each other but less like a smaller id with which they share blocks
    first, other = words(300), None
    other = edited(first, 12)
    out += [(1000, " ".join(first))] + [(1001 + i, " ".join(edited(other, i % 3))) for i in range(60)]
    passage = words(80)
    out += [(1100 + i, " ".join(words(20) + passage + words(20))) for i in range(40)]  # one passage in many
    out += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one"), (2006, "one two three"), (2007, "One two\tthree"), (None, out[0][1]), (None, None)]
    return [*out, out[1], out[1], (3000, " ".join(words(9000))), (0, " ".join(words(30)))]


@pytest.mark.parametrize("how", [{}, {"tile": 7, "share": 3000}])
def test_components(spark, rows, how, monkeypatch):
    if how:
        monkeypatch.setattr(ngram_join, "DENSE", 0)  # stars first, always
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, same string, node int, size int").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.join_components(docs, **how).collect()), key=repr)
    assert got == expected(rows)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join_components(docs).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_block(percent):
    """Two sets that link just so, of any sizes, have a key in common (the widest differences that are possible)."""
    rng, classes = np.random.default_rng(percent), ngram_join.Classes(percent)
    for size in [*range(1, 40), *rng.integers(40, 3000, 30).tolist()]:
        for _ in range(3):
            a = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            gone = int(rng.integers(0, size)) if size > 1 else 0
            new = 0
            while 100 * (size - gone) < percent * (size + new) and gone:
                gone -= 1
            while 100 * (size - gone) >= percent * (size + new + 1):
                new += 1
            b = np.concatenate([a[gone:], rng.integers(1, 1 << 63, new, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
            if not gone and not new:
                continue
            keys = []
            for h in (a, b):
                h, kind = np.sort(h), classes.of(np.array([len(h)]))
                keys.append({k for x in kind for k in ngram_join._keys(np.zeros(len(h), int), h, x, classes)[0].as_py()})
            assert keys[0] & keys[1], (size, gone, new)


def test_tree_keeps_what_the_bound_keeps():
    rng = np.random.default_rng(4)
    size = rng.integers(50, 90, 700)
    base = rng.random((20, 64))
    vectors = np.stack([rng.multinomial(s, (b := base[i % 20] ** 4) / b.sum()) for i, s in enumerate(size)]).astype(np.int32)
    q, p = ngram_join.CountTree(vectors, size).search(vectors[:100], size[:100])
    want = {(i, j) for i in range(100) for j in range(700) if 10 * min(size[i], size[j]) >= 9 * max(size[i], size[j]) and np.minimum(vectors[i], vectors[j]).sum() * 190 >= 90 * (size[i] + size[j])}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == want and len(want) < 40_000
