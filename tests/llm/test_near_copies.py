"""Near copies at a similarity of 0.8 against brute force over all pairs."""

import random
import re

import pyarrow as pa
import pytest

from tidewater.llm import near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _expected(rows):
    sets = [(i, _shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünder", "日本", "The", "the"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for k in rng.sample(range(len(w)), n):
            w[k] = rng.choice(vocabulary)
        return w

    out = [(i, " ".join(text(rng.randint(5, 300)))) for i in range(40)]
    base = text(200)
    out += [(100 + i, " ".join(edited(base, rng.randint(0, 9)))) for i in range(60)]  # similarities from 0.3 to 1
    out += [(200 + i, " ".join(edited(out[i][1].split(), 1))) for i in range(40)]
    out += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE  two"), (305, " ".join(text(9000))), (305, "one two"), (None, out[0][1]), (None, None), (306, out[1][1]), (306, out[1][1])]
    return out


@pytest.mark.parametrize("share", [3000, 1 << 20])
def test_components(spark, rows, share):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, same string, node int").repartition(3)
    got = near_copies.components(docs, share=share).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _expected(rows)
    assert len(got) == sum(r[0] is not None for r in rows)


def test_keep_one(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = _expected(rows)
    assert sorted(r[0] for r in near_copies.keep_one(docs).collect() if r[0] is not None) == sorted(i for i, _ in rows if i is not None and classes[i] == i)
    assert near_copies.keep_one(docs).where("doc_id is null").count() == 2
    assert not near_copies.keep_one(docs.limit(0)).collect()


def test_equal_minima_do_not_merge(spark):
    """1 and 2 have equal minima but not equal sets; 3 is at 0.8 with 2 and below it with 1; 4 is an exact copy of 2."""
    for seed in range(200):
        rng = random.Random(seed)
        base = [f"{rng.getrandbits(40):x}" for _ in range(204)]  # 200 shingles
        texts = [" ".join([*base[:-1], "other"]), " ".join(base), " ".join(base[40:])]
        keys = near_copies.signatures(*near_copies.shingle_hashes(pa.array(texts, pa.large_string()), 5))
        if (keys[0] == keys[1]).all():
            break
    else:
        raise AssertionError("no pair of texts with equal minima")
    rows = list(enumerate([*texts, texts[1]], 1))
    assert 5 * len(_shingles(texts[0]) & _shingles(texts[2])) < 4 * len(_shingles(texts[0]) | _shingles(texts[2]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()} == _expected(rows) == dict.fromkeys(range(1, 5), 1)
    assert [r["doc_id"] for r in near_copies.keep_one(docs).collect()] == [1]


def test_set_digests():
    hashes = near_copies.shingle_hashes(pa.array(["a b c d e a b c d e a b c d e", "b c d e a b c d e a b c d e a b c", "a b c d e", ""], pa.large_string()), 5)
    one, two, three, four = near_copies.set_digests(*hashes)
    assert one == two and len({one, three, four}) == 3 and len(one) == 16
