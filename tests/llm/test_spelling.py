"""Spelling variants against a restatement that compares all pairs."""

import random
import re
import zlib

import pytest

from tidewater.llm import spelling


def expected(rows, times=10):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 7:
                count[run] = count.get(run, 0) + 1
    count = {w: n for w, n in count.items() if n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        first = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return len(b) - len(a) == 1 and b[:first] + b[first + 1 :] == a

    out, form = {}, {}
    for w, n in count.items():
        close = [v for v in count if abs(len(v) - len(w)) <= 1 and near(v, w)]
        best = min(close, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= times * n else None
        out[w] = (n, len(close), form[w], count[form[w]] if form[w] else None)
    for w in out:
        end = w
        while form[end]:
            end = form[end]
        out[w] += (end,)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    letters = "abaé"  # few letters: many words share their halves, and edits are possible in several places
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(500)]
    pool += [p[:i] + p[i + 1 :] for p in pool[:100] for i in (0, 3, len(p) - 1)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉaaÿ×÷ab", "Information", "INFORMATION", "informatoin"]
    out = [(i, " ".join(rng.choice(pool) for _ in range(60)) + rng.choice([".", "1", "_x", "日"])) for i in range(150)]
    out += [(1000 + i, "information " * 9) for i in range(30)] + [(2000 + i, " ".join(rng.choice(["informaton", "infomaton", "informationn"]) for _ in range(4))) for i in range(6)]
    return [*out, (3000, None), (3001, ""), (None, "information aaaaaaab aaaaaaab"), out[0], out[0], (3002, "x" * 200_000), (3003, "x" * 200_000), (3004, "y" + "x" * 199_999), (3005, "y" + "x" * 199_999), *[(4000 + i, " ".join(["xy" * (k // 2) + "z" * (k % 2) for k in range(124, 136)])) for i in range(2)]]


@pytest.mark.parametrize(("shard", "hot"), [(20_000, 4_096), (40, 3), (1, 10**9)])
def test_spellings(spark, rows, shard, hot):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_spellings(docs, shard=shard, hot=hot).collect()}
    want = expected(rows)
    assert got == want
    assert max(x[1] for x in want.values()) > 5 and any(len(w) > 1000 and x[1] for w, x in want.items())


def test_chains_end_at_their_root(spark):
    """Forms of forms, four deep: each has ten times as many occurrences."""
    chain = ["abcdefghijk", "abcdefghij", "abcdefghi", "abcdefgh", "abcdefg"]
    data = [(w, 2 * 10**k) for k, w in enumerate(chain)]
    found = spelling.roots(spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(data[:-1], data[1:], strict=True)], "word string, form string"), data[-1][1])
    assert {r["word"]: r["root"] for r in found.collect()} == dict.fromkeys(chain[:-1], chain[-1])


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words are not kept"), (3, "lonelyword")], "doc_id long, text string")
    assert spelling.group_spellings(docs).collect() == [] and spelling.group_spellings(docs.limit(0)).collect() == []
