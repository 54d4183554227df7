"""Fill-in-middle outputs against a plain restatement, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import middle


def expected(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    alphabet = ["word", "Über", "naïve", "\n", " ", "\t", "<", "P>", "<S", "日本", "🙂", "é", "7", ".", "\r\n", " ", "x"]
    out = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    out += [(1000, None), (1001, ""), (1002, "a"), (1003, "7"), (1004, "text with <M> in it"), (None, "a null id has a text"), (None, None)]
    return [*out, out[0], out[0], (2**60 + 1, "a very large id and some words")]


def test_outputs_and_round_trips(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, `out.put` string").repartition(5)
    made = middle.fill_in_middle(docs, digests=True)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["output"])
    got = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in sorted(made.collect(), key=key)]
    want = sorted(((i, *expected(i, t)) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[-1]))
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}
    back = middle.restore(made)
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    assert back.where((sha != F.col("restored_sha256")) | (F.sha2(F.encode("output", "UTF-8"), 256) != F.col("output_sha256"))).count() == 0
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t in rows)
    narrow = middle.fill_in_middle_digests(docs)
    assert narrow.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(repr, narrow.collect())) == sorted(map(repr, made.drop("output").collect()))


def test_long_texts_string_ids_and_nothing(spark):
    long = "one two, " * 1_200_000  # beyond what a task takes at once
    docs = spark.createDataFrame([("a", long), ("b", "short one"), (None, "x")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in middle.fill_in_middle_digests(docs).collect()}
    assert got["a"]["n"] == 6_000_000 and got["a"]["restored_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    n, form, p, m, out = expected("a", long)
    assert (got["a"]["form"], got["a"]["prefix_chars"], got["a"]["middle_chars"], got["a"]["output_sha256"]) == (form, p, m, hashlib.sha256(out.encode()).hexdigest())
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_rules_choose_the_forms():
    text = "some words to cut in three parts"
    always = middle.Rules(plain_from=100, spm_below=100)
    forms = {middle.split(i, text, always)[1] for i in range(50)}
    assert forms == {"spm"} and {middle.split(i, text, middle.Rules(plain_from=0))[1] for i in range(50)} == {"plain"}
    assert {middle.split(i, text, middle.Rules(salt="2"))[2:] for i in range(20)} != {middle.split(i, text)[2:] for i in range(20)}
    for i in range(200):
        _, form, a, b = middle.split(i, text)
        assert middle.restored(middle.joined(text, form, a, b), form) == text
    with pytest.raises(ValueError):
        middle.restored("<S>x<P>y<M>z", "psm")
