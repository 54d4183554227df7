"""Scores, licences and mixtures against plain restatements of what they should be."""

import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import licenses, mixing, quality_fm, secrets


def test_scores_are_double_sums():
    """Whole scores equal the sum over all pairs of inputs, nulls and empty texts included."""
    rng = np.random.default_rng(0)
    m = quality_fm.Machine()
    m.w0, m.w, m.v = 0.3, rng.normal(0, 0.3, m.w.shape).astype(np.float32), rng.normal(0, 0.3, m.v.shape).astype(np.float32)
    texts = ["a few words here and a few words there", None, "", "ONE two two two\nline line\nline line", "é " * 40]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "n_chars": pa.array([38, None, 0, 30, 80], pa.float64())})
    start, cols, values = quality_fm.features(batch)
    got = m.score(start, cols, values)
    for i in range(len(texts)):
        c, x = cols[start[i] : start[i + 1]], values[start[i] : start[i + 1]].astype(float)
        v = m.v[c].astype(float)
        raw = m.w0 + float(m.w[c].astype(float) @ x) + sum(float(v[p] @ v[q]) * x[p] * x[q] for p in range(len(c)) for q in range(p))
        assert abs(got[i] - 1 / (1 + np.exp(-raw))) < 1e-4
    assert got[1] == got[2] or abs(values[start[1] : start[2]] - values[start[2] : start[3]]).max() > 0


def test_scores_without_both_kinds_of_labels(spark):
    docs = spark.createDataFrame([(1, "good text", 9), (2, None, None), (2, "", 0)], "doc_id long, text string, n_chars long")
    one = quality_fm.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    none = quality_fm.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r["score"] > 0.999 and r["predicted"] == 1 for r in quality_fm.score(docs, one).collect())
    assert all(abs(r["score"] - 0.5) < 1e-6 and r["predicted"] == 0 for r in quality_fm.score(docs, none).collect())


def test_licences_of_composed_texts(spark):
    """Texts made of known notices, whole or wrapped, and of filler: what was put in comes out, in order."""
    rng, rules = random.Random(1), licenses.Rules()
    filler = [" ".join(rng.choice("the quick brown fox jumps over lazy dogs licensed rights software under".split()) for _ in range(rng.randint(3, 12))) + "." for _ in range(200)]
    single = [(n, p) for n, p in licenses.RULES if len(p) == 1]
    data = []
    for i in range(120):
        lines, want = [], []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.5:
                name, (part,) = rng.choice(single)
                want.append(name)
                lines.append("\n".join(textwrap.wrap(part, rng.choice([18, 30, 500]))) if rng.random() < 0.5 else part.upper())
            else:
                lines.append(rng.choice(filler))
            lines.append("")
        data.append((i, "\n".join(lines), ",".join(dict.fromkeys(want)), len(want)))
    docs = spark.createDataFrame(data, "doc_id long, text string, want string, n int").withColumns({"licenses": F.lit(0), "matches": F.lit(0)})
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in licenses.scan_licenses(docs).collect()}
    plain = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    assert not any(plain(f) in rules.ids for f in filler)
    assert got == {i: (w, n) for i, _, w, n in data}
    odd = spark.createDataFrame([(None, "All rights reserved."), (1, "All rights reserved."), (1, "All rights reserved."), (2, "word " * 1_200_000 + "\nAll rights reserved.")], "doc_id long, text string")
    assert [r["licenses"] for r in licenses.scan_licenses(odd).collect()] == ["proprietary"] * 4


def test_mixture_and_selection_agree(spark):
    """Every document as often as the mixture says, and the mixture is the longest prefix of the seeded order that fits."""
    import hashlib

    rng = random.Random(2)
    data = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), "en", f"s{i % 3}") for i in range(150)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    how = {"domain": F.lit("d"), "weights": {"source": {"s0": 3, "s1": 1, "s2": 1}}, "share": 1.2, "max_epochs": 3, "seed": 5}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs, **how).collect()}
    chosen = {r["doc_id"]: r["count"] for r in mixing.select(docs, **how).groupBy("doc_id").count().collect()}
    assert copies == chosen
    size = {i: len(t.split()) for i, t, _, _ in data}
    totals = {s: sum(size[i] for i, _, _, x in data if x == s) for s in ("s0", "s1", "s2")}
    leaves = spark.createDataFrame([("d", "en", s, n) for s, n in totals.items()], "domain string, lang string, source string, tokens long")
    for r in mixing.leaf_budgets(leaves, how["weights"], how["share"], how["max_epochs"]).collect():
        whole, left = divmod(r["budget"], totals[r["source"]])
        order = sorted((i for i, _, _, s in data if s == r["source"]), key=lambda i: hashlib.md5(f"5:{whole}:{i}".encode()).hexdigest())  # noqa: B023
        at = 0
        for i in order:
            at += size[i]
            assert copies.get(i, 0) == whole + (left > 0 and at <= left)


@pytest.mark.parametrize("n", [1, 40])
def test_hot_values_are_salted(spark, n):
    """A value in most rows: the verdict reaches all of them whatever the salts."""
    data = [(i, "token=everywhere99", f"o{i % 7}/r") for i in range(300)]
    found = secrets.candidates(spark.createDataFrame(data, "doc_id long, text string, source string"))
    got = secrets.judged(found, salts=n).select(F.size("example").alias("e"), F.size("live").alias("l")).collect()
    assert len(got) == 300 and all((r["e"], r["l"]) == (1, 0) for r in got)


def poured(leaves, weights, share, epochs):
    """Budgets of leaves by pouring what is left until nothing overflows, level by level."""
    total = int(sum(leaves.values()) * share)
    w = lambda path: weights.get(("domain", "lang", "source")[len(path) - 1], {}).get(path[-1], 1)
    live = {p: n * epochs for p, n in leaves.items() if all(w(p[: k + 1]) for k in range(3))}
    budget = {(): total}
    for depth in range(3):
        for up in {p[:depth] for p in live}:
            caps = {}
            for p, c in live.items():
                if p[:depth] == up:
                    caps[p[: depth + 1]] = caps.get(p[: depth + 1], 0) + c
            got, left = {}, dict(caps)
            while left:
                rest = (budget[up] - sum(got.values())) / sum(map(w, left))
                full = [p for p, c in left.items() if w(p) * rest >= c]
                got |= {p: caps[p] if full else w(p) * rest for p in full or left}
                left = {p: c for p, c in left.items() if p not in got}
            budget |= got
    return {p: int(budget[p] + 1e-6) for p in live}


def test_a_shut_out_leaf_gives_its_share_to_the_others(spark):
    schema = "domain string, lang string, source string, tokens long"
    leaves = {("a", "x", "1"): 100, ("a", "y", "1"): 900, ("b", "x", "1"): 1000}
    got = {r["domain"]: r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame([(*k, v) for k, v in leaves.items()], schema), {"lang": {"y": 0}}, 0.5, 1).collect()}
    assert got == {"a": 100, "b": 900}
    rng = random.Random(6)
    for _ in range(6):
        leaves = {(rng.choice("abc"), rng.choice("xyz"), rng.choice("1234")): rng.randint(0, 1000) for _ in range(25)}
        weights = {"domain": {"a": rng.randint(0, 3), "b": 2}, "lang": {"x": 0, "y": rng.randint(0, 4)}, "source": {"1": 0, "2": 5}}
        share, epochs = rng.choice([0.1, 0.5, 0.9]), rng.randint(1, 3)
        rows = mixing.leaf_budgets(spark.createDataFrame([(*k, v) for k, v in leaves.items()], schema), weights, share, epochs).collect()
        want = poured(leaves, weights, share, epochs)
        assert {(r["domain"], r["lang"], r["source"]) for r in rows} == want.keys()
        assert all(abs(r["budget"] - want[r["domain"], r["lang"], r["source"]]) <= 1 for r in rows)


def test_shortlists_grow_with_the_table(spark, monkeypatch):
    """Vectors without structure in many blocks: recall stays where a fixed shortlist would lose it."""
    from tidewater.llm import nearest

    assert nearest.shortlist(1000) == nearest.shortlist(nearest.FULL) == 200 and nearest.shortlist(400_000) == 1398
    assert nearest.share_of(200, 1) == 200 and nearest.share_of(1600, 16) == 180 and nearest.share_of(10, 40) == 10
    x = np.random.default_rng(9).normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 700)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 16)
    recall = {}
    for full in (500, 10**9):  # grown to 173 rows; and 50, as for a small table
        monkeypatch.setattr(nearest, "FULL", full)
        got = {}
        for r in nearest.search(df, F.col("vec_id") % 150 == 0, sample=2048, books=8, words=64, rerank=50).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        want = {q: set(np.argsort(-np.where(np.arange(6000) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in got}
        recall[full] = np.mean([len(got[q] & want[q]) / 20 for q in got])
        assert len(got) == 40
    assert recall[500] > recall[10**9] + 0.05


def test_a_null_id_is_not_held_out(spark, tmp_path):
    from tidewater.llm import queries

    spark.createDataFrame([(1, "some good text", 14), (None, "a text without id", 17)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in queries.op6_quality_fm(spark, str(tmp_path)).collect()}
    assert got[None][0] is False and 0 <= got[None][1] <= 1


def test_rules_match_as_a_plain_restatement_says():
    """Random sequences of sentences: identifiers by equality, all rules at every place, the longest first."""
    rng = random.Random(21)
    known = [f"sentence number {w} of the licence." for w in "alpha beta gamma delta epsilon".split()]
    given = [(f"L{i}", tuple(rng.choice(known) for _ in range(rng.randint(1, 4)))) for i in range(14)]
    rules = licenses.Rules(tuple(given))
    ordered = sorted(given, key=lambda r: -len(r[1]))
    for _ in range(400):
        said = [rng.choice([*known, "something else.", "Sentence   NUMBER alpha, of the licence!"]) for _ in range(rng.randint(0, 12))]
        plain = [licenses.normalise(s) for s in said]
        want, at = [], 0
        while at < len(said):
            hit = next((r for r in ordered if plain[at : at + len(r[1])] == [licenses.normalise(s) for s in r[1]]), None)
            if hit:
                want.append((hit[0], at, at + len(hit[1])))
            at += len(hit[1]) if hit else 1
        joint = rng.choice(["\n", "\n\n", " ", "\n// "])
        got = rules.scan(joint.join(said))
        assert got[2] == want and got[1] == sum(p in {licenses.normalise(k) for k in known if any(k in r[1] for r in given)} for p in plain)


def test_notices_of_many_licences():
    rules = licenses.Rules()
    said = {
        "// SPDX-License-Identifier: AGPL-3.0-or-later\ncode()": "AGPL-3.0-or-later",
        "/* SPDX-License-Identifier: MIT */": "MIT",
        "# This library is free software; you can redistribute it and/or modify it under\n# the terms of the GNU Lesser General Public License as published by the Free\n# Software Foundation; either version 2.1 of the License, or (at your option)\n# any later version.": "LGPL-2.1-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later",
        " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This software is licensed under the BSD 3-Clause License.": "BSD-3-Clause",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.": "Zlib",
        "SPDX-License-Identifier: MIT OR GPL-9": None,
        "the terms of the Boost Software License": None,
    }
    for text, name in said.items():
        assert [m[0] for m in rules.scan(text)[2]] == ([name] if name else []), text
    assert len({name for name, _ in (*licenses.full_texts(), *licenses.long_rules(), *licenses.RULES, *licenses.notice_rules())}) >= 36
