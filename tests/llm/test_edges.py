"""Odd columns, very long texts, empty tables and repeated rows, for the operators that carry documents along."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import mixing, near_copies, quality_rules, secrets, store, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ("__text", "__kept", "__base", "__repo", "__rid", "own", "c0", "base", "rid", "a.b", "salt", "key", "part", "value", "id", "root", "node")


def odd(df):
    return df.select("*", *[F.lit(k).alias(name) for k, name in enumerate(ODD)])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    prose = lambda n: ". ".join(" ".join(rng.choice(["river", "Stone", "green", "walks", "over", "seven", "hills", "and", "home", "again"]) for _ in range(9)) for _ in range(n))
    out = [(i, prose(12), "en", f"o{i % 3}/r{i % 5}", 1) for i in range(20)]
    return [*out, (20, "token = abcdefgh12345 " + prose(10), "en", "o1/r1", 1), (21, None, None, None, None), (22, "", "", "", 0), (22, "", "", "", 0), (None, prose(9), "de", "o1/r2", 3)]


def test_odd_columns_stay(spark, rows):
    docs = odd(spark.createDataFrame(rows, SCHEMA))
    how = {"domain": F.lit("d"), "weights": {"source": {"o1/r1": 3}}, "share": 0.7}
    kept, masked, mixed, few = quality_rules.keep_good(docs, quality_rules.PRIOR), secrets.redact(docs), mixing.select(docs, **how), near_copies.keep_one(docs)
    for out in (kept, masked, mixed, few):
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert all(r["a.b"] == ODD.index("a.b") and r["own"] == ODD.index("own") for r in out.collect())
    assert masked.count() == len(rows) and masked.where("text like '[SECRET]%'").count() == 1
    assert secrets.scan(docs).count() == len(rows) and quality_rules.rate(docs, quality_rules.PRIOR).count() == len(rows)
    assert 0 < kept.count() < len(rows) and mixed.count() > 0


def test_repositories_and_owners_differ(spark):
    """A value in three repositories of one owner is shared but live; one in three owners is an example."""
    data = [(i, "token=onlyours123", f"a/r{i}") for i in range(3)] + [(10 + i, "token=everyones123", f"o{i}/r") for i in range(3)] + [(20, "token=single12345", "b/x")]
    got = {r["doc_id"]: (r["n_live"], r["n_shared"], r["n_example"]) for r in secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got == {0: (1, 1, 0), 1: (1, 1, 0), 2: (1, 1, 0), 10: (0, 0, 1), 11: (0, 0, 1), 12: (0, 0, 1), 20: (1, 0, 0)}


def test_many_leaves_are_salted_with_equal_results(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    how = {"domain": F.lit("d"), "weights": {"source": {"o1/r1": 3}}, "share": 0.7}
    rest = [sorted(map(tuple, mixing.mixture(docs, **how, few_leaves=n).collect()), key=repr) for n in (0, 1000)]
    assert rest[0] == rest[1] and rest[0]


def test_weights_of_thousands_of_names(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = {"source": {f"s{i}": 2 for i in range(5000)} | {"o1/r1": 0}}
    assert mixing.mixture(docs, domain=F.lit("d"), weights=weights, share=0.9).where("source = 'o1/r1'").count() == 0


def test_tokenizer_files_that_are_not_handled(tmp_path):
    tokenizers_at = pytest.importorskip("public_tokenizers")
    import json

    good = json.loads(Path(tokenizers_at.path("word_bpe_49k.json")).read_text())
    good["model"] |= {"vocab": {"a</w>": 0, "a": 1}, "merges": []}
    good["added_tokens"] = []
    for change in (lambda t: t["normalizer"]["normalizers"].append({"type": "StripAccents"}), lambda t: t["pre_tokenizer"]["pretokenizers"].pop(), lambda t: t["model"].update(byte_fallback=True)):
        bad = json.loads(json.dumps(good))
        change(bad)
        path = tmp_path / f"{random.random()}.json"
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            token_counts.prove_whole_tokens(str(path))


def test_token_counts_of_many_scripts():
    tokenizers_at = pytest.importorskip("public_tokenizers")
    path, rng = tokenizers_at.path("word_bpe_49k.json"), random.Random(4)
    counter, library = token_counts.Counter(path, token_counts.prove_whole_tokens(path), ()), token_counts._library(path)
    ranges = [(0, 0x24F), (0x391, 0x3CE), (0x400, 0x45F), (0x3041, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x20, 0x7E), (0x300, 0x310), (0x1F600, 0x1F640)]
    for _ in range(4000):
        some = rng.sample(ranges, 2)
        text = "".join(chr(rng.randint(*rng.choice(some))) for _ in range(rng.randint(1, 14)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False)), repr(text)


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        store.shared_dir(Cluster)
    Cluster.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(ValueError):
        store.shared_dir(Cluster)


def test_very_long_texts(spark):
    """A text beyond every slice (over 4 MiB) is measured, judged and kept whole."""
    rng = random.Random(5)
    words = [f"word{rng.randrange(10**6)}" for _ in range(600_000)]
    text = "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, len(words), 12))
    assert len(text) > 5 << 20
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in quality_rules.rate(docs, quality_rules.PRIOR).collect()}
    assert r[1]["n_words"] == 600_000 and r[1]["word_chars"] == sum(map(len, text.split())) and r[1]["n_lines"] == 50_000 and r[1]["n_dup_lines"] == 0
    assert [x[0] for x in near_copies.keep_one(docs).orderBy("doc_id").select("doc_id").collect()] == [1, 3]


def test_held_out_verdicts():
    """Labels that the field was not fitted on: nearly all good documents that pass the base rules stay, few bad ones do."""
    at = Path("/root/testdata/sf0.1")
    if not at.exists():
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    from tidewater.llm.words import slices, text_column

    quality = dict(zip(*pq.read_table(at / "labels.parquet", columns=["doc_id", "quality"]).to_pydict().values(), strict=True))
    xs, docs, sizes, base, ids, n = [], [], [], [], [], 0
    for batch in pq.read_table(at / "documents.parquet", columns=["doc_id", "text"]).to_batches():
        for part in slices(batch):
            counts, x, size, doc = quality_rules.measure(text_column(part))
            xs.append(x), docs.append(doc + n), sizes.append(size), base.append((counts["n_words"] < 50) | (2 * counts["n_repeat_words"] > counts["n_words"])), ids.append(part.column(0).to_numpy())
            n += part.num_rows
    x, doc, size, failed, ids = map(np.concatenate, (xs, docs, sizes, base, ids))
    label = np.array([quality.get(i, -1) for i in ids])
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in ids])
    taught = np.flatnonzero(~held & (label >= 0))[: quality_rules.TRAIN_DOCS]
    rows = np.isin(doc, taught)
    theta = quality_rules.fit(x[rows], np.searchsorted(taught, doc[rows]), (label[doc[rows]] == 0).astype(float))
    noise = quality_rules.viterbi(x @ theta[: quality_rules.N], theta[quality_rules.N], doc)
    words = np.bincount(doc, size, len(ids))
    kept = ~failed & (np.bincount(doc, np.where(noise, 0, size), len(ids)) >= quality_rules.CONTENT_SHARE * words)
    good, bad = held & (label == 1) & ~failed, held & (label == 0)
    assert kept[good].mean() > 0.99 and kept[bad].mean() < 0.1 < (~failed)[bad].mean()


def test_pipeline_of_nothing(spark, tmp_path):
    """An empty table, and one whose documents are all rejected, give no rows and the last stage's columns."""
    for name, data in (("none", []), ("bad", [(1, "x", "en", "s", 1), (2, None, None, None, None)])):
        spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() == 0


def test_texts_that_are_all_secrets(spark):
    """A megabyte of opaque words, and 50,000 assignments: every span at its place, in seconds."""
    import re
    import time

    rng = random.Random(9)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["aB3" + "".join(rng.choice(alphabet) for _ in range(rng.randint(25, 45))) for _ in range(26_000)]
    opaque, assigned = "é " + " ".join(words), "\n".join(f"token = {w[:12]}" for w in words + words[:24_000])
    mixed = "password=" + words[0] + " " + words[1] + " AKIA" + "B2" * 8 + " x" * 3 + " " + words[2] + "/0123456789abcdef0123456789abcdef"
    assert len(opaque) > 1_000_000
    docs = spark.createDataFrame([(1, opaque), (2, assigned), (3, mixed)], "doc_id long, text string")
    secrets.scan(docs.where("doc_id = 3")).collect()
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert time.time() - began < 60
    places = lambda text, pattern, kind: [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text)]
    assert got[1]["spans"].split(",") == places(opaque, secrets.OPAQUE, "opaque") and got[1]["n_assign"] == 0
    assert got[2]["n_assign"] == 50_000 and got[2]["spans"].split(",") == places(assigned, r"token = \w{12}", "assign")
    kinds = [x.split(":")[0] for x in got[3]["spans"].split(",")]
    assert kinds == ["assign", "opaque", "access", "hex"]  # the last word overlaps a base span
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert masked[1] == "é " + " ".join(["[SECRET]"] * len(words)) and masked[2] == "\n".join(["[SECRET]"] * 50_000)
