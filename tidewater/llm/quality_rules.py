"""Quality rules with line sequence labelling (operator 8).

Base rules are counts over the whole text. The verdict comes from a linear-chain conditional random field
over the lines that hold a word: each line gets the label content or boilerplate, Viterbi decoding finds the
likeliest sequence, and a document is kept if the share of its words in content lines reaches a threshold.

The field is fitted on a bounded sample of labelled documents (``TRAIN_DOCS``, of each its first ``TRAIN_LINES`` lines;
of repeated rows of one id the one of the smallest text), whose lines take the label of
their document: most lines of good documents are content, most lines of bad ones are not, and the clean lines
inside bad ones are outvoted by those of the good ones. Without labels of both kinds, fixed prior weights hold.

Defined results: a null or empty text has zero counts, fails the base rules and is not kept; texts are judged
whole; each row is judged by itself, so repeated rows and ties get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, mix, slices, text_column

#: The most labelled documents that the field is fitted on.
TRAIN_DOCS = 1500
#: The most lines of one of them that the field is fitted on: its first ones.
TRAIN_LINES = 1000
MIN_WORDS, MOST_REPEATED_PERCENT, CONTENT_SHARE = 50, 50, 0.5
FEATURES = ("bias", "log_words", "upper", "symbols", "bangs", "same_as_before", "in_repeated", "duplicate", "digits", "ends_sentence")
N = len(FEATURES)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
#: Bytes of text that are measured at once (a longer text is measured whole).
AT_ONCE = 512 << 10
_SPACES = " \t\x0b\x0c\r"
#: Scores of boilerplate over content by feature, and of a change of label, where there are no labels to learn from.
PRIOR = np.array([-3.0, 0.0, 6.0, 6.0, 6.0, 8.0, 6.0, 3.0, 0.0, 0.0, -1.0])


def _prefix(x: np.ndarray) -> np.ndarray:
    """Running sums from 0; of flags, so 32 bits do for a slice or a text of under 2 GiB."""
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=out[1:], dtype=np.int32)
    return out


def _inside(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each stretch."""
    sums = _prefix(flags)
    return sums[end] - sums[begin]


def _repeated(w: Words, h: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three words that its document has twice or more."""
    at, win = w.windows(h, 3, 0x2545F4914F6CDD1D)
    key = mix(win ^ (w.doc[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    again = np.zeros(len(h) + 3, bool)
    hit = at[order[twice]]
    for j in range(3):
        again[hit + j] = True
    return again[: len(h)]


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Of each line with a word: whether it equals an earlier one of its document."""
    flags: list[bool] = []
    for text in texts:
        seen: set[str] = set()
        for line in text.as_py().split("\n"):
            if line.strip(_SPACES):
                flags.append(line in seen)
                seen.add(line)
    return np.array(flags, bool)


def measure(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each document; features of each line with a word, its number of words and its document. Only one
    array over all bytes is laid out at a time."""
    w = Words(texts)
    h, body, s, e = w.hashes(), w.buf[: w.size], w.starts, w.ends
    low, high = w.offsets[:-1], w.offsets[1:]
    again = _repeated(w, h)
    symbol = IS_SYMBOL[body]
    counts = {
        "n_words": np.diff(w.first), "word_chars": _inside(w.inside & ((body & 0xC0) != 0x80), low, high).astype(np.int64), "n_symbols": _inside(symbol, low, high).astype(np.int64),
        "n_dup_lines": np.zeros(w.n, np.int64), "n_repeat_words": _inside(again, w.first[:-1], w.first[1:]).astype(np.int64),
    }
    # lines with a word
    begins = np.unique(np.concatenate([low, np.flatnonzero(body == 10) + 1]))
    line = np.searchsorted(begins, s, "right") - 1
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    head = np.flatnonzero(new)
    if not len(head):
        return counts, np.zeros((0, N)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(line)))
    doc = np.searchsorted(w.first, head, "right") - 1
    duplicate = _duplicate_lines(texts)
    counts["n_dup_lines"] = np.bincount(doc[duplicate], minlength=w.n)
    share = lambda x: np.add.reduceat(np.minimum(x, 1).astype(np.float64), head) / size
    shouts = (_inside((body >= 65) & (body <= 90), s, e) >= 2) & (_inside((body >= 97) & (body <= 122), s, e) == 0)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & ~new[1:]
    final = w.buf[e[np.append(head[1:], len(line)) - 1] - 1]
    x = np.stack([
        np.ones(len(head)), np.log1p(size) / 4, share(shouts), share(_inside(symbol, s, e)), share(_inside(body == 33, s, e)), share(same), share(again), duplicate.astype(np.float64),
        share(_inside((body >= 48) & (body <= 57), s, e)), np.isin(final, list(b".!?:;\"'")).astype(np.float64),
    ], 1)
    return counts, x, size, doc


def _by_position(doc: np.ndarray) -> list[np.ndarray]:
    """The lines at position 0, 1, ... of their documents."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    position = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    order = np.argsort(position, kind="stable")
    return np.split(order, np.cumsum(np.bincount(position))[:-1]) if len(doc) else []


def viterbi(score: np.ndarray, change: float, doc: np.ndarray) -> np.ndarray:
    """True for boilerplate. score: of boilerplate over content, by line; change: of two labels that differ.
    Ties go to content. All documents advance together, one line at a time."""
    steps = _by_position(doc)
    back = np.zeros((len(doc), 2), np.int8)
    best = np.zeros((len(doc), 2))
    for t, now in enumerate(steps):
        gain = np.stack([np.zeros(len(now)), score[now]], 1)
        if t:
            before = best[now - 1]
            stay0, stay1 = before[:, 0], before[:, 1]
            back[now, 0] = stay1 + change > stay0
            back[now, 1] = stay1 >= stay0 + change
            gain[:, 0] += np.maximum(stay0, stay1 + change)
            gain[:, 1] += np.maximum(stay1, stay0 + change)
        best[now] = gain
    label = np.zeros(len(doc), np.int8)
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    label[last] = best[last, 1] > best[last, 0]
    for now in reversed(steps[1:]):
        label[now - 1] = back[now, label[now]]
    return label.astype(bool)


def _marginals(score: np.ndarray, change: float, doc: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(boilerplate) of each line, and P(differs from the line before)."""
    n = len(doc)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    trans = np.array([[0.0, change], [change, 0.0]])
    emit = np.stack([np.zeros(n), score], 1)
    for t, now in enumerate(steps):
        fwd[now] = emit[now] + (np.logaddexp(fwd[now - 1][:, :1] + trans[0], fwd[now - 1][:, 1:] + trans[1]) if t else 0)
    for now in reversed(steps[1:]):
        y = emit[now] + bwd[now]
        bwd[now - 1] = np.stack([np.logaddexp(y[:, 0], y[:, 1] + change), np.logaddexp(y[:, 0] + change, y[:, 1])], 1)
    both = fwd + bwd
    z = np.logaddexp(both[:, 0], both[:, 1])
    p = np.exp(both[:, 1] - z)
    differs = np.zeros(n)
    for now in steps[1:]:
        y = emit[now] + bwd[now]
        differs[now] = np.exp(fwd[now - 1][:, 0] + change + y[:, 1] - z[now]) + np.exp(fwd[now - 1][:, 1] + change + y[:, 0] - z[now])
    return p, differs


def fit(x: np.ndarray, doc: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> np.ndarray:
    """Weights (feature scores, then the score of a change) of greatest conditional likelihood, by Adam."""
    if not len(label) or label.min() == label.max():
        return PRIOR.copy()
    steps, n = _by_position(doc), len(label)
    changed = np.zeros(n)
    for now in steps[1:]:
        changed[now] = label[now] != label[now - 1]
    theta, m, v = np.zeros(N + 1), np.zeros(N + 1), np.zeros(N + 1)
    for k in range(1, rounds + 1):
        p, differs = _marginals(x @ theta[:N], theta[N], doc, steps)
        g = np.append(x.T @ (label - p), (changed - differs).sum()) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        theta[N] = min(theta[N], 0.0)
    # a change of label stays possible: documents are labelled as wholes, so the data never show one
    theta[N] = max(theta[N], -2.0)
    return theta


def one_each(rows: DataFrame) -> DataFrame:
    """One row of each doc_id: that of the smallest values, in the order of the columns."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in others))


def fit_on(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> np.ndarray:
    """Weights fitted on the ``train_docs`` labelled documents of smallest hash: a bounded sample."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    joined = one_each(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id"))  # train_docs rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=AT_ONCE):
                _, x, _, doc = measure(text_column(part))
                ids, quality = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "quality"))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(quality, pa.int32()), pa.array([x[a : min(b, a + train_lines)].astype("<f4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["doc_id", "quality", "x"])

    rows = sorted(joined.mapInArrow(run, "doc_id long, quality int, x binary").collect())
    x = [np.frombuffer(r["x"], "<f4").reshape(-1, N).astype(np.float64) for r in rows]
    if not rows:
        return PRIOR.copy()
    doc = np.repeat(np.arange(len(x)), [len(a) for a in x])
    return fit(np.concatenate(x), doc, np.repeat([float(r["quality"] == 0) for r in rows], [len(a) for a in x]))


def judge(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED_PERCENT, carry: bool = False) -> DataFrame:
    """Counts and verdict of each document: its id and the columns ``COUNTS``, base_failed, kept, n_lines, content_share.
    With ``carry`` instead the documents that pass, with their own columns and nothing else. Narrow: no shuffle; a text
    goes to Python once, and the texts of documents that fail do not come back."""
    names = docs.columns if carry else [id_col, text_col]
    rows = docs.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])  # by place, so that no name can clash
    text = f"c{names.index(text_col)}" if carry else "c1"
    if not isinstance(rows.schema[text].dataType, (T.StringType, T.BinaryType)):
        rows = rows.withColumn(text, F.col(text).cast("string"))
    theta = np.asarray(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, most=AT_ONCE):
                counts, x, size, doc = measure(text_column(part, text))
                noise = viterbi(x @ theta[:N], theta[N], doc)
                content = np.bincount(doc, np.where(noise, 0, size), part.num_rows)
                n = counts["n_words"]
                failed = (n < min_words) | (100 * counts["n_repeat_words"] > most_repeated * n)
                kept = ~failed & (content >= share * n)
                if carry:
                    yield part.filter(pa.array(kept))
                    continue
                lines = np.bincount(doc, minlength=part.num_rows)
                arrays = [pa.array(counts[c], pa.int64()) for c in COUNTS] + [pa.array(failed), pa.array(kept), pa.array(lines, pa.int64()), pa.array(content / np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["c0", *COUNTS, "base_failed", "kept", "n_lines", "content_share"])

    if carry:
        out = rows.mapInArrow(run, rows.schema)
        return out.select([F.col(f"c{k}").cast(docs.schema[c].dataType).alias(c) for k, c in enumerate(names)])
    fields = [f"c0 {rows.schema['c0'].dataType.simpleString()}", *(f"{c} long" for c in COUNTS), "base_failed boolean", "kept boolean", "n_lines long", "content_share double"]
    return rows.mapInArrow(run, ", ".join(fields)).withColumnRenamed("c0", id_col)


def rate(docs: DataFrame, weights: np.ndarray, **how) -> DataFrame:
    """id, counts, base_failed, kept, n_lines, content_share of each document."""
    return judge(docs, weights, **how)


def keep_good(docs: DataFrame, weights: np.ndarray, **how) -> DataFrame:
    """The documents that pass, with all their columns."""
    return judge(docs, weights, carry=True, **how)
