"""Token counts by the whole-token shortcut (operator 3).

Offline, on the driver, the library encodes every vocabulary string that can be a whole pre-token, alone;
those that come back as exactly one token are proven whole tokens (a set bounded by the vocabulary). In the
tasks a pre-token of that set counts one, directly; only the other pre-tokens are merged, by the library.

The normaliser, the pattern and the suffix of words are read from the tokenizer file; a file that asks for something
that is not handled here (:func:`rules_of`) is an error, not a wrong count.

Texts are cut at ASCII white space first: these normalisers and patterns never join anything across it, so the counts
of the parts add up. A part with characters outside ``KNOWN`` (Latin, Greek without the sigma whose small form depends
on its place, Cyrillic, kana, Han, Hangul) or a text that contains an added token is counted by the library as it is.

Defined results: a null text is empty (0 bytes, 0 tokens); texts are counted whole; rows are kept as they
are; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_column

#: Parts whose counts a Python worker remembers at once; then it starts anew. Bounds memory, not results.
PARTS_KEPT = 300_000
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Characters whose lower case, composition and kind are the same here and in the library.
KNOWN = re.compile("[\\u0000-\\u024f\\u0391-\\u03a1\\u03a4-\\u03a9\\u03ac-\\u03c1\\u03c3-\\u03ce\\u0400-\\u045f\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]*")


@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def _count(t, texts: list[str]) -> list[int]:
    return [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies, by the published rule: printable Latin-1 stays, the other
    bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rules_of(path: str) -> tuple[bool, bool, str, str]:
    """Whether the tokenizer composes (NFC), whether it lower-cases, its pattern of pre-tokens, its suffix of words.
    Raises ValueError where the file asks for anything beyond these and the replacement of white space by a space."""
    import json

    t = json.loads(_library(path).to_str())
    listed = lambda part, name: part[name] if part and part["type"] == "Sequence" else [part] if part else []
    steps, before, model = listed(t["normalizer"], "normalizers"), listed(t["pre_tokenizer"], "pretokenizers"), t["model"]
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    fine = all(s == spaces or s in ({"type": "NFC"}, {"type": "Lowercase"}) for s in steps) and [s["type"] for s in steps if s != spaces] in ([], ["NFC"], ["Lowercase"], ["NFC", "Lowercase"])
    fine &= len(before) == 2 and before[0]["type"] == "Split" and (before[0]["behavior"], before[0]["invert"]) == ("Removed", True) and "Regex" in before[0]["pattern"]
    fine = fine and {k: before[1].get(k) for k in level} == level
    fine &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not fine:
        raise ValueError(f"{path}: this tokenizer's normaliser, pattern or model is not one that the whole-token shortcut handles")
    kinds = {s["type"] for s in steps}
    return "NFC" in kinds, "Lowercase" in kinds, before[0]["pattern"]["Regex"], model["end_of_word_suffix"] or ""


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that the library, given them alone, encodes as one token."""
    t, of, suffix = _library(path), byte_alphabet(), rules_of(path)[3]
    words = []
    for entry in t.get_vocab(with_added_tokens=False):
        if entry.endswith(suffix) and len(entry) > len(suffix):
            try:
                words.append(bytes(of[c] for c in entry[: len(entry) - len(suffix)]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    return frozenset(w for w, n in zip(words, _count(t, words), strict=True) if n == 1)


class Counter(dict):
    """Part of a text (between white space) to its number of tokens."""

    def __init__(self, path: str, whole: frozenset[str], added: tuple[str, ...]):
        import regex

        super().__init__()
        self.t, self.whole, self.added = _library(path), whole, added
        self.composes, self.lowers, pattern, _ = rules_of(path)
        self.split = regex.compile(pattern)
        self.rest: dict[str, int] = {}

    def __missing__(self, part: str) -> int:
        plain = part.isascii()
        if plain or KNOWN.fullmatch(part):
            text = unicodedata.normalize("NFC", part) if self.composes and not plain else part
            n = 0
            for p in self.split.findall(text.lower() if self.lowers else text):
                n += 1 if p in self.whole else self.merged(p)
        else:
            n = _count(self.t, [part])[0]
        if len(part) <= 64:
            self[part] = n
        return n

    def merged(self, pre: str) -> int:
        if (n := self.rest.get(pre)) is None:
            n = len(self.t.encode(pre, add_special_tokens=False))
            if len(pre) <= 64:
                self.rest[pre] = n
        return n

    def count(self, text: str) -> int:
        if any(a in text for a in self.added):
            return _count(self.t, [text])[0]
        if len(self) + len(self.rest) > PARTS_KEPT:
            self.clear()
            self.rest.clear()
        return sum(map(self.__getitem__, filter(None, _SPACE.split(text))))


@lru_cache(maxsize=2)
def _counter(path: str, whole: frozenset[str], added: tuple[str, ...]) -> Counter:
    return Counter(path, whole, added)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit. Narrow: no shuffle; one row in, one row out."""
    whole = prove_whole_tokens(path)
    added = tuple(sorted(x.content for x in _library(path).get_added_tokens_decoder().values()))
    shared = docs.sparkSession.sparkContext.broadcast(whole)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, shared.value, added)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = text_column(part, "text")
                n = [counter.count(x) for x in texts.to_pylist()]
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
