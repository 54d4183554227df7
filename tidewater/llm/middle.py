"""Fill-in-middle transformation (operator 13): an Arrow-batched pandas UDF.

A text is cut into units (``UNIT``: a run of letters, or any other single character). ``regex``'s finditer gives the ends
of the units, kept in a compact array of unsigned 32-bit numbers; the ends of prefix and middle are two look-ups in it, and
three slices of the text are the parts. ``hashlib`` computes the seed of a document from its id (so nothing depends on
partitions or order) and, where asked for, the digests.

Two of the seed's numbers choose the cuts, the third whether the text stays plain, the fourth the order of the parts:
psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Texts that hold one of the marks stay plain, so that an
output can be taken apart again without doubt.

Scale: narrow, one row in and one row out. Arrow batches are cut into ``BATCH_CHARS`` of text inside a task, so memory
follows the longest text, of which one copy, its units' ends (4 bytes each) and its output are held.

Defined results: a null text is empty; an empty text is plain, with no units; a null id has the seed of the word ``null``;
repeated rows and rows of one id are rows of their own (equal id and text give an equal output); an empty table gives no rows; columns
besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: units, marks, shares in percent.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW, SALT = 90, 20, "1"
#: Characters of text that a task turns into outputs at once (one text at least).
BATCH_CHARS = 4 << 20


@dataclass(frozen=True)
class Rules:
    """How texts are cut: of a hundred documents those from ``plain_from`` on stay plain, and of the others those below
    ``spm_below`` have the suffix first. ``salt`` makes another, independent choice for every document."""

    plain_from: int = PLAIN_FROM
    spm_below: int = SPM_BELOW
    salt: str = SALT


def unit_ends(text: str) -> array:
    """The code point at which each unit ends."""
    import regex

    return array("I", (m.end() for m in regex.finditer(UNIT, text)))


def split(doc_id: object, text: str, rules: Rules = Rules()) -> tuple[int, str, int, int]:
    """Number of units, form, end of the prefix and end of the middle (code points; 0 where the form is plain)."""
    seed = hashlib.sha256(f"{rules.salt}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(seed[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = unit_ends(text)
    if not text or h3 % 100 >= rules.plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", 0, 0
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    at = lambda k: ends[k - 1] if k else 0
    return len(ends), "spm" if h4 % 100 < rules.spm_below else "psm", at(low), at(high)


def joined(text: str, form: str, a: int, b: int) -> str:
    """The output of a text whose prefix ends at ``a`` and whose middle ends at ``b``."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text, from its output and form alone. An output that is not of its form is an error."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    parts, middle = output.split(MIDDLE)
    if not parts.startswith(first):
        raise ValueError(f"not of form {form}")
    a, b = parts[len(first) :].split(second)
    return a + middle + b if form == "psm" else b + middle + a


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _pieces(texts: pd.Series) -> Iterator[slice]:
    size = texts.str.len().to_numpy().cumsum() if len(texts) else []
    at = 0
    while at < len(texts):
        end = max(at + 1, int(size.searchsorted((size[at - 1] if at else 0) + BATCH_CHARS, "right")))
        yield slice(at, end)
        at = end


def _transform(docs: DataFrame, id_col: str, text_col: str, rules: Rules, outputs: bool, digests: bool) -> DataFrame:
    # ids go to Python and back as text: pandas would make doubles of numbers with nulls among them
    given = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = "id string, n long, form string, prefix_chars long, middle_chars long"
    schema += ", output string" * outputs + ", output_sha256 string, restored_sha256 string" * digests

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in _pieces(batch["text"]):
                part, rows = batch.iloc[piece], []
                for doc_id, text in zip(part["id"], part["text"], strict=True):
                    n, form, a, b = split(doc_id, text, rules)
                    out = joined(text, form, a, b)
                    cut = (None, None) if form == "plain" else (a, b - a)
                    rows.append((doc_id, n, form, *cut, *([out] * outputs), *((_sha(out), _sha(restored(out, form))) if digests else ())))
                named = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                yield named.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = given.mapInPandas(run, schema)
    return made.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *made.columns[1:])


def fill_in_middle(docs: DataFrame, *, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output: training examples. With ``digests`` those of outputs and of restored texts, too."""
    return _transform(docs, id_col, text_col, rules, True, digests)


def fill_in_middle_digests(docs: DataFrame, *, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`fill_in_middle`, but with the digests in place of the outputs, which stay in the tasks."""
    return _transform(docs, id_col, text_col, rules, False, True)


def restore(examples: DataFrame, *, output_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """``examples`` with the texts they were made from."""

    @F.pandas_udf("string")
    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else restored(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return examples.withColumn(name, back(F.col(f"`{output_col}`"), F.col(f"`{form_col}`")))


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u, sha256('{SALT}:' || coalesce(doc_id::varchar, 'null')) as s from documents),
h as (select *, len(u) as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
  case when n = 0 or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {PLAIN_FROM} then 'plain' when h4 % 100 < {SPM_BELOW} then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(u[:low], '') as p, array_to_string(u[low + 1:high], '') as m, array_to_string(u[high + 1:], '') as x from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || x || '{MIDDLE}' || m else '{SUFFIX}' || x || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256,
  sha256(p || m || x) as restored_sha256
from p"""
