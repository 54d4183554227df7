"""Spelling variant grouping by Aho-Corasick halves (operator 12).

Words are maximal runs of letters (``RUN``), A-Z in lower case; of ``DAMAGE`` runs one loses a letter, as the seed of its
document and spelling says. Words of ``LEAST`` code points and ``TWICE`` occurrences or more are compared: two are near if
they differ by one inserted, deleted or replaced code point. A word's form is its near word of most occurrences, if that
has ``TIMES`` as many as the word itself; its root is where the forms lead to.

Search: every word holds two segments, its halves. One edit leaves one of them whole, at the start of the other word or at
its end. Automata over segments are built in shards; all words are scanned, and a match counts if the segment lies at its
own offset and the lengths go together; then the distance is verified on what is beside the segment.

Scale: a segment lives in one shard, and a word is sent only to the shards of the beginnings and ends that it could share (four at
most), not to all. A shard holds about ``SHARD`` segments, so memory does not follow the vocabulary. The holders of a segment
are indexed by what is beside it, whole and with one letter left out: words that are near share such a key, so that verification meets
few words even where thousands hold a segment. A segment of more than ``HOT`` holders is dealt over tasks by these
same keys; no pair is lost, as near words meet at the key they share, and no pair is met twice, as only one such key counts. Tasks send on a
count and the best near word for each scanned word, never pairs. Occurrences are summed before they are shuffled. Chains of forms grow in
occurrences ``TIMES``-fold, so they are short, and a few doublings reach all roots.

Defined results: null texts have no words; a null id has the seed of the word ``null``; repeated rows count as rows of
their own; ties of forms go to the smaller spelling in code-point order; an empty table, or one without such words, gives
no rows; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, written

RUN = r"[a-zÀ-ÿ]"
DAMAGE, LEAST, TWICE, TIMES = 31, 7, 2, 10
#: Segments in one automaton; holders of a segment beyond which it is dealt over tasks by keys.
SHARD, HOT = 20_000, 4_096
#: Letters beyond which a key is a hash (base and modulus of the polynomial).
LONG, BASE, PRIME = 64, 1_000_003, (1 << 61) - 1
Index = dict[tuple[int, str], dict[str | int, list[tuple[str, int, str]]]]


def words(docs: DataFrame, *, damage: int = DAMAGE, least: int = LEAST, twice: int = TWICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of enough letters and occurrences. A run too short for that is too short with a letter less, too,
    so such runs are not even read."""
    lower = F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run"))
    seeded = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.expr("cast(h % char_length(run) as int)")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % damage == 0, damaged).otherwise(F.col("run"))
    return seeded.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def name(letters: str) -> str | int:
    """What stands for a sequence of letters among keys: itself or, of more than ``LONG``, its hash."""
    if len(letters) <= LONG:
        return letters
    h = 0
    for c in letters:
        h = (h * BASE + ord(c)) % PRIME
    return h


def keys(rest: str) -> set[str | int]:
    """What is beside a segment, whole and with each letter left out. In time in proportion to its length where that is
    beyond ``LONG``."""
    n = len(rest)
    if n <= LONG + 1:
        return {name(rest), *(rest[:i] + rest[i + 1 :] for i in range(n))}
    before, power = [0], [1]
    for c in rest:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    after = lambda i: before[n] - before[i] * power[n - i]  # hash of what begins at i
    return {before[n], *((before[i] * power[n - 1 - i] + after(i + 1)) % PRIME for i in range(n))}


def place(key: str | int, tiles: int) -> int:
    return (zlib.crc32(key.encode()) if isinstance(key, str) else key) % tiles


def meets(a: str, b: str, key: str | int) -> bool:
    """a and b differ by one letter, and ``key``, which both have, is the one at which that counts."""
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :] and key == name(a[:i] + a[i + 1 :])
    return len(b) - len(a) == 1 and a[i:] == b[i + 1 :] and key == name(a)


def _halves(scans: bool) -> Column:
    """side (0: the segment begins the word, 1: it ends it), seg, rest: the two halves of a word or, with ``scans``, all
    beginnings and ends that are the half of a word of one letter less, as many, or one more."""
    size = F.char_length("word")
    if scans:
        heads, tails = (F.array_distinct(F.array(*[((size + d) / 2).cast("int") for d in by])) for by in ((-1, 0, 1), (0, 1, 2)))
    else:
        heads, tails = F.array((size / 2).cast("int")), F.array(((size + 1) / 2).cast("int"))
    part = lambda side, seg, rest: F.struct(F.lit(side).alias("side"), seg.alias("seg"), rest.alias("rest"))
    head = F.transform(heads, lambda k: part(0, F.substring("word", F.lit(1), k), F.substring("word", k + 1, size)))
    tail = F.transform(tails, lambda k: part(1, F.substring("word", size - k + 1, k), F.substring("word", F.lit(1), size - k)))
    return F.concat(head, tail)


def routed(vocabulary: DataFrame, shards: int, hot: int = HOT) -> DataFrame:
    """unit, tile, tiles, scans, side, seg, word, n: what each automaton holds and what it scans."""
    each = lambda scans: vocabulary.select("word", "n", F.lit(scans).alias("scans"), F.inline(_halves(scans)))
    held = each(False)
    crowded = held.groupBy("side", "seg").agg(F.count("*").alias("holders")).where(F.col("holders") > hot).select("side", "seg", F.ceil(F.col("holders") / hot).cast("int").alias("tiles"))
    crowded = cut(crowded)
    rows = held.unionByName(each(True)).join(crowded, ["side", "seg"], "left")

    @F.pandas_udf("array<int>")
    def places(rest: pd.Series, tiles: pd.Series) -> pd.Series:
        return pd.Series([list({place(k, t) for k in keys(r)}) for r, t in zip(rest, tiles, strict=True)])

    names = ["scans", "side", "seg", "rest", "word", "n"]
    whole = rows.where(F.col("tiles").isNull()).select(F.pmod(F.xxhash64("side", "seg"), F.lit(shards)).alias("unit"), F.lit(0).alias("tile"), F.lit(1).alias("tiles"), *names)
    dealt = rows.where(F.col("tiles").isNotNull()).select(F.xxhash64("side", "seg").alias("unit"), F.explode(places("rest", "tiles")).alias("tile"), "tiles", *names)
    return whole.unionByName(dealt)


class Shard:
    """The automaton of one unit, and its holders by segment and key."""

    def __init__(self):
        self.held: Index = {}
        self.automaton = None

    def hold(self, side: int, seg: str, rest: str, word: str, n: int, tile: int, tiles: int) -> None:
        by = self.held.setdefault((side, seg), {})
        for key in keys(rest):
            if tiles == 1 or place(key, tiles) == tile:
                by.setdefault(key, []).append((rest, n, word))

    def scan(self, word: str, tile: int, tiles: int) -> Iterator[tuple[int, str]]:
        """n and spelling of the words here that are near ``word``, each once over all shards."""
        if not self.held:
            return
        for side, seg in self.lying(word):
            by = self.held.get((side, seg))
            if not by:
                continue
            rest = word[: len(word) - len(seg)] if side else word[len(seg) :]
            for key in keys(rest):
                if tiles == 1 or place(key, tiles) == tile:
                    for beside, n, other in by.get(key, ()):
                        # words that share their beginning, too, have met there
                        if meets(beside, rest, key) and not (side and word.startswith(beside)):
                            yield n, other

    def lying(self, word: str) -> Iterator[tuple[int, str]]:
        """Side and letters of the segments that lie in ``word`` at their own offset. The automaton finds those of up to ``LONG`` letters;
        longer ones, which a word can have in four lengths only, are cut out (an automaton goes back over all of a long repeated segment at each letter)."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for _, seg in self.held:
                if len(seg) <= LONG:
                    self.automaton.add_word(seg, seg)
            self.automaton.make_automaton()
        size = len(word)
        if (size - 1) // 2 <= LONG and len(self.automaton):
            for last, seg in self.automaton.iter(word):
                if last + 1 == len(seg):
                    yield 0, seg
                if last + 1 == size:
                    yield 1, seg
        for k in {(size - 1) // 2, size // 2, (size + 1) // 2}:
            if k > LONG:
                yield 0, word[:k]
        for k in {size // 2, (size + 1) // 2, (size + 2) // 2}:
            if k > LONG:
                yield 1, word[size - k :]


def _near(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, scanned = None, Shard(), None
        for batch in batches:
            out: list[tuple[str, int, int, str]] = []
            for unit, tile, scans, word, tiles, side, seg, rest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (unit, tile) != at:
                    at, shard, scanned = (unit, tile), Shard(), None
                if not scans:
                    shard.hold(side, seg, rest, word, n, tile, tiles)
                elif word != scanned:
                    scanned, found = word, list(shard.scan(word, tile, tiles))
                    if found:
                        n, other = min(found, key=lambda x: (-x[0], x[1]))
                        out.append((word, len(found), n, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["word", "n_near", "n", "near"])

    order = ["unit", "tile", "scans", "word"]
    ready = rows.repartition("unit", "tile").sortWithinPartitions(*order).select(*order, "tiles", "side", "seg", "rest", "n")
    return ready.mapInArrow(run, "word string, n_near long, n long, near string")


def roots(forms: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """word, root for each row of ``forms`` (word, form). A chain gains ``times`` the occurrences at each step, so one that
    ends at ``most`` has a known length at most, and each round doubles the way."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(most, 1), times))))):
        found = cut(found)
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = found.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found


def group_spellings(docs: DataFrame, *, shard: int = SHARD, hot: int = HOT, times: int = TIMES, **how) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words."""
    spark = docs.sparkSession
    counted = words(docs, **how)
    vocabulary = spark.read.schema(counted.schema).parquet(written(counted, "words"))
    size, most = vocabulary.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    near = _near(routed(vocabulary, max(1, math.ceil(2 * size / shard)), hot))
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    chosen = (-F.col("best.n")) >= times * F.col("n")
    found = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.n")).alias("form_n"))
    found = spark.read.schema(found.schema).parquet(written(found, "forms"))
    ends = roots(found.where("form is not null"), most, times)
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE_SQL = f"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n::ubigint, range(8)::ubigint[]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end)) as tab),
runs as (select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{{LEAST},}}')) as run from documents),
raw as (select run, hex(encode(id || ':' || run)) as x from runs),
seeded as (select run, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::ubigint)), lambda c, b: xor(tab[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint) as h from raw, crc),
vocabulary as (select case when h % {DAMAGE} = 0 then run[:(h % length(run))::bigint] || run[(h % length(run))::bigint + 2:] else run end as word, count(*) as n from seeded group by 1 having length(word) >= {LEAST} and count(*) >= {TWICE}),
less as (select word, n, i, word[:i - 1] || word[i + 1:] as d from (select word, n, unnest(range(1, length(word) + 1)) as i from vocabulary)),
pairs as (select a.word, b.word as near, b.n from less a join less b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from less a join vocabulary b on a.d = b.word union select b.word, a.word, a.n from less a join vocabulary b on a.d = b.word),
best as (select word, count(*) as n_near, arg_min(near, (-n, near)) as near, max(n) as near_n from pairs group by word),
found as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= {TIMES} * v.n then near end as form, case when near_n >= {TIMES} * v.n then near_n end as form_n from vocabulary v left join best b on v.word = b.word),
walk as (select word, word as place from found union all select walk.word, f.form from walk join found f on f.word = walk.place where f.form is not null)
select word, n::bigint as n, n_near::bigint as n_near, form, form_n::bigint as form_n, place as root from found join (select walk.word, place from walk join found f on f.word = place where f.form is null) using (word)"""
