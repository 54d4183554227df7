"""Secret scans with corpus-wide ownership frequency (operator 2). DataFrame functions only.

Candidates are the base patterns' matches and, beyond them, opaque words (``OPAQUE``) that no base match overlaps. The
hash of each candidate's value is aggregated over the corpus by distinct repositories and owners. A value in more than
``most_owners`` owners is a widely copied example; the others are owner-specific and look live, and of these the ones in
more than one repository are shared (to be changed first). Opaque words become spans only if they look live, base spans
always stay, with their verdict.

Positions: the gaps between matches (``split``) and the matches (``regexp_extract_all``) give, by adding lengths in chunks,
the code point at which each match starts; overlaps are judged on sorted spans. So a text of a million characters that is
all candidates takes seconds. A span is the whole match, end exclusive; an assignment's value is its group 2.

Scale: the scan is narrow and its small result (no text unless ``carry``) is written once; values are aggregated twice
with partial sums, so a value in a third of all rows costs each map task one row for a repository; only values with a
verdict other than the usual one are joined back, and the spans of a value are salted (``SALTS``), so a hot value is not
one task's work. Texts without candidates take no part in any shuffle.

Defined results: a null text is empty (no spans, hash of the empty string); a null repository or owner counts as one
of its own; repeated rows, of one id too, are rows of their own with equal results; extra columns of any name are
ignored or, with ``redact``, kept (a document's own columns are carried in one struct, by place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are long enough: the longest runs of the class, so the same matches as with + and a test of the length.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
OPAQUE = "[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
OPAQUE_KIND = KINDS.index("opaque")
MOST_OWNERS = 2
#: Parts that the spans of one value are dealt into when verdicts are joined.
SALTS = 32
#: Places of an array that are summed at once: running sums of n places take n * CHUNK / 2 additions.
CHUNK = 128
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, zero: Column, add) -> Column:
    """For each place of an array what ``add`` makes of all values before it. In chunks, whose sums are added first: an array
    that grows by one in ``aggregate`` would be copied at every step."""
    of = lambda some, start: F.aggregate(some, start, add)

    def laid(chunks: Column) -> Column:
        heads = _let(F.transform(chunks, lambda c: of(c, zero)), lambda t: F.transform(t, lambda _, k: of(F.slice(t, F.lit(1), k), zero)))
        return F.flatten(F.zip_with(chunks, heads, lambda c, head: F.transform(c, lambda _, i: of(F.slice(c, F.lit(1), i), head))))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(CHUNK))
    return _let(F.transform(starts, lambda at: F.slice(values, at, F.lit(CHUNK))), laid)


def _spans(text: Column, kind: int, pattern: str, group: int = 0, counts=lambda value: F.lit(True)) -> Column:
    """start, kind, stop, value hash of the matches whose group ``counts``."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    value = (lambda pair: pair["value"]) if group else (lambda pair: pair["match"])
    pairs = [F.split(text, pattern, -1).alias("gap"), found.alias("match"), *([F.regexp_extract_all(text, p, F.lit(group)).alias("value")] if group else [])]
    sized = F.transform(F.filter(F.arrays_zip(*pairs), lambda x: x["match"].isNotNull()), lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("n"), F.when(counts(value(x)), F.sha2(value(x), 256)).alias("value")))

    def placed(m: Column) -> Column:
        ends = _before(F.transform(m, lambda x: x["gap"] + x["n"]), F.lit(0), lambda s, n: s + n)
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("stop"), x["value"].alias("value"))
        return F.filter(F.zip_with(m, ends, span), lambda s: s["value"].isNotNull())

    return F.when(text.rlike(pattern), _let(sized, placed)).otherwise(F.array().cast(SPAN))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that no base span overlaps: sorted together, the base spans that begin before end before, and those that
    begin later begin after. Spans that begin together: the base first, by its smaller kind."""
    least, most = F.lit(-1), F.lit(2**31 - 1)

    def judged(all_: Column) -> Column:
        ends = _before(F.transform(all_, lambda s: F.when(s["kind"] < OPAQUE_KIND, s["stop"]).otherwise(least)), least, lambda a, b: F.greatest(a, b))
        begins = F.reverse(_before(F.transform(F.reverse(all_), lambda s: F.when(s["kind"] < OPAQUE_KIND, s["start"]).otherwise(most)), most, lambda a, b: F.least(a, b)))
        seen = F.arrays_zip(all_.alias("s"), ends.alias("end"), begins.alias("begin"))
        kept = F.filter(seen, lambda x: (x["s"]["kind"] == OPAQUE_KIND) & (x["end"] <= x["s"]["start"]) & (x["begin"] >= x["s"]["stop"]))
        return F.transform(kept, lambda x: x["s"])

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), _let(F.array_sort(F.concat(base, spans)), judged)).otherwise(spans)


def _join(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def candidates(docs: DataFrame, *, repo: Column | None = None, owner: Column | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each document: rid, own (its id, or with ``carry`` all its columns, as c0, c1, ...), repo, owner, base,
    more. Written once to the shared folder, so the row numbers stay."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    repo = source if repo is None else repo
    owner = F.split(repo, "/")[0] if owner is None else owner
    own = docs.columns if carry else [id_col]
    kept = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)])
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    scanned = docs.select(kept.alias("own"), filled(repo).alias("repo"), filled(owner).alias("owner"), filled(F.col(f"`{text_col}`")).alias("text"))
    text = F.col("text")
    base = F.array_sort(F.concat(_spans(text, 0, ASSIGN, 2, lambda v: F.char_length(v) >= 8), _spans(text, 1, ACCESS), _spans(text, 2, HEX)))
    mixed = F.lit(r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])")
    words = _spans(text, OPAQUE_KIND, OPAQUE, 0, lambda w: F.regexp(w, mixed))
    scanned = scanned.withColumn("base", base).withColumn("words", words)
    scanned = scanned.select("own", "repo", "owner", "base", _apart(F.col("words"), F.col("base")).alias("more"), F.monotonically_increasing_id().alias("rid"))
    return docs.sparkSession.read.parquet(written(scanned, "secrets"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners, n_uses over the corpus, aggregated by distinct repositories and owners."""
    spans = found.select("repo", "owner", F.explode(F.concat("base", "more")).alias("s"))
    pairs = spans.groupBy(F.col("s.value").alias("value"), "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_uses"))


def judged(found: DataFrame, most_owners: int = MOST_OWNERS, salts: int = SALTS) -> DataFrame:
    """``found`` with live (the spans that look live), shared (those of them in several repositories) and example (the
    widely copied ones)."""
    told = ownership(found).where((F.col("n_owners") > most_owners) | (F.col("n_repos") > 1)).select("value", (F.col("n_owners") > most_owners).alias("wide"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    some = F.size("base") + F.size("more") > 0
    spans = found.where(some).select("rid", F.explode(F.concat("base", "more")).alias("s")).select("rid", "s", F.col("s.value").alias("value"), F.pmod("rid", F.lit(salts)).cast("int").alias("salt"))
    marked = spans.join(told, ["value", "salt"], "left")
    wide = F.coalesce("wide", F.lit(False))
    spans_of = lambda which: F.collect_list(F.when(which, F.col("s")))  # of one document
    lists = marked.groupBy("rid").agg(spans_of(~wide).alias("live"), spans_of(~F.col("wide")).alias("shared"), spans_of(wide).alias("example"))
    none = F.array().cast(SPAN)
    return found.where(some).join(lists, "rid").unionByName(found.where(~some).withColumns({"live": none, "shared": none, "example": none}))


def scan(docs: DataFrame, *, most_owners: int = MOST_OWNERS, id_col: str = "doc_id", **how) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, n_example (base spans that are widely copied)."""
    rows = judged(candidates(docs, id_col=id_col, **how), most_owners)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    extra = F.filter("live", lambda s: s["kind"] == 3)
    return rows.select(
        F.col("own.c0").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(F.concat("base", extra)).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("shared").cast("long").alias("n_shared"), F.size(F.filter("example", lambda s: s["kind"] < 3)).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, *, most_owners: int = MOST_OWNERS, text_col: str = "text", mask: str = "[SECRET]", **how) -> DataFrame:
    """The documents with each span that looks live replaced by ``mask``; overlapping spans become one mask. All rows and
    columns stay; texts without such spans are unchanged."""
    rows = judged(candidates(docs, text_col=text_col, carry=True, **how), most_owners)
    text = F.col(f"own.c{docs.columns.index(text_col)}")


    def gaps(live: Column) -> Column:
        """(from, to) of what lies before each span that does not overlap those before it, and after the last."""
        ends = _let(F.transform(live, lambda s: s["stop"]), lambda stops: F.array_append(_before(stops, F.lit(0), lambda a, b: F.greatest(a, b)), F.array_max(stops)))
        begins = F.array_append(F.transform(live, lambda s: s["start"]), F.char_length(text))
        both = F.zip_with(ends, begins, lambda a, b: F.struct(a.alias("from"), b.alias("to")))
        return F.filter(both, lambda g: g["to"] >= g["from"])

    def cut(parts: Column) -> Column:
        # some gaps at a time from a piece of the text: finding a place in a text takes time in proportion to it
        some = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(CHUNK)), lambda at: F.slice(parts, at, F.lit(CHUNK)))
        piece = lambda g: F.substring(text, g[0]["from"] + 1, F.element_at(g, -1)["to"] - g[0]["from"])
        joined = F.transform(some, lambda g: _let(piece(g), lambda t: F.array_join(F.transform(g, lambda x: F.substring(t, x["from"] - g[0]["from"] + 1, x["to"] - x["from"])), mask)))
        return F.array_join(joined, mask)

    masked = _let(gaps(F.array_sort("live")), cut)
    return rows.select([(F.when(F.size("live") > 0, masked).otherwise(text) if c == text_col else F.col(f"own.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def _sql_spans(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', {group})"
    return f"""select rid, {kind} as k, '{name}' as kind, unnest(range(1, len(m) + 1)) as i, g, m, v from (select rid,
        string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}') as m, {value} as v from d where regexp_matches(t, '{p}'))""", least


def _oracle() -> str:
    parts = []
    for kind, (name, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
        rows, least = _sql_spans(kind, name, pattern, group, least)
        parts.append(f"select rid, k, kind, len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i-1], '')) as s, len(m[i]) as n, v[i] as v from ({rows}) where len(v[i]) >= {least}")
    return f"""
    with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
    base as ({" union all ".join(parts)}),
    owned as (select v, count(distinct coalesce(split_part(source, '/', 1), '')) as owners, count(distinct coalesce(source, '')) as repos from base join d using (rid) group by v),
    agg as (select rid, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
      string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, k) as spans,
      count(*) filter (owners <= {MOST_OWNERS}) as n_live, count(*) filter (owners <= {MOST_OWNERS} and repos > 1) as n_shared, count(*) filter (owners > {MOST_OWNERS}) as n_example
      from base join owned using (v) group by rid)
    select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
      sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_shared, 0)::bigint as n_shared, coalesce(n_example, 0)::bigint as n_example
    from d left join agg using (rid)"""


#: For tables without opaque words beyond the base spans.
ORACLE_SQL = _oracle()
