"""Mixing sources to target weights by hierarchical budgeting (operator 10). DataFrame functions only.

The tree is domain, language, source. A token budget goes down it: a node's children share its budget by weight, none
gets more than its subtree can give (its tokens times ``max_epochs``), and what a child can't use goes to its siblings;
only what a whole subtree can't use goes to the siblings of its root, and so on up. With children in the order of
capacity over weight, the water level is the greatest (budget - capacities before) / (weights from here on), so a level
of the tree is two windows over its nodes. What a weight of 0 shuts out at any level can give nothing, so it counts in no
node's capacity (it does count in the total that the budget is a share of).

A leaf of T tokens and budget b gives every document floor(b / T) times (whole epochs) and, of the next epoch's seeded
order, the longest prefix of documents whose tokens fit in the rest. The order is that of md5(seed:epoch:doc_id).

Scale: all windows over nodes see one row for each leaf or for each of a leaf's ``4096`` parts. Prefixes are sums over
these parts (by the first three digits of the order key); only the one part of a leaf where the budget ends is sorted,
so a source with a third of all rows is never in one task. What documents learn of their leaf is broadcast if there are
``FEW_LEAVES`` leaves at most, and else joined with a salt. Tokens are whole words, counted once and written, and so are
the leaves' totals.

Defined results: null and empty texts have no tokens; a null domain, language or source is the name ''; names without a
weight have weight 1, weight 0 gives nothing; repeated rows are rows of their own; ties in the order (one doc_id twice)
go by tokens; no documents or no budget: nothing is selected; extra columns of any name are ignored or, in ``select``,
kept (a document's own columns are carried in one struct, by place).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


#: Leaves (one row each: three names and two numbers) that are broadcast; with more, rows are salted and joined.
FEW_LEAVES, SALTS = 20_000, 64


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    """The weight of a name of this level, 1 for names without one: a map that is folded into one constant."""
    if not weights:
        return F.lit(1).cast("long")
    names = sorted(weights)
    table = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(int(weights[n])).cast("long") for n in names]))
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1).cast("long"))


def _of_leaf(rows: DataFrame, leaves: DataFrame, few: bool, how: str) -> DataFrame:
    """``rows`` joined with what their leaf has."""
    if few:
        return rows.join(F.broadcast(leaves), list(LEVELS), how)
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*LEVELS, "salt"], how).drop("salt")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """``leaves``: domain, lang, source, tokens. Adds budget (whole tokens); leaves that a weight of 0 shuts out have no row."""
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(share)).cast("double").alias("budget"))
    shut = F.lit(False)
    for level in LEVELS:
        shut = shut | (_weight(level, weights.get(level, {})) <= 0)
    nodes = leaves.where(~shut).withColumn("cap", F.col("tokens") * max_epochs).crossJoin(total)  # one row on the right
    for depth, level in enumerate(LEVELS):
        path, up = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        level_nodes = nodes.groupBy(*path).agg(F.sum("cap").alias("c"), F.first("budget").alias("b")).withColumn("w", _weight(level, weights.get(level, {})))
        by = [F.col("c") / F.col("w"), F.col(level)]
        inside = Window.partitionBy(*up, F.lit(0)) if up else Window.partitionBy(F.lit(0))
        before = inside.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        rest = F.sum("w").over(inside) - F.coalesce(F.sum("w").over(before), F.lit(0))
        stepped = level_nodes.withColumn("level_at", (F.col("b") - F.coalesce(F.sum("c").over(before), F.lit(0)).cast("double")) / rest.cast("double"))
        got = stepped.withColumn("top", F.max("level_at").over(inside)).select(*path, F.least(F.col("c").cast("double"), F.col("w").cast("double") * F.col("top")).alias("budget"))
        nodes = nodes.drop("budget").join(got, path)
    return nodes.select(*LEVELS, "tokens", F.greatest(F.floor("budget"), F.lit(0)).cast("long").alias("budget"))


def copies(docs: DataFrame, *, domain: Column, lang: Column | None = None, source: Column | None = None, weights: Mapping[str, Mapping[str, int]], share: float = 0.5, max_epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, few_leaves: int = FEW_LEAVES) -> DataFrame:
    """How often each document is taken: own (its id, or with ``carry`` all its columns, as c0, c1, ...), domain, lang,
    source, n_tokens, copies (0: not taken)."""
    spark, names = docs.sparkSession, docs.columns if carry else [id_col]
    keys = {"domain": domain, "lang": F.col("lang") if lang is None else lang, "source": F.col("source") if source is None else source}
    tokens = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    counted = docs.select(own.alias("own"), *[F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in keys.items()], tokens.alias("n_tokens"))
    counted = spark.read.parquet(written(counted, "mixing"))
    totals = spark.read.parquet(written(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "totals"))  # one row for each leaf
    leaves = leaf_budgets(totals, weights, share, max_epochs)
    leaves = leaves.select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("left"))
    leaves = spark.read.parquet(written(leaves, "leaves"))
    few = leaves.count() <= few_leaves
    at = F.col(f"own.c{names.index(id_col)}")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(at.cast("string"), F.lit("null"))))
    placed = _of_leaf(counted, leaves, few, "inner").withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    parts = placed.groupBy(*LEVELS, "left", "part").agg(F.sum("n_tokens").alias("t"))
    so_far = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = parts.withColumn("end", F.sum("t").over(so_far)).where(F.col("end") > F.col("left"))
    edge = ends.groupBy(*LEVELS).agg(F.min_by(F.struct("part", (F.col("end") - F.col("t")).alias("start")), "part").alias("edge"))
    placed = _of_leaf(placed, edge, few, "left")
    sure = F.col("edge").isNull() | (F.col("part") < F.col("edge.part"))
    at_edge = F.col("edge").isNotNull() & (F.col("part") == F.col("edge.part"))
    inside = Window.partitionBy(*LEVELS).orderBy("key", at, "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = placed.where(at_edge).withColumn("more", F.col("edge.start") + F.sum("n_tokens").over(inside) <= F.col("left"))
    rest = placed.where(~at_edge).withColumn("more", sure)
    # a leaf of no budget gives nothing, not even documents without tokens
    more = F.col("more") & (F.col("left") > 0)
    out = rest.unionByName(border).withColumn("copies", F.col("whole") + more.cast("long"))
    return out.select("own", *LEVELS, "n_tokens", "copies")


def select(docs: DataFrame, **how) -> DataFrame:
    """The mixture: each taken document as often as it is taken, with the columns of ``docs``."""
    taken = copies(docs, carry=True, **how).where("copies > 0")
    each = taken.select("own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))
    return each.select([F.col(f"own.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def mixture(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """id, domain, lang, source, n_tokens, copies of the taken documents."""
    return copies(docs, id_col=id_col, **how).where("copies > 0").select(F.col("own.c0").alias(id_col), *LEVELS, "n_tokens", "copies")


def oracle_sql(domain: str, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int, seed: int) -> str:
    """DuckDB SQL for :func:`mixture` over the table documents. Budgets by the definition: at each level what is left is
    poured by weight over the children that still take some, those that would overflow are filled, and again until none does."""
    weight = lambda level: " ".join(["case", *(f"when {level} = '{n}' then {w}" for n, w in sorted(weights.get(level, {}).items())), "else 1 end"]) if weights.get(level) else "1"
    open_ = " and ".join(f"{weight(level)} > 0" for level in LEVELS)
    ctes, up, budget = [f"open as (select * from leaves where {open_})"], "", f"(select floor(sum(tokens) * {share!r}::double)::double from leaves)"
    for depth, level in enumerate(LEVELS):
        path = ", ".join(LEVELS[: depth + 1])
        start = f"select {path}, sum(tokens * {max_epochs})::double as c, {weight(level)}::double as w, {budget if not depth else 'any_value(p.budget)'} as b, null::double as got, 0 as step from open" + (f" join level{depth - 1} p using ({up})" if depth else "") + f" group by {path}"
        over = f"over (partition by {up})" if up else "over ()"
        poured = f"select *, w * ((b - coalesce(sum(got) {over}, 0)) / sum(w) filter (got is null) {over}) as part from pour{depth}"
        filled = f"select *, got is null and part >= c as brim, max((got is null and part >= c)::int) {over} as moves from ({poured})"
        ctes.append(f"pour{depth} as ({start} union all select {path}, c, w, b, case when brim then c else got end, step + 1 from ({filled}) where moves = 1)")
        last = f"select * from (select *, max(step) {over} as last from pour{depth}) where step = last"
        ctes.append(f"level{depth} as (select {path}, coalesce(got, w * ((b - coalesce(sum(got) {over}, 0)) / sum(w) filter (got is null) {over})) as budget from ({last}))")
        up = path
    names = ", ".join(LEVELS)
    return f"""
    with recursive docs as (select doc_id, coalesce({domain}, '') as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from documents),
    leaves as (select {names}, sum(n_tokens) as tokens from docs group by all), {", ".join(ctes)},
    cuts as (select {names}, (greatest(floor(budget), 0)::bigint // tokens)::bigint as whole, (greatest(floor(budget), 0)::bigint % tokens)::bigint as rest from leaves join level2 using ({names}) where tokens > 0),
    ordered as (select *, sum(n_tokens) over (partition by {names} order by md5(concat_ws(':', '{seed}', whole, coalesce(doc_id::varchar, 'null'))), doc_id, n_tokens rows unbounded preceding) as so_far from docs join cuts using ({names}))
    select doc_id, {names}, n_tokens::bigint as n_tokens, (whole + (rest > 0 and so_far <= rest)::int)::bigint as copies from ordered where whole + (rest > 0 and so_far <= rest)::int > 0"""
