"""Queries over the star schema and the text tables: lookups, statistics on measures, sets, top-k, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, intervals, sampling, stats, vectors
from ..sources.tables import CatalogQuery
from .registry import query, table

R = lambda c, name: F.round(c, 6).alias(name)


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where (l_returnflag <> 'R' or l_quantity >= 10) and (l_returnflag <> 'A' or l_quantity <= 30) and l_discount between 0.02 and 0.08")
def staged_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").where(((flag != "R") | (q >= 10)) & ((flag != "A") | (q <= 30)) & F.col("l_discount").between(0.02, 0.08)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, o_totalprice from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus is distinct from 'F' and o_totalprice > 1000")
def catalog_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chained predicate query over a catalog."""
    q = CatalogQuery(table(spark, sf_dir, "orders")).where("o_orderpriority in ['1-URGENT', '2-HIGH'] and o_orderstatus != 'F'").where("o_totalprice > @least", least=1000)
    return q.load(columns=["o_orderkey", "o_totalprice"])


@query("select o_orderkey, c_name, c_mktsegment from orders left join (select * from (select *, row_number() over (partition by c_custkey order by c_name) as n from customer) where n = 1) c on o_custkey = c_custkey")
def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return intervals.bucketed_lookup(table(spark, sf_dir, "orders"), dim, ["o_custkey"], [F.col("c_name")]).select("o_orderkey", "c_name", "c_mktsegment")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def missing_keys_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order that is done: some lack one."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def synchronised_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return table(spark, sf_dir, "orders").join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("select d.doc_id, l.doc_id is not null as labelled from documents d left join labels l using (doc_id)")
def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled")).dropDuplicates(["doc_id"])
    return table(spark, sf_dir, "documents").select("doc_id").join(marks, "doc_id", "left").fillna(False)


@query("""select l_returnflag, count(*)::bigint as n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) as slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) as intercept, round(corr(ln(l_extendedprice), ln(l_quantity)), 6) as r from lineitem group by 1 having count(*) >= 10""")
def log_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.regressions(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.log("l_quantity"), F.log("l_extendedprice"))
    return out.select("l_returnflag", "n", *[R(F.col(c), c) for c in ("slope", "intercept", "r")])


@query("""select l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) as q1, round(median(l_quantity), 6) as med, round(quantile_cont(l_quantity, 0.75), 6) as q3, round(stddev_pop(l_quantity), 6) as sd from lineitem group by 1""")
def pooled_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(q.alias("q"), R(F.stddev_pop("l_quantity"), "sd")).select("l_returnflag", R(F.col("q")[0], "q1"), R(F.col("q")[1], "med"), R(F.col("q")[2], "q3"), "sd")


@query("""with e as (select quantile_cont(o_totalprice, [i / 8.0 for i in range(1, 8)]) as e from orders), b as (select len([x for x in e if x <= o_totalprice]) as bin, o_totalprice from orders, e)
select bin::int as bin, count(*)::bigint as n, round(median(o_totalprice), 4) as med from b group by 1""")
def quantile_bin_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quantile_bins(table(spark, sf_dir, "orders"), "o_totalprice", 8).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.median("o_totalprice"), 4).alias("med"))


@query("""with e as (select quantile_cont(l_quantity, 0.01) as lo, quantile_cont(l_quantity, 0.99) as hi from lineitem), b as (select least(greatest(floor((l_quantity - lo) / (hi - lo) * 20), 0), 19)::bigint as bin, l_extendedprice from lineitem, e)
select bin, count(*)::bigint as n, round(avg(l_extendedprice), 4) as mean from b group by 1 having count(*) >= 3""")
def binned_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.binned_means(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("""select least(floor((l_quantity - 1) / 49 * 10), 9)::bigint as bx, least(floor(l_discount / 0.1 * 10), 9)::bigint as by, count(*)::bigint as n from lineitem where l_quantity between 1 and 50 and l_discount between 0 and 0.1 group by all""")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (1.0, 50.0), (0.0, 0.1), 10)


@query("""select o_orderpriority, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as f, round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as o, round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as p from orders group by 1""")
def pivot_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return out.select("o_orderpriority", F.round("F", 2).alias("f"), F.round("O", 2).alias("o"), F.round("P", 2).alias("p"))


@query("""select s_suppkey, 'acctbal' as variable, s_acctbal as value from supplier union all select s_suppkey, 'nationkey', s_nationkey from supplier""")
def unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nationkey")).unpivot("s_suppkey", ["acctbal", "nationkey"], "variable", "value")


@query("select p_brand, count(*)::bigint as n from part where p_brand not in ('Brand#11') group by 1 order by 2 desc, 1 limit 10")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_labels(table(spark, sf_dir, "part"), "p_brand", 10, ["Brand#11"])


@query("select p_partkey from (select p_partkey from part order by p_retailprice desc, p_partkey limit 20) union select p_partkey from (select p_partkey from part order by p_size desc, p_partkey limit 20)")
def top_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return df.orderBy(F.desc("p_retailprice"), "p_partkey").limit(20).select("p_partkey").union(df.orderBy(F.desc("p_size"), "p_partkey").limit(20).select("p_partkey")).distinct()


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("select l_partkey from lineitem group by 1 having count(distinct l_returnflag) = 3")
def intersection_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n = 3").select("l_partkey")


@query("select p_type, p_partkey from (select *, row_number() over (partition by p_type order by md5('5:' || p_partkey), p_partkey) as place from part) order by place, p_type limit 300")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.spread(table(spark, sf_dir, "part"), "p_type", ["p_partkey"], 300, 5).select("p_type", "p_partkey")


@query("""with c as (select c_mktsegment, count(*) as cap from customer group by 1), s as (select c_mktsegment, unnest(range(1, least(cap, 100) + 1)) as seat from c), t as (select c_mktsegment, count(*) as take from (select * from s order by seat, c_mktsegment limit 100) group by 1)
select c_mktsegment, cap::bigint as cap, coalesce(take, 0)::bigint as take from c left join t using (c_mktsegment)""")
def water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("cap"))
    return sampling.water_fill(caps, "c_mktsegment", "cap", 100)


@query("""with n as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by all), e as (select a, b, n, sum(n) over (partition by a) * sum(n) over (partition by b) / sum(n) over () as e from n)
select round(sum((n - e) ** 2 / e), 6) as chi2, ((count(distinct a) - 1) * (count(distinct b) - 1))::bigint as df from e""")
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chi_square(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select(R(F.col("chi2"), "chi2"), "df")


@query("""with r as (select p_size, p_retailprice, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part)
select round(corr(a, b), 6) as rho, count(*)::bigint as n from r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(R(F.col("rho"), "rho"), "n")


@query("select c_nationkey, max(c_acctbal) as best, arg_min(c_name, (-c_acctbal, c_name)) as winner from customer group by 1")
def group_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties go to the smaller name."""
    first = F.min(F.struct((-F.col("c_acctbal")).alias("b"), "c_name"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), first["c_name"].alias("winner"))


@query("select conv_id, list(role order by turn) as role_list, first(text order by turn) as text_first, count(*)::bigint as n from conversations group by 1")
def conversation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(rows.alias("r"), F.count("*").alias("n")).select("conv_id", F.col("r.role").alias("role_list"), F.col("r")[0]["text"].alias("text_first"), "n")


@query("select page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') as host, nullif(regexp_extract(url, '([0-9]+)', 1), '')::bigint as number, string_split(url, '/')[-1] as leaf from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")).alias("host"), F.nullif(F.regexp_extract("url", "([0-9]+)", 1), F.lit("")).cast("long").alias("number"), F.element_at(F.split("url", "/"), -1).alias("leaf"))


@query("select s_suppkey, case when p < 1000 then '<1k' when p < 5000 then '1-5k' when p < 10000 then '5-10k' end as bin from (select s_suppkey, case when s_acctbal >= 0 then s_acctbal end as p from supplier)")
def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(p < 1000, "<1k").when(p < 5000, "1-5k").when(p < 10000, "5-10k").alias("bin"))
