"""Statistics over lineitem, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.operators import stats as S

from .registry import query, table

R = lambda df, digits=6: df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def items(spark, d):
    return table(spark, d, "lineitem")


@query("""select l_returnflag, count(*) as n, round(avg(l_extendedprice), 4) as mean, round(var_pop(l_extendedprice), 2) as variance, round(stddev_pop(l_extendedprice), 4) as sd, round(var_samp(l_extendedprice), 2) as sample_variance,
 min(l_extendedprice) as min, max(l_extendedprice) as max, round(quantile_cont(l_extendedprice, 0.25), 4) as q1, round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.75), 4) as q3,
 round(skewness(l_extendedprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 6) as skewness, round(kurtosis_pop(l_extendedprice), 6) as kurtosis from lineitem group by 1""")
def describe_prices(spark, d):
    x = S.describe(items(spark, d), "l_extendedprice", ["l_returnflag"])
    digits = {"variance": 2, "sample_variance": 2, "skewness": 6, "kurtosis": 6}
    return x.select("l_returnflag", "n", *[F.round(c, digits.get(c, 4)).alias(c) for c in x.columns[2:] if c not in ("min", "max")], "min", "max")


@query("""with m as (select l_shipdate, l_suppkey, l_quantity, quantile_cont(l_quantity, 0.5) over (partition by l_suppkey) as mid from lineitem)
 select l_suppkey, round(quantile_cont(abs(l_quantity - mid), 0.5), 6) as mad, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) as iqr from m group by 1""")
def median_absolute_deviation(spark, d):
    return R(S.mad(items(spark, d), "l_quantity", ["l_suppkey"]))


@query("""select c_custkey, rank() over w as rank_min, rank() over w + count(*) over (partition by c_nationkey, round(c_acctbal / 100)) - 1 as rank_max,
 rank() over w + (count(*) over (partition by c_nationkey, round(c_acctbal / 100)) - 1) / 2 as rank_average, dense_rank() over w as rank_dense, row_number() over (partition by c_nationkey order by round(c_acctbal / 100), c_custkey) as rank_ordinal
 from customer window w as (partition by c_nationkey order by round(c_acctbal / 100))""")
def rank_methods(spark, d):
    x = table(spark, d, "customer").withColumn("v", F.round(F.col("c_acctbal") / 100))
    return S.ranks(x, "v", ["c_nationkey"], "c_custkey").select("c_custkey", *[f"rank_{k}" for k in ("min", "max", "average", "dense", "ordinal")])


@query("select l_suppkey, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r, round(covar_samp(l_quantity, l_extendedprice), 4) as covariance from lineitem group by 1")
def pearson_correlation(spark, d):
    x = S.pearson(items(spark, d), "l_quantity", "l_extendedprice", ["l_suppkey"])
    return x.select("l_suppkey", "n", F.round("r", 6).alias("r"), F.round("covariance", 4).alias("covariance"))


@query("""with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as x,
 rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2 as y from lineitem) select l_returnflag, count(*) as n, round(corr(x, y), 6) as r from r group by 1""")
def spearman_correlation(spark, d):
    return R(S.spearman(items(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("covariance"))


@query("select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")
def linear_regression(spark, d):
    x = S.linear_fit(items(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return x.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""with p as (select o_orderkey, o_orderpriority, (o_orderkey * 7919 % 9973 + 1) / 10000.0 as p from orders), i as (select *, count(*) over (partition by o_orderpriority) as n, row_number() over (partition by o_orderpriority order by p) as i from p),
 j as (select *, least(1.0, p * n) as bonferroni, least(1.0, min(p * n / i) over (partition by o_orderpriority order by p desc, i desc rows unbounded preceding)) as bh, least(1.0, max(p * (n - i + 1)) over (partition by o_orderpriority order by p, i rows unbounded preceding)) as holm from i)
 select o_orderkey, round(bonferroni, 6) as bonferroni, round(min(bh) over (partition by o_orderpriority, p), 6) as bh, round(max(holm) over (partition by o_orderpriority, p), 6) as holm from j""")
def adjusted_p_values(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", ((F.col("o_orderkey") * 7919 % 9973 + 1) / F.lit(10000.0)).alias("p"))
    return R(S.adjust(x, "p", ["o_orderpriority"]).select("o_orderkey", "bonferroni", "bh", "holm"))


PAIR = "x as (select l_suppkey, l_linenumber % 2 as g, l_extendedprice as v from lineitem)"


def pair(spark, d):
    return items(spark, d).select("l_suppkey", (F.col("l_linenumber") % 2).alias("g"), F.col("l_extendedprice").alias("v"))


@query(f"""with {PAIR}, a as (select l_suppkey, count(*) filter (g = 0) as n0, count(*) filter (g = 1) as n1, avg(v) filter (g = 0) - avg(v) filter (g = 1) as gap, var_samp(v) filter (g = 0) as v0, var_samp(v) filter (g = 1) as v1 from x group by 1),
 b as (select *, v0 / n0 + v1 / n1 as se, ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) as pv from a where n0 > 1 and n1 > 1)
 select l_suppkey, n0, n1, round(gap / sqrt(se), 6) as welch_t, round(se ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)), 4) as welch_df, round(gap / sqrt(pv * (1 / n0 + 1 / n1)), 6) as pooled_t,
 round(gap / sqrt(pv), 6) as cohen_d, round(gap / sqrt(pv) * (1 - 3 / (4 * (n0 + n1) - 9)), 6) as hedges_g from b""")
def two_sample_tests(spark, d):
    x = S.two_samples(pair(spark, d), "v", "g", ["l_suppkey"])
    return R(x.withColumn("welch_df", F.round("welch_df", 4)))


@query("""with c as (select l_shipmode, l_returnflag, count(*) as n, avg(l_extendedprice) as m, var_pop(l_extendedprice) * count(*) as within_ from (select l_linestatus as l_shipmode, l_returnflag, l_extendedprice from lineitem) group by 1, 2),
 g as (select *, sum(n * m) over (partition by l_shipmode) / sum(n) over (partition by l_shipmode) as grand from c),
 t as (select l_shipmode, count(*) as k, sum(n) as n, sum(n * (m - grand) ** 2) as between_, sum(within_) as within_ from g group by 1)
 select l_shipmode as l_linestatus, k - 1 as df_between, cast(n - k as bigint) as df_within, round(between_ / (k - 1) / (within_ / (n - k)), 5) as f, round(between_ / (between_ + within_), 7) as eta2 from t where k > 1""")
def one_way_anova(spark, d):
    x = S.anova(items(spark, d), "l_extendedprice", "l_returnflag", ["l_linestatus"])
    return x.select("l_linestatus", "df_between", "df_within", F.round("f", 5).alias("f"), F.round("eta2", 7).alias("eta2"))


@query(f"""with {PAIR}, r as (select l_suppkey, g, rank() over (partition by l_suppkey order by v) + (count(*) over (partition by l_suppkey, v) - 1) / 2 as r from x),
 t as (select l_suppkey, count(*) filter (g = 0) as n0, count(*) filter (g = 1) as n1, sum(r) filter (g = 0) as r0 from r group by 1), u as (select *, r0 - n0 * (n0 + 1) / 2 as u from t where n0 > 0 and n1 > 0)
 select l_suppkey, n0, n1, least(u, n0 * n1 - u) as u, round((least(u, n0 * n1 - u) - n0 * n1 / 2) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12), 6) as z from u""")
def mann_whitney_u(spark, d):
    return R(S.mann_whitney(pair(spark, d), "v", "g", ["l_suppkey"]))


@query("""with r as (select l_suppkey, l_returnflag, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as r from lineitem),
 t as (select l_suppkey, l_returnflag, count(*) as n, sum(r) as r from r group by 1, 2), s as (select l_suppkey, count(*) as k, sum(n) as n, sum(r * r / n) as s from t group by 1)
 select l_suppkey, k - 1 as df, round(12 / (n * (n + 1)) * s - 3 * (n + 1), 5) as h from s""")
def kruskal_wallis(spark, d):
    return R(S.kruskal(items(spark, d), "l_quantity", "l_returnflag", ["l_suppkey"]), 5)


@query("""with o as (select l_returnflag, l_linenumber, count(*) as o from lineitem group by 1, 2), r as (select l_returnflag, count(*) as r from lineitem group by 1), c as (select l_linenumber, count(*) as c from lineitem group by 1), n as (select count(*) as n from lineitem),
 x as (select coalesce(o, 0) as o, r * c / n as e from r cross join c cross join n left join o using (l_returnflag, l_linenumber)), k as (select (select count(*) from r) as rows_, (select count(*) from c) as cols_)
 select round(sum((o - e) ** 2 / e), 6) as chi2, (select (rows_ - 1) * (cols_ - 1) from k) as df, round(sqrt(sum((o - e) ** 2 / e) / ((select n from n) * (select least(rows_, cols_) - 1 from k))), 6) as cramers_v from x""")
def chi_squared(spark, d):
    return R(S.contingency(items(spark, d), "l_returnflag", "l_linenumber"))


@query("""with t as (select l_suppkey, count(*) filter (a and b) :: double as p, count(*) filter (a and not b) :: double as q, count(*) filter (not a and b) :: double as r, count(*) filter (not a and not b) :: double as s
 from (select l_suppkey, l_quantity > 25 as a, l_discount > 0.05 as b from lineitem) group by 1)
 select l_suppkey, round(p * s / (q * r), 6) as odds_ratio, round((p / (p + q)) / (r / (r + s)), 6) as relative_risk, round((p * s - q * r) / sqrt((p + q) * (r + s) * (p + r) * (q + s)), 6) as phi from t""")
def odds_ratios(spark, d):
    return R(S.odds(items(spark, d), F.col("l_quantity") > 25, F.col("l_discount") > 0.05, ["l_suppkey"]))


@query("""select c_custkey, round((c_acctbal - avg(c_acctbal) over w) / stddev_pop(c_acctbal) over w, 6) as z, round((c_acctbal - min(c_acctbal) over w) / (max(c_acctbal) over w - min(c_acctbal) over w), 6) as min_max from customer window w as (partition by c_nationkey)""")
def z_score_normalise(spark, d):
    return R(S.z_scores(table(spark, d, "customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", "z", "min_max"))


@query("""with e as (select min(o_totalprice) as l, max(o_totalprice) as h from orders) select cast(least(19, floor((o_totalprice - l) / (h - l) * 20)) as int) as bin, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from orders, e group by 1""")
def price_histogram(spark, d):
    return S.histogram(table(spark, d, "orders"), "o_totalprice", 20)


EXPR = "x as (select p_brand as item, strftime(l_shipdate, '%Y-%m') as sample, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey group by 1, 2)"


def expression(spark, d):
    """Expression matrix: brands are genes, shipping months samples, summed quantity the value."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("item"))
    x = items(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("item", F.date_format("l_shipdate", "yyyy-MM").alias("sample")).agg(F.sum("l_quantity").alias("v"))


@query(f"with {EXPR} select a.item as item_a, b.item as item_b, count(*) as n, round(corr(a.v, b.v), 6) as r from x a join x b on a.sample = b.sample and a.item < b.item group by 1, 2")
def correlation_matrix(spark, d):
    return R(S.correlations(expression(spark, d), "item", "sample", "v").drop("covariance"))


@query(f"with {EXPR}, y as (select *, ascii(item[7:7]) + 10 as len from x) select item, sample, round(v / sum(v) over (partition by sample), 6) as share, round(v / sum(v) over (partition by sample) * 1e6, 3) as cpm, round((v / len) / sum(v / len) over (partition by sample) * 1e6, 3) as tpm from y")
def counts_per_million(spark, d):
    x = expression(spark, d).withColumn("len", F.ascii(F.substring("item", 7, 1)) + 10)
    x = S.normalise_counts(x, "sample", "item", "v", "len")
    return x.select("item", "sample", F.round("share", 6).alias("share"), F.round("cpm", 3).alias("cpm"), F.round("tpm", 3).alias("tpm"))


@query(f"with {EXPR}, g as (select item, avg(ln(v)) as g, count(*) as k from x where v > 0 group by 1), m as (select item, g from g where k = (select count(distinct sample) from x)) select sample, round(quantile_cont(exp(ln(v) - g), 0.5), 6) as size_factor from x join m using (item) group by 1")
def median_size_factors(spark, d):
    return R(S.size_factors(expression(spark, d), "sample", "item", "v"))


@query(f"with {EXPR}, r as (select *, row_number() over (partition by sample order by v, item) as r from x), m as (select r, avg(v) as m from r group by 1) select item, sample, round(m, 6) as normalised from r join m using (r)")
def quantile_normalisation(spark, d):
    return R(S.quantile_normalise(expression(spark, d), "sample", "item", "v").select("item", "sample", "normalised"))
