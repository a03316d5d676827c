"""Projections, filters, joins, aggregations, windows, sorts, set operations and generators, DataFrame first."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: A side is broadcast up to this many rows; beyond, Spark chooses by its own statistics.
BROADCAST_ROWS = 100_000


def query(sql: str | None) -> Callable[[Callable[[Callable[[str], DataFrame]], DataFrame]], Query]:
    """Registers a function of `table(name)` as a query, under its own name."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register


def small(df: DataFrame) -> DataFrame:
    """Marks a side for broadcasting if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@query("SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, l_returnflag AS flag FROM lineitem")
def project(t):
    return t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_returnflag").alias("flag"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus IN ('O', 'F')) OR NOT (o_orderpriority LIKE '%URGENT')")
def filter_boolean(t):
    keep = ((F.col("o_totalprice") > 100000) & F.col("o_orderstatus").isin("O", "F")) | ~F.col("o_orderpriority").like("%URGENT")
    return t("orders").where(keep).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'e') AND (starts_with(p_brand, 'Brand#1') OR ends_with(p_type, 'EL')) AND regexp_matches(p_type, '[A-Z]+')")
def filter_strings(t):
    c = F.col
    return t("part").where(c("p_name").contains("e") & (c("p_brand").startswith("Brand#1") | c("p_type").endswith("EL")) & c("p_type").rlike("[A-Z]+")).select("p_partkey")


@query("SELECT o_orderkey, nullif(o_custkey % 3, 0) AS x, coalesce(nullif(o_custkey % 3, 0), -1) AS y, (nullif(o_custkey % 3, 0) IS NULL) AS missing, (nullif(o_custkey % 3, 0) IS NOT DISTINCT FROM nullif(o_custkey % 2, 0)) AS same FROM orders")
def null_handling(t):
    x, y = F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.nullif(F.col("o_custkey") % 2, F.lit(0))
    return t("orders").select("o_orderkey", x.alias("x"), F.coalesce(x, F.lit(-1)).alias("y"), x.isNull().alias("missing"), x.eqNullSafe(y).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi FROM orders")
def conditionals(t):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    band = F.when(p > 200000, "high").when(p > 50000, "mid").otherwise("low")
    return t("orders").select("o_orderkey", band.alias("band"), F.when(s == "F", 1).when(s == "O", 2).otherwise(0).alias("code"), F.least("o_orderkey", "o_custkey").alias("lo"), F.greatest("o_orderkey", "o_custkey").alias("hi"))


@query("SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, xor(p_size, 5) AS x, ~p_size AS n, -p_size AS m, p_size % 7 AS r, p_size / 4 AS q FROM part")
def arithmetic(t):
    c = F.col("p_size")
    return t("part").select("p_partkey", c.bitwiseAND(6).alias("a"), c.bitwiseOR(8).alias("o"), c.bitwiseXOR(5).alias("x"), F.bitwise_not(c).alias("n"), (-c).alias("m"), (c % 7).alias("r"), (c / 4).alias("q"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, CAST(CAST(o_custkey AS VARCHAR) AS INTEGER) AS i, CAST(o_custkey AS DOUBLE) AS f FROM orders")
def casts(t):
    return t("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("s"), F.col("o_orderdate").cast("date").cast("string").alias("d"), F.col("o_custkey").cast("string").cast("int").alias("i"), F.col("o_custkey").cast("double").alias("f"))


@query("SELECT o_orderkey, x FROM (SELECT o_orderkey, nullif(o_custkey % 5, 0) AS x FROM orders) q WHERE x IS NOT NULL")
def na_drop(t):
    return t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("x")).dropna()


@query("SELECT o_orderkey, coalesce(nullif(o_custkey % 5, 0), 99) AS x, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE o_orderstatus END AS s FROM orders")
def na_fill_replace(t):
    filled = t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("x"), F.col("o_orderstatus").alias("s")).fillna(99, ["x"])
    return filled.replace({"F": "done"}, subset=["s"])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(t):
    return t("customer").join(small(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(small(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


def _hinted(name: str, hint: str) -> None:
    def run(t):
        orders = small(t("orders")) if hint == "broadcast" else t("orders").hint(hint)
        return t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = name
    query("SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")(run)


for _name, _hint in (("join_sort_merge", "merge"), ("join_shuffle_hash", "shuffle_hash"), ("join_broadcast_hash", "broadcast")):
    _hinted(_name, _hint)


def _outer(name: str, how: str, sql: str) -> None:
    def run(t):
        return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), how).select("c_custkey", "o_orderkey")

    run.__name__ = name
    query(f"SELECT c_custkey, o_orderkey FROM customer {sql} JOIN orders ON o_custkey = c_custkey")(run)


for _name, _how, _sql in (("join_left", "left", "LEFT"), ("join_right", "right", "RIGHT"), ("join_full", "full", "FULL")):
    _outer(_name, _how, _sql)


@query("SELECT n_name, c_custkey FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) c ON c_nationkey = n_nationkey")
def join_broadcast_outer(t):
    rich = t("customer").where("c_acctbal > 9900")
    return t("nation").join(small(rich), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_name", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def join_broadcast_semi(t):
    asia = t("nation").join(small(t("region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(small(asia), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("SELECT n_nationkey AS k, n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def join_using(t):
    suppliers = t("supplier").withColumnRenamed("s_nationkey", "k")
    return t("nation").withColumnRenamed("n_nationkey", "k").join(suppliers, "k").select("k", "n_name", "s_suppkey")


@query("SELECT r_name, n_name FROM region LEFT JOIN nation ON r_regionkey * 5 < n_nationkey")
def join_theta_outer(t):
    return t("region").join(small(t("nation")), F.col("r_regionkey") * 5 < F.col("n_nationkey"), "left").select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def join_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 150000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey % 25 < n_nationkey")
def join_theta(t):
    return t("supplier").join(small(t("nation")), F.col("s_suppkey") % 25 < F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE s_suppkey % 25 < n_nationkey - 10)")
def join_semi_theta(t):
    return t("supplier").join(small(t("nation")), F.col("s_suppkey") % 25 < F.col("n_nationkey") - 10, "left_semi").select("s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t("region").crossJoin(small(t("nation"))).select("r_name", "n_name")


@query("SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def join_self(t):
    a, b = t("orders").alias("a"), t("orders").alias("b")
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))).select(F.col("a.o_orderkey").alias("x"), F.col("b.o_orderkey").alias("y"))


@query("SELECT a.k, n * m AS n FROM (SELECT nullif(o_custkey % 4, 0) AS k, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT nullif(c_custkey % 4, 0) AS k, count(*) AS m FROM customer GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t):
    """How many pairs each key has: both sides are counted by key before they meet."""
    a = t("orders").groupBy(F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t("customer").groupBy(F.nullif(F.col("c_custkey") % 4, F.lit(0)).alias("j")).agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, a.k.eqNullSafe(b.j)).select("k", (F.col("n") * F.col("m")).alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS avg_price, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1, 2")
def aggregate_group(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
def aggregate_empty(t):
    return t("orders").where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders GROUP BY 1")
def aggregate_distinct(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.sum_distinct("o_custkey").alias("s"))


@query("SELECT l_returnflag, stddev_samp(l_quantity) AS sd, stddev_pop(l_quantity) AS sdp, var_samp(l_quantity) AS v, var_pop(l_quantity) AS vp, corr(l_quantity, l_extendedprice) AS r, covar_samp(l_quantity, l_extendedprice) AS cs FROM lineitem GROUP BY 1")
def aggregate_moments(t):
    q, p = "l_quantity", "l_extendedprice"
    return t("lineitem").groupBy("l_returnflag").agg(F.stddev_samp(q).alias("sd"), F.stddev_pop(q).alias("sdp"), F.var_samp(q).alias("v"), F.var_pop(q).alias("vp"), F.corr(q, p).alias("r"), F.covar_samp(q, p).alias("cs"))


@query("SELECT skewness_pop AS skewness, kurtosis FROM (SELECT avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skewness_pop, avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 AS kurtosis FROM (SELECT l_quantity AS x, avg(l_quantity) OVER () AS m FROM lineitem) q) z")
def aggregate_shape(t):
    return t("lineitem").agg(F.skewness("l_quantity").alias("skewness"), F.kurtosis("l_quantity").alias("kurtosis"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t("orders").select("o_orderstatus", "o_orderpriority").distinct()


def _grouping(name: str, how: str) -> None:
    def run(t):
        grouped = getattr(t("orders"), how)("o_orderstatus", "o_orderpriority")
        return grouped.agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderstatus").cast("long").alias("g1"), F.grouping("o_orderpriority").cast("long").alias("g2"))

    run.__name__ = f"aggregate_{name}"
    query(f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::BIGINT AS g1, grouping(o_orderpriority)::BIGINT AS g2 FROM orders GROUP BY {name.upper()} (o_orderstatus, o_orderpriority)")(run)


for _name in ("rollup", "cube"):
    _grouping(_name, _name)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def aggregate_grouping_sets(t):
    return t("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS \"F\", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS \"O\" FROM lineitem GROUP BY 1")
def pivot(t):
    return t("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') AS keys, len(list(DISTINCT c_mktsegment))::INTEGER AS segments FROM customer GROUP BY 1")
def aggregate_collect(t):
    return t("customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_custkey")), ",").alias("keys"), F.size(F.collect_set("c_mktsegment")).alias("segments"))


@query("SELECT o_orderstatus, c.x AS segment, count(*) AS n FROM orders JOIN (SELECT c_custkey AS k, c_mktsegment AS x FROM customer) c ON k = o_custkey GROUP BY 1, 2 HAVING count(*) > 5")
def aggregate_having(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderstatus", F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("SELECT round(covar_samp(l_quantity, l_discount), 8) AS cov, round(corr(l_quantity, l_discount), 8) AS corr FROM lineitem")
def stat_cov_corr(t):
    df = t("lineitem")
    return df.sparkSession.createDataFrame([(round(df.stat.cov("l_quantity", "l_discount"), 8), round(df.stat.corr("l_quantity", "l_discount"), 8))], "cov double, corr double")


@query("SELECT o_orderstatus AS o_orderstatus_band, count(*) FILTER (o_orderkey % 2 = 0) AS \"0\", count(*) FILTER (o_orderkey % 2 = 1) AS \"1\" FROM orders GROUP BY 1")
def stat_crosstab(t):
    return t("orders").select("o_orderstatus", (F.col("o_orderkey") % 2).alias("band")).stat.crosstab("o_orderstatus", "band")


RANKS = "rank() OVER w AS rank, dense_rank() OVER w AS dense, row_number() OVER u AS number, percent_rank() OVER w AS percent, cume_dist() OVER w AS cume, ntile(4) OVER u AS tile"


@query(f"SELECT o_orderkey, {RANKS} FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate), u AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)")
def window_ranking(t):
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderdate")
    u = Window.partitionBy("o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    made = {"rank": F.rank().over(w), "dense": F.dense_rank().over(w), "number": F.row_number().over(u), "percent": F.percent_rank().over(w), "cume": F.cume_dist().over(w), "tile": F.ntile(4).over(u)}
    return t("orders").select("o_orderkey", *(c.alias(n) for n, c in made.items()))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, 0) OVER w AS later, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_analytic(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, 0.0).over(w).alias("later"), F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(whole).alias("last"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after, sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)::BIGINT AS near FROM events")
def window_frames(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = Window.partitionBy("user_id").orderBy("event_id").rangeBetween(-500, 500)
    return t("events").select("event_id", F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("three"), F.max("event_id").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"), F.sum("event_id").over(r).alias("near"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("SELECT o_orderkey, k FROM (SELECT o_orderkey, nullif(o_custkey % 7, 0) AS k FROM orders) q ORDER BY k ASC NULLS FIRST, o_orderkey DESC")
def sort_global(t):
    return t("orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k")).orderBy(F.asc_nulls_first("k"), F.desc("o_orderkey"))


@query("SELECT o_custkey, o_orderkey FROM orders")
def repartition_sorted(t):
    return t("orders").select("o_custkey", "o_orderkey").repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def union_all(t):
    return t("customer").select(F.col("c_custkey").alias("k")).union(t("supplier").select("s_suppkey"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_custkey").alias("k")).union(t("supplier").select("s_suppkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_distinct(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def explode_array(t):
    return t("part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p_partkey, w AS word FROM part LEFT JOIN LATERAL (SELECT unnest(CASE WHEN p_size > 25 THEN string_split(p_name, ' ') END) AS w) ON true")
def explode_outer(t):
    return t("part").select("p_partkey", F.explode_outer(F.when(F.col("p_size") > 25, F.split("p_name", " "))).alias("word"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(t):
    return t("events").select("event_id", F.json_tuple("props", "k").alias("k"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
def map_groups(t):
    """Typed aggregation: each group in pandas."""
    def total(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_custkey": [group.o_custkey.iloc[0]], "s": [round(group.o_totalprice.sum(), 2)]})

    return t("orders").select("o_custkey", "o_totalprice").groupBy("o_custkey").applyInPandas(total, "o_custkey long, s double")


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS orders, coalesce(m, 0) AS customers FROM (SELECT o_custkey % 10 AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey % 13 AS k, count(*) AS m FROM customer GROUP BY 1) b ON a.k = b.k")
def cogroup(t):
    a = t("orders").select((F.col("o_custkey") % 10).alias("k")).groupBy("k").count()
    b = t("customer").select((F.col("c_custkey") % 13).alias("k")).groupBy("k").count()

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        k = (x if len(x) else y).k.iloc[0]
        return pd.DataFrame({"k": [k], "orders": [int(x["count"].sum())], "customers": [int(y["count"].sum())]})

    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "k long, orders long, customers long")


@query("SELECT o_orderkey, o_totalprice * 1.1 AS taxed FROM orders")
def udf_pandas(t):
    @F.pandas_udf("double")
    def taxed(x: pd.Series) -> pd.Series:
        return x * 1.1

    return t("orders").select("o_orderkey", taxed("o_totalprice").alias("taxed"))


@query("SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1")
def udaf_pandas(t):
    """A batch's sums first: a group's rows may be more than a task's memory, its partial sums are one for each of many rows."""

    def partial(batches):
        for x in batches:
            yield x.groupby("l_returnflag", dropna=False)["l_quantity"].agg(["sum", "count"]).reset_index()

    @F.pandas_udf("double")
    def mean(s: pd.Series, n: pd.Series) -> float | None:
        return float(s.sum() / n.sum()) if n.sum() else None

    sums = t("lineitem").select("l_returnflag", F.col("l_quantity").cast("double")).mapInPandas(partial, "l_returnflag string, sum double, count long")
    return sums.groupBy("l_returnflag").agg(mean("sum", "count").alias("m"))


@query("SELECT p_partkey, unnest(range(1, p_size % 4 + 1))::INTEGER AS n FROM part")
def udtf_python(t):
    from pyspark.sql.functions import udtf

    @udtf(returnType="n: int")
    class Count:
        def eval(self, n: int):
            for k in range(1, n + 1):
                yield (k,)

    part = t("part")
    part.sparkSession.udtf.register("tidelog_count", Count)
    part.createOrReplaceTempView("tidelog_part")
    return part.sparkSession.sql("SELECT p_partkey, c.n FROM tidelog_part, LATERAL tidelog_count(p_size % 4) c")


@query("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT c_name, s FROM big JOIN customer ON c_custkey = o_custkey WHERE s > (SELECT avg(s) FROM big)")
def common_table_expression(t):
    for name in ("orders", "customer"):
        t(name).createOrReplaceTempView(name)
    return t("orders").sparkSession.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT c_name, s FROM big JOIN customer ON c_custkey = o_custkey WHERE s > (SELECT avg(s) FROM big)")


@query(None)
def sample_rows(t):
    return t("orders").sample(0.1, 7).select("o_orderkey")


@query(None)
def sample_by_stratum(t):
    return t("orders").sampleBy("o_orderstatus", {"F": 0.2, "O": 0.1}, 7).select("o_orderkey", "o_orderstatus")


@query(None)
def frequent_items(t):
    return t("orders").stat.freqItems(["o_orderstatus"], 0.3)


@query(None)
def approximate_distinct(t):
    return t("orders").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@query("SELECT l_returnflag, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS stddev, var_samp(l_quantity) AS variance, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1")
def aggregate_aliases(t):
    """mean, stddev and variance, and first and last of rows in order."""
    q = F.col("l_quantity")
    ordered = F.array_sort(F.collect_set("l_shipdate"))
    rows = t("lineitem").groupBy("l_returnflag").agg(F.mean(q).alias("mean"), F.stddev(q).alias("stddev"), F.variance(q).alias("variance"), ordered.alias("days"))
    days = rows.select("l_returnflag", "mean", "stddev", "variance", F.explode("days").alias("day"))
    w = Window.partitionBy("l_returnflag").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = days.withColumns({"f": F.first_value("day").over(w), "l": F.last_value("day").over(w)})
    return marked.groupBy("l_returnflag").agg(F.first("mean").alias("mean"), F.first("stddev").alias("stddev"), F.first("variance").alias("variance"), F.first("f").alias("first"), F.last("l").alias("last"))


@query("SELECT o_orderkey, sum(o_totalprice) OVER w AS total, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_named(t):
    t("orders").createOrReplaceTempView("tidelog_orders")
    return t("orders").sparkSession.sql("SELECT o_orderkey, sum(o_totalprice) OVER w AS total, first_value(o_orderkey) OVER w AS first FROM tidelog_orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@query("SELECT l_orderkey, l_linenumber, (l_quantity::DECIMAL(12, 2) * l_discount::DECIMAL(6, 4))::DECIMAL(18, 6) AS product, (l_extendedprice::DECIMAL(12, 2) + 1)::DECIMAL(14, 2) AS next FROM lineitem")
def decimals(t):
    product = F.col("l_quantity").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(6,4)")
    return t("lineitem").select("l_orderkey", "l_linenumber", product.cast("decimal(18,6)").alias("product"), (F.col("l_extendedprice").cast("decimal(12,2)") + 1).cast("decimal(14,2)").alias("next"))


@query("SELECT l_returnflag, sum(l_extendedprice::DECIMAL(12, 2))::DECIMAL(22, 2) AS total, count(CASE WHEN abs(l_extendedprice) >= 1000 THEN 1 END) AS too_wide FROM lineitem GROUP BY 1")
def decimal_overflow(t):
    """What doesn't fit a decimal becomes null where that is asked for."""
    narrow = F.expr("try_cast(l_extendedprice AS decimal(5,2))")
    return t("lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"), F.count(F.when(narrow.isNull(), 1)).alias("too_wide"))


@query("SELECT p_partkey, unnest(['size', 'price']) AS k, unnest([p_size::DOUBLE, p_retailprice::DOUBLE]) AS v FROM part")
def explode_map(t):
    pairs = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice").cast("double"))
    return t("part").select("p_partkey", F.explode(pairs).alias("k", "v"))


@query("SELECT p_partkey, unnest(range(1, p_size % 3 + 1))::INTEGER AS n FROM part UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 0")
def explode_outer(t):
    numbers = F.when(F.col("p_size") % 3 > 0, F.sequence(F.lit(1), (F.col("p_size") % 3).cast("int")))
    return t("part").select("p_partkey", F.explode_outer(numbers).alias("n"))


@query("SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def script_transform(t):
    """Rows through a program of the operating system."""
    t("nation").createOrReplaceTempView("tidelog_nation")
    return t("nation").sparkSession.sql("SELECT TRANSFORM(n_nationkey, n_name) USING 'cat' AS (k STRING, v STRING) FROM tidelog_nation")


@query("SELECT count(*) AS n, true AS disjoint FROM orders")
def random_split(t):
    parts = t("orders").select("o_orderkey").randomSplit([0.6, 0.3, 0.1], 7)
    whole = parts[0].union(parts[1]).union(parts[2])
    return whole.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == F.count_distinct("o_orderkey")).alias("disjoint"))


@query("SELECT true AS repeats, true AS known")
def sample_with_replacement(t):
    keys = t("orders").select("o_orderkey")
    drawn = keys.sample(True, 1.5, 7).groupBy("o_orderkey").count()
    return drawn.join(keys, "o_orderkey", "left").agg((F.max("count") > 1).alias("repeats"), (F.count("o_orderkey") > 0).alias("known"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1 HAVING count(*) % 2 >= 0")
def udf_python(t):
    """A plain function in SELECT's WHERE and HAVING, by name, with nulls handled by itself."""
    spark = t("orders").sparkSession
    spark.udf.register("tidelog_rest", lambda x, n: None if x is None else x % n, "long")
    t("orders").createOrReplaceTempView("tidelog_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM tidelog_orders WHERE tidelog_rest(o_orderkey, 3) = 1 GROUP BY 1 HAVING tidelog_rest(count(*), 2) >= 0")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 1 THEN 2 * o_custkey END AS twice FROM orders")
def udf_null_arguments(t):
    twice = F.udf(lambda x: None if x is None else 2 * x, "long")
    return t("orders").select("o_orderkey", twice(F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey"))).alias("twice"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name FROM nation")
def zip_with_index(t):
    """Numbers rows in order without one task for all: counts of the sorted partitions, then places inside them."""
    placed = t("nation").orderBy("n_nationkey").select("n_name", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    before = placed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    starts = before.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(starts.select("p", "first", "start")), "p").select((F.col("m") - F.col("first") + F.col("start")).alias("i"), "n_name")


@query("SELECT floor(l_quantity / 10)::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(t):
    return t("lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(l_quantity) AS n, sum(l_quantity)::DOUBLE AS total, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd FROM lineitem")
def double_stats(t):
    q = F.col("l_quantity").cast("double")
    return t("lineitem").agg(F.count(q).alias("n"), F.sum(q).alias("total"), F.avg(q).alias("mean"), F.stddev_pop(q).alias("sd"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def subtract_by_key(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 GROUP BY 1")
def filter_by_range(t):
    """Rows are range-partitioned and sorted; a range is then read from few partitions."""
    ranged = t("orders").repartitionByRange("o_totalprice").sortWithinPartitions("o_totalprice")
    return ranged.where(F.col("o_totalprice").between(100000, 200000)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS name, n_regionkey + 1 AS region FROM nation")
def frame_over_rdd(t):
    """A DataFrame over an RDD of tuples."""
    rows = t("nation").select("n_name", "n_regionkey").rdd.map(lambda r: (r[0], r[1] + 1))
    return t("nation").sparkSession.createDataFrame(rows, "name string, region long").select("name", "region")
