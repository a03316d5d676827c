"""SQL statements and the catalogue: tables, views, caching, settings and functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.formats import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[SparkSession, str, str], DataFrame]], None]:
    """Registers a function of the session, a path to tables and an unused name as query sql_<its name>."""

    def register(f: Callable[[SparkSession, str, str], DataFrame]) -> None:
        name = f"sql_{f.__name__}"
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, f"tidelog_{uuid.uuid4().hex[:12]}")
        SQL[name] = sql

    return register


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def cache_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sql(f"CREATE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{sf_dir}/nation.parquet')")
    spark.sql(f"CACHE LAZY TABLE {name}_kept AS SELECT n_regionkey FROM {name}")
    rows = spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {name}_kept GROUP BY 1")
    counted = spark.createDataFrame(rows.collect(), rows.schema)
    spark.sql(f"UNCACHE TABLE {name}_kept")
    return counted


@query("SELECT 'spark.sql.shuffle.partitions' AS key, '7' AS value")
def set_option(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    other = spark.newSession()
    other.sql("SET spark.sql.shuffle.partitions = 7")
    return spark.createDataFrame([tuple(r) for r in other.sql("SET spark.sql.shuffle.partitions").collect()], "key string, value string")


@query("SELECT 1 AS views, 'upper' AS function, true AS described")
def show_and_describe(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sql(f"CREATE TEMPORARY VIEW {name} AS SELECT 1 AS one")
    views = spark.sql(f"SHOW TABLES LIKE '{name}'").count()
    shown = spark.sql("SHOW FUNCTIONS LIKE 'upper'").first()[0]
    described = spark.sql("DESCRIBE FUNCTION upper").count() > 0 and spark.sql(f"DESCRIBE TABLE {name}").first()[0] == "one"
    spark.sql(f"DROP VIEW {name}")
    return spark.createDataFrame([(views, shown, described)], "views int, function string, described boolean")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def create_table_as(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """CREATE TABLE USING ... AS, REFRESH, DESCRIBE and the rows of the table."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView(f"{name}_source")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{scratch(spark)}' AS SELECT o_orderkey, o_totalprice FROM {name}_source WHERE o_orderstatus = 'F'")
    spark.sql(f"REFRESH TABLE {name}")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    rows = spark.table(name)
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(rows.schema).parquet(path)


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def insert_into(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """saveAsTable with partitions, insertInto, and INSERT INTO of what is left."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    path = scratch(spark)
    orders.where("o_orderstatus = 'F'").write.mode("overwrite").option("path", path).partitionBy("o_orderstatus").saveAsTable(name)
    orders.where("o_orderstatus = 'O'").write.insertInto(name)
    orders.where("o_orderstatus NOT IN ('F', 'O')").createOrReplaceTempView(f"{name}_rest")
    spark.sql(f"INSERT INTO {name} SELECT o_orderkey, o_orderstatus FROM {name}_rest")
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(path).select("o_orderstatus", "o_orderkey")


@query("SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'F', 0")
def overwrite_partition(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Dynamic overwriting replaces only the partitions that come."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    path = scratch(spark)
    orders.write.partitionBy("o_orderstatus").parquet(path)
    one = spark.createDataFrame([(0, "F")], "o_orderkey long, o_orderstatus string")
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).select("o_orderstatus", "o_orderkey")


@query("SELECT 'old' AS ignored, 'new' AS overwritten, 2::BIGINT AS appended, true AS refused")
def write_modes(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    old, new = (spark.createDataFrame([(w,)], "w string").coalesce(1) for w in ("old", "new"))
    paths = {m: scratch(spark) for m in ("ignore", "overwrite", "append", "errorifexists")}
    refused = False
    for mode, path in paths.items():
        old.write.parquet(path)
        try:
            new.write.mode(mode).parquet(path)
        except Exception as error:  # noqa: BLE001
            if mode != "errorifexists" or "exist" not in str(error).lower():
                raise
            refused = True
    read = {m: spark.read.parquet(p) for m, p in paths.items()}
    return spark.createDataFrame([(read["ignore"].first()[0], read["overwrite"].first()[0], read["append"].count(), refused)], "ignored string, overwritten string, appended long, refused boolean")


@query("SELECT 'shadow' AS over, n_name AS under FROM nation WHERE n_nationkey = 0")
def temporary_view_over_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A temporary view hides a table of its name until it goes."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey = 0").select("n_name").write.option("path", scratch(spark)).saveAsTable(name)
    spark.sql(f"CREATE TEMPORARY VIEW {name} AS SELECT 'shadow' AS n_name")
    over = spark.table(name).first()[0]
    spark.catalog.dropTempView(name)
    under = spark.table(name).first()[0]
    spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame([(over, under)], "over string, under string")


@query("SELECT n_nationkey, n_name FROM nation")
def external_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(f"SELECT n_nationkey, n_name FROM parquet.`{sf_dir}/nation.parquet`")


@query("SELECT true AS explained")
def explain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The plan of a filter on a file shows that the file's reader gets it."""
    text = spark.sql(f"EXPLAIN FORMATTED SELECT n_name FROM parquet.`{sf_dir}/nation.parquet` WHERE n_nationkey = 3").first()[0]
    return spark.createDataFrame([("PushedFilters" in text and "n_nationkey" in text,)], "explained boolean").select(F.col("explained"))
