"""Stream queries over the events table, run over all that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.streaming import operators as ops


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its one file."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, file = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_available(ops.count_by_window(events(spark, sf_dir), "ts", "1 day", keys=["event_type"])).select(F.col("start").cast("string").alias("start"), "event_type", "n")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.reduce_by_key_and_window(events(spark, sf_dir), "ts", "event_type", "event_id", "2 days", "1 day")
    return ops.run_available(found).select(F.col("start").cast("string").alias("start"), "event_type", F.col("total").cast("long").alias("total"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = events(spark, sf_dir).where("value > 50").select("event_id", F.upper("event_type").alias("kind"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    return ops.run_available(chosen, "append")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.update_state_by_key(events(spark, sf_dir).select("user_id", F.col("event_id").cast("double").alias("x")), "user_id", "x", 0.0, lambda now, x: now + x.sum())
    return ops.run_available(found, "update").groupBy("key").agg(F.max("state").alias("total"))


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams as one, then counted."""
    clicks, others = (events(spark, sf_dir).where(f"event_type {sign} 'click'").select("event_type") for sign in ("=", "<>"))
    return ops.run_available(clicks.union(others).groupBy("event_type").count())


def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch joined with a table that stands still."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    joined = events(spark, sf_dir).join(customers, F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").count()
    return ops.run_available(joined)


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_available(ops.combine_by_key(events(spark, sf_dir), "event_type", "event_id"))


def inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three days that move by one, from the sums of days; those without rows go."""
    days = ops.reduce_by_key_and_window(events(spark, sf_dir), "ts", "event_type", "event_id", "1 day", "1 day")
    found = ops.with_inverse(ops.run_available(days), "event_type", "start", "total", "1 day", 3, F.col("total") > 0)
    return found.select("event_type", F.col("end").cast("string").alias("day"), F.col("total").cast("long").alias("total"))


QUERIES = {"stream_tumbling_window": tumbling, "stream_sliding_window": sliding, "stream_map_filter_explode": mapped, "stream_update_state": state, "stream_union": union, "stream_transform": transformed, "stream_combine_by_key": combined, "stream_window_inverse": inverse}
DAY = "date_trunc('day', ts)"
SQL = {
    "stream_tumbling_window": f"SELECT strftime({DAY}, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding_window": f"SELECT strftime(d, '%Y-%m-%d %H:%M:%S') AS start, event_type, sum(event_id)::BIGINT AS total FROM (SELECT {DAY} AS d, event_type, event_id FROM events UNION ALL SELECT {DAY} - INTERVAL 1 DAY, event_type, event_id FROM events) q GROUP BY 1, 2",
    "stream_map_filter_explode": "SELECT event_id, upper(event_type) AS kind, unnest([1, 2]) AS part FROM events WHERE value > 50",
    "stream_update_state": "SELECT user_id AS key, sum(event_id)::DOUBLE AS total FROM events GROUP BY 1",
    "stream_union": "SELECT event_type, count(*) AS count FROM events GROUP BY 1",
    "stream_transform": "SELECT c_mktsegment, count(*) AS count FROM events JOIN customer ON user_id = c_custkey GROUP BY 1",
    "stream_combine_by_key": "SELECT event_type, count(event_id) AS n, sum(event_id)::BIGINT AS total, avg(event_id) AS mean FROM events GROUP BY 1",
    "stream_window_inverse": f"SELECT event_type, strftime(d, '%Y-%m-%d %H:%M:%S') AS day, sum(event_id)::BIGINT AS total FROM (SELECT event_type, event_id, unnest([{DAY}, {DAY} + INTERVAL 1 DAY, {DAY} + INTERVAL 2 DAY]) AS d FROM events) q GROUP BY 1, 2 HAVING sum(event_id) > 0",
}
