"""Round trips through file formats, and partitioned and saved tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.store import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"


def through(kind: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    """Writes orders in a format, reads them back with their schema and selects."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
        path = scratch(spark)
        rows.write.format(kind).options(**options).mode("errorifexists").save(path)
        return spark.read.format(kind).options(**options).schema(rows.schema).load(path)

    return run


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").write.text(path)
    return spark.read.text(path)


def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended twice by partition, then one partition is read: only its folder is scanned."""
    path = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    for part in (0, 1):
        rows.where(F.col("o_orderkey") % 2 == part).write.mode("append").partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


def json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    path = scratch(spark)
    lines.write.text(path)
    return spark.read.json(path).select("event_id", "event_type")


def cached_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").cache()
    return rows.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def libsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and vectors, written and read back."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("double").alias("label"), F.col("p_size").cast("double").alias("size"), F.lit(1.5).alias("other"))
    path = scratch(spark)
    VectorAssembler(inputCols=["size", "other"], outputCol="features").transform(part).select("label", "features").write.format("libsvm").save(path)
    read = spark.read.format("libsvm").option("numFeatures", "2").load(path)
    return read.select("label", vector_to_array("features")[0].alias("size"), vector_to_array("features")[1].alias("other"))


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text files and binary files, one row each."""
    path = scratch(spark)
    spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").repartition(1).sortWithinPartitions("r_name").write.text(path)
    texts = spark.read.text(path, wholetext=True).select(F.char_length("value").alias("chars"))
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select(F.length("content").alias("bytes"))
    return texts.agg(F.sum("chars").alias("chars")).crossJoin(F.broadcast(binary.agg(F.sum("bytes").alias("bytes"))))


def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single quotes, comments and unquoted names are read; what isn't JSON is kept aside."""
    path = scratch(spark)
    spark.createDataFrame([("{'a': 1}",), ('{"a": 2} // two',), ("{a: 3}",), ("{broken",)], "value string").coalesce(1).write.text(path)
    options = {"allowSingleQuotes": "true", "allowComments": "true", "allowUnquotedFieldNames": "true", "mode": "PERMISSIVE"}
    return spark.read.schema("a long, _corrupt_record string").options(**options).json(path).select("a", F.col("_corrupt_record").isNotNull().alias("broken"))


def json_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema inferred from a share of the rows."""
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.to_json(F.struct("c_custkey", "c_name")).alias("value"))
    path = scratch(spark)
    lines.write.text(path)
    return spark.read.option("samplingRatio", 0.5).json(path).select("c_custkey", "c_name")


def by_class_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source by its class instead of its short name."""
    return spark.read.format("org.apache.spark.sql.execution.datasources.parquet.ParquetFileFormat").load(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")


ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"
QUERIES = {
    "source_parquet": through("parquet"),
    "source_orc": through("orc"),
    "source_json": through("json"),
    "source_csv": through("csv", header="true"),
    "source_text": text_lines,
    "source_json_inferred": json_inferred,
    "sink_partitioned": partitioned_write,
    "source_cache": cached_scan,
    "source_libsvm": libsvm,
    "source_whole_files": whole_files,
    "source_json_lenient": json_lenient,
    "source_json_sampled": json_sampled,
    "source_by_class": by_class_name,
}
SQL = {
    **{f"source_{k}": ORDERS for k in ("parquet", "orc", "json", "csv")},
    "source_text": "SELECT n_name AS value FROM nation",
    "source_json_inferred": "SELECT event_id, event_type FROM events",
    "sink_partitioned": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "source_cache": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "source_libsvm": "SELECT p_partkey::DOUBLE AS label, p_size::DOUBLE AS size, 1.5::DOUBLE AS other FROM part",
    "source_whole_files": "SELECT sum(length(r_name) + 1)::BIGINT AS chars, sum(length(r_name) + 1)::BIGINT AS bytes FROM region",
    "source_json_lenient": "SELECT * FROM (VALUES (1::BIGINT, false), (2, false), (3, false), (NULL, true)) t(a, broken)",
    "source_json_sampled": "SELECT c_custkey, c_name FROM customer",
    "source_by_class": "SELECT r_regionkey, r_name FROM region",
}
