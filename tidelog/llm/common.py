"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.java_gateway import JavaClass, JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of a Python operator works on, whatever the size of Spark's batches.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset (tests)."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage; the copy goes when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """materialise, for operators of many steps: then the driver collects its garbage, so that plans, stored copies and
    shuffle files that nothing refers to go at once, and gives the memory back."""
    done = materialise(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    trim_driver(df.sparkSession)
    return done


def trim_driver(spark: SparkSession) -> None:
    """Returns what the driver's JVM has freed outside its heap to the system, as give_back does for workers: its many
    short-lived threads leave much of it. A JVM without that command keeps it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind: JavaClass, *items: object) -> JavaObject:
        made = gateway.new_array(kind, len(items))
        for k, item in enumerate(items):
            made[k] = item
        return made

    lang, name = jvm.java.lang, "com.sun.management:type=DiagnosticCommand"
    kinds = array(lang.Class, *map(lang.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    arguments = array(lang.Object, jvm.javax.management.ObjectName(name), "systemTrimNativeHeap", array(lang.Object), array(lang.String))
    with suppress(Py4JJavaError):
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)


def text_chunks(batches: Iterable[pa.RecordBatch], text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about chunk_bytes of text; a longer text stands alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(text_col)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        part = np.cumsum(sizes) // chunk_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on after a task, beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
