"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CONSTRAINTS = "spark.sql.constraintPropagation.enabled"
ADAPTIVE = "spark.sql.adaptive.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset (tests)."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, in_place: bool = False) -> DataFrame:
    """Writes df to spark.checkpoint.dir (a new local folder where that is unset, as in tests) and cuts its lineage.

    The copy is reliable: an executor may be lost without any of it. It goes when nothing refers to it. in_place: the copy
    keeps df's partitioning, so joins and aggregations by it don't shuffle it again; adaptive execution, which would lose
    it, is off meanwhile, so this is for plans that don't shuffle by keys that can be skewed."""
    shared_folder(df.sparkSession)
    # a checkpoint keeps the constraints of its plan, and a later union fails on those of columns that it dropped
    conf = df.sparkSession.conf
    settings = {CONSTRAINTS: "false"} | ({ADAPTIVE: "false"} if in_place else {})
    before = {k: conf.get(k) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        return df.checkpoint(eager=True)
    finally:
        for k, v in before.items():
            conf.set(k, v)
