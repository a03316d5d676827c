"""Sharding by sampled splitters.

Records are ordered by a key in which equal texts stand side by side: a hash of the text above a hash of the id. A
size-weighted sample of the keys gives quantile boundaries of fine ranges; a range that holds too much is sampled
again and subdivided, which the id's part of the key allows even inside one group of equal texts. With exact sizes of
the ranges and running sums inside them, each record knows the bytes before it, and the shards are cut from that order
at equal shares of the bytes. A cut moves to the edge of a group of equal texts where one lies within GROUP_SLACK of a
shard's share, so small groups stay whole.

Defined cases: a null text has no bytes (size 1, crc of nothing) and groups with empty ones; with fewer records than
shards some shards stay empty; an empty table gives no rows; repeated rows each get a slot of their own; ties of the
key go by id; columns other than the id and the text are ignored. A null id is placed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidelog.llm.common import materialise

#: Low bits of the key that come from the id.
ID_BITS = 20
#: Expected sample keys of each range.
SAMPLES = 16
#: Rows that a range should hold; ranges at least and, before subdividing, at most. Tasks get their boundaries, the driver
#: the sample: half a million keys. Beyond 6 billion rows ranges grow with the input; they are sorted with spilling.
RANGE_ROWS = 200_000
LEAST_RANGES, MOST_RANGES = 64, 1 << 15
#: A range of over this many times its share is subdivided.
OVERFULL = 4
#: Rounds of subdividing; a range that is still overfull only takes longer to sort.
MOST_TURNS = 8
#: Share of a shard's bytes by which a cut may move to keep equal texts together.
GROUP_SLACK = 0.01


def shard_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, mask = F.coalesce(F.col(text_col).cast("string"), F.lit("")), (1 << ID_BITS) - 1
    return docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit(~mask)).bitwiseOR(F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(mask))).alias("key"),
    )


def sample_keys(keyed: DataFrame, share: Column, salt: int) -> np.ndarray:
    """Sorted keys of about `share` of the rows, chosen by a hash so that a repeated task chooses alike."""
    chance = (F.xxhash64(F.col("key"), F.col("size"), F.lit(salt)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).alias("chance")
    return np.sort(keyed.where(chance < share).select("key").toArrow()["key"].to_numpy())


def quantiles(sample: np.ndarray, parts: int, whole_groups: bool) -> np.ndarray:
    """Up to parts - 1 boundaries of a sorted sample. whole_groups: each at the first key of its text."""
    cuts = sample[len(sample) * np.arange(1, parts) // parts] if len(sample) else sample
    return np.unique(cuts & ~np.int64((1 << ID_BITS) - 1) if whole_groups else cuts)


def in_ranges(keyed: DataFrame, boundaries: np.ndarray) -> DataFrame:
    """Adds `range`, the number of boundaries that are at most the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.searchsorted(boundaries, batch.column("key").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "range"])

    return keyed.mapInArrow(run, StructType([*keyed.schema.fields, StructField("range", IntegerType())]))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row: the id, size, text_crc32, shard and slot (its place in the shard)."""
    keyed = materialise(shard_keys(docs, id_col, text_col))
    rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = min(max(LEAST_RANGES, -(-rows // range_rows)), MOST_RANGES)
    share = max(1, total) / wanted
    boundaries = quantiles(sample_keys(keyed, F.col("size") * (wanted * SAMPLES / max(1, total)), 0), wanted, True)
    for turn in range(1, MOST_TURNS + 1):
        sizes = {r[0]: (r[1], r[2]) for r in in_ranges(keyed, boundaries).groupBy("range").agg(F.sum("size"), F.count(F.lit(1))).collect()}
        full = sorted(k for k, (size, count) in sizes.items() if size > OVERFULL * share and count > 1)
        if not full or turn == MOST_TURNS:
            break
        rate = F.col("size") * (SAMPLES * wanted / max(1, total))
        overfull = docs.sparkSession.createDataFrame([(k,) for k in full], "range int")
        again = sample_keys(in_ranges(keyed, boundaries).join(F.broadcast(overfull), "range", "left_semi"), rate, turn)
        bounds = np.r_[0, np.searchsorted(again, boundaries), len(again)]
        more = [quantiles(again[bounds[k] : bounds[k + 1]], max(2, round(sizes[k][0] / share)), False) for k in full]
        finer = np.unique(np.concatenate([boundaries, *more]))
        if len(finer) == len(boundaries):
            break
        boundaries = finer
    starts = dict(zip(sorted(sizes), accumulate((sizes[k] for k in sorted(sizes)), lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0)), strict=False))
    in_order = Window.partitionBy("range").orderBy("key", F.col(id_col), "text_crc32")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    mask = (1 << ID_BITS) - 1
    text_of = F.col("key").bitwiseAND(F.lit(~mask))
    # whether a range begins where a text's group does
    offsets = docs.sparkSession.createDataFrame([(k, a, b, k == 0 or not int(boundaries[k - 1]) & mask) for k, (a, b) in starts.items()], "range int, byte_start long, row_start long, at_group boolean")
    placed = (
        in_ranges(keyed, boundaries)
        .withColumn("bytes_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("rows_before", F.row_number().over(in_order) - 1)
        .withColumn("last_text", F.lag(text_of).over(in_order))
        .join(F.broadcast(offsets), "range")
        .withColumn("edge", F.coalesce(F.col("last_text") != text_of, "at_group"))
        .withColumns({"bytes_before": F.col("bytes_before") + F.col("byte_start"), "rows_before": F.col("rows_before") + F.col("row_start")})
    )
    placed = materialise(placed.select(id_col, "size", "text_crc32", "bytes_before", "rows_before", "edge"))
    quota = max(1, total) / n_shards
    boundary = F.round(F.col("bytes_before") / quota).cast("int")
    distance = F.abs(F.col("bytes_before") - boundary * quota)
    found = placed.where((boundary > 0) & (boundary < n_shards)).groupBy(boundary.alias("boundary")).agg(
        F.min_by("bytes_before", distance).alias("row_cut"),
        F.min_by("bytes_before", F.when(F.col("edge") & (distance <= GROUP_SLACK * quota), distance)).alias("edge_cut"),
    )
    cut_at = {r["boundary"]: r["row_cut"] if r["edge_cut"] is None else r["edge_cut"] for r in found.collect()}
    cuts = [cut_at.get(s, quota * s) for s in range(1, n_shards)]
    shard = sum((F.when(F.col("bytes_before") >= F.lit(float(c)), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = placed.withColumn("shard", shard)
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("rows_before")).collect()}
    base = F.create_map(*[F.lit(x) for s, b in (first or {0: 0}).items() for x in (s, b)])
    return placed.select(id_col, "size", "text_crc32", "shard", (F.col("rows_before") - base[F.col("shard")]).cast("long").alias("slot"))

