"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

The instance is a histogram: how many pieces there are of each length, at most `capacity` numbers. The reduction goes
from the longest length down and permanently fixes a bin {j}, {j, k} or {j, k, l} where it dominates every other
bin that holds j: whatever else fits beside j can be exchanged for it. The rest of the histogram is packed by best fit,
longest first, many equal bins in one step. The plan is a list of (lengths in the bin, number of such bins).
Pieces of one length are then numbered without gaps, in hashed buckets so that no length lands in one task, and each
finds its bin and offset by the plan's running counts.

Defined cases: a null text counts as empty (one end token); an empty table gives no rows; repeated rows are packed each;
ties go by id, then piece; a piece is never longer than the capacity; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.bpe import byte_bpe
from tidelog.llm.common import materialise, text_chunks

BUCKET_ROWS = 50_000
Plan = list[tuple[tuple[int, ...], int]]


def token_pieces(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: the id, piece, start, length and ids_crc32. A document's last pieces are full, its first is what is left over."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(vocab_path)
        for batch in text_chunks(batches, text_col):
            ids, lengths = codec.encode_batch([t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()])
            ids = np.insert(ids, np.cumsum(lengths), end_id).astype("<u4")
            lengths = lengths + 1
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = lengths - (n - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = ((np.cumsum(lengths) - lengths)[doc] + start) * 4
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def least_sum(counts: Counter[int], sizes: list[int], n: int, capacity: int) -> int:
    """Of the n shortest pieces of these (ascending) lengths; over capacity if there aren't n."""
    total = 0
    for s in sizes:
        take = min(n, counts[s])
        total, n = total + take * s, n - take
        if not n:
            return total
    return capacity + 1


def widest_pair(counts: Counter[int], sizes: list[int], room: int) -> tuple[int, int]:
    """Over all pairs that fit: the greatest sum, and the greatest shorter length; zeros if none fits."""
    best, shorter, high = 0, 0, len(sizes) - 1
    for low, s in enumerate(sizes):
        while high >= 0 and s + sizes[high] > room:
            high -= 1
        if high < low or high == low and counts[s] < 2:
            break
        best, shorter = max(best, s + sizes[high]), s
    return best, shorter


def dominating_bin(counts: Counter[int], j: int, capacity: int) -> tuple[int, ...] | None:
    """A bin that holds j and dominates every other one that does; counts are without this j.

    A bin dominates another if the other's pieces can be shared out among its own, each getting no more than its
    length. {j} alone, if nothing fits. {j, k} with the longest k that fits, if k fills the bin or no several pieces
    that fit are together longer than k. {j, k, l}, if at most two pieces fit, with the longest l beside j and k, if no
    pair that fits has a shorter piece longer than l."""
    room = capacity - j
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    if not sizes:
        return (j,)
    k = sizes[-1]
    if k == room or least_sum(counts, sizes, 2, capacity) > room:
        return j, k
    if least_sum(counts, sizes, 3, capacity) <= room:
        return None
    best, shorter = widest_pair(counts, sizes, room)
    if best <= k:
        return j, k
    beside = [s for s in sizes if s <= room - k and counts[s] > (s == k)]
    return (j, k, beside[-1]) if beside and shorter <= beside[-1] else None


def reduce_by_dominance(counts: Counter[int], capacity: int) -> Plan:
    """Takes dominating bins out of counts, from the longest length down, until none is found."""
    plan: Plan = []
    found = True
    while found:
        found = False
        for j in sorted((s for s, n in counts.items() if n), reverse=True):
            while counts[j]:
                counts[j] -= 1
                fixed = dominating_bin(counts, j, capacity)
                counts[j] += 1
                if fixed is None:
                    break
                uses = Counter(fixed)
                # the same bin dominates as long as its pieces last: fewer pieces only take alternatives away
                times = min(counts[s] // n for s, n in uses.items())
                for s, n in uses.items():
                    counts[s] -= n * times
                plan.append((fixed, times))
                found = True
    return plan


def best_fit(counts: Counter[int], capacity: int) -> Plan:
    """Best fit of what counts hold, longest first; equal bins are filled together."""
    rooms: list[int] = []
    open_bins: dict[int, Plan] = {}

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, times))

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[s]
        while left and (at := bisect_left(rooms, s)) < len(rooms):
            room = rooms[at]
            pattern, times = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            used = min(times, left)
            if used < times:
                put(pattern, times - used)
            put((*pattern, s), used)
            left -= used
        each = capacity // s
        if left // each:
            put((s,) * each, left // each)
        if left % each:
            put((s,) * (left % each), 1)
        counts[s] = 0
    return [b for room in sorted(open_bins) for b in open_bins[room]]


def packing_plan(histogram: dict[int, int], capacity: int) -> Plan:
    counts = Counter({s: n for s, n in histogram.items() if n})
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def places(plan: Plan) -> dict[str, np.ndarray]:
    """For each run of pieces of one length, in order of length and number: length, first number, first bin, offset."""
    runs: list[tuple[int, int, int, int]] = []
    given: Counter[int] = Counter()
    bins = 0
    for pattern, times in plan:
        offset = 0
        for s in pattern:
            runs.append((s, given[s], bins, offset))
            given[s] += times
            offset += s
        bins += times
    columns = np.array(sorted(runs), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "bin", "offset"), columns, strict=True))


def pack(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to token pieces."""
    pieces = materialise(pieces)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = places(packing_plan(histogram, capacity))
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    named = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", "start"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = named.groupBy("length", "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32")
    numbered = named.withColumn("_number", F.row_number().over(inside) - 1).join(offsets, ["length", "_bucket"]).withColumn("_number", F.col("_number") + F.col("_before"))
    fields = [f.name for f in pieces.schema]
    step = 1 << 40
    keys = runs["length"] * step + runs["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
                at = np.searchsorted(keys, length * step + number, "right") - 1
                sequence = runs["bin"][at] + number - runs["first"][at]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), pa.array(sequence), pa.array(runs["offset"][at])], [*fields, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])
    return numbered.select(*fields, "_number").mapInArrow(run, schema)
