"""Exact top-k search by MaxScore over quantised vectors.

Each dimension is a query term. Its posting has every vector, as vectors are dense, and a query's bound for the term is its
weight times the extreme component of the side that it favours. In a shard, a query's terms are sorted by bound; the last of
them, which together can't reach the k-th best score so far, are non-essential. What they can give together is the sum of
their bounds or, if less, the product of the norms of the query's rest and of the longest vector. The essential postings are
traversed for all rows; then the others are probed a few terms at a time, for the rows that are still competitive.

Queries go to the rows: in blocks of bounded size that are broadcast, while rows stay in their tasks. The k-th best score
begins with that of a bounded sample of rows, rises from shard to shard of a task, and the tasks' best are merged by score.

Defined cases: null vectors, null ids and vectors with null or non-finite components take no part, nor do empty ones;
only vectors of one length are compared; a row isn't a candidate of a query of its own id; repeated rows are candidates
each, and queries of one id count once, with the least vector; ties go to the smaller id; an empty table gives no rows.
Scores are sums of doubles, exact up to 2^53; beyond, they are rounded and limited to a long's range. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialise, shared_dir

SHARD_ROWS = 4096
#: Components of the queries of a block, which is broadcast: 32 MB.
BLOCK_VALUES = 4 << 20
#: Rows that the first k-th best score comes from, about.
FIRST_ROWS = 4096
#: Rows of a task, about.
TASK_ROWS = 1 << 16
#: Terms that are probed between two looks at what is still competitive.
PROBED = 4
#: Queries whose bounds are handled in one step.
STEP = 64
RESULT = "query_id long, vec_id long, score double"
LONG = float(np.nextafter(2.0**63, 0))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: id and floor(256 * x) of each component as doubles."""

    def floored(c):
        v = c.cast("double") * 256
        return F.rint(v) - F.when(F.rint(v) > v, 1.0).otherwise(0.0)

    sound = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), floored).alias("x"), F.size(vector_col).alias("length"))


class Best:
    """The k best of each query so far: scores descending, ties by id; -inf where there is none yet."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), k

    def take(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.r_[self.scores[j], scores], np.r_[self.ids[j], ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[j], self.ids[j] = scores[order], ids[order]


def traverse(ids: np.ndarray, rows: np.ndarray, names: np.ndarray, queries: np.ndarray, floors: np.ndarray, best: Best) -> int:
    """Takes a shard's rows into the queries' best; how many products of components that took. floors: known lower bounds of
    the k-th best scores."""
    columns = np.ascontiguousarray(rows.T)
    most, least, products = columns.max(1), columns.min(1), 0
    longest = np.sqrt((rows * rows).sum(1).max(initial=0.0)) * (1 + 1e-9)
    for a in range(0, len(names), STEP):
        q = queries[a : a + STEP]
        bounds = np.maximum(q * most, q * least)
        by_bound = np.argsort(-bounds, axis=1, kind="stable")
        none = np.zeros((len(q), 1))
        # of a term and all after it
        sums = np.c_[np.cumsum(np.take_along_axis(bounds, by_bound, 1)[:, ::-1], 1)[:, ::-1], none]
        norms = np.sqrt(np.c_[np.cumsum(np.take_along_axis(q * q, by_bound, 1)[:, ::-1], 1)[:, ::-1], none]) * longest
        rest = np.minimum(sums, norms)
        floor = np.maximum(floors[a : a + STEP], best.scores[a : a + STEP, -1])
        essential = (rest[:, :-1] >= floor[:, None]).sum(1)
        for j in range(len(q)):
            e, terms, limit, weights = int(essential[j]), by_bound[j], floor[j], q[j]
            n = len(terms)
            products += e * len(ids)
            part = weights @ columns if e == n else weights[terms[:e]] @ columns[terms[:e]] if e else np.zeros(len(ids))
            at = np.flatnonzero((part + rest[j, e] >= limit) & (ids != names[a + j]))
            part = part[at]
            while e < n and len(at):
                some = terms[e : e + PROBED]
                part = part + weights[some] @ columns[np.ix_(some, at)]
                products += len(some) * len(at)
                e += len(some)
                near = part + rest[j, e] >= limit
                at, part = at[near], part[near]
            if len(at):
                best.take(a + j, ids[at], part)
    return products


def floors_of(queries: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Adds to each query the k-th best score over a sample of rows."""
    sent = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            for length, at, names, x in by_length(batch):
                ids, rows = sent.value.get(length, (np.empty(0, np.int64), np.empty((0, length))))
                if len(ids) > k:
                    for a in range(0, len(at), STEP):
                        scores = x[a : a + STEP] @ rows.T
                        scores[names[a : a + STEP, None] == ids] = -np.inf
                        floor[at[a : a + STEP]] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("id", "x", "length")), pa.array(floor)], ["id", "x", "length", "floor"])

    return materialise(queries.mapInArrow(run, "id long, x array<double>, length int, floor double"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length of vectors: it, the rows' places, their ids and vectors."""
    lengths, ids = batch.column("length").to_numpy(), batch.column("id").to_numpy()
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        flat = batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield length, at, ids[at], flat.reshape(len(at), length)


def blocks_of(queries: DataFrame, block_values: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The queries in blocks of bounded size: per length their ids, vectors and floors."""
    held, size = [], 0
    for r in queries.orderBy("length", "id").toLocalIterator():
        if held and size + r["length"] > block_values:
            yield packed(held)
            held, size = [], 0
        held.append((r["length"], r["id"], np.array(r["x"]), r["floor"]))
        size += r["length"]
    if held:
        yield packed(held)


def packed(rows: list[tuple]) -> dict[int, tuple[np.ndarray, ...]]:
    lengths = np.array([r[0] for r in rows])
    found = {}
    for length in np.unique(lengths).tolist():
        own = [rows[i] for i in np.flatnonzero(lengths == length)]
        found[length] = np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own]), np.array([r[-1] for r in own])
    return found


def search_block(rows: DataFrame, block: dict[int, tuple[np.ndarray, ...]], k: int, shard_rows: int) -> DataFrame:
    """The best of each task's rows for the queries of a block."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {length: Best(len(names), k) for length, (names, _, _) in sent.value.items()}
        for batch in batches:
            for a in range(0, batch.num_rows, shard_rows):
                for length, _, ids, x in by_length(batch.slice(a, shard_rows)):
                    if length in found:
                        names, queries, floors = sent.value[length]
                        traverse(ids, x, names, queries, floors, found[length])
        for length, best in found.items():
            names = sent.value[length][0]
            for a in range(0, len(names), SHARD_ROWS):
                scores = best.scores[a : a + SHARD_ROWS]
                there = scores > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[a : a + SHARD_ROWS], there.sum(1))), pa.array(best.ids[a : a + SHARD_ROWS][there]), pa.array(scores[there])], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, RESULT)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score. Both frames have the id and the vector column."""
    spark: SparkSession = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col)
    count = rows.count()
    asked = quantised(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("length", "x")).alias("q")).select("id", "q.x", "q.length")
    # dealt out without a key: neither a common vector nor a repeated id makes a task larger
    rows = materialise(rows.repartition(max(spark.sparkContext.defaultParallelism, -(-count // TASK_ROWS))))
    chance = F.xxhash64("id", "x").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    chosen = rows.where(chance < FIRST_ROWS / max(1, count)).limit(2 * FIRST_ROWS).toArrow().combine_chunks()
    sample = {length: (ids, x) for b in chosen.to_batches() for length, _, ids, x in by_length(b)}
    out = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(out)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for block in blocks_of(floors_of(asked, sample, k), block_values):
        ranked = search_block(rows, block, k, shard_rows).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
        ranked.select("query_id", "vec_id", "score", "rank").write.mode("append").parquet(out)
    found = spark.read.schema(f"{RESULT}, rank int").parquet(out)
    limited = F.greatest(F.least(F.col("score"), F.lit(LONG)), F.lit(-LONG))
    return found.select("query_id", "rank", "vec_id", limited.cast("long").alias("score"))
