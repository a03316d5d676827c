"""Pregel and what is built on it, as joins and aggregations whose rounds are written to the shared folder.

Ids are longs. Messages are aggregated before the shuffle; no vertex's neighbours are gathered anywhere, except the label
counts of label propagation, which are counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.datalog import DatalogSession
from tidelog.datalog.products import closed
from tidelog.plans.store import stored


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with src_value and dst_value, structs of the vertices' columns."""
    value = F.struct(*(c for c in vertices.columns if c != "id"))
    src = vertices.select(F.col("id").alias("src"), value.alias("src_value"))
    dst = vertices.select(F.col("id").alias("dst"), value.alias("dst_value"))
    return edges.join(src, "src").join(dst, "dst")


def aggregate_messages(vertices: DataFrame, edges: DataFrame, merge: Callable[[Column], Column], to_dst: Column | None = None, to_src: Column | None = None) -> DataFrame:
    """Per vertex: message, what merge makes of those sent to it. The messages are columns over triplets; nulls aren't sent."""
    t = triplets(vertices, edges)
    sent = [t.select(F.col(end).alias("id"), m.alias("message")) for end, m in (("dst", to_dst), ("src", to_src)) if m is not None]
    both = sent[0] if len(sent) == 1 else sent[0].union(sent[1])
    return both.where("message IS NOT NULL").groupBy("id").agg(merge(F.col("message")).alias("message"))


def pregel(vertices: DataFrame, edges: DataFrame, program: Column, merge: Callable[[Column], Column], to_dst: Column | None = None, to_src: Column | None = None, max_rounds: int = 50, to_the_end: bool = False) -> DataFrame:
    """vertices: id and value. Each round sends messages along the edges, merges them for each vertex and sets its value to
    `program` over (value, message) where one came, until no value changes or max_rounds are over; to_the_end: the latter is
    an error."""
    vertices = stored(vertices.select("id", "value"))
    for _ in range(max_rounds):
        messages = aggregate_messages(vertices, edges, merge, to_dst, to_src)
        new = F.when(F.col("message").isNotNull(), program).otherwise(F.col("value"))
        step = stored(vertices.join(messages, "id", "left").select("id", new.alias("value"), (~new.eqNullSafe(F.col("value"))).alias("changed")))
        vertices = step.select("id", "value")
        if not step.where("changed").take(1):
            return vertices
    if to_the_end:
        raise RuntimeError(f"values still change after {max_rounds} rounds")
    return vertices


def connected_components(edges: DataFrame) -> DataFrame:
    """Per vertex: the smallest id that undirected edges reach."""
    start = vertices_of(edges).withColumn("value", F.col("id"))
    found = pregel(start, edges, F.least("value", "message"), F.min, F.col("src_value.value"), F.col("dst_value.value"), 10_000, True)
    return found.select("id", F.col("value").alias("component"))


def kept_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges between these vertices."""
    src, dst = (vertices.select(F.col("id").alias(end)) for end in ("src", "dst"))
    return stored(edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select(*edges.columns))


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """Per vertex: the smallest id of those that it reaches and that reach it.

    Each turn spreads the smallest id forward; a vertex that its label's vertex is reached from, back along edges inside the
    label, is of that component and leaves."""
    left = edges.select("src", "dst").where("src <> dst")
    open_ids = vertices_of(edges)
    done: DataFrame | None = None
    while open_ids.take(1):
        # what has no edge in or none out is a component of its own
        inner = stored(open_ids.join(left.select(F.col("src").alias("id")), "id", "left_semi").join(left.select(F.col("dst").alias("id")), "id", "left_semi"))
        alone = open_ids.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        done = alone if done is None else done.union(alone)
        open_ids, left = inner, kept_edges(left, inner)
        if not open_ids.take(1):
            break
        labels = pregel(open_ids.withColumn("value", F.col("id")), left, F.least("value", "message"), F.min, F.col("src_value.value"), None, 10_000, True)
        inside = triplets(labels, left).where("src_value.value = dst_value.value").select("src", "dst")
        marks = labels.withColumn("value", F.when(F.col("id") == F.col("value"), F.col("value")))
        back = pregel(marks, inside, F.coalesce("value", "message"), F.min, None, F.col("dst_value.value"), 10_000, True)
        found = stored(back.where("value IS NOT NULL").select("id", F.col("value").alias("component")))
        done = done.union(found)
        open_ids = stored(open_ids.join(found, "id", "left_anti"))
        left = kept_edges(left, open_ids)
    return done if done is not None else open_ids.withColumn("component", F.col("id"))


def pagerank(edges: DataFrame, rounds: int = 10, reset: float = 0.15, tolerance: float | None = None, source: int | None = None) -> DataFrame:
    """Per vertex: rank after so many rounds, or until no rank moves by more than the tolerance; from one source only, if
    it is given. Ranks begin at 1 and aren't normalised; a vertex without edges out passes nothing on."""
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = stored(edges.join(degrees, "src").select("src", "dst", (1 / F.col("degree")).alias("weight")))
    here = F.lit(1.0) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    ranks = stored(vertices_of(edges).withColumn("rank", here))
    for _ in range(rounds if tolerance is None else 10_000):
        given = weighted.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("weight")).alias("given"))
        rank = reset * here + (1 - reset) * F.coalesce("given", F.lit(0.0))
        step = stored(ranks.join(given, "id", "left").select("id", rank.alias("new"), F.abs(rank - F.col("rank")).alias("moved")))
        ranks = step.select("id", F.col("new").alias("rank"))
        if tolerance is not None and not step.where(F.col("moved") > tolerance).take(1):
            break
    return ranks


def shortest_paths(edges: DataFrame, landmarks: list[int]) -> DataFrame:
    """Per vertex and landmark that it reaches: the number of edges of the shortest path."""
    datalog = DatalogSession(edges.sparkSession)
    datalog.load_program("database({arc(A: long, B: long), mark(A: long)}). d(M,M,mmin<C>) <- mark(M), C=0. d(M,A,mmin<D>) <- d(M,B,C), arc(A,B), D=C+1.")
    datalog.register("arc", edges.select("src", "dst"))
    datalog.register("mark", [(x,) for x in landmarks])
    return datalog.query("d(Landmark, Id, Hops).").to_df()


def triangle_counts(edges: DataFrame) -> DataFrame:
    """Per vertex: the triangles that it is in. Edges go both ways and count once. They are directed from the vertex of lower
    degree, so a hub has few edges out, and few wedges, which are counted where they are made."""
    once = stored(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = once.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = once.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    up = stored(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b")))
    found = closed(up.select(F.col("a").alias("x"), F.col("b").alias("k")), up.select(F.col("a").alias("k"), F.col("b").alias("y")), up.select(F.col("a").alias("x"), F.col("b").alias("y")))
    counts = found.groupBy("id").agg(F.sum("number").alias("triangles"))
    return vertices_of(edges).join(counts, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Per vertex: its label after so many rounds, in which each takes its neighbours' most frequent one (the least among equals)."""
    labels = stored(vertices_of(edges).withColumn("label", F.col("id")))
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "label").count()
        most = seen.groupBy("id").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label"))
        labels = stored(most)
    return labels


def read_edges(spark, path: str) -> DataFrame:
    """An edge list: two ids a line between white space; lines that begin with # don't count."""
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(fields[0].cast("long").alias("src"), fields[1].cast("long").alias("dst"))


def partitioned(edges: DataFrame, strategy: str, parts: int) -> DataFrame:
    """Edges dealt out by source (1d), by both ends (random), by both whatever their order (canonical), or as a grid (2d)."""
    side = max(1, round(parts**0.5))
    keys = {
        "1d": [F.col("src")],
        "random": [F.col("src"), F.col("dst")],
        "canonical": [F.least("src", "dst"), F.greatest("src", "dst")],
        "2d": [F.pmod(F.xxhash64("src"), F.lit(side)), F.pmod(F.xxhash64("dst"), F.lit(side))],
    }
    return edges.repartition(parts, *keys[strategy])


def degrees(edges: DataFrame) -> DataFrame:
    out, into = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")), edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "id", "full").fillna(0)


def grid(spark, rows: int, columns: int) -> DataFrame:
    """Edges of a grid, to the right and down."""
    cells = spark.range(rows * columns)
    right = cells.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return right.union(cells.where(F.col("id") < (rows - 1) * columns).select("id", F.col("id") + columns))


def star(spark, n: int) -> DataFrame:
    return spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))


def log_normal(spark, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 1) -> DataFrame:
    """Edges of a graph whose numbers of edges out are log-normal, to vertices that a hash chooses."""
    degree = F.least(F.exp(F.randn(seed) * sigma + mu), F.lit(float(n))).cast("int")
    placed = spark.range(n).select(F.col("id").alias("src"), degree.alias("degree")).where("degree > 0")
    ends = placed.select("src", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("k"))
    return ends.select("src", F.pmod(F.xxhash64("src", "k", F.lit(seed)), F.lit(n)).alias("dst"))


#: Shares of the four quarters of R-MAT's matrix (fixed values).
QUARTERS = (0.45, 0.15, 0.15, 0.25)


def rmat(spark, n: int, edges: int, seed: int = 1) -> DataFrame:
    """Distinct edges over the next power of two of n vertices: each bit of both ends comes from the quarter of the matrix
    that is drawn for it."""
    levels = max(1, (n - 1).bit_length())
    a, b, c, _ = QUARTERS
    drawn = spark.range(edges).select(*(F.rand(seed + k).alias(f"r{k}") for k in range(levels)))
    src = sum((F.when(F.col(f"r{k}") >= a + b, F.lit(1 << k)).otherwise(0) for k in range(levels)), F.lit(0).cast("long"))
    down = [F.when(F.col(f"r{k}") < a + b, F.col(f"r{k}") >= a).otherwise(F.col(f"r{k}") >= a + b + c) for k in range(levels)]
    dst = sum((F.when(x, F.lit(1 << k)).otherwise(0) for k, x in enumerate(down)), F.lit(0).cast("long"))
    return drawn.select(src.alias("src"), dst.alias("dst")).distinct()


def map_vertices(vertices: DataFrame, value: Column) -> DataFrame:
    return vertices.select("id", value.alias("value"))


def subgraph(vertices: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The vertices that a condition holds for, and the edges between them."""
    kept = stored(vertices.where(keep))
    return kept, kept_edges(edges, kept.select("id"))


def minus(vertices: DataFrame, other: DataFrame) -> DataFrame:
    """Vertices whose id the other doesn't have."""
    return vertices.join(other, "id", "left_anti")


def diff(vertices: DataFrame, other: DataFrame) -> DataFrame:
    """Vertices of both with another value there: the other's."""
    theirs = other.select("id", F.col("value").alias("theirs"))
    return vertices.join(theirs, "id").where(~F.col("value").eqNullSafe(F.col("theirs"))).select("id", F.col("theirs").alias("value"))


def joined(vertices: DataFrame, other: DataFrame, value: Column, inner: bool = False) -> DataFrame:
    """Vertices with a value from their own and the other's `theirs`; those the other lacks get null there, or go."""
    theirs = other.select("id", F.col("value").alias("theirs"))
    return vertices.join(theirs, "id", "inner" if inner else "left").select("id", value.alias("value"))


def aggregate_using_index(vertices: DataFrame, messages: DataFrame, merge: Callable[[Column], Column]) -> DataFrame:
    """Messages (id, value) merged by vertex, for vertices that are there."""
    return messages.groupBy("id").agg(merge(F.col("value")).alias("value")).join(vertices.select("id"), "id", "left_semi")


def map_edges(edges: DataFrame, value: Column) -> DataFrame:
    return edges.select("src", "dst", value.alias("value"))


def inner_join_edges(edges: DataFrame, other: DataFrame, value: Column) -> DataFrame:
    """Edges of both, with a value from their own and the other's `theirs`."""
    return edges.join(other.select("src", "dst", F.col("value").alias("theirs")), ["src", "dst"]).select("src", "dst", value.alias("value"))
