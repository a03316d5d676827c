"""Graph queries over the suppliers' graph, with SQL where recursion can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.graph import algorithms as g
from tidelog.plans.datalog import RELATIONS, with_relations


def edges(spark: SparkSession, sf_dir: str, relation: str = "supp_arc") -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(RELATIONS[relation]).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def over(f: Callable[[DataFrame], DataFrame], relation: str = "supp_arc") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(edges(spark, sf_dir, relation))


def vertex_joins(edges: DataFrame) -> DataFrame:
    """Degrees joined to vertices: those that differ, those without edges out, and all with both numbers."""
    degrees = g.degrees(edges)
    out = degrees.where("out_degree > 0").select("id", F.col("out_degree").alias("value"))
    into = degrees.select("id", F.col("in_degree").alias("value"))
    both = g.joined(g.map_vertices(into, F.col("value")), out, F.col("value") - F.coalesce("theirs", F.lit(0)))
    none = g.minus(into, out).select("id", F.lit(-1).cast("long").alias("value"))
    return both.select(F.lit("both").alias("kind"), "id", "value").union(none.select(F.lit("none"), "id", "value")).union(g.diff(into, out).select(F.lit("diff"), "id", "value"))


ids = "nodes AS (SELECT a AS id FROM supp_arc UNION SELECT b FROM supp_arc)"
ALGORITHMS = {
    "graph_connected_components": g.connected_components,
    "graph_strong_components": g.strongly_connected_components,
    "graph_pagerank": lambda e: g.pagerank(e, 3).select("id", F.round("rank", 6).alias("rank")),
    "graph_shortest_paths": lambda e: g.shortest_paths(e, [1, 2]),
    "graph_triangles": g.triangle_counts,
    "graph_label_propagation": lambda e: g.label_propagation(e, 3),
    "graph_degrees": g.degrees,
    "graph_subgraph": lambda e: g.subgraph(g.vertices_of(e).withColumn("value", F.col("id")), e, F.col("value") % 2 == 0)[1],
    "graph_vertex_joins": lambda e: vertex_joins(e),
    "graph_edge_join": lambda e: g.inner_join_edges(g.map_edges(e, F.col("src")), g.map_edges(g.reverse(e), F.col("dst")), F.col("value") * 1000 + F.col("theirs")),
    "graph_messages": lambda e: g.aggregate_messages(g.vertices_of(e).withColumn("value", F.col("id")), e, F.sum, F.col("src_value.value")),
}
QUERIES = {name: over(f) for name, f in ALGORITHMS.items()}
SQL = {
    "graph_connected_components": with_relations("supp_arc", "u AS (SELECT a, b FROM supp_arc UNION SELECT b, a FROM supp_arc), r AS (SELECT a AS id, a AS o FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.o = u.a) SELECT id, min(o) AS component FROM r GROUP BY id"),
    "graph_strong_components": with_relations("supp_arc", f"{ids}, r AS (SELECT id, id AS o FROM nodes UNION SELECT r.id, s.b FROM r JOIN supp_arc s ON r.o = s.a) SELECT x.id, min(x.o) AS component FROM r x JOIN r y ON x.id = y.o AND x.o = y.id GROUP BY x.id"),
    "graph_pagerank": with_relations("supp_arc", ids + ", w AS (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS w FROM supp_arc), r0 AS (SELECT id, 1.0::DOUBLE AS r FROM nodes)" + "".join(f", r{k} AS (SELECT n.id, 0.15 + 0.85 * coalesce(sum(r.r * w.w), 0) AS r FROM nodes n LEFT JOIN w ON w.b = n.id LEFT JOIN r{k - 1} r ON r.id = w.a GROUP BY n.id)" for k in (1, 2, 3)) + " SELECT id, round(r, 6) AS rank FROM r3"),
    "graph_shortest_paths": with_relations("supp_arc", "d(landmark, id, hops) USING KEY (landmark, id) AS (SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 0::BIGINT), (2, 2, 0)) t(landmark, id, hops) UNION SELECT q.* FROM (SELECT DISTINCT d.landmark, s.a AS id, d.hops + 1 AS hops FROM d JOIN supp_arc s ON s.b = d.id) q LEFT JOIN recurring.d o ON o.landmark = q.landmark AND o.id = q.id WHERE o.hops IS NULL OR q.hops < o.hops) SELECT landmark, id, hops FROM d"),
    "graph_triangles": with_relations("supp_arc", ids + ", e AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM supp_arc WHERE a <> b), t AS (SELECT p.x AS a, p.y AS b, q.y AS c FROM e p JOIN e q ON p.y = q.x JOIN e r ON r.x = p.x AND r.y = q.y), m AS (SELECT unnest([a, b, c]) AS id FROM t) SELECT n.id, count(m.id) AS triangles FROM nodes n LEFT JOIN m ON m.id = n.id GROUP BY n.id"),
    "graph_label_propagation": with_relations("supp_arc", "u AS (SELECT a, b FROM supp_arc UNION ALL SELECT b, a FROM supp_arc), " + ids + ", l0 AS (SELECT id, id AS label FROM nodes)" + "".join(f", c{k} AS (SELECT u.b AS id, l.label, count(*) AS n FROM u JOIN l{k - 1} l ON l.id = u.a GROUP BY 1, 2), l{k} AS (SELECT id, arg_max(label, (n, -label)) AS label FROM c{k} GROUP BY id)" for k in (1, 2, 3)) + " SELECT id, label FROM l3"),
    "graph_degrees": with_relations("supp_arc", ids + " SELECT id, (SELECT count(*) FROM supp_arc WHERE a = id) AS out_degree, (SELECT count(*) FROM supp_arc WHERE b = id) AS in_degree FROM nodes"),
    "graph_subgraph": with_relations("supp_arc", "e AS (SELECT a AS src, b AS dst FROM supp_arc WHERE a % 2 = 0 AND b % 2 = 0) SELECT src, dst FROM e"),
    "graph_vertex_joins": with_relations("supp_arc", ids + ", d AS (SELECT id, (SELECT count(*) FROM supp_arc WHERE a = id) AS o, (SELECT count(*) FROM supp_arc WHERE b = id) AS i FROM nodes) SELECT 'both' AS kind, id, i - o AS value FROM d UNION ALL SELECT 'none', id, -1 FROM d WHERE o = 0 UNION ALL SELECT 'diff', id, o FROM d WHERE o > 0 AND o <> i"),
    "graph_edge_join": with_relations("supp_arc", "e AS (SELECT x.a AS src, x.b AS dst, x.a * 1000 + x.b AS value FROM supp_arc x JOIN supp_arc y ON x.a = y.b AND x.b = y.a) SELECT src, dst, value FROM e"),
    "graph_messages": with_relations("supp_arc", "m AS (SELECT b AS id, sum(a)::BIGINT AS message FROM supp_arc GROUP BY b) SELECT id, message FROM m"),
}
