"""Queries against DuckDB on the smallest tables, and what has no SQL against brute force."""

from __future__ import annotations

import glob
import math
import os
import random
import shutil
import socket
import subprocess
import sys
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidelog.graph import algorithms as g
from tidelog.plans.catalog import QUERIES, SQL
from tidelog.streaming import operators as ops

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    relation = duck.execute(SQL[name])
    order = [d[0] for d in relation.description]
    assert sorted(order) == columns
    expected = sorted(tuple(plain(r[order.index(c)]) for c in columns) for r in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_rest_works_without_the_corpus_operators(tmp_path):
    """In a copy without them and without the pipeline, or with the pipeline left behind, all other queries are there."""
    root = os.path.dirname(__spark_entry__.__file__)
    shutil.copytree(f"{root}/tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.split() == [str(len(QUERIES)), "False"], done.stderr


def test_sampled_rows_are_rows(spark):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    found = [r[0] for r in QUERIES["sample_rows"](spark, SF).collect()]
    assert set(found) <= ids and 0.05 < len(found) / len(ids) < 0.16
    assert abs(QUERIES["approximate_distinct"](spark, SF).first()[0] / len({r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()}) - 1) < 0.1


def graph(spark, seed, n=12, m=22):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
    return edges, spark.createDataFrame(edges, "src long, dst long")


def reached(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_algorithms(spark, seed):
    edges, df = graph(spark, seed)
    nodes = {x for e in edges for x in e}
    both = edges + [(b, a) for a, b in edges]
    assert {r.id: r.component for r in g.connected_components(df).collect()} == {x: min(reached(both, x)) for x in nodes}
    strong = {x: min(y for y in nodes if y in reached(edges, x) and x in reached(edges, y)) for x in nodes}
    assert {r.id: r.component for r in g.strongly_connected_components(df).collect()} == strong
    once = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    triangles = {x: sum((a, b) in once and (b, c) in once and (a, c) in once and x in (a, b, c) for a in nodes for b in nodes if a < b for c in nodes if b < c) for x in nodes}
    assert {r.id: r.triangles for r in g.triangle_counts(df).collect()} == triangles
    ranks = {x: 1.0 for x in nodes}
    for _ in range(4):
        ranks = {x: 0.15 + 0.85 * sum(ranks[a] / sum(e[0] == a for e in edges) for a, b in edges if b == x) for x in nodes}
    assert {r.id: r.rank for r in g.pagerank(df, 4).collect()} == pytest.approx(ranks)
    personal = {r.id: r.rank for r in g.pagerank(df, tolerance=1e-4, source=edges[0][0]).collect()}
    assert personal[edges[0][0]] >= 0.15 and all(v == 0 for x, v in personal.items() if x not in reached(edges, edges[0][0]))


def test_rounds_that_do_not_suffice_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    start = spark.range(7).selectExpr("id", "id AS value")
    run = lambda n: g.pregel(start, path, F.least("value", "message"), F.min, F.col("src_value.value"), None, n, True)
    with pytest.raises(RuntimeError):
        run(2)
    assert {r.value for r in run(10).collect()} == {0}


def test_same_generation_is_the_level_of_a_tree(spark, duck):
    nodes = [x for (x,) in duck.execute("SELECT s_suppkey FROM supplier WHERE s_suppkey >= 1").fetchall()]
    level = lambda x: int(x).bit_length()
    assert {tuple(r) for r in QUERIES["sg"](spark, SF).collect()} == {(x, y) for x in nodes for y in nodes if x != y and level(x) == level(y)}


def test_label_propagation_and_helpers(spark, tmp_path):
    pairs = [(a, b) for group in ((0, 1, 2, 3), (10, 11, 12, 13)) for a in group for b in group if a < b]
    labels = {r.id: r.label for r in g.label_propagation(spark.createDataFrame(pairs, "src long, dst long"), 4).collect()}
    assert len({labels[k] for k in (0, 1, 2, 3)}) == 1 and len({labels[k] for k in (10, 11, 12, 13)}) == 1 and labels[0] != labels[10]
    (tmp_path / "edges.txt").write_text("# a comment\n1 2\n\n2\t3\n")
    read = g.read_edges(spark, str(tmp_path / "edges.txt"))
    assert sorted(map(tuple, read.collect())) == [(1, 2), (2, 3)]
    assert all(g.partitioned(read, s, 4).count() == 2 for s in ("1d", "2d", "random", "canonical"))
    powers = g.log_normal(spark, 50, 1.0, 0.5).collect()
    assert {r.src for r in powers} <= set(range(50)) and all(0 <= r.dst < 50 for r in powers) and 50 < len(powers) < 500
    drawn = [tuple(r) for r in g.rmat(spark, 32, 400).collect()]
    assert len(drawn) == len(set(drawn)) and all(0 <= x < 32 for e in drawn for x in e) and sum(a < 16 for a, _ in drawn) > len(drawn) / 2
    assert g.grid(spark, 3, 4).count() == 17 and g.star(spark, 5).count() == 4
    assert sorted(map(tuple, g.reverse(read).select("src", "dst").collect())) == [(2, 1), (3, 2)]


def test_stream_state_restarts_from_its_checkpoint(spark, tmp_path):
    seen = []
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(3).write.parquet(source)
    stream = lambda: ops.read_files(spark, source, "id long", files_per_trigger=1)
    ops.for_each_batch(stream(), lambda df, k: seen.extend(r[0] for r in df.collect()), checkpoint)
    spark.range(3, 5).write.mode("append").parquet(source)
    ops.for_each_batch(stream(), lambda df, k: seen.extend(r[0] for r in df.collect()), checkpoint)
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_stream_listener_and_socket(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"one\ntwo\n")
        time.sleep(5)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    seen, progress = [], ops.Progress()
    spark.streams.addListener(progress)
    query = ops.read_socket(spark, "127.0.0.1", server.getsockname()[1]).writeStream.foreachBatch(lambda df, k: seen.extend(r[0] for r in df.collect())).option("checkpointLocation", str(tmp_path / "socket")).start()
    for _ in range(100):
        if len(seen) == 2:
            break
        time.sleep(0.3)
    query.stop()
    for _ in range(50):
        if progress.ended:
            break
        time.sleep(0.2)
    spark.streams.removeListener(progress)
    assert seen == ["one", "two"] and progress.started == 1 and sum(progress.rows) == 2 and progress.ended == [None]


def test_library_does_not_import_the_corpus_package():
    for path in glob.glob(f"{os.path.dirname(__spark_entry__.__file__)}/tidelog/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "tidelog.llm" not in f.read(), path
