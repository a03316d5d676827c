"""Products of sparse relations against brute force, and how much they shuffle."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.datalog import DatalogSession, products
from tidelog.datalog.fixpoint import Options
from tidelog.graph import algorithms as g
from tidelog.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def shuffled_rows(spark, run):
    """Rows that the stages of run() write for shuffles, where nothing is small enough to broadcast."""
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before, threshold = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return found, written() - before


def complete(spark, n):
    return spark.range(n).selectExpr("id AS src").crossJoin(spark.range(n).selectExpr("id AS dst")).where("src < dst")


def pairs(spark, seed, n, m):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n), rng.randrange(-20, 20)) for _ in range(m)]
    return rows, spark.createDataFrame(rows, "a long, b long, v long")


@pytest.mark.parametrize("least", [50_000, 20])
@pytest.mark.parametrize("kind", ["count", "min", "max"])
def test_product_equals_brute_force(spark, monkeypatch, kind, least):
    """Whatever the number of blocks; with repeated rows and with middles that only one side has or that are null."""
    monkeypatch.setattr(products, "LEAST", least)
    monkeypatch.setattr(products, "MOST", 60 if least == 20 else products.MOST)
    left, right = pairs(spark, 1, 30, 150), pairs(spark, 2, 40, 200)
    expected = {}
    for x, k, v in left[0]:
        for k2, y, w in right[0]:
            if k == k2:
                expected.setdefault((x, y), []).append(v + w)
    nulls = spark.createDataFrame([(1, None, 1)], "x long, k long, v long")
    found = products.product(left[1].toDF("x", "k", "v").union(nulls), right[1].toDF("k", "y", "v"), kind)
    assert {(r.x, r.y): r.value for r in found.collect()} == {key: {"count": len, "min": min, "max": max}[kind](v) for key, v in expected.items()}


@pytest.mark.parametrize("wedges", [3, 50, 2_000_000])
def test_spans_of_any_size_give_the_same(monkeypatch, wedges):
    np = products.np
    rng = np.random.default_rng(3)
    left, right = ((rng.integers(0, 9, 60), rng.integers(0, 9, 60), rng.integers(-5, 5, 60)) for _ in range(2))
    monkeypatch.setattr(products, "WEDGES", wedges)
    every = Counter((x, y) for x, k, _ in zip(*left, strict=True) for k2, y, _ in zip(*right, strict=True) if k == k2)
    found = Counter()
    for x, y, n in products.summed(products.Wedges(left, right), "count"):
        found.update(dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)))
    assert found == every


def test_triangles_do_not_shuffle_wedges(spark):
    n = 90
    edges = complete(spark, n).localCheckpoint()
    found, rows = shuffled_rows(spark, lambda: {(r.id, r.triangles) for r in g.triangle_counts(edges).collect()})
    assert found == {(k, (n - 1) * (n - 2) // 2) for k in range(n)}
    # 4,005 edges, 117,480 wedges
    assert rows < 60_000


def test_counted_pairs_do_not_shuffle_wedges(spark):
    rows = [(0, k) for k in range(1, 301)] + [(400, k) for k in range(1, 301)]
    datalog = DatalogSession(spark)
    datalog.load_program("database({e(A: long, B: long)}). u(X,Y) <- e(X,Y). u(Y,X) <- e(X,Y). closing(Y,Z,count<X>) <- u(X,Y), u(X,Z), Y ~= Z, ~u(Y,Z).")
    datalog.register("e", rows)
    found, shuffled = shuffled_rows(spark, lambda: {tuple(r) for r in datalog.query("closing(A,B,C).").collect()})
    assert found == {(a, b, 2) for a in range(1, 301) for b in range(1, 301) if a != b} | {(0, 400, 300), (400, 0, 300)}
    # 90,000 pairs of 180,600 wedges: the pairs are summed up and joined with what they must not be
    assert shuffled < 270_000


@pytest.mark.parametrize("nulls", [False, True])
def test_best_sums_are_products(spark, monkeypatch, nulls):
    """A complete graph of 30, with a relation that isn't small enough to broadcast; facts with nulls are joined instead."""
    monkeypatch.setattr(products, "LEAST", 100)
    n, rng = 30, random.Random(5)
    arcs = {(a, b): rng.randrange(1, 100) for a in range(n) for b in range(n) if a != b}
    best = dict(arcs)
    for k in range(n):
        for a in range(n):
            for b in range(n):
                if (a, k) in best and (k, b) in best:
                    best[a, b] = min(best.get((a, b), 10**9), best[a, k] + best[k, b])
    datalog = DatalogSession(spark, Options(broadcast_rows=0))
    datalog.load_program("database({e(A: long, B: long, C: long)}). m(A,B,mmin<C>) <- e(A,B,C). m(A,B,mmin<D>) <- m(A,C,D1), e(C,B,D2), D=D1+D2.")
    datalog.register("e", spark.createDataFrame([(a, b, c) for (a, b), c in arcs.items()] + [(1, 2, None)] + [(0, None, 3)] * nulls, "a long, b long, c long").repartition(4))
    calls = []
    monkeypatch.setattr(products, "product", lambda *a, made=products.product: calls.append(a) or made(*a))
    found = {tuple(r) for r in datalog.query("m(A,B,C).").collect()}
    assert {r for r in found if r[1] is not None} == {(a, b, c) for (a, b), c in best.items()}
    if nulls:
        assert {r for r in found if r[1] is None} == {(a, None, 3 + (best[a, 0] if a else 0)) for a in range(n)}
    else:
        assert calls and all(r[1] is not None for r in found)


def test_mean_of_a_group_shuffles_sums(spark):
    found, shuffled = shuffled_rows(spark, lambda: {r[0]: r[1] for r in QUERIES["udaf_pandas"](spark, SF).collect()})
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert found == pytest.approx({r[0]: r[1] for r in lines.groupBy("l_returnflag").agg(F.avg("l_quantity")).collect()})
    # of about 6,000 lines
    assert shuffled < 100
