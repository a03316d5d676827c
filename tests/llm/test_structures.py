"""Joins, search, chat and packing against brute force; the pipeline end to end."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm import maxscore, ngram_join
from tidelog.llm.chat import format_conversations, loss_text
from tidelog.llm.components import components
from tidelog.llm.maxscore import search
from tidelog.llm.packing import best_fit, dominating_bin, pack, packing_plan, places, token_pieces

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def linked(rows, percent=80):
    """Component of each id by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}


def families(seed):
    """Groups of edited copies, short texts, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(20, 150))] + passage * rng.randrange(2)
        for _ in range(rng.randrange(1, 18)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 18)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    short = [word() for _ in range(14)]
    rows += [" ".join(short[a : a + rng.randrange(1, 14)]) for a in range(4) for _ in range(9)]
    rows += ["", None, "  ", "One", "one", "A b\tC", "a B c"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "most_light"), [(1, None), (2, 0), (3, 16)])
def test_similar_documents(spark, seed, most_light, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = families(seed)
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, n string, component string")
    found = {r.doc_id: r for r in ngram_join.similar_documents(df, most_light=most_light).collect()}
    assert {i: r.component_id for i, r in found.items()} == linked(rows)
    assert all(found[i].n_shingles == len(shingles(t)) for i, t in rows)


def test_similar_documents_of_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(None, text), (5, text), (3, text), (3, text), (7, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id) for r in ngram_join.similar_documents(df).collect()), key=str)
    assert rows == sorted([(None, None), (5, 3), (3, 3), (3, 3), (7, 7)], key=str)
    assert ngram_join.similar_documents(df.limit(0)).count() == 0


def test_one_of_each_group(spark):
    one, other, near = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = one.replace("a59", "z")
    rows = [(1, one), (1, other), (1, one), (5, near), (6, other), (7, None), (7, ""), (8, " "), (None, one), (None, one), (9, "x y z" * 50), (9, "lone words here"), (2, other + " more")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, _copies string, component_id string")
    for docs in (df, df.repartition(3)):
        kept = ngram_join.one_of_each(docs)
        assert kept.columns == df.columns
        found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert found == sorted([(1, one), (1, other), (7, None), (7, ""), (8, " "), (None, one), (None, one), (9, "x y z" * 50), (9, "lone words here")], key=str)
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated ids and rows, empty and very long texts, other columns, an empty table."""
    import corpus_pipeline

    text = " ".join(f"word{k} and" for k in range(40))
    rows = [(1, text, "en"), (1, text, None), (2, None, "en"), (3, "", None), (None, text + " no id", "en"), (4, "long words go on. " * 30000, "en"), (5, "secret = abcdefgh12 " + text, "en")]
    schema = "doc_id long, text string, lang string"
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} <= {1, 2, 3, 4, 5, None}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    # past the quality rules, which may well reject such texts
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, str(tmp_path / "odd")).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    first = [r for r in docs.collect() if r.piece == 0]
    assert sorted((r.doc_id for r in first), key=str) == [1, 2, 3, 4, None]  # 5 is a near copy of 1


def test_boundary_and_sizes():
    assert ngram_join.required(10, 10, 80) == 9 and ngram_join.required(10, 8, 80) == 8 and list(ngram_join.partners(10, 80)) == [8, 9, 10, 11, 12]
    assert ngram_join.choose_boundary({}, 2.0, 80) == 0
    assert 0 <= ngram_join.choose_boundary({k: 100 for k in range(1, 17)}, 2.0, 80) <= 16


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("rows", "size", "first"), [(4096, 1 << 20, 4096), (7, 20, 0)])
def test_search(spark, rows, size, first, monkeypatch):
    monkeypatch.setattr(maxscore, "FIRST_ROWS", first)
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=8).round(1)], "clash") for i in range(300)]
    vectors += [(900 + k, vectors[10][1], "copy") for k in range(4)] + [(950, None, ""), (951, [1.0, None], ""), (952, [float("nan")] * 8, ""), (None, [1.0] * 8, ""), (953, [], ""), (1000, [1.0, 2.0], ""), (1001, [2.0, 1.0], ""), (1050, [0.5] * 8, ""), (1050, [0.5] * 8, "")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string")
    found = search(df, df.where("vec_id % 50 = 0"), 5, shard_rows=rows, block_values=size).collect()
    sound = [(i, np.floor(np.array(v) * 256)) for i, v, _ in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q in sorted({i for i, _ in sound if i % 50 == 0}):
        x = next(v for i, v in sound if i == q)
        best = sorted((-int(x @ v), i) for i, v in sound if i != q and len(v) == len(x))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == expected
    assert search(df.limit(0), df.limit(0)).count() == 0


def test_search_of_large_values(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30]), (3, [-0.001])], "vec_id long, embedding array<double>")
    found = search(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, int(maxscore.LONG)), (3, -int(maxscore.LONG)), (2, -int(maxscore.LONG))]


def test_share_of_products():
    """On vectors without any structure, the hardest case, the floor of a sample leaves less than all to be multiplied."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    queries, ids = x[:64], np.arange(len(x))
    scores = queries @ x.T
    scores[np.arange(64), np.arange(64)] = -np.inf
    floors = np.partition(scores[:, :4096], -5, axis=1)[:, -5]
    best = maxscore.Best(64, 5)
    done = sum(maxscore.traverse(ids[a : a + 4096], x[a : a + 4096], ids[:64], queries, floors, best) for a in range(0, len(x), 4096))
    assert (best.scores == -np.sort(-scores, axis=1)[:, :5]).all()
    assert done < 0.65 * queries.size * len(x)


PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "[ROLE=x]", "\\", "[", "]", "<", " ", "\n", "é", "ok", "\\\\", "</s"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "INST", "a]b", "", None]), "".join(rng.choice(PIECES) for _ in range(rng.randrange(7))) if rng.random() > 0.1 else None, "clash") for c in range(120) for t in range(rng.randrange(1, 5))]
    turns += [(None, 0, "user", "x", ""), (500, None, "user", "first", ""), (500, 1, "user", "b", ""), (500, 1, "user", "a", ""), (500, 1, "user", "a", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    rows = format_conversations(df).withColumn("loss", loss_text()).collect()
    source = collections.defaultdict(list)
    for c, t, role, text, _ in turns:
        source[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(rows) == len(source) and all(r.identical for r in rows)
    for r in rows:
        expected = [x[1:] for x in sorted(source[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == expected
        assert r.loss == "".join(t for role, t in expected if role == "assistant")
        spans = [re.sub(r"\\([\\<\[\]])", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert spans == [t for role, t in expected if role == "assistant"]
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["end"].alias("end")))
    broken = format_conversations(df).withColumn("loss_spans", moved).select(loss_text().alias("loss")).collect()
    assert sorted(r.loss for r in broken) != sorted(r.loss for r in rows)
    assert format_conversations(df.limit(0)).count() == 0


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + sizes[k] <= capacity:
                place(k + 1, [*bins[:j], bins[j] + sizes[k], *bins[j + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominating_bins_keep_the_optimum(sizes):
    counts = collections.Counter(sizes)
    for j in sorted(counts, reverse=True):
        rest = counts - collections.Counter([j])
        fixed = dominating_bin(rest, j, 20)
        if fixed is not None:
            assert sum(fixed) <= 20 and not collections.Counter(fixed) - counts
            assert fewest([*(counts - collections.Counter(fixed)).elements()], 20) + 1 == fewest(sizes, 20)
    plan = packing_plan(dict(counts), 20)
    assert sum((collections.Counter(p) for p, n in plan for _ in range(n)), collections.Counter()) == counts
    assert all(sum(p) <= 20 for p, _ in plan) and sum(n for _, n in plan) <= fewest(sizes, 20) * 11 / 9 + 1


def test_plan_of_many():
    histogram = {s: 50 + s % 7 for s in range(1, 1025)}
    plan = packing_plan(histogram, 1024)
    assert sum(n for _, n in plan) <= -(-sum(s * n for s, n in histogram.items()) // 1024) * 1.002
    runs = places(plan)
    assert {s: n for s, n in histogram.items()} == dict(sum((collections.Counter({s: n}) for p, n in plan for s in p), collections.Counter()))
    assert len(runs["first"]) == sum(len(p) for p, _ in plan) and best_fit(collections.Counter(), 10) == []


def test_packing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(5000, None), (5001, ""), (5002, "a b c d e " * 3000), (None, "x"), (5003, "same"), (5003, "same")], "doc_id long, text string"))
    rows = pack(token_pieces(docs, BYTE), bucket_rows=40).collect()
    library, bins, pieces = Tokenizer.from_file(BYTE), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for inside in bins.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array(library.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        own = pieces[d.doc_id]
        assert {p.piece for p in own} == set(range(-(-len(ids) // 1024)))
        for p in own:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and (p.piece == 0 or p.length == 1024)
    assert len(bins) <= 1.01 * -(-sum(r.length for r in rows) // 1024) + 1
    assert pack(token_pieces(docs.limit(0), BYTE)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        if name != "best-fit packing":
            assert docs.columns == before.columns
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in after}
    assert kept < {r.doc_id for r in before}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 0}
    assert not kept & bad
    before, after = seen["n-gram Jaccard join"]
    parts = linked([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == set(parts.values())
    before, after = seen["secret scans"]
    texts = {r.doc_id: r.text for r in after}
    assert len(after) == len(before) and not any(re.search("[0-9a-f]{32}", t) for t in texts.values())
    assert all(texts[r.doc_id] == r.text for r in before if not re.search("[0-9a-f]{32}|token|secret|passw|api_?key|AKIA", r.text, re.I))
    assert {r.doc_id for r in docs.select(F.col("doc_id")).distinct().collect()} == set(texts)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
