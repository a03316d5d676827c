"""The ten queries over the smallest tables: their last columns against the libraries, DuckDB and brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_structures import linked, shingles
from test_texts import brute_spans
from tokenizers import Tokenizer

from tidelog.llm.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {i: t or "" for i, t in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text")), strict=True)}


def result(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    return {r[0]: r for r in rows} if name != "op10_best_fit_packing" else rows


def encoded(path, texts):
    library = Tokenizer.from_file(public_tokenizers.path(path))
    return library, {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = QUERIES[name](spark, SF)
    relation = connection.execute(SQL[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(relation.fetchall())


def test_op1(spark, texts):
    library, ids = encoded("byte_bpe_50k.json", texts)
    rows = result(spark, "op1_bpe_encoding")
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert (r.n_tokens, r.ids_sha256) == (len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids[i], skip_special_tokens=False).encode()).hexdigest()


def test_op2(spark, texts):
    rows = result(spark, "op2_sharding")
    assert rows.keys() == texts.keys() and {(r.law, r.grown_shard) for r in rows.values()} == {("bytes", None)}
    assert all((r["size"], r.text_crc32) == (len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode())) for i, r in rows.items())
    slots = sorted((r.shard, r.slot) for r in rows.values())
    assert all(b == (a[0], a[1] + 1) or b[1] == 0 for a, b in pairwise(slots)) and slots[0][1] == 0
    sizes = [sum(r["size"] for r in rows.values() if r.shard == k) for k in range(16)]
    assert max(sizes) - sum(sizes) / 16 <= max(r["size"] for r in rows.values())


def test_op3(spark):
    rows = result(spark, "op3_html_extraction")
    table = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert rows.keys() == {r["page_id"] for r in table}
    assert all(r.n_chars == len(r.text) and r.text == r.text.strip() and "\n\n\n" not in r.text for r in rows.values())


def test_op4(spark, texts):
    for i, r in result(spark, "op4_quality_rules").items():
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
        repeated = len({k + j for k, w in enumerate(windows) if w in often for j in range(5)}) if often is not None else r.n_repeat_words
        seen, dup = set(), 0
        for line in texts[i].split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts[i])), dup)
        assert r.n_repeat_words == repeated and r.base_failed == (len(words) < 10 or 100 * repeated > 20 * len(words)) and not (r.base_failed and r.kept)


def test_op5(spark, texts):
    _, ids = encoded("word_bpe_49k.json", texts)
    rows, at = result(spark, "op5_token_files"), 0
    assert rows.keys() == texts.keys()
    for i in sorted(texts):
        own = [*ids[i], 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_op6(spark, texts):
    rows, parts = result(spark, "op6_ngram_jaccard_join"), linked(list(texts.items()))
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == {i: (len(shingles(t)), parts[i]) for i, t in texts.items()}


def test_op9(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts, kinds, total = {r["doc_id"]: r["text"] or "" for r in table}, ["assign", "access", "hex"], 0
    rows = QUERIES["op9_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        base = sorted(brute_spans(texts[r.doc_id]), key=lambda s: (s[0], kinds.index(s[1])))
        joined = ",".join(f"{kind}:{start}:{end}" for start, kind, end in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and all(s in r.spans.split(",") for s in joined.split(",") if s)
        total += len(base)
    assert total > 0


def test_op10(spark, texts):
    _, ids = encoded("byte_bpe_50k.json", texts)
    bins = {}
    pieces = {}
    for r in result(spark, "op10_best_fit_packing"):
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for i, own in pieces.items():
        whole = np.array([*ids[i], 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and zlib.crc32(whole[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(whole)
    for own in bins.values():
        assert all(b[0] == a[0] + a[1] for a, b in pairwise(sorted(own))) and min(own)[0] == 0 and sum(x[1] for x in own) <= 1024
