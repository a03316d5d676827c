"""Queries over the corpus operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import bpe_encode_decode
from tidelog.llm.chat import format_conversations, loss_text
from tidelog.llm.common import table
from tidelog.llm.html_extract import extract_pages
from tidelog.llm.maxscore import search
from tidelog.llm.ngram_join import similar_documents
from tidelog.llm.packing import pack, token_pieces
from tidelog.llm.quality import judge_documents, train
from tidelog.llm.secrets import BASE, scan_secrets
from tidelog.llm.sharding import shard_documents
from tidelog.llm.tokenfile import read_token_files, write_token_files


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_documents(docs, *train(docs, table(spark, sf_dir, "labels")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, uri = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_token_files(shards, uri).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), 5, 80)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP7_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_conversations(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss_text()).cast("long").alias("loss_chars"),
        F.sha2(loss_text().cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), r AS (
    SELECT *, CASE WHEN role = 'user' THEN 4 ELSE 5 + length(regexp_replace(role, '([\\<\[\]])', '\\\1', 'g')) END AS mark,
        CASE WHEN regexp_matches(text, '</?s>|\[/?(INST|ROLE=)|\\[\\<\[\]]') THEN regexp_replace(text, '([\\<\[\]])', '\\\1', 'g') ELSE text END AS body
    FROM t
), s AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(14 + 2 * mark + length(body)) AS chars
    FROM r GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM s
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in BASE]
    base = shown(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)
    return pack(pieces, 1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encoding": op1_bpe_encoding,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_files": op5_token_files,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_topk_search": op7_topk_search,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_secret_scan": op9_secret_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
}

SQL: dict[str, str] = {
    "op7_topk_search": OP7_SQL,
    "op8_chat_formatting": OP8_SQL,
}
