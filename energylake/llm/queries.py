"""Registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    binary,
    bpe,
    grid_codes,
    html,
    mixing,
    packing,
    pii,
    ppm,
    quality,
    shards,
    simhash,
    topk,
    whitening,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Query) -> Query:
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op2_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op3_shards(spark, sf_dir):
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_quality(spark, sf_dir):
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op10_pii(spark, sf_dir):
    return pii.report(pii.find(table(spark, sf_dir, "documents"))).select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query
def op4_tokens(spark, sf_dir):
    return binary.round_trip(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)


@query
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)


@query
def op6_simhash(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_fingerprint("fp").alias("fingerprint"),
        "component_id",
    )


@query
def op9_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


@query
def op1_html(spark, sf_dir):
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query
def op7_ppm(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return ppm.score(table(spark, sf_dir, "documents"), held_out)


@query
def op11_grid_codes(spark, sf_dir):
    return grid_codes.compress(
        table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256
    )


@query
def op12_mixing(spark, sf_dir):
    plan = mixing.plan_mix(
        table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0
    )
    return mixing.per_row(plan).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)
