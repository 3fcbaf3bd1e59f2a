"""The operators over the given tables, with production parameters and the contracted columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, clusters, huffman, licenses, mixing, neighbours, packing, pages, pii, quality, sharding, simhash
from .common import folder, table

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
ODD_CHAT = "\\### Assistant: </turn> ok"          # the contract's extra conversation, id -7


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY),
                                  with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree()
    placed = sharding.shard(table(spark, sf_dir, "documents"), tree, sharding.with_new_shard(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    huffman.write_corpus(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_VOCABULARY))
    return huffman.read_corpus(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op11_tokenizer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY),
                           public_tokenizers.path(PIECE_VOCABULARY))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    odd = spark.createDataFrame([(-7, 0, "user", ODD_CHAT), (-7, 1, "assistant", ODD_CHAT)],
                                "conv_id long, turn long, role string, text string")
    path = folder(spark, "chats")
    chat.write_chats(table(spark, sf_dir, "conversations").select(*columns).unionByName(odd), path)
    return chat.read_chats(spark, path)


QUERIES = {f.__name__: f for f in (op1_main_text, op2_best_fit_packing, op3_simhash, op4_nearest, op5_licenses,
                                   op6_shards, op7_mix, op8_token_files, op9_quality, op10_personal_data, op11_tokenizer_links,
                                   op12_clusters, op13_chats)}
