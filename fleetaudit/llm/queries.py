"""The registered queries of this package: one per operator, over its whole table, and the pipeline's parts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetaudit.session import scratch_folder

from . import centroids, divergence, fingerprints, jaccard_join, line_dedup, neighbours, packing, personal_data, piece_encoding, quality, simhash, token_files, toxicity
from .common import documents, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(table(spark, folder, "documents"))
    own, kept = F.struct("doc_id", "text_key", "line_no"), F.struct("kept_doc", "kept_text_key", "kept_line")
    return line_dedup.line_classes(docs).select("doc_id", "line_no", "kept_doc", "kept_line", own.eqNullSafe(kept).alias("stays"))


def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), out, WORD_BPE, end_id=1, vocabulary=49_408)
    return token_files.document_ids(token_files.read_token_files(spark, out))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, folder, "embeddings"))
    return neighbours.nearest(vectors, vectors.where(F.col("id") % 50 == 0), k=5, factor=1.0)


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), BYTE_BPE, end_id=0, capacity=2048)


def op9_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return piece_encoding.round_trip(table(spark, folder, "documents"), PIECE_BPE)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings"), clusters=8, rounds=10, dims=64, scale=1024, salt="3")


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, folder, "documents"), words=4, percent=85)


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_document_fingerprints, op3_token_files, op4_personal_data, op5_toxicity, op6_quality, op7_nearest_neighbours, op8_best_fit_packing,
    op9_piece_encoding, op10_simhash, op11_centroid_clusters, op12_jaccard_join, op13_source_divergence)}
ORACLE_SQL: dict[str, str] = {"op13_source_divergence": divergence.SQL}
