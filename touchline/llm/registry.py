"""The queries of the training-data operators and the SQL that a second engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dups, hard_negatives, line_dedup, lines_rules, mixing, near_dups, oracles, packing, pii_scan, quality_model, secret_scan, suffix_dedup, whitening
from .store import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93).drop("first_row")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed_lines", F.sha2("text", 256).alias("text_sha256"))


#: The mix that the query asks for: domains 4:3:2:1, twice as much English as of any other language.
MIX = mixing.Weights(domain={"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, lang={"en": 2})


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_ids(table(spark, sf_dir, "documents"), MIX, share=0.6, max_epochs=2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model).select("doc_id", quality_model.held_out().alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100).drop("kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op9_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.digest(pii_scan.find_personal_data(table(spark, sf_dir, "documents")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dups.near_duplicates(docs, shingle=3, percent=85).drop("first_row", "row")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_line_dedup, op3_mixing_sources, op4_quality_classifier, op5_quality_rules, op6_suffix_array_dedup, op7_packing, op8_secret_scan, op9_pii_scan, op10_minhash_near_dedup, op11_embedding_whitening, op12_hard_negatives, op13_bpe_codec)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": oracles.OP1, "op5_quality_rules": oracles.OP5, "op10_minhash_near_dedup": oracles.OP10, "op12_hard_negatives": oracles.OP12}
