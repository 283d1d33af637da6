"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the
last return the columns of documents; packing returns one row for each piece of a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import line_dedup, mixing, near_dups, packing, quality_model
from touchline.llm.store import settle, table

#: Weights of the mix: domains 4:3:2:1, twice as much English as of any other language.
MIX = mixing.Weights(domain={"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, lang={"en": 2})
#: Share of all tokens that the mix takes; no document is taken twice.
MIX_SHARE = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the rows at hand, doesn't reject."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, keep_text=True).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left with nothing go."""
    kept = line_dedup.dedup_lines(docs, drop_empty=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dups.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source weights call for."""
    return mixing.mix(docs, MIX, share=MIX_SHARE, max_epochs=1).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences."""
    return packing.pack(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express the classifier or the token ids; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
