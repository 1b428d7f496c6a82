"""The ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import fingerprints, language, minhash, mixing, neighbours, ngrams, oracles, packing, quality, toxicity, warc
from .common import fold

#: The vocabulary file of op3; every operator that takes one has it as a parameter.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, rest: int):
    """A row of the held-out fold; a null id teaches nothing and counts as held out."""
    return F.coalesce(fold("doc_id", parts) == rest, F.lit(True))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(fold("doc_id", 5) != 0))
    return toxicity.score(documents, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.where(fold("doc_id", 3) != 1))
    return language.predict(documents, model).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, capacity=4096, end_id=1)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.fit(documents))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3)).select("doc_id", "size", "source_size", "target", "taken")


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngrams.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_katz": op9_katz,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op6_warc": oracles.OP6, "op7_neighbours": oracles.OP7, "op8_mixing": oracles.OP8}
