"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from eventide.llm import language, minhash, mixing, packing, toxicity
from eventide.llm.common import give_back_heap, stored

#: A document whose toxicity score reaches this goes.
TOXIC = 0.5
#: A document of which no language holds this share of its words goes, as does one without words.
MAIN_LANGUAGE = 0.5
#: Sources, in code point order, are mixed in these proportions, repeating.
WEIGHTS = (1, 2, 3)
CAPACITY = 4096
#: Goes before the names of columns that a stage adds and drops again.
OWN = "stage__"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def lean(stage: Stage) -> Stage:
    """The stage, begun once executors have given back the heap that the stage before it grew."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heap(spark)
        return stage(spark, docs, sf_dir)

    return run


@lean
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from ``labels``, does not reject.

    Null, empty and very long texts are scored like others; repeated rows and null ids
    stay or go each; clashing names are kept apart by a prefix; empty in, empty out.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=docs.columns, prefix=OWN).where(F.col(f"{OWN}score") < TOXIC).select(*docs.columns)


@lean
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, by a field learnt from the texts that name one.

    Texts that are null, empty or without letters have none and go; repeated rows and
    null ids are judged each; empty in, empty out.
    """
    found = language.predict(docs, language.fit(docs), keep=docs.columns, prefix=OWN)
    return found.where((F.col(f"{OWN}lang_pred") != language.UNKNOWN) & (F.col(f"{OWN}score") >= MAIN_LANGUAGE)).select(*docs.columns)


@lean
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity 0.8 or more.

    Rows that repeat an id and text are one document, the least by its other columns;
    unlike texts of one id are documents of their own. Documents without words and rows
    without an id all stay. Empty in, empty out.
    """
    key, first = f"{OWN}key", f"{OWN}first"
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.where("doc_id is not null").select("doc_id", text.alias("text"))
    twice = texts.groupBy("doc_id").agg(F.min("text").alias(first), F.max("text").alias("last")).where(F.col(first) < F.col("last")).drop("last")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if not twice.isEmpty():
        # unlike texts under one id are documents of their own; all but one get keys above the ids
        other = F.xxhash64("doc_id", text).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
        keyed = keyed.join(twice, "doc_id", "left").withColumn(key, F.when(F.col(first) != text, other).otherwise(F.col(key)))
        keyed = stored(keyed.select(*docs.columns, key), "pipeline-keyed")
    kept = minhash.near_duplicates(keyed, key, size=5, percent=80).where(f"kept and {key} is not null").select(key).distinct()
    named = keyed.join(kept, key).select(key, *docs.columns)
    # rows that repeat an id and text are one document; rows without an id cannot be matched and stay
    once = named.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.struct("text", *[c for c in docs.columns if c != "text"])).alias("row")).select("row.*")
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


@lean
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as the mix holds it, as repeated rows.

    Documents without words are never taken; a null source is a source; rows that repeat
    an id get the largest count among them. Empty in, empty out.
    """
    return mixing.mixed(docs, WEIGHTS)


@lean
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document, with its sequence and its place there.

    A null or empty text is one piece, very long ones are cut; repeated rows are packed
    each. Empty in, empty out.
    """
    return packing.pack_documents(docs, VOCABULARY, CAPACITY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express trained models and packing; tests hold each stage against brute force.
ORACLE_SQL = None
