"""The corpus pipeline: stages that each take and keep documents, the last of which encodes them.

Each stage is a function of (spark, docs, sf_dir); run() writes what a stage returns to the shared folder and
reads it back for the next one, so a lost executor costs one stage at most. All stages but the last return the
columns of documents; n_chars follows the text.

Null ids are ids, and rows with one id are documents of their own but where a stage says otherwise. A null, empty or
wordless text has no language, so the first stage drops it. Repeated rows are near copies of each other, of which one
stays. Empty tables give empty ones. Columns that documents don't have by contract are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup
from veritab.llm._core import named, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly; their columns stay as they were."""
    dictionaries = language_id.learn(docs, ~language_id.held_out("doc_id"))
    made = language_id.language_id(docs, dictionaries, carry=COLUMNS[1:])
    return made.filter(~language_id.rejected()).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines it shares with many others."""
    made = line_dedup.line_dedup(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return made.select(F.col("row.doc_id").alias("doc_id"), F.col("kept").alias("text"), *[F.col(f"row.{c}").alias(c) for c in ("lang", "source")], changed.alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, and of these the smallest hash of its text."""
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    made = staged(jaccard_join.jaccard_components(keyed, id_column="key"), "components")
    first = F.col("key").eqNullSafe(F.col("component_id"))
    gone = staged(made.filter(~first).select(F.col("key").alias("gone")).distinct(), "copies", made.count())
    kept = keyed.join(named(gone), F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    # rows alike in id and text are copies too, and have one key
    twins = staged(made.filter(first & (F.col("n_shingles") > 0)).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("twin")), "twins", made.count())
    if not twins.isEmpty():
        same, twins = F.col("key").eqNullSafe(F.col("twin")), named(twins)
        kept = kept.join(twins, same, "left_anti").unionByName(kept.join(twins, same, "left_semi").dropDuplicates(["key"]))
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs.select(*COLUMNS), items)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and decoded texts (as digests) of what is left."""
    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Compression, components and BPE can't be written in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
