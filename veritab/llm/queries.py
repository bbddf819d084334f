"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import _logistic, alignment, bpe, decontaminate, jaccard_join, language_id, licenses, line_dedup, packing, periodic_runs, quality, substring_dedup, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.held_out("doc_id")
    sample = _logistic.sampled(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out, toxicity.FIT_ROWS)
    made = toxicity.toxicity(docs, toxicity.learn(sample))
    return made.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_exact", "n_fuzzy", "n_quoted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return made.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' tree: a folder for each source, and in it one for each language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.license_scan(table(spark, sf_dir, "documents"), path)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.learn(docs, ~language_id.held_out("doc_id"))
    made = language_id.language_id(docs, dictionaries)
    return made.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score", "margin", language_id.rejected().alias("rejected"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), outputs=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = _logistic.sampled(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True), quality.FIT_ROWS)
    return quality.quality(docs, quality.learn(sample))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), seed=seed, outputs=False)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), outputs=False)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), outputs=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}

#: Line dedup is the one whose rows SQL can give at an acceptable cost on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": """
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        each_line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each_line),
        shared AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT d.doc_id, d.pos, d.line, s.k IS NOT NULL AND d.doc_id <> s.keeper AS gone FROM keyed d LEFT JOIN shared s ON d.k = s.k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
