"""Content-addressed stages: signatures, manifests and fail-closed reuse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def signature(payload) -> str:
    """SHA-256 of canonical JSON (L1)."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def records(spark: SparkSession, path: str) -> DataFrame:
    """name, size and SHA-256 of each file of a table: hashed in executors, never brought together (Q52)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def content_digest(spark: SparkSession, path: str) -> dict:
    """Files, bytes and an order-free digest of a table's records."""
    h = F.conv(F.substring("sha256", 1, 12), 16, 10).cast("decimal(38,0)")
    r = records(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest")).first()
    return r.asDict()


def _manifest(path: str) -> str:
    return path.rstrip("/") + ".manifest"


def write_manifest(spark: SparkSession, path: str, stage: str, sign: str) -> None:
    row = {"stage": stage, "signature": sign, "content": content_digest(spark, path)}
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "record string").coalesce(1).write.mode("overwrite").text(_manifest(path))


def is_hit(spark: SparkSession, path: str, sign: str) -> bool:
    """Whether the stored table is the one that this signature made: anything odd is a miss (L2)."""
    try:
        row = json.loads(spark.read.text(_manifest(path)).first()["value"])
        return row["signature"] == sign and row["content"] == content_digest(spark, path)
    except Exception:  # noqa: BLE001  a missing, torn or changed record must recompute
        return False


def cached_stage(spark: SparkSession, path: str, stage: str, payload, compute: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """The table of a stage, computed unless an untouched one of the same signature is there (L4)."""
    sign = signature({"stage": stage, "payload": payload})
    hit = not force and is_hit(spark, path, sign)
    if not hit:
        compute().write.mode("overwrite").parquet(path)
        write_manifest(spark, path, stage, sign)
    return spark.read.parquet(path), hit


def missing_records(required: DataFrame, known: DataFrame) -> DataFrame:
    """Required files of which no known record has the size and hash, wherever they lie."""
    return required.join(known.select("size", "sha256").distinct(), ["size", "sha256"], "left_anti")


def load_verified(spark: SparkSession, path: str, sign: str, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """A stored table, only if the signature made it, its files are untouched, its keys are unique and, where given, are
    exactly the expected ones; anything else is an error (S8-S10, S15, Q51)."""
    if not is_hit(spark, path, sign):
        raise ValueError(f"{path} is not what this signature made")
    frame = spark.read.parquet(path)
    if not frame.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"keys of {path} repeat")
    if expected is not None:
        sides = frame.select(*keys, F.lit(1).alias("a")).join(expected.select(*keys, F.lit(1).alias("b")), keys, "full_outer")
        if not sides.filter("a is null or b is null").isEmpty():
            raise ValueError(f"keys of {path} are not those expected")
    return frame


def inventory_findings(spark: SparkSession, stages: dict[str, tuple[str, str]]) -> list[str]:
    """Names of the stages (path, signature) whose stored table is missing or not the one of its signature; to be called before any is read."""
    return sorted(name for name, (path, sign) in stages.items() if not is_hit(spark, path, sign))
