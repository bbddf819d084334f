"""Readers and writers of tables (S1-S20, K1-K8). Paths may be of any file system that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.labels import safe_stem

#: The form of an opaque identifier, and columns that link to a source.
OPAQUE_ID = r"^rid_[0-9a-f]{32}$"
LINKING, LINKING_PREFIX = ("sample_order", "source_file", "source_row", "raw_fingerprint"), "tensor_fingerprint"


def stripped(frame: DataFrame) -> DataFrame:
    """Column names without blanks around them."""
    return frame.toDF(*[c.strip() for c in frame.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By suffix: .csv, .csv.gz, .parquet or .pq; anything else is an error."""
    name = path.rstrip("/").lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith((".csv", ".csv.gz")):
        reader = reader.option("header", True)
        return stripped((reader if schema else reader.option("inferSchema", True)).csv(path))
    if name.endswith((".parquet", ".pq")):
        return stripped(reader.parquet(path))
    raise ValueError(f"no reader for {path}")


def with_identity(frame: DataFrame) -> DataFrame:
    """source_file and the zero-based source_row of Parquet rows; columns are pruned as before."""
    return frame.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))


def read_directory(spark: SparkSession, path: str, pattern: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    """All files of a folder that match, with their columns united by name."""
    reader = spark.read.format(fmt).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    if fmt == "csv":
        return stripped(reader.option("header", True).option("inferSchema", True).load(path))
    return stripped(reader.option("mergeSchema", True).load(path))


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """A missing table reads as no rows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(path)


def with_path_context(frame: DataFrame, names: tuple[str, ...] = ("dataset", "model", "xai")) -> DataFrame:
    """Columns from name=value parts of the path, else from its last folders in order."""
    path = F.col("_metadata.file_path")
    folders = F.slice(F.reverse(F.split(path, "/")), 2, len(names))
    named = {n: F.regexp_extract(path, rf"/{n}=([^/]+)/", 1) for n in names}
    return frame.select("*", *[F.when(named[n] != "", named[n]).otherwise(F.get(folders, F.lit(len(names) - 1 - i))).alias(n) for i, n in enumerate(names)])


def predictions_snapshot(frame: DataFrame, keys: list[str], condition: list[str]) -> DataFrame:
    """Identities that not every condition holds exactly once; a sound snapshot has none."""
    n = frame.select(*condition).distinct().count()
    counted = frame.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*condition)).alias("n_conditions"))
    return counted.filter((F.col("n_rows") != n) | (F.col("n_conditions") != n))


def linkability_findings(frame: DataFrame, id_column: str = "flow_id") -> list[str]:
    """Forbidden columns, and whether any id is not opaque; stops at the first such row.

    Names count without blanks around them and in lower case; a null or empty id is none.
    """
    names = {c: c.strip().lower() for c in frame.columns}
    found = [f"direct_linkage_field:{n}" for n in names.values() if n in LINKING or n.startswith(LINKING_PREFIX)]
    for c, n in names.items():
        if n == id_column:
            value = F.col(f"`{c}`").cast("string")
            if not frame.filter((value != "") & ~value.rlike(OPAQUE_ID)).isEmpty():
                found.append("nonopaque_flow_id")
    return found


def csv_linkability(spark: SparkSession, path: str) -> list[str]:
    """The findings of a CSV file, compressed or not; one that can't be read is a finding of its own."""
    try:
        return linkability_findings(spark.read.option("header", True).option("mode", "FAILFAST").csv(path))
    except Exception:  # noqa: BLE001  whatever makes it unreadable
        return ["unreadable_csv_for_linkability_check"]


def write_splits(frame: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split; an existing table is an error (K1)."""
    frame.write.partitionBy(split).mode("errorifexists").parquet(path)


def write_csv(frame: DataFrame, path: str) -> str | None:
    """One folder of CSV with a header, replaced as a whole when the job commits; a frame without columns removes it (K2, K5)."""
    spark = frame.sparkSession
    if not frame.columns:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return None
    frame.write.mode("overwrite").option("header", True).csv(path)
    return path


def csv_to_parquet(spark: SparkSession, path: str, out: str, force: bool = False) -> str:
    """Header names stripped; an existing result is kept unless forced (S1). Returns the table's path."""
    target = f"{out.rstrip('/')}/{stem(path)}.parquet"
    stripped(spark.read.option("header", True).option("inferSchema", True).csv(path)).write.mode("overwrite" if force else "ignore").parquet(target)
    return target


def stem(path: str) -> str:
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "_", path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".csv"))


def stem_column(path: Column) -> Column:
    return safe_stem(F.regexp_extract(path, r"([^/]+?)(\.csv)?(\.gz)?/?$", 1))


def decision_row(spark: SparkSession, payload: dict) -> DataFrame:
    """A record as one row of canonical JSON (K6)."""
    return spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "record string")
