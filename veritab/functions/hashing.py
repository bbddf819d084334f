"""Deterministic hashes, seeds and priorities that SQL engines agree on."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_zero(value: Column) -> Column:
    """-0.0 as 0.0, which print differently."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def row_fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' text; a null is an empty field of its own."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]), 256)


def rounded_fingerprint(decimals: int, *columns: Column) -> Column:
    """Of values rounded half to even."""
    return row_fingerprint(*[canonical_zero(F.bround(c.cast("double"), decimals)) for c in columns])


def bytes_fingerprint(values: Column, dtype: str = "<f8", decimals: int | None = None) -> Column:
    """SHA-256 (hex) of the little-endian bytes of an array of numbers, as ``<f4`` or ``<f8`` (H1-H4).

    Zeros lose their sign, before and after rounding to decimals (half to even, in the type itself). A value that is not
    finite in that type, a null among the values included, is an error; a null array has no fingerprint. The numbers of
    a batch are one buffer, of which each row's bytes are a view.
    """
    if dtype not in ("<f4", "<f8"):
        raise ValueError("fingerprints are of <f4 or <f8")

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        # values under a null row lie outside of flatten(), so rows are told by their lengths
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            flat = np.asarray(flat, np.dtype(dtype))
        if not np.isfinite(flat).all():
            raise ValueError("values that are not finite have no fingerprint")
        flat = flat + flat.dtype.type(0)
        if decimals is not None:
            flat = np.round(flat, decimals).astype(flat.dtype, copy=False) + flat.dtype.type(0)
        data, made, start = memoryview(flat.tobytes()), [], 0
        for n in rows.value_lengths().to_pylist():
            if n is None:
                made.append(None)
                continue
            made.append(hashlib.sha256(data[start : start + n * flat.itemsize]).hexdigest())
            start += n * flat.itemsize
        return pa.array(made, pa.string())

    return run(values.cast("array<double>"))


def unit(salt: str, *keys: Column) -> Column:
    """A number in [0, 2 ** 32) that depends on salt and keys only: uniform, the same on any cluster."""
    text = F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def stable_seed(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 modulo 2 ** 32: its lower 8 digits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 9, 8), 16, 10).cast("long")


def stable_seed_le(*parts: Column) -> Column:
    """First four bytes of SHA-256, little-endian."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def flow_id(task: Column, file: Column, row: Column, fingerprint: Column) -> Column:
    """Identity of a row that recurs across seeds (H5)."""
    return F.sha2(F.concat_ws("|", task, file, row.cast("string"), fingerprint), 256)


def unit_sql(salt: str, *keys: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', '" + salt + "', " + ", ".join(f"({k})::VARCHAR" for k in keys) + ")), 1, 8))::BIGINT"
