"""Removal of lines that many documents share, by Bloom filters of once-seen and twice-seen line hashes.

A text is split at newlines (null or empty: one empty line). A line's key is the line with space and 0x09 to
0x0D stripped at both ends and A-Z lower-cased. Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents lose all their lines except in the largest id that holds them.

1. One pass hashes each document's long keys. The hashes, with their documents' ids, are dealt out to shards that
   hold the two filters (see _filters); lines whose hash only one document has go no further.
2. Only the suspects' lines are shuffled, by their whole key, to count documents and to find the largest id. A false
   suspect costs its own row and nothing else. Their texts are found by the suspects' hashes, which are broadcast
   if they are few, or else by the ids of the suspects' documents.
3. The keys that are shared, with the id that keeps each, are broadcast if they are few: then no text is shuffled.
   Otherwise each document's list of keys to drop is joined to it by id.

Rows with the same id count as one document when documents are counted, and all keep or lose the same lines.
A null id is an id like any other, smaller than all. A key that recurs within one document counts once. There are no
ties, as the id that keeps a key is one. Very long texts and lines are read whole. Extra columns pass through
untouched, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import SEPARATOR, buffer_of, lean, lowered, packed, released, signed, slices, small_batches, staged, swept, trimmed, word_hashes
from veritab.llm._filters import HELD_KEYS, Chosen, settled, small_set, twice_seen

MIN_CHARS, MIN_DOCS = 40, 5
#: Shared keys are broadcast if they are no more than these, and no more bytes.
BROADCAST_KEYS, BROADCAST_BYTES = 1 << 17, 1 << 24


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and for each row the index of its first line (rows + 1 entries)."""
    breaks = np.flatnonzero(raw == 10)
    start, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([offsets[1:], breaks]))
    return start, end, np.searchsorted(breaks, offsets) + np.arange(len(offsets))


def long_keys(low: np.ndarray, start: np.ndarray, end: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines whose key has ``min_chars`` code points or more: index, and their keys' starts, ends and hashes. low: lower-cased bytes."""
    solid = np.flatnonzero(~SEPARATOR[low])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    chosen = np.flatnonzero(b - a > 0)
    begin, stop = solid[a[chosen]], solid[b[chosen] - 1] + 1
    points = np.append(0, np.cumsum((low & 0xC0) != 0x80))
    long = points[stop] - points[begin] >= min_chars
    chosen, begin, stop = chosen[long], begin[long], stop[long]
    return chosen, begin, stop, signed(word_hashes(low, begin, stop))


def _hashed(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, kind, id): the distinct hashes of each document's long keys."""
    held: list[tuple[np.ndarray, pa.Array]] = []
    n = 0
    for batch in batches:
        raw, offsets = buffer_of(batch.column(1))
        for low_row, _, part, own in slices(raw, offsets):
            low = lowered(part)
            start, end, first = lines_of(low, own)
            line, _, _, h = long_keys(low, start, end, min_chars)
            row = np.searchsorted(first, line, "right") - 1
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            held.append((h[new], batch.column(0).take(pa.array(row[new] + low_row))))
            n += int(new.sum())
        if n >= HELD_KEYS:
            yield settled(np.concatenate([x for x, _ in held]), {"id": pa.concat_arrays([x for _, x in held])})
            held, n = [], 0
    if n:
        yield settled(np.concatenate([x for x, _ in held]), {"id": pa.concat_arrays([x for _, x in held])})
    held = []
    trimmed()


def _lines(batches: Iterator[pa.RecordBatch], min_chars: int, chosen) -> Iterator[pa.RecordBatch]:
    """Rows (id, key): the long keys, if given only those of chosen hashes, of each document."""
    for batch in batches:
        raw, offsets = buffer_of(batch.column(1))
        for low_row, _, part, own in slices(raw, offsets):
            low = lowered(part)
            start, end, first = lines_of(low, own)
            line, begin, stop, h = long_keys(low, start, end, min_chars)
            if chosen is not None:
                keep = chosen.value.has(h)
                line, begin, stop = line[keep], begin[keep], stop[keep]
            flat = low.tobytes()
            rows = np.searchsorted(first, line, "right") - 1 + low_row
            keys = pa.array([flat[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), keys], names=["id", "key"])


def shared_keys(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_hashes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows: (id, text). The staged table (key, keeper) of the keys that lose lines, and that of suspected lines (id, key)."""
    kind = rows.schema["id"].dataType.simpleString()
    hashed = staged(rows.mapInArrow(lean(lambda b: _hashed(b, min_chars)), f"h long, kind int, id {kind}"), "line-hashes")
    suspects = staged(twice_seen(hashed), "line-suspects")
    released(hashed)
    chosen = small_set(suspects.select("h"), broadcast_hashes)
    texts = rows
    if chosen is None:
        ids = suspects.select(F.col("id").alias("suspect")).distinct()
        texts = rows.join(ids, F.col("id").eqNullSafe(F.col("suspect")), "left_semi")
    lines = staged(texts.mapInArrow(lean(lambda b: _lines(b, min_chars, chosen)), f"id {kind}, key string"), "lines")
    released(suspects)
    if chosen is not None:
        chosen.destroy()
    # one row for each document and key, then sums that are combined before they are dealt out
    each = lines.groupBy("key", "id").agg(F.lit(1).alias("one"))
    shared = each.groupBy("key").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).filter(F.col("docs") >= min_docs)
    return staged(shared.select("key", "keeper"), "line-shared", lines.count()), lines


def _applied(batches: Iterator[pa.RecordBatch], min_chars: int, keepers, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Columns: row, id, text and, if no keepers are given, the keys that the document loses."""
    known = None if keepers is None else keepers.value
    hashes = Chosen(np.zeros(0, np.int64))
    if known:
        raw, offsets = buffer_of(pa.array(list(known), pa.large_binary()))
        filled = [np.zeros(0, np.int64)] + [signed(word_hashes(part, own[:-1], own[1:])) for _, _, part, own in slices(raw, offsets)]
        hashes = Chosen(np.concatenate(filled))
    for batch in batches:
        raw, offsets = buffer_of(batch.column(2))
        n, gone, digests, texts = [], [], [], []
        for low_row, high_row, part, own in slices(raw, offsets):
            low = lowered(part)
            start, end, first = lines_of(low, own)
            line, begin, stop, h = long_keys(low, start, end, min_chars)
            row = np.searchsorted(first, line, "right") - 1
            drop = np.zeros(len(start), bool)
            flat = part.tobytes()
            under = low.tobytes()
            if known is not None:
                maybe = np.flatnonzero(hashes.has(h))
                ids = batch.column(1).take(pa.array(row[maybe] + low_row)).to_pylist()
                for i, own_id in zip(maybe.tolist(), ids, strict=True):
                    key = under[begin[i] : stop[i]]
                    drop[line[i]] = key in known and known[key] != own_id
            else:
                for i in range(low_row, high_row):
                    if keys := {x.encode() for x in batch.column(3)[i].as_py() or ()}:
                        for j in np.flatnonzero(row == i - low_row).tolist():
                            drop[line[j]] = under[begin[j] : stop[j]] in keys
            lost = np.add.reduceat(drop, first[:-1], dtype=np.int64)
            n.append(np.diff(first))
            gone.append(lost)
            for i, k in enumerate(lost.tolist()):
                kept = flat[own[i] : own[i + 1]]
                if k:
                    kept = b"\n".join([flat[start[j] : end[j]] for j in range(first[i], first[i + 1]) if not drop[j]])
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept)
        if n:
            columns = [batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(gone), pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                kept = pa.array(texts, pa.binary()).cast(pa.string())
                columns.append(pa.compute.if_else(batch.column(2).is_null(), pa.nulls(len(kept), pa.string()), kept))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_lines", "n_dropped", "kept_sha256", "kept"][: 4 + with_text])


def line_dedup(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = True, broadcast_hashes: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """All rows with their other columns in a struct ``row``, and n_lines, n_dropped, kept_sha256 and, on request,
    ``kept``: the text that is left, null where there was none."""
    spark = frame.sparkSession
    small_batches(spark)
    others = [F.col(f"`{c}`") for c in frame.columns if c != text_column]
    rows = packed(frame).select(F.struct(*others).alias("row"), F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    shared, lines = shared_keys(rows.select("id", "text"), min_chars, min_docs, broadcast_hashes)
    size = shared.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("bytes")).first()
    keepers = None
    if size["n"] <= broadcast_keys and size["bytes"] <= BROADCAST_BYTES:
        keepers = spark.sparkContext.broadcast({r["key"].encode(): r["keeper"] for r in shared.toLocalIterator()})
        released(shared, lines)
    else:
        hit = lines.join(shared, "key").filter(~F.col("id").eqNullSafe(F.col("keeper")))
        gone = staged(hit.groupBy(F.col("id").alias("gone_id")).agg(F.collect_set("key").alias("keys")), "line-dropped")
        released(shared, lines)
        rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left").select("row", "id", "text", "keys")
    swept(spark)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * with_text
    return rows.mapInArrow(lean(lambda b: _applied(b, min_chars, keepers, with_text)), schema)
