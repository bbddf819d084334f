"""Removal of word passages that occur more than once, by compacting a de Bruijn graph of word windows.

Words are unchanged runs of other bytes than space and 0x09 to 0x0D. A window is ``window`` consecutive words
of one document. Every word covered by a window whose words also start anywhere else, in the same document
too, is removed; windows are judged on the input.

1. A pass names each document's whole word sequence by a hash, so equal documents are one source from here on,
   and picks minimizers: in each window the ``k``-word gram with the smallest hash. Equal windows pick equal
   grams, so a window can only recur if a twice-seen filter knows its minimizer; most text ends here.
2. The suspected windows are the edges of a de Bruijn graph (they join their first and last window - 1 words),
   each with 128 bits of hashes and its source coordinate: source and position. Their minimizers are broadcast if
   they are few, else joined to the texts by source. A task settles the edges that recur among its own
   and sends one witness of each, so an edge that a third of all documents hold is no large group anywhere.
   The others are dealt out by their hash; an edge at two different coordinates is repeated.
3. Repeated edges that follow each other in a source, with nothing else between them, are a nonbranching path
   and are compacted into one span; a source keeps few spans.
4. Spans are joined with the texts by source, and applied to the words at their coordinates.

Null and empty texts have no words and keep the empty text. Documents of fewer words than a window lose
nothing. Repeated rows, with equal ids or not, are occurrences of their own and so repeats of each other; there are no
ties, as all occurrences of a window are treated alike. Very long texts are read whole. An empty table gives an empty
one. Only the id and the text are read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import buffer_of, gram_hashes, packed, released, sequence_hashes, signed, slices, small_batches, staged, swept, trimmed, word_hashes, words
from veritab.llm._filters import HELD_KEYS, Chosen, flat_longs, settled, small_set, twice_seen

WINDOW, K = 35, 12
#: Edges that a task compares with each other before it passes them on.
HELD_EDGES = 1 << 18
GRAM_SEED, SOURCE_SEED = 1, 2


def sources(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    return signed(sequence_hashes(hashes, first[:-1], first[1:], SOURCE_SEED))


def minimizers(hashes: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows: the word each starts at, its minimizer's hash and place (the first of equal ones); and the rows' bounds."""
    span = window - k + 1  # grams in a window
    counts = np.maximum(np.diff(first) - window + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not bounds[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    # grams are hashed across rows; windows that leave their row are not used
    least = gram_hashes(hashes, k, GRAM_SEED)
    place = np.arange(len(least))
    width = 1
    while width < span:
        step = min(width, span - width)
        right = least[step:] < least[:-step]
        least = np.where(right, least[step:], least[:-step])
        place = np.where(right, place[step:], place[:-step])
        width += step
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) + np.repeat(first[:-1], counts)
    return start, least[start], place[start], bounds


def joined_hashes(raw: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[str]:
    """SHA-256 of each row's kept words, joined by one space."""
    place = np.zeros(len(raw) + 1, np.int64)
    chosen = np.flatnonzero(kept)
    np.add.at(place, start[chosen], 1)
    np.add.at(place, end[chosen], -1)
    stays = np.cumsum(place[:-1]) > 0
    out = raw.copy()
    row = np.searchsorted(first, chosen, "right") - 1
    follows = np.flatnonzero(row[:-1] == row[1:])  # kept words after which another one of the row is kept
    gaps = end[chosen[follows]]
    stays[gaps] = True
    out[gaps] = 32
    cuts = np.concatenate([[0], np.cumsum(stays)])[offsets]
    flat = out[stays].tobytes()
    return [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _profiles(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, kind, source) of the distinct minimizers of each source, and (source, docs): how many documents it has.

    A task tells a source's minimizers once.
    """
    docs: Counter[int] = Counter()
    told: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        if held:
            made = settled(np.concatenate([x for x, _ in held]), {"source": pa.array(np.concatenate([x for _, x in held]))})
            yield made.append_column("docs", pa.nulls(made.num_rows, pa.int64()))
        if docs:
            size = len(docs)
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.int32()), pa.array(list(docs), pa.int64()), pa.array(list(docs.values()), pa.int64())], names=["h", "kind", "source", "docs"])
        held.clear()
        docs.clear()

    for batch in batches:
        raw, offsets = buffer_of(batch.column(0))
        for _, _, part, own in slices(raw, offsets):
            start, end, first = words(part, own)
            hashes = word_hashes(part, start, end)
            names = sources(hashes, first)
            _, least, place, bounds = minimizers(hashes, first, window, k)
            long = np.diff(bounds) > 0
            docs.update(names[long].tolist())
            fresh = np.zeros(len(names), bool)
            for i in np.flatnonzero(long).tolist():
                if (name := int(names[i])) not in told:
                    told.add(name)
                    fresh[i] = True
            row = np.repeat(np.arange(len(names)), np.diff(bounds))
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            new &= fresh[row]
            h, row = signed(least[new]), row[new]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            second = ~new  # a source that has a minimizer twice is a suspect by itself
            second[1:] &= new[:-1]
            keep = new | second
            held.append((h[keep], names[row[keep]]))
            n += int(keep.sum())
        if n >= HELD_KEYS:
            yield from flushed()
            n = 0
            if len(told) > HELD_KEYS:
                told.clear()
    yield from flushed()
    told = set()
    trimmed()


def _flushed(h: np.ndarray, check: np.ndarray, source: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Edges that a task holds. What recurs among them needs no shuffle, but for one witness for the other tasks.

    kind: 0 unknown, 1 repeated and the witness of its edge, 2 repeated.
    """
    order = np.lexsort((at, source, check, h))
    h, check, source, at = h[order], check[order], source[order], at[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
    repeated, witness = same[:-1] | same[1:], ~same[:-1]
    kind = np.where(repeated, np.where(witness, 1, 2), 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(check)), pa.array(source), pa.array(at), pa.array(kind)], names=["h", "check", "source", "at", "kind"])


def _edges(batches: Iterator[pa.RecordBatch], window: int, k: int, chosen) -> Iterator[pa.RecordBatch]:
    """Rows (h, check, source, at, kind) of the windows that may recur; a task tells a source once.

    chosen: the suspected minimizers; without them, each text comes with those of its source in a second column.
    """
    told: set[int] = set()
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        raw, offsets = buffer_of(batch.column(0))
        for low_row, high_row, part, own in slices(raw, offsets):
            start, end, first = words(part, own)
            hashes = word_hashes(part, start, end)
            names = sources(hashes, first)
            begin, least, _, bounds = minimizers(hashes, first, window, k)
            if not len(begin):
                continue
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            known = chosen.value if chosen is not None else Chosen(flat_longs(batch.column(1).slice(low_row, high_row - low_row)))
            suspect = known.has(signed(least[new]))[np.cumsum(new) - 1]
            row = np.repeat(np.arange(len(names)), np.diff(bounds))
            fresh = np.zeros(len(names), bool)
            for i in np.unique(row[suspect]).tolist():
                if (name := int(names[i])) not in told:
                    told.add(name)
                    fresh[i] = True
            at = begin[np.flatnonzero(suspect & fresh[row])]
            if len(at):
                row = np.searchsorted(first, at, "right") - 1
                check = gram_hashes(word_hashes(part, start, end, second=True), window)[at]
                held.append((gram_hashes(hashes, window)[at], check, names[row], (at - first[row]).astype(np.int32)))
                n += len(at)
        if n >= HELD_EDGES:
            yield _flushed(*[np.concatenate(x) for x in zip(*held, strict=True)])
            held, n = [], 0
            if len(told) > HELD_KEYS:  # only here: no coordinate may come twice among the edges of one flush
                told.clear()
    if n:
        yield _flushed(*[np.concatenate(x) for x in zip(*held, strict=True)])
    held, told = [], set()
    trimmed()


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, at) of the unknown edges that lie at two coordinates. Comes sorted by h, check, source, at.

    Only an edge's first coordinate is held, so an edge may have any number of rows.
    """
    edge, first, several, waiting = None, None, False, False
    for batch in batches:
        h, check, source, at, kind = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(5))
        if not len(h):
            continue
        begins = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
        ends = np.append(begins[1:], len(h))
        continued = edge is not None and (h[0], check[0]) == edge
        extra: list[tuple[int, int]] = []
        # rows of an edge are sorted, so two coordinates show in its first and last row; a witness stands for two
        multi = (source[begins] != source[ends - 1]) | (at[begins] != at[ends - 1]) | np.logical_or.reduceat(kind == 1, begins)
        if continued:
            multi[0] |= several or (source[0], at[0]) != first
            if multi[0] and waiting:
                extra.append(first)
                waiting = False
        out = np.repeat(multi, ends - begins) & (kind == 0)
        a = begins[-1]
        if not (continued and len(begins) == 1):
            edge, first, several, waiting = (h[-1], check[-1]), (source[a], at[a]), False, False
        several = bool(multi[-1])
        if not several:
            waiting = waiting or bool((kind[a:] == 0).any())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array([x[0] for x in extra], np.int64), source[out]])), pa.array(np.concatenate([np.array([x[1] for x in extra], np.int32), at[out]]))], names=["source", "at"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (source, spans): neighbouring repeated edges of a source compacted to (at, length)."""
    kind = pa.struct([("at", pa.int32()), ("length", pa.int32())])
    for batch in batches:
        sizes = np.asarray(batch.column(1).value_lengths())
        at = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False))
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((at, row))
        at, row = at[order], row[order]
        head = np.ones(len(at), bool)
        head[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        begins = np.flatnonzero(head)
        lengths = np.diff(np.append(begins, len(at))).astype(np.int32)
        places = np.searchsorted(row[begins], np.arange(len(sizes) + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(at[begins], pa.int32()), pa.array(lengths, pa.int32())], fields=list(kind))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(places), spans)], names=["source", "spans"])


def repeated_spans(texts: DataFrame, window: int, k: int, broadcast_hashes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """texts: a string column. Rows (source, spans): for each source its repeated spans of windows (at, length); and
    rows (source, copies) of the sources with several documents."""
    profiles = staged(texts.mapInArrow(lambda b: _profiles(b, window, k), "h long, kind int, source long, docs long"), "minimizers")
    n = profiles.filter("docs is not null").count()
    copies = staged(profiles.filter("docs is not null").groupBy("source").agg(F.sum("docs").alias("copies")).filter("copies > 1"), "copies", n)
    suspects = staged(twice_seen(profiles.filter("docs is null").drop("docs")), "suspects")
    released(profiles)
    chosen = small_set(suspects.select("h"), broadcast_hashes)
    if chosen is None:
        each = texts.mapInArrow(lambda b: (x.select(["text", "source"]) for x in _named(b, at=0)), "text string, source long").dropDuplicates(["source"])
        texts = each.join(suspects.groupBy("source").agg(F.collect_set("h").alias("hs")), "source").select("text", "hs")
    edges = staged(texts.mapInArrow(lambda b: _edges(b, window, k, chosen), "h long, check long, source long, at int, kind int"), "windows")
    released(suspects)
    if chosen is not None:
        chosen.destroy()
    swept(edges.sparkSession)
    dealt = edges.filter("kind < 2").repartition("h").sortWithinPartitions("h", "check", "source", "at")
    repeated = dealt.mapInArrow(_resolved, "source long, at int").unionByName(edges.filter("kind > 0").select("source", "at"))
    grouped = repeated.groupBy("source").agg(F.collect_set("at").alias("ats"))
    spans = staged(grouped.mapInArrow(_paths, "source long, spans array<struct<at: int, length: int>>"), "spans", n)
    released(edges)
    return spans, copies


def _named(batches: Iterator[pa.RecordBatch], seen=None, at: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows and their source; with a set of sources, only those in it. at: the column of the text."""
    for batch in batches:
        raw, offsets = buffer_of(batch.column(at))
        names = [np.zeros(0, np.int64)]
        for _, _, part, own in slices(raw, offsets):
            start, end, first = words(part, own)
            names.append(sources(word_hashes(part, start, end), first))
        source = np.concatenate(names)
        made = batch.append_column("source", pa.array(source))
        yield made if seen is None else made.filter(pa.array(seen.value.has(source)))


def _untouched(batches: Iterator[pa.RecordBatch], seen, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Results of the other rows, which keep all their words."""
    for batch in _named(batches):
        rest = batch.filter(pa.array(~seen.value.has(np.asarray(batch.column(2)))))
        nulls = [pa.nulls(rest.num_rows, pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32())]))), pa.nulls(rest.num_rows, pa.int64())]
        plain = pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), *nulls], names=["row", "text", "spans", "copies"])
        yield from _applied(iter([plain]), 1, with_text)


def _applied(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffer_of(batch.column(1))
        spans, copies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n, removed, digests, texts = [], [], [], []
        for low, high, part, own in slices(raw, offsets):
            start, end, first = words(part, own)
            kept = np.ones(len(start), bool)
            for i in range(low, high):
                a, b = first[i - low], first[i - low + 1]
                if (copies[i] or 0) > 1 and b - a >= window:
                    kept[a:b] = False
                for x in spans[i] or ():
                    kept[a + x["at"] : min(b, a + x["at"] + x["length"] + window - 1)] = False
            gone = np.concatenate([[0], np.cumsum(~kept)])
            n.append(np.diff(first))
            removed.append(gone[first[1:]] - gone[first[:-1]])
            digests += joined_hashes(part, own, start, end, first, kept)
            if with_text:
                flat = part.tobytes()
                texts += [" ".join(flat[start[j] : end[j]].decode() for j in np.flatnonzero(kept[first[i] : first[i + 1]]) + first[i]) for i in range(high - low)]
        if n:
            columns = [batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts)] if with_text else [])], names=["row", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])


def substring_dedup(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, k: int = K, with_text: bool = True, broadcast_hashes: int | None = None) -> DataFrame:
    """Per row: the id, n_words, n_removed, kept_sha256 and, on request, the kept words joined by one space."""
    small_batches(frame.sparkSession)
    rows = packed(frame).select(F.struct(F.col(id_column).alias("id")).alias("row"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    spans, copies = repeated_spans(rows.select("text"), window, k, broadcast_hashes)
    known = staged(spans.join(copies, "source", "full"), "known", spans.count() + copies.count())
    released(spans, copies)
    swept(frame.sparkSession)
    # only texts that lose words are shuffled, or all if the sources that lose some are too many to be broadcast
    seen = small_set(known.select("source"), broadcast_hashes)
    schema = f"row {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    touched = rows.mapInArrow(lambda b: _named(b, seen), f"row {kind}, text string, source long").join(known.hint("merge"), "source", "left").select("row", "text", "spans", "copies")
    out = touched.mapInArrow(lambda b: _applied(b, window, with_text), schema)
    if seen is not None:
        out = out.unionByName(rows.mapInArrow(lambda b: _untouched(b, seen, with_text), schema))
    return out.select(F.col("row.id").alias(id_column), "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)
