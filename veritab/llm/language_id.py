"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language, a raw-content zstandard dictionary is filled with text of a bounded sample of labelled
documents. A text is lower-cased, all but its letters becomes single spaces, and it is cut into blocks of
``block_chars`` characters: later blocks would otherwise be explained by the text's own start instead of by
the dictionary. Every block of the whole text is compressed with every dictionary, and the sizes are summed.

A prediction is rejected if there is no language or if the sizes of the best two are closer than ``least_margin``.

Null texts, and texts without a letter, are ``und`` with score 0. Equal sizes go to the language with
more labelled rows, then to the first in the alphabet, and are rejected. Very long texts are compressed block by block.
Repeated rows are predicted each on its own. If no labelled row is left to learn from, every text is ``und``; with one
language, every text with a letter is of it. An empty table gives an empty one. Columns that are carried along keep
their names, whatever these are; others are left out. Null ids are ids like any other, and not held out.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm._core import lean, small_batches

#: Bounds of the sample that dictionaries are made of: documents of each language, pieces of each document and their
#: characters, bytes of a dictionary.
SAMPLE_DOCS, PIECES, PIECE_CHARS, DICTIONARY_BYTES = 120, 8, 256, 1 << 17
BLOCK_CHARS, LEVEL = 2_048, 3
#: A text is rejected below this relative gap between the smallest and the second smallest size.
LEAST_MARGIN = 0.01
UNDETERMINED = "und"
OTHER = re.compile(r"[\W\d_]+")


def held_out(id_column: str, parts: int = 3, part: int = 1) -> Column:
    """Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def pieces_of(text: Column, pieces: int = PIECES, chars: int = PIECE_CHARS) -> Column:
    """Pieces of a text, evenly spaced from its first to its last character; the whole of a shorter text."""
    n = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, F.floor(i * (n - chars) / (pieces - 1)).cast("int") + 1, F.lit(chars)))
    return F.when(n <= pieces * chars, F.array(text)).otherwise(cut)


def letters(text: str | None) -> str:
    """Lower-case letters, with one space for whatever else stands between them."""
    return OTHER.sub(" ", text.lower()).strip() if text else ""


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Compressors:
    """dictionaries: in the order in which equal sizes are decided."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block_chars: int = BLOCK_CHARS):
        self.block = block_chars
        self.by_language = []
        for name in dictionaries:
            held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.by_language.append((name, zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def sizes(self, text: str) -> list[int]:
        blocks = [text[i : i + self.block].encode() for i in range(0, len(text), self.block)]
        return [sum([len(c.compress(x)) for x in blocks]) for _, c in self.by_language]

    def predict(self, raw: str | None) -> tuple[str, float, float]:
        """Language, score and margin."""
        text = letters(raw)
        if not self.by_language or not has_letter(text):
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min([x for i, x in enumerate(sizes) if i != best], default=None)
        if second is None:
            return self.by_language[best][0], 1.0, 1.0
        # the share of the best among two votes that fall with the 20th power of the size
        return self.by_language[best][0], 1 / (1 + (sizes[best] / second) ** 20), 1 - sizes[best] / second


def build(samples: dict[str, list[list[str]]], dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each language from the pieces of its documents: the first of each, then the second of each, and
    so on until it is full. A second round leaves out documents that the first one gives to another language."""

    def filled(kept: dict[str, list[list[str]]]) -> dict[str, bytes]:
        made = {}
        for name, docs in kept.items():
            parts, left = [], dictionary_bytes
            for pieces in itertools.zip_longest(*docs):
                for x in map(letters, pieces):
                    if x and len(part := x.encode() + b" ") <= left:
                        parts.append(part)
                        left -= len(part)
            made[name] = b"".join(reversed(parts))  # what stands last is the cheapest to point to
        return {k: v for k, v in made.items() if len(v) >= 8}

    first = Compressors(filled(samples))
    kept = {name: [x for x in docs if first.predict(" ".join(x))[0] == name] or docs for name, docs in samples.items()}
    return filled(kept)


def learn(frame: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionaries from rows that are ``usable`` and have a label: about ``sample_docs`` of each label, by a hash of id
    and text.

    One pass counts the rows of each label; a second one reads the chosen rows and brings PIECES pieces each of at most
    2 * sample_docs texts a label to the driver, from all over the text: those of the smallest hashes, however many rows
    share an id.
    """
    rows = frame.select(F.col(id_column).cast("string").alias("i"), F.col(label_column).alias("l"), F.col(text_column).cast("string").alias("t"), F.coalesce(usable, F.lit(False)).alias("u")).filter("u and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    unit = 1 << 20
    share = F.lit(unit)
    for name, n in counts.items():
        share = F.when(F.col("l") == name, F.lit(min(unit, unit * 3 * sample_docs // (2 * n) + 1))).otherwise(share)
    # copies have one hash: no more of them than the sample's size pass, task by task
    order = F.pmod(F.xxhash64("i", "t"), F.lit(unit))
    chosen = rows.filter("t is not null").withColumn("o", order).filter(F.col("o") < share).select("l", "o", F.coalesce("i", F.lit("")).alias("i"), pieces_of(F.col("t")).alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("o", "i", "t"))
    chosen = chosen.withColumn("place", place).filter(F.col("place") <= 2 * sample_docs)
    samples: dict[str, list[list[str]]] = {}
    for r in sorted(chosen.select("l", "i", "t").toLocalIterator(), key=lambda r: (r["l"], len(r["i"]), r["i"], r["t"])):
        samples.setdefault(r["l"], []).append(r["t"])
    ordered = sorted(samples, key=lambda name: (-counts[name], name))
    return build({name: samples[name] for name in ordered})


def language_id(frame: DataFrame, dictionaries: dict[str, bytes], id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), level: int = LEVEL, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: the id, lang_pred, score, margin, and the columns to ``carry`` along unchanged."""
    small_batches(frame.sparkSession)
    held = frame.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(held.value, level, block_chars)
        for batch in batches:
            made = [compressors.predict(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in made], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *[batch.column(1)] * with_text], names=["row", "lang_pred", "score", "margin", "text"][: 4 + with_text])

    with_text = text_column in carry  # once, beside the others
    row = F.struct(F.col(id_column).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if c != text_column])
    texts = frame.select(row.alias("row"), F.col(text_column).cast("string").alias("text"))
    made = texts.mapInArrow(lean(run), f"row {texts.schema['row'].dataType.simpleString()}, lang_pred string, score double, margin double" + ", text string" * with_text)
    carried = [F.col("text" if c == text_column else f"row.c{i}").alias(c) for i, c in enumerate(carry)]
    return made.select(F.col("row.id").alias(id_column), "lang_pred", "score", "margin", *carried)


def rejected(pred: str = "lang_pred", margin: str = "margin", least_margin: float = LEAST_MARGIN) -> Column:
    """Whether a prediction is unusable: no language, or too narrow a margin."""
    return (F.col(pred) == UNDETERMINED) | (F.col(margin) < least_margin)
