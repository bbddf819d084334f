"""Token counts of whole texts under a byte-level BPE vocabulary.

A document of more than ``chunk_chars`` characters is encoded in overlapping chunks, so memory and the cost of
one call stay bounded. Two neighbouring encodings are spliced at a boundary in their overlap that is proven
stable: the point between a letter and a following white space character. No piece of the pre-tokenizer
contains a letter directly followed by white space, and no special string contains white space, so every
encoding of every text that holds these two characters has a token boundary there, and what follows doesn't
depend on what comes before. Both encodings must show that boundary in their offsets; where the overlap has
none, or they disagree, the overlap doubles, up to the whole rest of the text.

A run of white space that would exhaust the pre-tokenizer's stack is one piece, without its last character if something
other than white space follows in the same stretch between special strings; such pieces are cut out before the pattern
sees them and encoded on their own.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows, and rows with one id, are counted each on its own; no
tie can arise. An empty table gives an empty one. Only the id and the text are read, so extra columns may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import small_batches

CHUNK_CHARS, OVERLAP_CHARS, LIMIT = 32_768, 512, 512

#: The pre-tokenizer's pattern and the special token of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}

STABLE = re.compile(r"[^\W\d_](?=\s)")
#: Longer runs of white space (a fixed set of characters) are kept from the pattern, which backtracks over each of them.
LONG_RUN = 100_000
LONG_SPACE = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")


class Counter:
    """Counts and lists tokens with the ranks of a vocabulary file (lines of base64 bytes and rank).

    special: whether special strings inside texts are tokens; else they are text like any other.
    """

    def __init__(self, ranks: bytes, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, special: bool = True):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.special = SPECIAL if special else {}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens=self.special)
        self.piece = tiktoken.Encoding("byte_bpe_piece", pat_str="(?s:.+)", mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max([*table.values(), *SPECIAL.values()]) + 1, np.int64)
        for token, rank in [*table.items(), *self.special.items()]:
            self.lengths[rank] = len(token)
        self.chunk, self.overlap = chunk_chars, overlap_chars

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, encoded in one go."""
        if len(text) < LONG_RUN or not LONG_SPACE.search(text):
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        found = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]:
            at = 0
            if part not in self.special:
                for run in LONG_SPACE.finditer(part):
                    to = run.end() if run.end() == len(part) else run.end() - 1
                    found += [self.encoding.encode_to_numpy(part[at : run.start()], allowed_special="all"), self.piece.encode_to_numpy(part[run.start() : to])]
                    at = to
            found.append(self.encoding.encode_to_numpy(part[at:], allowed_special="all"))
        return np.concatenate(found)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets after 0, 1, 2 ... tokens."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text of any length."""
        return np.concatenate([np.zeros(0, np.uint32), *self.parts(text)])

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a whole text, chunk by chunk."""
        start = 0  # the character at which the text still has to be encoded
        while len(text) - start > self.chunk:
            end = start + self.chunk
            ids, overlap, joined = self.ids(text[start:end]), self.overlap, None
            while joined is None and end < len(text):
                joined = self._splice(text, start, end, self.ends(ids), overlap)
                if joined is None and overlap >= end - start:  # nothing stable in the chunk: encode a longer one
                    end = min(len(text), start + 2 * (end - start))
                    ids, overlap = self.ids(text[start:end]), self.overlap
                elif joined is None:
                    overlap = min(2 * overlap, end - start)
            if joined is None:
                yield ids
                return
            yield ids[: joined[0]]
            start = joined[1]
        if start < len(text):
            yield self.ids(text[start:])

    def _splice(self, text: str, start: int, end: int, ends: np.ndarray, overlap: int) -> tuple[int, int] | None:
        """Tokens of text[start:end] before a stable boundary in its last ``overlap`` characters, and that boundary.

        The right encoding starts at the overlap's own begin; it is compared with the left one by offset.
        """
        begin = max(start, end - overlap)
        places = [m.end() + begin for m in STABLE.finditer(text[begin : end - 1])]
        if not places:
            return None
        right = self.ends(self.ids(text[begin:end]))
        base = len(text[start:begin].encode())
        for place in reversed(places):
            if place <= start:
                continue
            inner = len(text[begin:place].encode())
            i, j = np.searchsorted(ends, base + inner), np.searchsorted(right, inner)
            if i < len(ends) and ends[i] == base + inner and j < len(right) and right[j] == inner:
                return int(i), place
        return None


def token_counts(frame: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    vocabulary: path of the rank file on the driver; its contents, a fixed size, are broadcast.
    """
    spark = frame.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    kind = frame.schema[id_column].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value, chunk_chars, overlap_chars)
        for batch in batches:
            n = pa.array([counter.count(x) if x else 0 for x in batch.column(1).to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    texts = frame.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    made = texts.mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return made.withColumnRenamed("id", id_column)
