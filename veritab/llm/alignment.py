"""Alignment of two tokenizers over whole texts: groups, links, and how often linked ids meet in the corpus.

Each text is encoded by a byte-level vocabulary (A, which gets the text behind a space) and by a piece vocabulary (B,
which adds that space itself). Both then cut the same bytes. In Arrow batches, the cumulative byte ends of both are
merged: where both end, a group ends, and every stretch between two neighbouring ends is the overlap of one A token with
one B token, a link. Each document's distinct linked id pairs are staged with it. Spark counts the documents of each
pair, takes the maximum of each A and each B id, and joins both back; the counts, one row for each distinct pair, are
broadcast if they are at most ``broadcast_pairs``, and shuffled otherwise.

B encodes long texts in parts that begin behind a space after another character: no piece of B holds a space behind
another character (checked), so no merge crosses that place, and the space that B puts before a part is the one left out.

Texts that are null or empty, or whose A or B tokens don't spell a space and the text, have no tokens: zeros and an
empty string for the digest. Very long texts are encoded in parts; memory grows with their number of tokens. Ids that
tie for the highest count are all best. Repeated rows, and rows with one id, are documents of their own. An empty table
gives an empty one. Only the id and the text are read, so extra columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import small_batches, staged
from veritab.llm.bpe import spread
from veritab.llm.token_counts import Counter

#: Characters of a part of a text that B encodes at once, and bytes of texts that are merged at once.
PART_CHARS, SLICE_BYTES = 1 << 16, 1 << 20
#: Distinct pairs up to which their counts are broadcast (some 32 bytes each).
BROADCAST_PAIRS = 1 << 20
SPACE = "▁"


class Pieces:
    """The piece vocabulary: ids of texts, and the bytes of each id."""

    def __init__(self, model: bytes, part_chars: int = PART_CHARS):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.processor.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.part = part_chars if not any(SPACE in x.lstrip(SPACE) for x in names) else None

    def encode(self, text: str) -> np.ndarray:
        found, at = [], 0
        while self.part and len(text) - at > self.part:
            to = at + self.part
            while to < len(text) and not (text[to] == " " and text[to - 1] != " "):
                to += 1
            if to == len(text):
                break
            found.append(self.processor.encode(text[at:to], num_threads=1))
            at = to + 1
        found.append(self.processor.encode(text[at:], num_threads=1) if at < len(text) else [])
        if at and at == len(text):  # the space left out is the last character
            found[-1] = [self.processor.piece_to_id(SPACE)]
        return np.concatenate([np.asarray(x, np.int64) for x in found])


def table_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings one after the other, where each begins, and their sizes."""
    sizes = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


class Aligner:
    def __init__(self, ranks: bytes, model: bytes, part_chars: int = PART_CHARS):
        self.a, self.b = Counter(ranks, special=False), Pieces(model, part_chars)
        self.lengths_a = self.a.lengths
        self.bytes_b = table_of(self.b.bytes)
        #: Decimal ids, as they stand before another id of their side, and as the last one of their side in a group.
        self.shown_a = table_of([f"{i}{c}".encode() for c in ",|" for i in range(len(self.a.lengths))])
        self.shown_b = table_of([f"{i}{c}".encode() for c in ",;" for i in range(len(self.b.bytes))])
        #: A pair of ids as one number, a * step + b.
        self.step = len(self.b.bytes)
        self.pair_kind = "int" if len(self.a.lengths) * self.step < 1 << 31 else "long"

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None if there are none that spell a space and the text."""
        if not text:
            return None
        spelled = f" {text}".encode()
        a, b = self.a.encode(f" {text}"), self.b.encode(text)
        flat, begin, sizes = self.bytes_b
        if int(sizes[b].sum()) != len(spelled) or spread(flat, begin, sizes, b)[0].tobytes() != spelled or int(self.lengths_a[a].sum()) != len(spelled):
            return None
        return a, b

    def aligned(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, list]:
        """Per document: n_a, n_b, n_groups, n_links, the text of its groups, its distinct pairs and how often each occurs."""
        a, b = (np.concatenate([np.zeros(0, np.int64), *[t[k] for t in tokens]]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.bytes_b[2][b])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        # where both end; the ends of documents are among them
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        ends = np.union1d(end_a, end_b)
        document_end = end_a[last_a - 1] if len(tokens) else np.zeros(0, np.int64)
        group_of_a, group_of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        groups = np.searchsorted(common, document_end) + 1
        links = np.searchsorted(ends, document_end) + 1
        # the tokens of both sides in the order in which they are shown: of each group A, then B
        first_of_group = lambda group: np.append(0, np.flatnonzero(np.diff(group)) + 1)
        begin_a, begin_b = (first_of_group(x) if len(x) else np.zeros(0, np.int64) for x in (group_of_a, group_of_b))
        place_a = np.arange(len(a)) + begin_b[group_of_a]
        place_b = np.arange(len(b)) + (begin_a + np.diff(np.append(begin_a, len(a))))[group_of_b]
        ends_group_a, ends_group_b = np.append(np.diff(group_of_a) > 0, True)[: len(a)], np.append(np.diff(group_of_b) > 0, True)[: len(b)]
        both = [np.concatenate([x, y]) for x, y in zip(self.shown_a[1:], self.shown_b[1:], strict=True)]
        both[0][len(self.shown_a[1]) :] += len(self.shown_a[0])
        name = np.empty(len(a) + len(b), np.int64)
        name[place_a] = a + ends_group_a * len(self.a.lengths)
        name[place_b] = b + ends_group_b * self.step + len(self.shown_a[1])
        flat, at = spread(np.concatenate([self.shown_a[0], self.shown_b[0]]), *both, name)
        flat, at = flat.tobytes(), at[np.append(0, last_a + last_b)].tolist()
        # links: what stands in each stretch between neighbouring ends
        code = a[np.searchsorted(end_a, ends)] * self.step + b[np.searchsorted(end_b, ends)] if len(ends) else np.zeros(0, np.int64)
        top = len(self.a.lengths) * self.step
        keys, times = np.unique(np.repeat(np.arange(len(tokens)), np.diff(np.append(0, links))) * top + code, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, len(tokens)) * top)
        return {
            "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": np.diff(np.append(0, groups)).tolist(), "n_links": np.diff(np.append(0, links)).tolist(),
            "groups": [flat[x : y - 1] for x, y in zip(at[:-1], at[1:], strict=True)],
            "pairs": np.split(keys % top, cuts) if tokens else [], "times": np.split(times, cuts) if tokens else [],
        }


def linked(frame: DataFrame, ranks: str, model: str, id_column: str = "doc_id", text_column: str = "text", outputs: bool = True) -> tuple[DataFrame, int]:
    """Rows (id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times), and the factor of A ids in pairs.

    pairs: a document's distinct linked pairs, as a * factor + b; times: how often each is linked. outputs: False leaves
    out groups.
    """
    spark = frame.sparkSession
    small_batches(spark)
    with open(ranks, "rb") as f, open(model, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    here = Aligner(*files.value)
    kind, pair_kind = frame.schema[id_column].dataType.simpleString(), here.pair_kind
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, wide = Aligner(*files.value), np.int32 if pair_kind == "int" else np.int64

        def told(ids: list, tokens: list) -> pd.DataFrame:
            filled = [i for i, t in enumerate(tokens) if t is not None]
            made = aligner.aligned([tokens[i] for i in filled])
            out = {k: np.zeros(len(ids), np.int64) for k in counts} | {"groups_sha256": [""] * len(ids), "pairs": [np.zeros(0, wide)] * len(ids), "times": [np.zeros(0, np.int32)] * len(ids)} | ({"groups": [""] * len(ids)} if outputs else {})
            for k, i in enumerate(filled):
                for c in counts:
                    out[c][i] = made[c][k]
                out["groups_sha256"][i] = hashlib.sha256(made["groups"][k]).hexdigest()
                out["pairs"][i], out["times"][i] = made["pairs"][k].astype(wide), made["times"][k].astype(np.int32)
                if outputs:
                    out["groups"][i] = made["groups"][k].decode()
            return pd.DataFrame({"id": pd.Series(ids, dtype=object)} | out)

        for batch in batches:
            ids, tokens, held = [], [], 0
            for i, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                ids.append(None if i is None or i != i else i)
                tokens.append(aligner.tokens(text if isinstance(text, str) else None))
                held += len(text) if isinstance(text, str) else 0
                if held > SLICE_BYTES:
                    yield told(ids, tokens)
                    ids, tokens, held = [], [], 0
            if ids:
                yield told(ids, tokens)

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair_kind}>, times array<int>" + ", groups string" * outputs
    key = F.col(id_column)
    texts = frame.select(key.alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInPandas(run, schema), here.step


def pair_counts(documents: DataFrame, factor: int) -> DataFrame:
    """Rows (pair, n_docs, best_a, best_b): the documents of each linked pair, and whether no pair of its A (B) id has more."""
    counts = documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = counts.select("*", F.floor(F.col("pair") / factor).alias("a"), F.pmod("pair", F.lit(factor)).alias("b"))
    for side in ("a", "b"):
        most = counts.groupBy(side).agg(F.max("n_docs").alias(f"most_{side}"))
        counts = counts.join(most, side)
    return counts.select("pair", "n_docs", *[(F.col("n_docs") == F.col(f"most_{x}")).alias(f"best_{x}") for x in "ab"])


def alignment(frame: DataFrame, ranks: str, model: str, id_column: str = "doc_id", text_column: str = "text", outputs: bool = True, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), n_best_b,
    count_sum (counts summed over links), groups_sha256, and groups as ``a1,a2|b1;a3|b2,b3``.

    ranks, model: paths on the driver of A's rank file and B's model; their contents, a fixed size, are broadcast.
    outputs: False leaves out groups.
    """
    made, factor = linked(frame, ranks, model, id_column, text_column, outputs)
    documents = staged(made.withColumn("at", F.monotonically_increasing_id()), "aligned")
    counts = staged(pair_counts(documents, factor), "pair-counts")
    each = documents.select("at", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = each.join(F.broadcast(counts) if counts.count() <= broadcast_pairs else counts.hint("shuffle_hash"), "pair")
    sums = known.groupBy("at").agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("best_a"), F.col("times"))).alias("n_best"), F.sum(F.when(F.col("best_b"), F.col("times"))).alias("n_best_b"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")
    )
    shown = documents.drop("pairs", "times").join(sums, "at", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return shown.select(F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("n_best_b"), zero("count_sum"), "groups_sha256", *["groups"] * outputs)
