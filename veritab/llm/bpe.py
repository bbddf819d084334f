"""BPE encoding and decoding with a word-end vocabulary, by prefix-sharing trie traversal.

The distinct words of an Arrow batch that the worker doesn't know yet are inserted into a trie. A depth-first
walk gives each node the last token of the encoding of the node's prefix. That state suffices: an encoding
without its last token is the encoding of the shorter prefix, so the last token is the one token that ends the
prefix and is compatible with the last token of what stands before it. Words that share a prefix share the
work, and an encoding is read back along last tokens. Two tokens are compatible if merging their
concatenation by rank gives just the two; this is read from the merges along the inner border.

The runs between white space of a slice of texts are found in its bytes, named by hashes and compared byte by
byte with the first run of that name, so each distinct run is looked up once. Ids and decoded texts of all runs
are then gathered in NumPy.

Words with characters that are newer than this Python's Unicode are lower-cased and split by the vocabulary's own library.

Null and empty texts, and texts of white space, encode to no ids and decode to an empty text. Any text is encoded
whole; a very long word costs time in proportion to its length times the longest token, and no trie. Repeated rows
and rows with equal ids are encoded each on its own, and no tie can arise. An empty table gives an empty one. Extra
columns are left out, whatever their names.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import buffer_of, kept, lean, slices, small_batches, word_hashes, words

#: Runs, bytes of runs, words and pairs of tokens that a worker remembers before it starts anew.
KEPT_RUNS, KEPT_BYTES, KEPT_WORDS, KEPT_PAIRS = 1_600_000, 1 << 25, 200_000, 300_000
#: Runs that are remembered one by one before they are sorted into the table.
FRESH_RUNS = 1 << 16
#: Bytes of text that are encoded in one go; words of more symbols are encoded without a trie.
BATCH_BYTES, LONG_WORD = 1 << 20, 256
WORD_END = "</w>"
#: Symbols by which the longest token that may end a prefix is looked up.
REACH = 4

#: The vocabulary's splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class WordBpe:
    """vocabulary: JSON of a tokenizer with the parts normalizer, splitting pattern, BPE model and added tokens."""

    def __init__(self, vocabulary: bytes | str):
        self.vocabulary, self.library = vocabulary, None
        parts = json.loads(vocabulary)
        model = parts["model"]
        self.tokens: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.tokens.items()}
        self.special = {x["content"]: x["id"] for x in parts["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        #: rank of a merge by its two tokens; the rank that made a token (-1: a single symbol) and its two halves.
        self.rank: dict[int, int] = {}
        self.made = dict.fromkeys(self.names, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, whole = self.tokens[left], self.tokens[right], self.tokens[left + right]
            if whole in self.halves:
                raise ValueError(f"two merges make the token {left + right!r}")
            self.rank[a << 32 | b], self.made[whole], self.halves[whole] = rank, rank, (a, b)
        self.width = {t: len(name.removesuffix(WORD_END)) if name != WORD_END else 1 for name, t in self.tokens.items()}
        self.longest = max(self.width.values())
        #: The longest token that ends in these REACH symbols (and the word's end).
        self.reach: dict[str, int] = {}
        for name, t in self.tokens.items():
            if (size := self.width[t]) >= REACH:
                key = name[size - REACH :]
                self.reach[key] = max(size, self.reach.get(key, 0))
        self.pairs: dict[int, bool] = {}
        #: What is remembered: packed ids of words, and of runs between white space as they stand in texts.
        self.of_word: dict[str, bytes] = {}
        self.runs = Runs()
        #: The text of each token and a space, one after the other, and where each id's begin.
        shown = [f"{self.names.get(i, '')} ".encode() for i in range(max(self.names) + 1)]
        self.shown, self.shown_at = np.frombuffer(b"".join(shown), np.uint8), np.append(0, np.cumsum([len(x) for x in shown]))
        #: Whether what stands between white space can be split into words on its own: not if a special token has some.
        self.plain = all(not any(c.isspace() for c in x) for x in self.special)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Back in time from the finished tokens: at no moment was a merge across the border due.

        until_a, until_b: the ranks of the merges that take up what stands left and right of the border; of
        equal ranks the left place merges first.
        """
        until_a = until_b = sys.maxsize
        while True:
            rank = self.rank.get(a << 32 | b)
            if rank is not None and rank < until_a and rank <= until_b:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_b >= made_a:
                until_b, b = made_b, self.halves[b][0]
            else:
                until_a, a = made_a, self.halves[a][1]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words and remembers their ids and token texts."""
        gc.disable()  # a trie is all containers and no cycles
        try:
            self._walk(words)
        finally:
            gc.enable()

    def _last_token(self, tail: str, ends: bool, depth: int, last: list[int]) -> int:
        """The last token of a prefix of ``depth`` symbols. tail: its last symbols; last: those of the shorter prefixes."""
        name, size = tail + WORD_END if ends else tail, len(tail)
        tokens, most = self.tokens, size if size < REACH else min(size, self.reach.get(name[size - REACH :], REACH - 1))
        for back in range(most, 0, -1):
            token = tokens.get(name[size - back :])
            if token is not None and (back == depth or self.compatible(last[depth - back - 1], token)):
                return token
        raise ValueError(f"the vocabulary can't end {tail!r}")

    def _walk(self, words: Iterable[str]) -> None:
        root: dict = {}
        for word in words:
            chars = "".join([self.symbols[b] for b in word.encode()])
            if len(chars) > LONG_WORD:
                last: list[int] = []
                for depth in range(1, len(chars) + 1):
                    last.append(self._last_token(chars[max(0, depth - self.longest) : depth], depth == len(chars), depth, last))
                self._read_back([word], last)
                continue
            node = root
            for ch in chars[:-1]:
                node = node.setdefault(ch, {})
            node.setdefault(chars[-1] + WORD_END, []).append(word)
        last, stack = [], [(root, 0, "")]
        while stack:
            node, depth, tail = stack.pop()
            if depth:
                del last[depth - 1 :]
                last.append(self._last_token(tail, isinstance(node, list), depth, last))
            if isinstance(node, list):
                self._read_back(node, last)
                continue
            for ch, child in node.items():
                stack.append((child, depth + 1, (tail + ch[:1])[-self.longest :]))

    def _read_back(self, same: list[str], last: list[int]) -> None:
        found, at = [], len(last)
        while at:
            found.append(last[at - 1])
            at -= self.width[last[at - 1]]
        found.reverse()
        packed = pack(found)
        for word in same:
            self.of_word[word] = packed

    def pieces(self, text: str) -> list[str]:
        """Words of a text as the vocabulary splits them; special tokens stand for themselves."""
        if self.split_special is None:
            return self._words(text)
        return [w for i, part in enumerate(self.split_special.split(text)) for w in ([part] if i % 2 else self._words(part))]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split.findall(text.lower())
        if newer_characters().search(text):
            return self._words_by_library(text)
        # lower() alone would treat a final sigma by its neighbours; the vocabulary lowers each character alone
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _words_by_library(self, text: str) -> list[str]:
        """The words of a text some of whose characters Python, regex and the vocabulary's library may class differently."""
        if self.library is None:
            import tokenizers

            held = self.vocabulary
            self.library = tokenizers.Tokenizer.from_str(held.decode() if isinstance(held, bytes) else held)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_batch(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Per text: its ids as little-endian unsigned 32-bit integers, and the decoded text (tokens joined by a space)."""
        raw, offsets = buffer_of(texts)
        for _, _, part, own in slices(raw, offsets, BATCH_BYTES):
            yield from self._encoded(part, own)

    def _encoded(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        if self.plain:
            start, end, first = words(raw, offsets)
        else:  # a text is one run
            filled = np.flatnonzero(np.diff(offsets))
            start, end, first = offsets[filled], offsets[filled + 1], np.append(0, np.cumsum(np.diff(offsets) > 0))
        if not len(start):
            yield from ((b"", b"") for _ in offsets[1:])
            return
        hashes = word_hashes(raw, start, end)
        names, first_of = distinct_runs(raw, start, end, hashes)
        a, b, own = start[first_of], end[first_of], hashes[first_of]
        at = self.runs.find(own, raw, a, b)
        new = np.flatnonzero(at < 0)
        flat = raw.tobytes()
        learned = self._learned(own[new].tolist(), [flat[x:y] for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True)])
        known = np.flatnonzero(at >= 0)
        # ids of all distinct runs, the remembered ones first, and where those of each stand
        held, bounds = spread(self.runs.ids, self.runs.id_begin, self.runs.id_size, at[known])
        sizes = np.array([len(x) for x in learned], np.int64) >> 2
        begin, length = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        begin[known], length[known] = bounds[:-1], np.diff(bounds)
        begin[new], length[new] = len(held) + np.cumsum(sizes) - sizes, sizes
        ids, to_id = spread(np.concatenate([held, np.frombuffer(b"".join(learned), "<u4")]), begin, length, names)
        shown, to_byte = gathered(self.shown, self.shown_at, ids)
        packed, text, to_id = ids.astype("<u4").tobytes(), shown.tobytes(), to_id[first]
        to_byte, to_id = to_byte[to_id], to_id * 4
        for a, b, c, d in zip(to_id[:-1].tolist(), to_id[1:].tolist(), to_byte[:-1].tolist(), to_byte[1:].tolist(), strict=True):
            yield packed[a:b], text[c : max(c, d - 1)]  # each token's text ends in a space

    def _learned(self, hashes: list[int], runs: list[bytes]) -> list[bytes]:
        """Packed ids of runs that are not in the sorted table, which are remembered as fresh ones."""
        fresh, known = self.runs.fresh, self.of_word
        out = [f[1] if (f := fresh.get(h)) is not None and f[0] == x else None for h, x in zip(hashes, runs, strict=True)]
        if len(known) > KEPT_WORDS:
            known.clear()
        for x in self.special:
            known[x] = pack([self.special[x]])
        new = [i for i, x in enumerate(out) if x is None]
        parts = [self.pieces(runs[i].decode()) for i in new]
        self.learn({w for x in parts for w in x if w not in known})
        for i, x in zip(new, parts, strict=True):
            out[i] = known[x[0]] if len(x) == 1 else b"".join([known[w] for w in x])
            fresh[hashes[i]] = runs[i], out[i]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.names[t] for t in unpack(ids)])


class Runs:
    """Runs and their ids in flat arrays, sorted by hash; the newest ones wait in lists until they are many."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes, self.raw, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        # where the bytes and the ids of each run lie: these stay in the order in which they came
        self.begin = self.size = self.id_begin = self.id_size = np.zeros(0, np.int32)
        self.fresh: dict[int, tuple[bytes, bytes]] = {}

    def find(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each run of bytes, or -1. Equal hashes count if the bytes are equal too."""
        if len(self.fresh) > FRESH_RUNS:
            self._sort_in()
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        sizes = end - start
        hit = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == sizes))
        mine, bounds = spread(self.raw, self.begin, self.size, at[hit])
        given, _ = spread(raw, start, sizes, hit)
        same = np.ones(len(hit), bool)
        if len(mine):
            same = np.add.reduceat(mine != given, bounds[:-1]) == 0
        out = np.full(len(hashes), -1)
        out[hit[same]] = at[hit[same]]
        return out

    def _sort_in(self) -> None:
        if len(self.hashes) + len(self.fresh) > KEPT_RUNS or len(self.raw) > KEPT_BYTES:
            fresh = self.fresh
            self.clear()
            self.fresh = fresh
        hashes = np.array(list(self.fresh), np.uint64)
        runs, ids = zip(*self.fresh.values(), strict=True)
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        all_hashes = np.concatenate([self.hashes, hashes])[order]
        once = np.append(True, all_hashes[1:] != all_hashes[:-1])
        order, self.hashes = order[once], all_hashes[once]

        def placed(begin: np.ndarray, size: np.ndarray, after: int, new: tuple, width: int) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.array([len(x) // width for x in new], np.int64)
            begins = after + np.cumsum(sizes) - sizes
            return np.concatenate([begin, begins])[order].astype(np.int32), np.concatenate([size, sizes])[order].astype(np.int32)

        self.begin, self.size = placed(self.begin, self.size, len(self.raw), runs, 1)
        self.id_begin, self.id_size = placed(self.id_begin, self.id_size, len(self.ids), ids, 4)
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(runs), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4").astype(np.uint32)])
        self.fresh = {}


def distinct_runs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span of bytes the number of its distinct contents, and for each of these its first span."""
    sizes = end - start
    names, found = pd.factorize(hashes)
    example = np.zeros(len(found), np.int64)
    example[names[::-1]] = np.arange(len(names) - 1, -1, -1)
    same = bool((sizes == sizes[example][names]).all())
    if same:  # and byte by byte
        own, _ = spread(raw, start, sizes, np.arange(len(start)))
        other, _ = spread(raw, start[example], sizes[example], names)
        same = bool((own == other).all())
    if not same:  # hashes that meet
        flat = raw.tobytes()
        names, held = pd.factorize(np.array([flat[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], object))
        example = np.zeros(len(held), np.int64)
        example[names[::-1]] = np.arange(len(names) - 1, -1, -1)
    return names, example


def spread(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[name] : begin[name] + sizes[name]] for all names, one after the other, and where each name's begin (len + 1)."""
    names = names.astype(np.int64)
    each = sizes[names]
    bounds = np.append(0, np.cumsum(each))
    at = np.arange(bounds[-1]) + np.repeat(begin[names] - bounds[:-1], each)
    return flat[at], bounds


def gathered(flat: np.ndarray, begin: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for parts that follow each other: begin has one entry more than there are names."""
    return spread(flat, begin[:-1], np.diff(begin), names)


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def unpack(ids: bytes) -> array:
    packed = array("I")
    packed.frombytes(ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed


@functools.cache
def newer_characters() -> regex.Pattern:
    """Any character that this Python's Unicode doesn't have, while other libraries may."""
    new = np.array([unicodedata.category(chr(i)) == "Cn" for i in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], new, [False]]).astype(int)))
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist()) + "]")


def kept_model(vocabulary: bytes) -> WordBpe:
    """The model that this process has already built, with the words it remembers, or a new one."""
    return kept(("bpe", hashlib.sha256(vocabulary).digest()), lambda: WordBpe(vocabulary))


def bpe_round_trip(frame: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", outputs: bool = True) -> DataFrame:
    """Per row: the id, ids (binary, 4 bytes each), decoded text, n_tokens, and SHA-256 of ids and of decoded text.

    outputs: False leaves out ids and decoded. vocabulary: path on the driver; its contents, a fixed size, are broadcast.
    """
    spark = frame.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_model(model.value)
        for batch in batches:
            n, a, b, ids, shown = [], [], [], [], []
            for packed, text in bpe.encode_batch(batch.column(1)):
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(text).hexdigest())
                if outputs:
                    ids.append(packed)
                    shown.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if outputs:
                columns, names = [*columns, pa.array(ids, pa.binary()), pa.array([x.decode() for x in shown], pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = frame.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * outputs
    texts = frame.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(lean(run, keeps=True), schema).withColumnRenamed("id", id_column)
