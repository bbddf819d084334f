"""Periodic runs, packing and alignment against brute force and the tokenizers' own libraries, with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.llm import alignment, packing, periodic_runs, token_counts
from veritab.llm._core import buffer_of

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, row string, place string, length string, at string, pairs string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcéñ漢ß🙂"[: rng.choice((4, 4, 4, 8))]) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    out = [None, "", "   \n\t", "one", "a a a a a", "a a a a a a", "x y " * 4, "x y " * 90, "<|endoftext|> and <s></s> <unk> text", "  two  spaces ", "tab\tand\x0bothers\x1c\x85", "end "]
    out += ["e" * 9000, " " * 3000, "a  b " * 900, "word\n" * 700, "▁ literal", "b́ Å ﬁ", "\x00 nul"]
    for i in range(40):
        words = [rng.choice(vocab if i % 2 else vocab[:4]) for _ in range(rng.randint(1, 260))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice(vocab) for _ in range(rng.randint(1, 7))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: rng.randint(1, 9 * len(unit))]
        out.append((" " if i % 3 else "\n").join(words))
    return out + out[20:26]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(None if i == 4 else i * 7 % 55, t, *["clash"] * 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- periodic runs


def brute_runs(w, least=6, exponent=4):
    found, n = [], len(w)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p) and not any(all(w[k] == w[k + q] for k in range(i, j + p - q)) for q in range(1, p)):
                found.append((i, j + p - i, p))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("deceived", [False, True])
def test_runs_of_random_words(monkeypatch, deceived):
    """Small alphabets, runs of runs, tiny blocks of grid points, and a base under which all hashes agree."""
    rng = random.Random(8)
    if deceived:
        monkeypatch.setattr(periodic_runs, "BASES", (0, *periodic_runs.BASES))
    monkeypatch.setattr(periodic_runs, "BLOCK_POINTS", 7)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice("ab") for _ in range(rng.randint(0, 50))]
            for _ in range(rng.randint(0, 3)):
                unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
                w += (unit * 9)[: rng.randint(0, 9 * len(unit))]
            rows.append(w)
        got, shown = periodic_runs.runs_of(*buffer_of(pa.array([" ".join(w) for w in rows])), None, 6, 4)
        assert got == [brute_runs(w) for w in rows]
        assert [x.decode() for x in shown] == [collapsed(w, brute_runs(w)) for w in rows]


def test_words_whose_hashes_meet(monkeypatch):
    monkeypatch.setattr(periodic_runs, "word_hashes", lambda raw, start, end: (end - start).astype(np.uint64))
    got, _ = periodic_runs.runs_of(*buffer_of(pa.array(["a b c a b c a b c a b c d e f"])), None, 6, 4)
    assert got == [[(0, 12, 3)]]


def test_all_bases_deceive(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BASES", (0,))
    with pytest.raises(RuntimeError):
        periodic_runs.runs_of(*buffer_of(pa.array(["a " * 8 + "b c d e"])), None, 6, 4)


def seeded(doc, w):
    h, n = None if doc is None else zlib.crc32(str(doc).encode()), len(w)
    if h is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs(docs):
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    expected, planted = [], 0
    for r in docs.collect():
        w = WORD.findall(r["text"] or "")
        planted += seeded(r["doc_id"], w) != w
        w = seeded(r["doc_id"], w)
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        expected.append((r["doc_id"], len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)), [tuple(x) for x in runs], collapsed(w, runs)))
    got = [(*r[:8], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs, seed=seed).collect()]
    assert planted and sorted(map(repr, got)) == sorted(map(repr, expected))
    narrow = periodic_runs.periodic_runs(docs, seed=seed, outputs=False)
    assert sorted(map(repr, map(tuple, narrow.collect()))) == sorted(repr(x[:8]) for x in expected)
    assert any(n > 20 for _, n, *_ in got) or max(x[1] for x in got) > 1


def test_periodic_runs_without_rows_and_bounds(empty):
    assert periodic_runs.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(empty, exponent=1)


def test_a_very_long_run():
    got, shown = periodic_runs.runs_of(*buffer_of(pa.array(["start " + "a b c " * 60_000 + "a end"])), None, 6, 4)
    assert got == [[(1, 180_001, 3)]] and next(shown) == b"start a b c end"


# -- packing


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        limit = int(rng.integers(1, 14))
        price = np.where(rng.random(limit + 1) < 0.6, rng.random(limit + 1), 0)
        best = [0.0] * (limit + 1)
        for room in range(1, limit + 1):
            best[room] = max([best[room - 1], *[price[x] + best[room - x] for x in range(1, room + 1) if price[x] > 0]])
        value, taken = packing.knapsack(price)
        assert np.allclose(value, best)
        for first in range(1, limit + 1):
            config = packing.configurations(np.array([first]), taken, limit)[0]
            assert sum(x * n for x, n in config.items()) <= limit
            assert np.isclose(sum(price[x] * n for x, n in config.items()), price[first] + best[limit - first])


@pytest.mark.parametrize("kind", ["mixed", "one length", "halves", "long", "ones", "none", "huge"])
def test_plans_hold_all_pieces(kind):
    rng, limit = random.Random(4), 256
    lengths = {"mixed": [min(limit, int(rng.lognormvariate(4, 1)) + 1) for _ in range(3000)], "one length": [100] * 999, "halves": [128] * 501, "long": [rng.randint(129, 256) for _ in range(400)], "ones": [1] * 1000, "none": [], "huge": [min(limit, int(rng.lognormvariate(4, 1)) + 1) for _ in range(300)]}[kind]
    counts = {x: n * (10**9 if kind == "huge" else 1) for x, n in collections.Counter(lengths).items()}
    made = packing.plan(counts, limit)
    held = collections.Counter()
    for config, times in made:
        assert times > 0 and sum(x * n for x, n in config.items()) <= limit
        for x, n in config.items():
            held[x] += n * times
    assert held == collections.Counter(counts)
    area = -(-sum(x * n for x, n in counts.items()) // limit)
    least = max(area, sum(n for x, n in counts.items() if 2 * x > limit), -(-counts.get(100, 0) // 2) if kind == "one length" else 0)
    assert sum(n for _, n in made) <= least * (1.02 if kind == "huge" else 1.005) + 1
    table = packing.segments(made)
    assert (np.diff(table[0]) > 0).all()


def check_packed(rows, docs, library, limit):
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    expected = collections.defaultdict(list)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % limit + 1
        cuts = [0, *range(first, len(ids) + 1, limit)]
        expected[r["doc_id"]] += [(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(by_sequence)


def test_packed(docs, library, empty):
    held = docs.collect()
    made = packing.packed(docs, RANKS)
    rows = made.collect()
    used = check_packed(rows, held, library, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    short = packing.packed(docs, RANKS, limit=64, outputs=False).collect()
    assert check_packed(short, held, library, 64) <= 1.01 * sum(r["length"] for r in short) / 64 + 1
    assert packing.packed(empty, RANKS).count() == 0


def test_copies_of_one_length_lie_apart(spark, library):
    """A third of all rows alike, in many tasks."""
    rows = [(i, "the same text" if i % 3 == 0 else "word " * (i % 40)) for i in range(400)]
    f = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    check_packed(packing.packed(f, RANKS, limit=50, outputs=False).collect(), f.collect(), library, 50)


# -- long texts of the byte-level vocabulary


def test_long_white_space_counts_as_the_library_says(library):
    counter = token_counts.Counter(open(RANKS, "rb").read())
    n = 1_000_000
    for text in (" " * n, "\n" * n, "\t" * n, "a" + " " * n + "b", "a" + "\n" * n + "b", "x" * n, " " * n + "<|endoftext|>" + " \n" * (n // 2) + "z", "　" * n + "e  f"):
        assert counter.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(counter.encode(text))


def test_a_long_run_without_a_stable_boundary(library):
    counter = token_counts.Counter(open(RANKS, "rb").read(), chunk_chars=64, overlap_chars=8)
    rng = random.Random(6)
    for _ in range(40):
        text = "".join(rng.choice(["ab", "  ", ".", "7", "\n", "é", "<|endoftext|>", " " * 90, "c" * 130, "." * 70]) for _ in range(60))
        assert counter.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


# -- alignment


def brute_alignment(texts, library):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    library.encode_special_tokens = True
    symbols = {}
    free = iter(range(256, 512))
    for b in range(256):
        symbols[chr(b) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b else chr(next(free))] = b
    bytes_a = {i: bytes(symbols[c] for c in t) for t, i in library.get_vocab().items() if all(c in symbols for c in t)}
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(processor.id_to_piece, range(processor.get_piece_size()))]
    each = []
    for text in texts:
        a = library.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = processor.encode(text) if text else []
        if not text or b"".join(bytes_a[i] for i in a) != f" {text}".encode() or b"".join(bytes_b[i] for i in b) != f" {text}".encode():
            each.append(None)
            continue
        spans = []
        for ids, known in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(known[i]), i))
                at += len(known[i])
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else None
        common = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for s, e, i in own if low < e <= high) for own in spans) if len(a) < 3000 else "")
            low = high
        each.append((a, b, links, groups))
    library.encode_special_tokens = False
    return each


@pytest.mark.parametrize("broadcast_pairs", [1 << 20, 1])
def test_alignment(docs, texts, library, broadcast_pairs, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 400)
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("text is null or length(text) < 2500").collect()]
    made = brute_alignment([t for _, t in rows], library)
    held = collections.Counter(p for x in made if x for p in set(x[2]))
    top_a, top_b = collections.Counter(), collections.Counter()
    for (a, b), n in held.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    expected = []
    for (doc, _), x in zip(rows, made, strict=True):
        if x is None:
            expected.append((doc, 0, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        a, b, links, groups = x
        shown = ";".join(groups)
        expected.append((doc, len(a), len(b), len(groups), len(links), sum(held[p] == top_a[p[0]] for p in links), sum(held[p] == top_b[p[1]] for p in links), sum(held[p] for p in links), sha(shown), shown))
    got = alignment.alignment(docs.filter("text is null or length(text) < 2500"), RANKS, MODEL, broadcast_pairs=broadcast_pairs)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert sum(x is None for x in made) >= 3 and sum(x is not None for x in made) > 40


def test_alignment_without_rows(empty):
    assert alignment.alignment(empty, RANKS, MODEL).count() == 0


def test_pieces_in_parts(texts):
    model = open(MODEL, "rb").read()
    whole, parts = sentencepiece.SentencePieceProcessor(model_proto=model), alignment.Pieces(model, 20)
    assert parts.part
    for text in [*filter(None, texts), "ab " * 30, "x" * 100 + " ", "  a" * 40, "a" + " " * 90 + "b"]:
        assert parts.encode(text).tolist() == whole.encode(text), text[:50]
