"""Text operators against brute force, exact round trips and held-out accuracy, with the odd cases each must bear."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.llm import _core, _filters, bpe, decontaminate, jaccard_join, language_id, licenses, line_dedup, quality, substring_dedup, token_counts, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id string, row string, e long, source string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages and lines, periodic texts, and odd rows."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    line = " ".join(rng.choice(vocab) for _ in range(14))
    passage = [rng.choice(vocab) for _ in range(60)]
    base = [rng.choice(vocab) for _ in range(120)]
    out = [None, "", "   \n\t", "one", "a b c", "a b c", "x " * 90, "Y " * 37, "line\x0bbreak\x0c one\r\n two"]
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 160))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        if i % 3 == 0:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
        text = " ".join(words)
        out.append(text + ("\n  " + line.upper() + " \n" + text[:50] if i % 5 == 0 else ""))
    return out + out[20:30]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 7 % 101, t, "clash", "clash", 1, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def test_words_in_bytes_match_the_pattern(texts):
    raw, offsets = _core.buffer_of(pa.array(texts))
    for low, high, part, own in _core.slices(raw, offsets, 500):
        start, end, first = _core.words(part, own)
        flat = part.tobytes()
        for i in range(low, high):
            a, b = first[i - low], first[i - low + 1]
            assert [flat[s:e].decode() for s, e in zip(start[a:b], end[a:b], strict=True)] == words_of(texts[i])


def test_filters_miss_nothing(spark, monkeypatch):
    """Hashes in two tasks, or twice in one, pass with their rows; in shards of any size few others do."""
    hashes = [[int(x) for x in np.random.default_rng(i).integers(-(2**62), 2**62, 50)] + ([11, -5] if i % 2 else [7]) for i in range(8)]
    hashes[0] += [99, 99]
    kinds = []
    for i, h in enumerate(hashes):
        made = _filters.settled(np.array(h, np.int64), {"row": pa.array([i] * len(h))})
        kinds += [tuple(x.values()) for x in made.to_pylist()]
    assert {k for h, k, _ in kinds if h == 99} == {_filters.WITNESS, _filters.REPEATED}
    f = spark.createDataFrame(kinds, "h long, kind int, row long").repartition(3)
    for shard_keys in (1 << 19, 100):
        monkeypatch.setattr(_filters, "SHARD_KEYS", shard_keys)
        got = collections.Counter(map(tuple, _filters.twice_seen(f).collect()))
        true = collections.Counter((h, i) for i, x in enumerate(hashes) for h in x if h in (11, -5, 7, 99))
        assert true == collections.Counter({k: v for k, v in got.items() if k[0] in (11, -5, 7, 99)}) and len(got) <= len(true) + 2


def test_sets_of_hashes(spark):
    f = spark.createDataFrame([(x,) for x in (5, -7, 5, 2**62)], "h long")
    known = _filters.small_set(f, 3).value
    assert known.has(np.array([5, 6, -7, 2**62, -(2**63)], np.int64)).tolist() == [True, False, True, True, False]
    assert _filters.small_set(f, 2) is None
    assert not _filters.small_set(f.limit(0)).value.has(np.array([1], np.int64)).any()


def test_tiny_partitions_are_read_together(spark, monkeypatch, tmp_path):
    spark.range(4000).selectExpr("id", "cast(id as string) text").repartition(40).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(_core, "parallel", lambda _: 3)
    with _core.setting(spark, "spark.sql.files.openCostInBytes", "1"), _core.setting(spark, "spark.sql.files.maxPartitionBytes", "2048"):
        f = spark.read.parquet(f"{tmp_path}/t")
        assert f.rdd.getNumPartitions() > 3 and _core.packed(f).rdd.getNumPartitions() == 3 and _core.packed(f).count() == 4000
        monkeypatch.setattr(_core, "PACKED_BYTES", 1)
        assert _core.packed(f).rdd.getNumPartitions() == f.rdd.getNumPartitions()
    shuffled = f.groupBy("text").count()
    assert _core.packed(shuffled) is shuffled


def thue_morse(n, flip=0):
    return [(i.bit_count() + flip) % 2 for i in range(n)]


def test_hashes_tell_thue_morse_texts_apart():
    """Such pairs collide in every polynomial modulo 2 ** 64."""
    a, b = ("".join("ab"[x] for x in thue_morse(1024, f)) for f in (0, 1))
    raw, offsets = _core.buffer_of(pa.array([f"{a} {b}"]))
    start, end, _ = _core.words(raw, offsets)
    for second in (False, True):
        h = _core.word_hashes(raw, start, end, second)
        assert h[0] != h[1]
    raw, offsets = _core.buffer_of(pa.array([" ".join(a), " ".join(b)]))
    start, end, first = _core.words(raw, offsets)
    h = _core.word_hashes(raw, start, end)
    assert len(set(_core.sequence_hashes(h, first[:-1], first[1:]).tolist())) == 2
    assert len(set(_core.gram_hashes(h, 1024)[[0, 1024]].tolist())) == 2


def test_thue_morse_words_are_told_apart(spark):
    w, v = ("".join("ab"[x] for x in thue_morse(1024, f)) for f in (0, 1))
    rest = " ".join(f"z{i}" for i in range(34))
    rows = [(1, f"{w} x"), (2, f"{v} x"), (3, f"{w} {rest}"), (4, f"{v} {rest}"), (5, " ".join("ab"[x] for x in thue_morse(512))), (6, " ".join("ab"[x] for x in thue_morse(512, 1)))]
    f = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(f).collect()}
    assert got[1] == 1 and got[2] == 2
    assert collections.Counter(tuple(r) for r in jaccard_join.jaccard_components(f).select("doc_id", "n_shingles", "component_id").collect()) == components(rows)
    check_substrings(f, substring_dedup.substring_dedup(f))


@pytest.mark.parametrize("limits", [{}, {"broadcast_hashes": 0}, {"broadcast_keys": 0}, {"broadcast_hashes": 0, "broadcast_keys": 0}])
def test_line_dedup(docs, limits):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    where = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                where[key(x)].add(i)
    keeper = {k: max(v) for k, v in where.items() if len(v) >= 5}
    assert keeper
    expected = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        expected[i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), None if t is None else "\n".join(kept)] += 1
    got = line_dedup.line_dedup(docs, **limits)
    assert got.select("row.*").columns == [c for c in docs.columns if c != "text"]
    assert collections.Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"], r["kept"]) for r in got.collect()) == expected


def test_line_dedup_of_null_and_repeated_ids(spark):
    line = "A line that many of the documents here have, of over forty letters"
    rows = [(None, line), (None, f"x\n {line.lower()}"), (1, line), (1, f"{line}\n{line}"), (2, line), (3, line), (4, f"\n{line}\t"), (5, None), (6, "ä" * 39), (7, "ä" * 40)]
    for limits in ({}, {"broadcast_hashes": 0, "broadcast_keys": 0}):
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
        kept = collections.Counter((r["row"]["doc_id"], r["n_dropped"], r["kept"]) for r in got)
        assert kept == collections.Counter([(None, 1, ""), (None, 1, "x"), (1, 1, ""), (1, 2, ""), (2, 1, ""), (3, 1, ""), (4, 0, f"\n{line}\t"), (5, 0, None), (6, 0, "ä" * 39), (7, 0, "ä" * 40)])


def components(rows, percent=80):
    sets = []
    for _, t in rows:
        w = words_of((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_components(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_join.jaccard_components(docs)
    assert collections.Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == components(rows)


def test_prefixes_share_what_is_demanded():
    """Linked sets share the smaller number of matches in their prefixes, and what the bound demands."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        common = rng.choice(10_000, n, replace=False)
        a, b = set(common.tolist()), set(common.tolist())
        for s in (a, b):
            for _ in range(int(rng.integers(0, 1 + n // 8))):
                s.discard(int(rng.choice(common)))
                s.add(int(rng.integers(10_000, 20_000)))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        made = []
        for s in (a, b):
            cost = rng.integers(0, 50, len(s)).astype(float)
            length, m = jaccard_join.choose_prefix(np.sort(list(s)), cost, len(s), 80, 4)
            made.append((set(sorted(s)[:length]), m, length))
        c = len(made[0][0] & made[1][0])
        beyond = [-(-len(s) * 80 // 100) - m for s, (_, m, _) in zip((a, b), made, strict=True)]
        assert c >= min(made[0][1], made[1][1]) and c >= np.ceil((len(a) + len(b)) * 80 / 180 - 1e-9) - max(beyond)


def check_substrings(frame, made):
    rows = [(r["doc_id"], words_of(r["text"])) for r in frame.collect()]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    expected = collections.Counter()
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i, len(w), sum(gone), sha(kept), kept] += 1
    assert collections.Counter(map(tuple, made.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect())) == expected


@pytest.mark.parametrize("broadcast_hashes", [None, 0])
def test_substring_dedup(docs, broadcast_hashes):
    check_substrings(docs, substring_dedup.substring_dedup(docs, broadcast_hashes=broadcast_hashes))


def test_edges_are_resolved_across_batches():
    rng = np.random.default_rng(7)
    rows = sorted((int(h), int(c), int(s), int(p), 0) for h, c, s, p in zip(rng.integers(0, 12, 400), rng.integers(0, 2, 400), rng.integers(0, 4, 400), rng.integers(0, 3, 400), strict=True))
    spots = collections.defaultdict(set)
    for h, c, s, p, _ in rows:
        spots[h, c].add((s, p))
    single = next((h, c, s, p) for h, c, s, p, _ in rows)
    rows = sorted(rows + [(99, 0, 7, 7, 1), (99, 0, 8, 8, 0), (99, 1, 9, 9, 0), (100, 0, 5, 5, 0), (100, 0, 5, 5, 0)])
    expected = {(s, p) for h, c, s, p, _ in rows if h < 99 and len(spots[h, c]) > 1} | {(8, 8)}
    assert single
    for size in (1, 3, 50, 500):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        parts = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a : a + size]], t) for i, t in enumerate(kinds)], names=["h", "check", "source", "at", "kind"]) for a in range(0, len(rows), size)]
        got = {(x["source"], x["at"]) for b in substring_dedup._resolved(iter(parts)) for x in b.to_pylist()}
        assert expected <= got and not got & {(9, 9), (5, 5)}


POOL = "aàéßΣσςİıﬀ日本٣²½ \t\n\x0b\x1c\x85\xa0 'sStTrRvVeEmMlLdD<|>_-.,!0123456789😀́̀ǆ한"


def odd_texts():
    rng = random.Random(3)
    plain = [None, "", " ", "<|endoftext|>x<|startoftext|> y", "a" * 3000, "ΑΣ Σ ΣΑΣ. İ", "A'S it's DON'T", "word " * 900]
    return plain + ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 90))) for _ in range(500)]


def test_token_counts_and_splices_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = odd_texts()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    f = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for chunk, overlap in ((32_768, 512), (120, 8)):
        got = token_counts.token_counts(f, public_tokenizers.path("byte_bpe_50k.tiktoken"), chunk_chars=chunk, overlap_chars=overlap, limit=100)
        assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == expected
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got.collect())


def test_long_texts_are_counted_whole_with_the_defaults(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    words = ["".join(rng.choice(POOL) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(12_000)), "x" * 40_000, "ab " * 20_000 + "é" * 9_000, None]
    assert all(len(t) > token_counts.CHUNK_CHARS for t in texts[:3])
    rows = [(i, t, "clash", "clash", 1, "s") for i, t in enumerate(texts)] * 2
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == sorted(expected * 2)


def test_bpe_remembers_within_bounds(monkeypatch):
    """Results don't depend on what a worker remembers, or on how many runs it sorts in at once."""
    texts = pa.array([f"{x} w{i % 97} <|startoftext|>q{i}" for i, x in enumerate(t or "" for t in odd_texts())])
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocabulary = f.read()
    whole = list(bpe.WordBpe(vocabulary).encode_batch(texts))
    for name, value in (("FRESH_RUNS", 50), ("KEPT_RUNS", 120), ("KEPT_WORDS", 30), ("BATCH_BYTES", 400)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.WordBpe(vocabulary)
    assert list(small.encode_batch(texts)) == whole == list(small.encode_batch(texts))
    clash = np.zeros(7, np.uint64)  # all hashes alike
    raw, offsets = _core.buffer_of(pa.array(["a bb a cc bb a d"]))
    start, end, _ = _core.words(raw, offsets)
    names, first = bpe.distinct_runs(raw, start, end, clash)
    assert names.tolist() == [0, 1, 0, 2, 1, 0, 3] and first.tolist() == [0, 1, 3, 6]


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = odd_texts()
    f = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(f, public_tokenizers.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert list(bpe.unpack(got[i]["ids"])) == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == decoded
        assert got[i]["decoded_sha256"] == sha(decoded) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_language_id(spark):
    en, de = "the house was by the river and the boats went on", "das haus stand am fluss und die boote fuhren weiter"
    rng = random.Random(1)
    mix = lambda t: " ".join(rng.sample(t.split(), 8))
    rows = [(i, mix(en) if i % 2 else mix(de), "en" if i % 2 else "de") for i in range(120)] + [(500, None, "en"), (501, "12 34 !", None), (502, "", "de"), (503, mix(en) * 3000, None)]
    f = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language_id.held_out("doc_id")
    got = {r["doc_id"]: r for r in language_id.language_id(f, language_id.learn(f, ~held), carry=("lang",)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502)) and got[503]["lang_pred"] == "en"
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:120]) > 112
    assert {r["lang_pred"] for r in language_id.language_id(f, {}).collect()} == {"und"}


def test_toxicity():
    lexicon = toxicity.Lexicon(["idiot", "moron", "scum"], ["achl"])
    hit = lambda w: {(lexicon.names[i], fuzzy) for i, fuzzy in lexicon.find(w)}
    assert hit("idiot") == {("idiot", False)} and hit("achlich") == {("achl-", False)} and hit("scun") == set() and hit("house") == set()
    for w in ("idoit", "idit", "idiott", "xdiot", "diot", "iidiot"):
        assert hit(w) == {("idiot", True)}, w
    for w in ("idoti", "ditto", "id", "idiottt"):
        assert not hit(w) or w == "idoti"
    sample = [(str(i), f"well {'you idiot' if i % 2 else 'dear friend'} {i}", i % 2) for i in range(60)]
    terms, stems, weights, bias = toxicity.learn(sample)
    model = toxicity.Lexicon(terms, stems)
    score = lambda t: bias + sum(weights[k] * v for k, v in toxicity.features(model, t).items())
    assert score("hey you idiott") > 0 > score("a fine day") and score(None) == score("") == bias
    quoted = toxicity.features(lexicon, 'he said "idiot" to me')
    assert quoted[3] > 0 and quoted[4] == 0 and toxicity.features(lexicon, "you idiot")[4] > 0


def test_quality_counts(spark, docs):
    made = {}
    for r in docs.collect():
        t, w = r["text"] or "", words_of(r["text"])
        grams, hit = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), [0] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit[i : i + 3] = [1] * 3
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        made.setdefault(r["doc_id"], []).append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit)))
    sample = [(str(i), "clean words here and there " * 12 if i % 2 else "x*** y%%% z$$$ " * 20, i % 2) for i in range(80)]
    model = quality.learn(sample)
    for r in quality.quality(docs, model).collect():
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts in made[r["doc_id"]]
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])
    rng = random.Random(2)
    clean = " ".join(rng.choice("clean words here and there go far off".split()) + str(i % 7) for i in range(80))
    f = spark.createDataFrame([(1, clean), (2, " ".join(x + "***" for x in clean.split()))], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.quality(f, model).collect()} == {1: True, 2: False}


def test_decontamination(spark):
    item = "Tom has 12 apples and Anna gives him 5 more apples so how many kg 12 are there now in Paris"
    rows = [(1, "x. " + item), (2, "Oh. " + item.replace("12", "30").replace("Anna", "Berta").replace("Paris", "London")), (3, item.replace("12", "30", 1)), (4, None), (5, ""), (6, "nothing of the kind"), (7, item[:40]), (1, "again " + item)]
    f = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, item long, h int")
    items = spark.createDataFrame([(9, item), (9, item), (10, None), (11, "too short")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(f, items).collect()) == [(1, 9), (2, 9)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(f, items).collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.contaminated_pairs(f, items.limit(0)).isEmpty()


def test_license_scan(spark):
    rows = [(1, "a/LICENSE", "x\nReleased under the MIT License."), (2, "a/b/c.py", "hello"), (3, "q/z.py", None), (4, None, "Licensed under CC BY-NC 4.0."), (5, "a/b/d/e.py", 'Licensed under the Apache License, Version 2.0 (the "License");\nfoo'), (6, "a/b/d/e/f/g.py", "")]
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p"), common=2.0).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: ("CC-BY-NC-4.0", "own"), 5: ("Apache-2.0", "own"), 6: ("Apache-2.0", "inherited")}


def test_empty_tables(spark, empty):
    path = public_tokenizers.path
    assert line_dedup.line_dedup(empty).isEmpty() and jaccard_join.jaccard_components(empty).isEmpty() and substring_dedup.substring_dedup(empty).isEmpty()
    assert token_counts.token_counts(empty, path("byte_bpe_50k.tiktoken")).isEmpty() and bpe.bpe_round_trip(empty, path("word_bpe_49k.json")).isEmpty()
    assert language_id.learn(empty, F.lit(True), label_column="source") == {} and licenses.license_scan(empty, F.col("source")).isEmpty()
    assert quality.quality(empty, quality.learn([])).isEmpty() and toxicity.toxicity(empty, toxicity.learn([])).isEmpty()
    assert decontaminate.contaminated_pairs(empty, empty, item_column="e").isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _core.staged(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and (name == "line_dedup" or all(after[i] == before[i] for i in after))
        before = after
    assert len(components(list(before.items()))) == len(before)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == set(before)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = (np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint64)) for _ in range(2))
        bits = jaccard_join.parity_bits(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(set(a.tolist()) ^ set(b.tolist()))
    assert (jaccard_join.parity_bits(np.zeros(0, np.uint64), np.array([0, 0])) == 0).all()
