"""Null and shared ids, bounded samples, all characters of the vocabulary's normalizer, and shards with a ceiling."""

import collections
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.llm import _core, _filters, bpe, decontaminate, language_id, line_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_character_encodes_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    model = bpe.WordBpe(open(path, "rb").read())
    rng = random.Random(2)
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    # every fifth character between letters, and all that case or a newer Unicode may change
    texts = [f"a{c}b" for i, c in enumerate(chars) if i % 5 == 0 or c.lower() != c or c.upper() != c or 0x1C80 < i < 0x1CFF or 0xA700 < i < 0xA800 or 0x10D00 < i < 0x10E00 or 0x16E00 < i < 0x17000]
    odd = [c for c in chars[:0x1F000] if bpe.newer_characters().match(c)]
    texts += ["".join(rng.choice([rng.choice(odd), "Σ", "ς", "İ", "x", " ", "é", "\u0301"]) for _ in range(12)) for _ in range(2000)]
    wanted = library.encode_batch(texts, add_special_tokens=False)
    shown = library.decode_batch([x.ids for x in wanted], skip_special_tokens=False)
    for text, (ids, decoded), want, text_back in zip(texts, model.encode_batch(pa.array(texts)), wanted, shown, strict=True):
        assert bpe.unpack(ids).tolist() == want.ids and decoded.decode() == text_back, text


ITEM = "Which river flows through the old harbour town before it meets the cold northern sea near the seven islands of the coast"
CLEAN = "a plain text about gardens and the weather that has nothing to do with any question at all " * 2


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(None, f"so {ITEM} indeed", 1), (None, CLEAN, 2), (5, f"and {ITEM}", 3), (5, CLEAN + "too", 4), (6, CLEAN, 5), (6, CLEAN, 6), (7, None, 7), (8, "", 8), (9, ITEM, 9), (9, ITEM, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"key": F.lit("clash"), "row": F.lit("clash"), "h": F.lit(1)})
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    made = decontaminate.decontaminated(docs, items)
    assert sorted(r["n"] for r in made.collect()) == [2, 4, 5, 6, 7, 8] and made.columns == docs.columns
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0


def test_whole_texts_are_not_shuffled_to_meet_few_documents(spark, monkeypatch, tmp_path):
    """Neither where a stage drops documents nor where it reads some of them again, whatever Spark broadcasts by itself."""
    rows = [(i, f"number {i} " + (ITEM if i % 4 == 0 else CLEAN if i % 4 == 1 else " ".join(f"w{i}x{j}" for j in range(60))), "en", "web", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    again, write = [], decontaminate.staged
    monkeypatch.setattr(decontaminate, "staged", lambda f, label, *n: again.append(plan(f)) or write(f, label, *n) if label == "tokens" else write(f, label, *n))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = []
        for most in (_core.BROADCAST_DOCS, 0):
            monkeypatch.setattr(_core, "BROADCAST_DOCS", most)
            for stage in (corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.drop_contaminated):
                made = stage(spark, docs, str(tmp_path))
                assert ("SortMergeJoin" in plan(made)) == (most == 0)
                found.append(sorted(r["doc_id"] for r in made.collect()))
        assert ["SortMergeJoin" in p for p in again] == [False, True]
        assert found[:2] == found[2:] and found[1] == [i for i in range(40) if i % 4] and 0 < len(found[0]) < 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_samples_are_bounded(spark, monkeypatch, ids):
    """However many rows share an id or have none, each language brings at most twice the sample's size."""
    texts = [f"das ist ein satz von {i} worten" if i % 2 else f"this is a sentence of {i} words" for i in range(1500)]
    rows = [({"null": None, "one": 3, "own": i}[ids], t, "de" if i % 2 else "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    seen = {}
    build = language_id.build
    monkeypatch.setattr(language_id, "build", lambda samples: seen.update({k: len(v) for k, v in samples.items()}) or build(samples))
    made = language_id.learn(docs, F.lit(True), sample_docs=20)
    assert set(seen) == set(made) == {"de", "en"} and all(8 <= n <= 40 for n in seen.values())


@pytest.mark.parametrize(("partitions", "keys"), [(1, 20), (3, 20), (3, 7)])
def test_shards_in_few_partitions(spark, monkeypatch, partitions, keys):
    monkeypatch.setattr(_filters, "MOST_PARTITIONS", partitions)
    monkeypatch.setattr(_filters, "SHARD_KEYS", keys)
    hashes = [[int(x) for x in np.random.default_rng(i).integers(-(2**62), 2**62, 50)] + ([11, -5] if i % 2 else [7]) for i in range(8)]
    hashes[0] += [99, 99]
    rows = [tuple(x.values()) for i, h in enumerate(hashes) for x in _filters.settled(np.array(h, np.int64), {"row": pa.array([i] * len(h))}).to_pylist()]
    made = _filters.twice_seen(spark.createDataFrame(rows, "h long, kind int, row long").repartition(3))
    got = collections.Counter(map(tuple, made.collect()))
    true = collections.Counter((h, i) for i, x in enumerate(hashes) for h in x if h in (11, -5, 7, 99))
    assert true == collections.Counter({k: v for k, v in got.items() if k[0] in (11, -5, 7, 99)}) and len(got) <= len(true) + 2


def test_line_dedup_with_one_partition_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(_filters, "MOST_PARTITIONS", 1)
    monkeypatch.setattr(_filters, "SHARD_KEYS", 50)
    lines = [f"a line that is long enough to be a key of its own, number {i:05d}" for i in range(200)]
    rng = random.Random(1)
    rows = [(i, "\n".join([f"own {i} " * 8, *rng.sample(lines, 9)])) for i in range(60)]
    made = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), with_text=False)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            holders[x.strip().lower()].add(i)
    gone = {i: sum(len(holders[x.strip().lower()]) >= 5 and max(holders[x.strip().lower()]) != i for x in t.split("\n")) for i, t in rows}
    assert {r["row"]["doc_id"]: r["n_dropped"] for r in made.collect()} == gone and sum(gone.values()) > 20


def test_workers_keep_nothing_for_other_operators(spark):
    """What the last stage has learned stays in its workers, but not while they serve the first stages again."""
    docs = spark.createDataFrame([(i, f"{ITEM} number {i}") for i in range(40)], "doc_id long, text string").repartition(8)

    def holding(batches):
        from veritab.llm import _core, bpe

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(getattr(bpe, "_kept", ())) + len(getattr(_core, "_kept", ()))])], names=["n"])

    held = lambda of: max(r["n"] for r in of.mapInArrow(holding, "n long").collect())
    path = public_tokenizers.path("word_bpe_49k.json")
    made = bpe.bpe_round_trip(docs, path, outputs=False).select("n_tokens").collect()
    assert len(made) == 40 and held(docs) > 0
    for _ in range(3):  # eight tasks on four cores, so that every worker gets some
        language_id.language_id(docs, {"en": CLEAN.encode()}).select("score").collect()
    assert held(docs) == 0
