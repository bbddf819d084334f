"""Toxicity and language identification against scorers in plain Python, row by row."""

import math
import random
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from veritab.llm import _logistic, language_id, toxicity

SCHEMA = "doc_id long, text string, lang string, id string, row string, score double"


def swaps_and_edits(term):
    """All words within one letter wrong, missing, added or swapped with the next, as a pattern each."""
    out = {re.escape(term)}
    for i in range(len(term) + 1):
        a, b = re.escape(term[:i]), term[i:]
        out.add(rf"{a}\w{re.escape(b)}")
        if b:
            out.add(a + re.escape(b[1:]))
            out.add(rf"{a}\w{re.escape(b[1:])}")
        if len(b) > 1:
            out.add(a + re.escape(b[1] + b[0] + b[2:]))
    return re.compile("|".join(out))


def reference_score(text, terms, stems, weights, bias):
    near_terms = [swaps_and_edits(t) if len(t) >= toxicity.FUZZY_LENGTH else re.compile(re.escape(t)) for t in terms]
    lower = (text or "").lower()
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+", lower)]
    counts, entries = dict.fromkeys(toxicity.EXTRA, 0), {}
    hits = 0
    for i, (w, _, _) in enumerate(words):
        found = [(len(terms) + k, None) for k, s in enumerate(stems) if w.startswith(s)]
        if w in terms:
            found += [(terms.index(w), False)]
        elif close := [k for k, p in enumerate(near_terms) if p.fullmatch(w)]:
            found += [(close[0], True)]
        hits += len(found)
        for entry, fuzzy in found:
            entries[entry] = entries.get(entry, 0) + 1
            if fuzzy is None:
                counts["stems"] += 1
                continue
            counts["fuzzy" if fuzzy else "exact"] += 1
            around = lower[words[i - 1][2] if i else 0 : words[i + 1][1] if i + 1 < len(words) else len(lower)]
            near = {x for x, _, _ in words[max(0, i - 6) : i] + words[i + 1 : i + 7]}
            quoted = any(c in around for c in "\"“”«»„‘’") or near & toxicity.REPORTING
            counts["quoted" if quoted else "addressed" if near & toxicity.ADDRESS else "plain"] += 1
    if not hits:
        return 1 / (1 + math.exp(-bias)), counts
    margin = bias + sum(weights[k] * math.log1p(counts[x]) for k, x in enumerate(toxicity.EXTRA[:6]))
    margin += weights[6] * math.log1p(100 * hits / len(words)) + weights[7]
    margin += sum(weights[len(toxicity.EXTRA) + k] * math.log1p(n) for k, n in entries.items())
    return 1 / (1 + math.exp(-max(-40, min(40, margin)))), counts


def test_toxicity_matches_a_scorer_in_python(spark):
    rng = random.Random(4)
    vocab = "you your he said the house idiot idoit idiott moron morn stupid stpid sutpid losers loser trash trahs klown clown word achlich good day «x» \"scum\" scum scam".split()
    texts = [None, "", " \n", "idiot", "IDIOT!", "idiot " * 3000] + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    rows = [(i % 90 if i else None, t, "en", "clash", "clash", 0.0) for i, t in enumerate(texts)]
    sample = [(str(i), f"well {'you idiot' if i % 2 else 'dear friend'} {rng.choice(vocab)} {i}", i % 2) for i in range(120)]
    terms, _, _, _ = toxicity.learn(sample)
    stems = ["achl"]
    np_rng = np.random.default_rng(3)
    model = (terms, stems, np_rng.normal(0.3, 1, len(toxicity.EXTRA) + len(terms) + 1), -0.3)
    f = spark.createDataFrame(rows + rows[:20], SCHEMA).repartition(3)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9), r["predicted"], r["n_exact"], r["n_fuzzy"], r["n_quoted"]) for r in toxicity.toxicity(f, model).collect())
    expected = []
    for i, t, *_ in rows + rows[:20]:
        score, n = reference_score(t, *model)
        expected.append((-1 if i is None else i, round(score, 9), int(score >= 0.5), n["exact"], n["fuzzy"], n["quoted"]))
    assert got == sorted(expected) and len({x[2] for x in got}) == 2
    assert f.select(toxicity.held_out("doc_id").alias("h")).filter("h is null").isEmpty()


def test_language_matches_a_scorer_in_python(spark):
    rng = random.Random(6)
    said = {"en": "the house was by the river and the boats went on with them", "de": "das haus stand am fluss und die boote fuhren weiter mit ihnen", "fr": "la maison était près de la rivière et les bateaux passaient"}
    samples = {x: [[" ".join(rng.choice(t.split()) for _ in range(30))] for _ in range(40)] for x, t in said.items()}
    dictionaries = language_id.build(samples)
    texts = [None, "", "12 34 !", "Ω", "x " * 4000] + [" ".join(rng.choice((said[rng.choice(list(said))]).split()) for _ in range(rng.randint(1, 900))) + rng.choice(["", " 12.", "!?"]) for _ in range(80)]
    f = spark.createDataFrame([(i % 50 if i else None, t, None, "clash", "clash", 1.0) for i, t in enumerate(texts)] * 2, SCHEMA).repartition(3)

    def predicted(text):
        clean = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
        if not clean:
            return "und", 0.0, 0.0
        sizes = []
        for name, held in dictionaries.items():
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total = 0
            for k in range(0, len(clean), 2048):
                total += len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(clean[k : k + 2048].encode()))
            sizes.append((total, len(sizes), name))
        (a, _, best), (b, _, _) = sorted(sizes)[:2]
        return best, round(1 / (1 + (a / b) ** 20), 9), round(1 - a / b, 9)

    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"], round(r["score"], 9), round(r["margin"], 9), r["lang"] or "") for r in language_id.language_id(f, dictionaries, carry=("lang", "text")).collect())
    assert got == sorted((-1 if i == 0 else i % 50, *predicted(t), "") for i, t in list(enumerate(texts)) * 2)
    narrow = spark.createDataFrame([("en", 0.5), ("en", 0.001), ("und", 0.0)], "lang_pred string, margin double")
    assert [r["r"] for r in narrow.select(language_id.rejected().alias("r")).collect()] == [False, True, True]
    assert f.select(language_id.held_out("doc_id").alias("h")).filter("h is null").isEmpty()


def test_pieces_come_from_all_over_a_text(spark):
    f = spark.createDataFrame([("a" * 5000 + "é" * 5000,), ("short é",), ("",)], "t string")
    made = [r["p"] for r in f.select(language_id.pieces_of(F.col("t")).alias("p")).collect()]
    assert made[1] == ["short é"] and made[2] == [""]
    assert made[0] == ["a" * 256] * 4 + ["é" * 256] * 4


def test_one_language_and_ties(spark):
    f = spark.createDataFrame([(1, "abc def"), (2, None), (3, "7")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.language_id(f, {"en": b"some words of it"}).orderBy("doc_id").collect()] == ["en", "und", "und"]
    twins = {"b": b"the same words in both", "a": b"the same words in both"}
    got = {r["doc_id"]: r for r in language_id.language_id(f, twins).withColumn("rejected", language_id.rejected()).collect()}
    assert got[1]["lang_pred"] == "b" and got[1]["margin"] == 0 and got[1]["rejected"]


@pytest.mark.parametrize("most_chars", [1 << 26, 400])
def test_samples_are_whole_texts_within_a_bound(spark, most_chars):
    docs = spark.createDataFrame([(i, "x" * 50 + str(i)) for i in range(40)] + [(None, "y"), (50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (50, 0), (7, 5), (8, None)], "doc_id long, toxic int")
    got = _logistic.sampled(docs, labels, "toxic", F.lit(True), 1000, most_chars=most_chars)
    assert got == _logistic.sampled(docs.repartition(3), labels, "toxic", F.lit(True), 1000, most_chars=most_chars)
    assert all(t in ("", "x" * 50 + i) for i, t, _ in got) and sum(len(t) for _, t, _ in got) <= most_chars
    assert len(got) == (41 if most_chars > 400 else 7) or most_chars == 400
