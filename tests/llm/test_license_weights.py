"""The weights of the license scan that the query uses, against brute force."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veritab.llm import licenses

NOTICE = "Released under the MIT License."


def origins(spark, rows):
    f = spark.createDataFrame(rows, "doc_id long, p string, text string")
    return {r["doc_id"]: (r["license"], r["origin"]) for r in licenses.license_scan(f, F.col("p")).collect()}


def test_a_notice_in_a_third_of_the_files_is_found(spark):
    rows = [(i, f"d{i}/x.py", f"x\n{NOTICE}" if i % 3 == 0 else f"some of the text to write {i}") for i in range(300)]
    got = origins(spark, rows)
    assert all(got[i] == (("MIT", "own") if i % 3 == 0 else (None, "none")) for i in range(300))
    got = origins(spark, [(i, f"d{i}/LICENSE", NOTICE) for i in range(30)] + [(100, "d1/a/b.py", "hello")])
    assert got[100] == ("MIT", "inherited") and got[3] == ("MIT", "own")


def brute(weights, words, least):
    best = 0.0
    for _, length, pull in weights.units:
        for a, b in [(0, len(words)), *((s, s + length) for s in range(len(words) - length + 1))]:
            n = Counter(words[a:b])
            norm = sum((c * weights.idf[w]) ** 2 for w, c in n.items() if w >= 0) + n.get(-1, 0) * weights.other**2
            if sum(w >= 0 and pull[w] > 0 for w in n) >= 2:
                best = max(best, sum(pull[w] * c for w, c in n.items()) / norm**0.5)
    return best if best >= least else 0.0


def test_best_stretches_match_brute_force():
    rng, vocabulary = np.random.default_rng(2), licenses.Vocabulary()
    v = len(vocabulary.words)
    for _ in range(8):
        weights = licenses.Weights(vocabulary, 1000, rng.integers(0, 1000, v).astype(float))
        lines = []
        for _ in range(60):
            parts = vocabulary.templates[rng.integers(len(vocabulary.templates))][1]
            inner = [weights.place[w] if rng.random() < 0.85 else int(rng.integers(-1, v)) for w in parts]
            lines.append([*rng.integers(-1, 4, rng.integers(0, 30)).tolist(), *inner, *rng.integers(-1, v, rng.integers(0, 30)).tolist()])
        bounds = np.append(0, np.cumsum([len(x) for x in lines]))
        got = np.zeros(len(lines))
        number, cosine, _, _ = weights.best(np.concatenate(lines).astype(np.int64), bounds, 0.6)
        got[number] = cosine
        assert np.allclose(got, [brute(weights, x, 0.6) for x in lines]) and (got > 0).any()


def test_foreign_words_on_the_line_do_not_lose_the_notice():
    vocabulary = licenses.Vocabulary()
    for files in (100, 10_000, 10_000_000):
        weights = licenses.Weights(vocabulary, files, np.full(len(vocabulary.words), files / 100))
        words = [weights.place[w] for w in licenses.PART.findall(NOTICE.lower())]
        # before the notice, and one amid it
        for line, least in (([-1, -1, *words], 0.999), ([*words[:2], -1, *words[2:]], 0.75)):
            _, cosine, template, _ = weights.best(np.array(line), np.array([0, len(line)]), 0.6)
            assert len(cosine) == 1 and cosine[0] > least and weights.units[template[0]][0] == "MIT"


def cosine(words, template, idf, length=None):
    """The best cosine of all words and, with a length, of all stretches of that length; two shared words at least."""
    n = Counter(template)
    whole = sum((c * idf(w)) ** 2 for w, c in n.items()) ** 0.5
    best = 0.0
    for a, b in [(0, len(words)), *((s, s + length) for s in range(len(words) - (length or 0) + 1) if length)]:
        own = Counter(words[a:b])
        if len(own.keys() & n.keys()) >= 2 and (norm := sum((c * idf(w)) ** 2 for w, c in own.items() if w in KNOWN) + sum(c * idf(w) ** 2 for w, c in own.items() if w not in KNOWN)):
            best = max(best, sum(c * idf(w) * n[w] * idf(w) for w, c in own.items()) / whole / norm**0.5)
    return best


KNOWN: set = set()


def reference(rows):
    """doc_id -> (license, origin, license_path), file by file and line by line."""
    vocabulary = licenses.Vocabulary()
    notices, texts = set(vocabulary.words[: vocabulary.notices]), set(vocabulary.words)
    words = [[licenses.PART.findall(x) for x in (t or "").lower().split("\n")] for _, _, t in rows]
    seen = Counter(w for lines in words for w in {x for line in lines for x in line})
    weight = lambda c: min(np.log((1 + len(rows)) / (1 + c)) + 1, licenses.MOST_WEIGHT)
    other = min(np.log(1 + len(rows)) + 1, licenses.MOST_WEIGHT)
    files = []
    for (i, path, _), lines in zip(rows, words, strict=True):
        flat = [w for line in lines for w in line]
        KNOWN.clear()
        KNOWN.update(texts)
        whole = max((round(cosine(flat, parts, lambda w: weight(seen[w]) if w in texts else other), 9), name) for name, parts in vocabulary.texts) if flat else (0.0, "")
        KNOWN.clear()
        KNOWN.update(notices)
        best, covered = (0.0, None), 0
        for line in lines:
            found = [(-round(cosine(line, parts, lambda w: weight(seen[w]) if w in notices else other, len(parts)), 9), k) for k, (_, parts) in enumerate(vocabulary.templates)]
            score, k = min(found)
            if -score >= 0.6:
                name, parts = vocabulary.templates[k]
                covered += len(line) if round(cosine(line, parts, lambda w: weight(seen[w]) if w in notices else other), 9) == -score else len(parts)
                if -score > best[0]:
                    best = (-score, name)
        share = covered / max(1, len(flat))
        if whole[0] >= licenses.WHOLE_COSINE:
            best, share = whole, 1.0
        files.append((i, path, best, share))
    holders = {}
    for _, path, (score, name), share in files:
        if name and path is not None and (share >= 0.5 or licenses.re.match(licenses.LICENSE_FILE, path.rsplit("/", 1)[-1])):
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            holders[folder] = min(holders.get(folder, (9.0, "", "")), (-score, path, name))
    out = Counter()
    for i, path, (_, name), _ in files:
        origin, where = ("own", path) if name else ("none", None)
        if not name and path is not None:
            folder = path.rsplit("/", 1)[0] if "/" in path else ""
            while folder not in holders and folder:
                folder = folder.rsplit("/", 1)[0] if "/" in folder else ""
            if folder in holders:
                _, where, name = holders[folder]
                origin = "inherited"
        out[i, name, origin, where] += 1
    return out


def test_scan_matches_a_reference_in_python(spark):
    rng = np.random.default_rng(8)
    plain = "this file holds some code of the program and a few words more about how it works".split()
    notices = list(licenses.TEMPLATES.values())
    rows = [(1, None, NOTICE), (2, "x.py", None), (3, "a/b/LICENSE", ""), (4, "a/b/LICENSE", licenses.TEXTS["ISC"]), (4, "a/b/LICENSE", licenses.TEXTS["ISC"]), (5, "COPYING", "c 2001 somebody\n" + licenses.TEXTS["BSD-3-Clause"]), (6, "q/LICENSE.md", licenses.TEXTS["BSD-2-Clause"].replace("\n", " ")), (7, None, None)]
    for i in range(120):
        folder = "/".join(rng.choice(["a", "b", "q", "z"], rng.integers(0, 4)))
        text = "\n".join(" ".join(rng.choice(plain, rng.integers(0, 12))) for _ in range(rng.integers(0, 5)))
        if i % 2:  # half of all files carry one notice
            text = f"{text} {NOTICE}"
        elif i % 3 == 0:
            text += "\n" + str(rng.choice(notices)) + " " + " ".join(rng.choice(plain, rng.integers(0, 8)))
        rows.append((10 + i % 100, f"{folder}/{i}.py".lstrip("/"), text))
    f = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, p string, text string, row string, license string").repartition(3)
    got = licenses.license_scan(f, F.col("p")).select("doc_id", "license", "origin", "license_path").collect()
    made, expected = Counter(map(tuple, got)), reference(rows)
    assert made == expected, (sorted(map(str, made - expected))[:8], sorted(map(str, expected - made))[:8])


def test_whole_texts_and_common_notices(spark):
    rows = [(i, f"d{i}/x.py", f"x\n{NOTICE}" if i % 2 else "no words of that kind here") for i in range(100)]
    rows += [(200, "p/terms.txt", "(c) 2020 A. Nobody\n\n" + licenses.TEXTS["MIT"].lower()), (201, "p/s/y.py", "hello")]
    got = origins(spark, rows)
    assert all(got[i] == (("MIT", "own") if i % 2 else (None, "none")) for i in range(100))
    assert got[200] == ("MIT", "own") and got[201] == ("MIT", "inherited")
