"""Copies of items that no template window finds."""

import random
import re

from veritab.llm import decontaminate


def test_verbatim_copies_are_found_whatever_their_slots(spark):
    long_item = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(59))
    items = [(1, "Compute 12 + 7, 3 + 4, 5 + 6"), (2, "What is 2 + 2"), (3, "Paris lies on the river Seine"), (4, long_item)]
    passage = " ".join(long_item.split()[20:40])
    docs = [(1, "so compute 12 + 7, 3 + 4, 5 + 6 now"), (2, "Well: what is 2 + 2?"), (3, "we say, Paris lies on the river Seine"), (4, f"before {passage} after"), (5, "compute 12 + 7, 3 + 4, 5 + 8 now"), (6, "what is 2 + 3"), (7, " ".join(passage.split()[:-1])), (8, None)]
    f, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(f, b).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(f, b).collect()) == [5, 6, 7, 8]


def rephrased(text, values):
    for old, new in values.items():
        text = re.sub(rf"\b{re.escape(old)}\b", new, text)
    return text


#: Questions, and what changes in a re-parameterised copy of each.
QUESTIONS = [
    ("Maria buys 12 apples and 7 pears at the market. She pays 3 euros for each apple. How much does she pay for the apples?", {"Maria": "Jonas", "She": "He", "she": "he", "12": "15", "7": "9", "3": "2"}),
    ("Tom drives 120 km in 2 hours. How many km does Tom drive in 5 hours at the same speed?", {"Tom": "Anna", "120": "90", "2": "3", "5": "8"}),
    ("A tank holds 500 l of water and loses 20 l every day. After how many days is the tank empty?", {"500": "640", "20": "16"}),
    ("Peter has twice as many marbles as Lena. Together they have 36 marbles. How many marbles does Lena have?", {"Peter": "Olga", "Lena": "Karl", "36": "48"}),
    ("Sarah reads 24 pages every evening. Her book has 312 pages in all. How many evenings does Sarah need for her book?", {"Sarah": "David", "Her": "His", "her": "his", "24": "18", "312": "270"}),
    ("The train from Berlin to Hamburg leaves at 9 and takes 3 hours to get there. When does it arrive in Hamburg?", {"Berlin": "Paris", "Hamburg": "Lyon", "9": "7", "3": "2"}),
    ("Julia mixes 250 g of flour with 3 eggs and 125 ml of milk. How much flour does Julia need for 12 eggs?", {"Julia": "Marco", "250": "300", "3": "4", "125": "200", "12": "16"}),
    ("If 4 workers build a wall in 6 days, how many days do 8 workers need to build the same wall?", {"4": "5", "6": "9", "8": "15"}),
    ("Nina saves 15 dollars every week. After 8 weeks she buys a coat for 100 dollars. How many dollars has she got left?", {"Nina": "Felix", "she": "he", "15": "25", "8": "6", "100": "130"}),
    ("Robert is 34 years old and his son is 8 years old. In how many years will Robert be twice as old as his son?", {"Robert": "Emma", "his": "her", "34": "41", "8": "12"}),
]


def test_recall_of_questions_with_other_values(spark):
    items = [(i, q) for i, (q, _) in enumerate(QUESTIONS)]
    docs = [(i, "Some words stand before it. " + rephrased(q, v) + " And some words come after.") for i, (q, v) in enumerate(QUESTIONS)]
    # one value stands for two others: slots are not consistent, or it is another question of the same kind
    docs += [(100, rephrased(QUESTIONS[1][0], {"120": "5", "2": "5"})), (101, "Maria buys pears at the market. How many days does she need for the wall of 500 l?")]
    f, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(f, b).collect()}
    assert len(got & {(i, i) for i in range(len(QUESTIONS))}) >= 0.9 * len(QUESTIONS)
    assert not any(d != i for d, i in got)


TOKEN = re.compile(r"[^\W_]+")


def reference(docs, items, window=8, shortest=5, coverage=0.3, run=20):
    """Pairs by comparing every window of every document with every window of every item, in plain Python."""
    capital, number = re.compile(r"[A-ZÀ-Ö][a-zà-ö]+"), re.compile(r"\d+")

    def split(text):
        out = []
        for x in TOKEN.findall(text or ""):
            kind = "n" if number.fullmatch(x) else "m" if capital.fullmatch(x) else ""
            if kind == "" and out and out[-1][0] == "n" and re.fullmatch(decontaminate.UNITS, x.lower()):
                kind = "u"
            out.append((kind, x.lower()))
        return out

    shape = lambda w: [k or ("pronoun" if x in decontaminate.PRONOUNS else x) for k, x in w]
    found = set()
    for i, text in items:
        item = split(text)
        size = min(window, len(item))
        if not item:
            continue
        places = range(len(item) - size + 1)
        slots = {a: sum(k != "" for k, _ in item[a : a + size]) for a in places}
        heavy = {a for a in places if 2 * slots[a] > size}
        typed = set(places) - heavy if size >= shortest else set()
        for d, doc_text in docs:
            doc = split(doc_text)
            raw, raw_item = [x for _, x in doc], [x for _, x in item]
            n = min(run, len(item))
            grams = {tuple(raw[p : p + n]) for p in range(len(raw) - n + 1)}
            whole = any(tuple(raw_item[p : p + n]) in grams for p in range(len(item) - n + 1))
            hit, valued, alignments = set(), set(), {}
            for p in range(len(doc) - size + 1):
                own = doc[p : p + size]
                for a in places:
                    it = item[a : a + size]
                    if a in typed and shape(own) == shape(it):
                        alignments.setdefault(p - a, []).append((a, [(y[1], x[1]) for x, y in zip(own, it, strict=True) if y[0]]))
                    if a in heavy and 2 * sum(k != "" for k, _ in own) > size and [x for _, x in own] == [x for _, x in it]:
                        valued.add(a)
            for rows in alignments.values():
                pairs = {p for _, x in rows for p in x}
                plain = {a for a, x in rows if not x}
                hit |= plain
                if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    hit |= {a for a, _ in rows}
            share = max([len(hit) / len(typed) if typed else 0, (len(hit) + len(valued)) / (len(typed) + len(heavy)) if typed or heavy else 0])
            if whole or share >= coverage:
                found.add((d, i))
    return found


def test_pairs_match_a_reference_in_python(spark):
    rng = random.Random(11)
    vocab = "the a of river stone walks Maria Paris Tom 3 7 12 km house and under green he she takes 5 hours days Berlin".split()
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 8, 9, 12, 15, 22, 40])))) for i in range(25)]
    docs = [(0, None), (1, ""), (2, "Maria")]
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)[1].split()
        if k % 2:
            low = rng.randint(0, len(item) // 2)
            item = item[low : rng.randint(low, len(item))]
        if k % 3 == 0:
            item = [{"Maria": "Tom", "3": "12", "Paris": "Berlin"}.get(x, x) for x in item]
        words[len(words) // 2 : len(words) // 2] = item
        docs.append((k + 3, " ".join(words)))
    f, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items + items[:2], "item_id long, text string")
    for limit in (1 << 20, 0):
        decontaminate.BROADCAST_WINDOWS, before = limit, decontaminate.BROADCAST_WINDOWS
        try:
            got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(f, b).collect()}
        finally:
            decontaminate.BROADCAST_WINDOWS = before
        assert got == reference(docs, items)
