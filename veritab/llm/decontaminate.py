"""Benchmark decontamination by template windows, in DataFrame operations only.

1. Numbers, units behind numbers, and names (all capitalised words, so that a name that begins a sentence is one too)
   become typed placeholders that still carry their values; the rest of a text is lower-cased and split into runs of
   letters and digits. In templates, third-person pronouns are one word, as they change with names.
2. All windows of ``window`` template tokens of an item, and the whole of a shorter item down to ``shortest``
   tokens, are hashed. Windows of which less than half are literal tokens say little: they are hashed with their
   values instead, and so found where they are verbatim.
3. The windows of all documents are hash-joined with these.
4. Matches of one document and item on one diagonal (document position less item position) are one alignment.
   It is consistent if its slots map one to one: each item value to one document value, and the other way.
   Copies keep all values; a re-parameterised question replaces them consistently.
5. A pair is contaminated if its consistent alignments cover ``coverage`` of the item's windows, or of these and
   the windows of mostly slots.
6. Whatever slots and share there are, a pair is also contaminated by a verbatim run: ``run`` tokens in a row, or
   the whole of a shorter item, compared as lower-cased tokens without types. Every such run holds one of the
   document's windows that begin at a multiple of the runs' shortest number of windows; these anchors are
   joined with the items' windows, and the tokens beside them are compared on their diagonal.

Null and empty texts match nothing. Items of fewer than ``shortest`` tokens are found by verbatim copies. Rows of
documents with the same id are taken as one document, items with the same id as one item. Each document and item is
told once, so there are no ties. A document with a null id is in no pair. ``decontaminated`` tells rows by id and text
together, so rows with a null id, or with the id of another, stay or go by their own text. Very long texts are read
whole. Empty tables give no pair. Extra columns of either table may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._core import named, packed, released, staged

WINDOW, SHORTEST, COVERAGE, RUN = 8, 5, 0.3, 20
#: The items' windows are broadcast if they are no more than these, else both sides are dealt out.
BROADCAST_WINDOWS = 1 << 20

#: Units that may stand behind a number, and pronouns.
UNITS = "mm|cm|dm|m|km|mg|g|kg|t|ml|cl|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inches|pounds?|euros?|dollars?|cents?|percent"
UNITS += "|stunden?|minuten?|sekunden?|tage?|wochen?|monate?|jahre?|meter|kilo|heures?|jours?|semaines?|mois|ans?|années?|horas?|minutos?|segundos?|días?|semanas?|meses|años?|metros?"
PRONOUNS = "he she him her his hers himself herself they them their theirs themself themselves".split()

MARK, POINT, PRONOUN = "\u0001", "\u0002", "\u0002p"


def tokens_of(text: Column) -> Column:
    """Tokens; a placeholder is the mark, its type (n, u, m) and its value."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.contains(MARK) | t.contains(POINT), F.translate(t, MARK + POINT, "  ")).otherwise(t)
    n = F.regexp_replace(t, r"(?<=\d)[.,](?=\d)", POINT)
    n = F.regexp_replace(n, rf"(?<![\p{{L}}\d{POINT}])[\d{POINT}]+", f" {MARK}n$0 ")
    n = F.regexp_replace(n, rf"({MARK}n[\d{POINT}]+)\s+({UNITS})(?![\p{{L}}\d])", f"$1 {MARK}u$2 ")
    t = F.when(t.rlike(r"\d"), n).otherwise(t)
    t = F.regexp_replace(t, rf"(?<![\p{{L}}{MARK}])\p{{Lu}}\p{{Ll}}+", f" {MARK}m$0")
    return F.array_remove(F.split(F.lower(t), rf"[^\p{{L}}\p{{M}}\p{{N}}{MARK}{POINT}]+", -1), "")


def is_slot(token: Column) -> Column:
    return token.startswith(MARK)


def template_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.when(is_slot(x), F.substring(x, 1, 2)).when(x.isin(*PRONOUNS), PRONOUN).otherwise(x))


def raw_of(tokens: Column) -> Column:
    """Lower-cased tokens without types."""
    return F.transform(tokens, lambda x: F.when(is_slot(x), F.substring(x, 3, 1 << 30)).otherwise(x))


def hashes_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def bound(value: Column, body) -> Column:
    """body of a value that is made once: else the optimizer may move what makes it into the body's loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def windows_at(starts: Column, hashes: Column, kind: str, size: int) -> Column:
    """(place, h, kind) of the windows of ``size`` tokens that begin at these numbers, from 1."""
    return bound(hashes, lambda held: F.transform(starts, lambda i: F.struct((i - 1).alias("place"), F.xxhash64(F.slice(held, i, size)).alias("h"), F.lit(kind).alias("kind"))))


def starts_of(n: Column, size: int, step: int = 1) -> Column:
    """Numbers, from 1, of the tokens at which every step-th window of ``size`` tokens begins."""
    return F.when(n >= size, F.sequence(F.lit(1), n - (size - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))


def slotted_starts(tokens: Column, size: int) -> Column:
    """Starts of the windows of ``size`` tokens of which more than half are slots: from the slots' places alone."""
    least = size // 2 + 1
    places = F.filter(F.transform(tokens, lambda x, i: F.when(is_slot(x), i + 1)), lambda i: i.isNotNull())
    dense = lambda p: F.filter(F.transform(p, lambda x, k: F.struct(x.alias("a"), F.get(p, k + (least - 1)).alias("b"))), lambda y: y["b"] - y["a"] < size)
    lists = F.transform(bound(places, dense), lambda y: F.sequence(F.greatest(F.lit(1), y["b"] - (size - 1)), y["a"]))
    return bound(F.size(tokens) - (size - 1), lambda last: F.filter(F.array_distinct(F.flatten(lists)), lambda i: i <= last))


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Rows (item, size, at, h, values, kind, slots): the windows of each item, kind t by template, v of mostly slots by
    their values, a (anchor) all by their values; and rows (item, raw): the items' tokens without types."""
    tokens = items.select(F.col(id_column).alias("item"), tokens_of(F.col(text_column).cast("string")).alias("tokens")).filter(F.size("tokens") > 0)
    tokens = staged(tokens.distinct(), "item-tokens").withColumn("size", F.least(F.size("tokens"), F.lit(window)))
    hashed = tokens.select("item", "size", "tokens", hashes_of(template_of(F.col("tokens"))).alias("typed"), hashes_of(raw_of(F.col("tokens"))).alias("untyped"))
    at = hashed.select("*", F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)).alias("at"))
    values = F.slice("tokens", F.col("at"), F.col("size"))
    at = at.withColumn("values", values).withColumn("slots", F.size(F.filter("values", is_slot)))
    of = lambda hashes: F.xxhash64(F.slice(hashes, F.col("at"), F.col("size")))
    heavy = F.col("slots") * 2 > F.col("size")
    kinds = [("t", of("typed"), ~heavy & (F.col("size") >= shortest)), ("v", of("untyped"), heavy), ("a", of("untyped"), F.lit(True))]
    parts = [at.filter(which).select("item", "size", (F.col("at") - 1).alias("at"), h.alias("h"), "values", F.lit(kind).alias("kind"), "slots", F.size("tokens").alias("n")) for kind, h, which in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct(), tokens.select("item", raw_of(F.col("tokens")).alias("raw"))


def _one_to_one(pairs: Column) -> Column:
    """Whether the distinct (item value, document value) pairs are as many as the values on either side."""
    distinct = F.array_distinct(pairs)
    return (F.size(distinct) == F.size(F.array_distinct(F.transform(distinct, lambda p: p["i"])))) & (F.size(distinct) == F.size(F.array_distinct(F.transform(distinct, lambda p: p["d"]))))


def _longest_run(a: Column, b: Column) -> Column:
    """The most tokens in a row that two aligned lists share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = lambda now, most: F.struct(now.alias("now"), most.alias("most"))
    step = lambda acc, x: F.when(x, state(acc["now"] + 1, F.greatest(acc["most"], acc["now"] + 1))).otherwise(state(F.lit(0), acc["most"]))
    return F.aggregate(same, state(F.lit(0), F.lit(0)), step, lambda acc: acc["most"])


def contaminated_pairs(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, shortest: int = SHORTEST, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """Rows (id, item id, n_windows, n_matched, coverage, n_slots): the contaminated pairs."""
    benchmark, item_tokens = item_windows(items, item_column, item_text_column, window, shortest)
    benchmark = staged(benchmark, "items")
    totals = benchmark.groupBy("item").agg(F.countDistinct(F.when(F.col("kind") == "t", F.col("at"))).alias("n_windows"), F.countDistinct(F.when(F.col("kind") == "v", F.col("at"))).alias("n_heavy"))
    # of each kind and size, the least number of windows that a verbatim run has: at most window rows of each kind
    least = F.min(F.least(F.col("n"), F.lit(run)) - F.col("size") + 1)
    kinds = sorted((r["kind"], r["size"], max(1, r["step"])) for r in benchmark.groupBy("kind", "size").agg(least.alias("step")).collect())
    small = benchmark.count() <= BROADCAST_WINDOWS
    hinted = (lambda x: F.broadcast(x)) if small else (lambda x: x)

    rows = packed(docs).select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    tokens = rows.select("doc", tokens_of(F.col("text")).alias("tokens"))
    hashed = tokens.select("doc", "tokens", hashes_of(template_of(F.col("tokens"))).alias("typed"), hashes_of(raw_of(F.col("tokens"))).alias("untyped"))
    lists = []
    for kind, size, step in kinds or [("t", window, 1)]:
        starts = slotted_starts(F.col("tokens"), size) if kind == "v" else starts_of(F.size("typed"), size, step if kind == "a" else 1)
        lists.append(windows_at(starts, F.col("typed" if kind == "t" else "untyped"), kind, size))
    known = benchmark.select("h", "kind").distinct()
    each = hashed.select("doc", F.inline(F.concat(*lists)))
    found = staged(each.join(hinted(known), ["h", "kind"]).select("doc", "place", "h", "kind"), "matches")
    n = found.count()
    every = found.join(hinted(benchmark), ["h", "kind"]).select("doc", "item", "place", "at", "slots", "values", "size", "kind", (F.col("place") - F.col("at")).alias("diagonal"))
    matches = every.filter("kind = 't'")
    plain = matches.filter("slots = 0").select("doc", "item", "at", "kind", "slots")
    valued = every.filter("kind = 'v'").select("doc", "item", "at", "kind", "slots")
    slotted, anchors = staged(matches.filter("slots > 0"), "slotted", n), staged(every.filter("kind = 'a'").select("doc", "item", "diagonal").distinct(), "anchors", n)

    # only documents with a match whose tokens matter are read again
    wanted = staged(slotted.select("doc").unionByName(anchors.select("doc")).filter("doc is not null").select(F.xxhash64("doc").alias("h")).distinct(), "wanted", n)
    # hashes tell which texts may matter; the joins by doc tell which do
    again = staged(rows.withColumn("h", F.xxhash64("doc")).join(named(wanted), "h", "left_semi").select("doc", tokens_of(F.col("text")).alias("tokens")), "tokens")
    released(wanted)
    sided = slotted.join(again, "doc").withColumn("own", F.slice("tokens", F.col("place") + 1, F.col("size")))
    # rows of one id are tried each; only the row that has the window there counts
    sided = sided.filter(template_of(F.col("own")) == template_of(F.col("values")))
    pairs = F.filter(F.arrays_zip(F.col("values").alias("i"), F.col("own").alias("d")), lambda p: is_slot(p["i"]))
    sided = sided.select("doc", "item", "diagonal", "at", "slots", pairs.alias("pairs"))
    grouped = sided.groupBy("doc", "item", "diagonal").agg(F.collect_set("at").alias("ats"), F.flatten(F.collect_set("pairs")).alias("pairs"), F.max("slots").alias("slots"))
    consistent = grouped.filter(_one_to_one(F.col("pairs"))).select("doc", "item", F.explode("ats").alias("at"), F.lit("t").alias("kind"), "slots")

    beside = anchors.join(again, "doc").join(hinted(item_tokens), "item")
    begin = F.greatest(F.col("diagonal"), F.lit(0)) + 1  # of the document's tokens beside the item's
    inside = F.slice("raw", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("raw"))
    beside = beside.select("doc", "item", F.size("raw").alias("n"), _longest_run(inside, raw_of(F.slice("tokens", begin, F.size("raw")))).alias("run"))
    runs = beside.filter(F.col("run") >= F.least(F.col("n"), F.lit(run))).select("doc", "item").distinct().withColumn("whole", F.lit(True))

    parts = plain.unionByName(consistent).unionByName(valued)
    covered = parts.groupBy("doc", "item").agg(F.countDistinct(F.when(F.col("kind") == "t", F.col("at"))).alias("n_typed"), F.countDistinct(F.when(F.col("kind") == "v", F.col("at"))).alias("n_raw"), F.max("slots").alias("n_slots"))
    scored = covered.join(runs, ["doc", "item"], "full_outer").join(hinted(totals), "item").fillna(0, ["n_typed", "n_raw", "n_slots"])
    typed, both = F.try_divide("n_typed", "n_windows"), F.try_divide(F.col("n_typed") + F.col("n_raw"), F.col("n_windows") + F.col("n_heavy"))
    more = F.coalesce(both > F.coalesce(typed, F.lit(0.0)), F.lit(False))
    scored = scored.withColumn("coverage", F.coalesce(F.greatest(typed, both), F.lit(0.0))).filter((F.col("coverage") >= coverage) | F.coalesce("whole", F.lit(False)))
    n_windows, n_matched = F.col("n_windows") + F.when(more, F.col("n_heavy")).otherwise(0), F.col("n_typed") + F.when(more, F.col("n_raw")).otherwise(0)
    return scored.select(F.col("doc").alias(id_column), F.col("item").alias(item_column), n_windows.alias("n_windows"), n_matched.alias("n_matched"), "coverage", "n_slots")


def decontaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that no item contaminates.

    A row is told by its id and a hash of its text, so of rows with one id, or with a null id, those stay that are clean.
    """
    key = F.struct(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column).cast("string")).alias("h"))
    keyed = docs.select(key.alias("key"), F.col(text_column).alias("text"), F.struct("*").alias("row"))
    bad = staged(contaminated_pairs(keyed, items, "key", "text", **options).select(F.col("key").alias("bad")).distinct(), "contaminated")
    return keyed.join(named(bad), F.col("key").eqNullSafe(F.col("bad")), "left_anti").select("row.*")
