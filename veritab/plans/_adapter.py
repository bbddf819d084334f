"""The reference concepts on the driver's tables, for Spark and as SQL common table expressions.

accounts: each embedding is an attribution account of flow ``vec_id``, class ``label`` and fitted seed 42 to 46;
the second account of a flow is that of the next vector of its class. predictions: events scored by two fixed
arithmetic rules. rows: lineitem rows, named by a hash of all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import accounts as A
from veritab.operators.prefix import running_totals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow, label, seed, a (doubles as stored), m (their magnitudes)."""
    e = table(spark, sf_dir, "embeddings")
    a = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("flow"), "label", (42 + F.col("vec_id") % 5).cast("int").alias("seed"), a.alias("a"), A.absolute(F.col("embedding")).alias("m"))


def account_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow, label, seed, a, b, x, y: magnitudes x of the flow and y of the next flow of the class."""
    own = accounts(spark, sf_dir)
    # only flows are numbered, by running totals; their arrays are joined by flow, however few the classes
    places = running_totals(own.select("flow", "label", F.lit(1).alias("one")), "flow", ["one"], "label").select("flow", "label", F.col("cum_one").alias("place"))
    after = places.select(F.col("flow").alias("next"), "label", (F.col("place") - 1).alias("place"))
    following = places.join(after, ["label", "place"]).select("flow", "next")
    other = own.select(F.col("flow").alias("next"), F.col("a").alias("b"), F.col("m").alias("y"))
    return own.join(following, "flow").join(other, "next").select("flow", "label", "seed", "a", "b", F.col("m").alias("x"), "y")


ACCOUNTS = """
acc AS (SELECT vec_id AS flow, label, (42 + vec_id % 5)::INT AS seed, list_transform(embedding, lambda x: x::DOUBLE) AS a,
               list_transform(embedding, lambda x: abs(x::DOUBLE)) AS m FROM embeddings)"""
PAIRS = ACCOUNTS + """,
pairs AS (SELECT * FROM (SELECT flow, label, seed, a, lead(a) OVER (PARTITION BY label ORDER BY flow) AS b, m AS x,
                                lead(m) OVER (PARTITION BY label ORDER BY flow) AS y FROM acc) t WHERE y IS NOT NULL)"""

# The similarity of each pair, long way round: features as rows, ranks by windows.
SIMILARITY = PAIRS + """,
long AS (SELECT flow, label, seed, unnest(x) AS x, unnest(y) AS y, generate_subscripts(x, 1) - 1 AS i FROM pairs),
ranked AS (SELECT *, rank() OVER (PARTITION BY flow ORDER BY x) + (count(*) OVER (PARTITION BY flow, x) - 1) / 2.0 AS rx,
                  rank() OVER (PARTITION BY flow ORDER BY y) + (count(*) OVER (PARTITION BY flow, y) - 1) / 2.0 AS ry,
                  row_number() OVER (PARTITION BY flow ORDER BY x DESC, i) AS px, row_number() OVER (PARTITION BY flow ORDER BY y DESC, i) AS py,
                  sum(x) OVER (PARTITION BY flow) AS sx, sum(y) OVER (PARTITION BY flow) AS sy FROM long),
sim AS (SELECT flow, label, seed,
               corr(rx, ry) AS r, max(abs(x - y)) AS maxdiff, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, max(sx) AS sx, max(sy) AS sy,
               max(x) FILTER (WHERE px = 10) - max(x) FILTER (WHERE px = 11) AS gx, max(y) FILTER (WHERE py = 10) - max(y) FILTER (WHERE py = 11) AS gy,
               count(*) FILTER (WHERE px <= 10 AND py <= 10) AS shared,
               sum(least(x / sx, y / sy)) AS low, sum(greatest(x / sx, y / sy)) AS high, 0.5 * sum(abs(x / sx - y / sy)) AS l1
        FROM ranked GROUP BY flow, label, seed),
simil AS (SELECT flow, label, seed,
                   CASE WHEN rank_ok THEN CASE WHEN maxdiff <= 1e-12 THEN 1.0 ELSE r END ELSE 0.0 END AS spearman,
                   CASE WHEN top_ok THEN shared / (20.0 - shared) ELSE 0.0 END AS jaccard_10,
                   low / high AS weighted_jaccard, l1 AS normalized_mass_l1, rank_ok, top_ok, sx, sy
            FROM (SELECT *, maxx - minx > greatest(1e-12, maxx * 1e-8) AND maxy - miny > greatest(1e-12, maxy * 1e-8) AS rank_ok,
                            gx > greatest(1e-12, maxx * 1e-8) AND gy > greatest(1e-12, maxy * 1e-8) AS top_ok FROM sim) t)"""


def similar(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pairs = account_pairs(spark, sf_dir)
    made = A.similarity(F.col("x"), F.col("y"), **options)
    return pairs.select("flow", "label", "seed", made.alias("s")).select("flow", "label", "seed", "s.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow, seed, truth, scores p1 and p2 in [0, 1), decisions d1 and d2, source, value."""
    e = table(spark, sf_dir, "events")
    p1 = (F.col("event_id") * 7919 % 1000) / 1000.0
    p2 = (F.col("event_id") * 104729 % 997) / 997.0
    truth = (F.col("event_type") == "error").cast("int")
    # scores that know a little of the truth
    s1, s2 = (p1 + truth * 0.5) / 1.5, (p2 + truth * 0.25) / 1.25
    return e.select(F.col("event_id").alias("flow"), (42 + F.col("event_id") % 5).cast("int").alias("seed"), truth.alias("truth"), s1.alias("p1"), s2.alias("p2"), (s1 >= 0.5).cast("int").alias("d1"), (s2 >= 0.5).cast("int").alias("d2"), F.col("user_id"), F.col("event_type"), F.col("value"), F.col("ts"))


PREDICTIONS = """
pred AS (SELECT *, (p1 >= 0.5)::INT AS d1, (p2 >= 0.5)::INT AS d2 FROM (
           SELECT event_id AS flow, (42 + event_id % 5)::INT AS seed, (event_type = 'error')::INT AS truth,
                  ((event_id * 7919 % 1000)::DOUBLE / 1000.0::DOUBLE + (event_type = 'error')::INT * 0.5::DOUBLE) / 1.5::DOUBLE AS p1,
                  ((event_id * 104729 % 997)::DOUBLE / 997.0::DOUBLE + (event_type = 'error')::INT * 0.25::DOUBLE) / 1.25::DOUBLE AS p2,
                  user_id, event_type, value, ts FROM events) t)"""


def r6(column: Column | str, digits: int = 6) -> Column:
    """A double rounded for comparison."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem rows: label, features, source year, a coarse fingerprint fp and a row key."""
    li = table(spark, sf_dir, "lineitem")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))
    fp = F.sha2(F.concat_ws("|", F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.floor(F.col("l_extendedprice") / 100).cast("int").cast("string")), 256)
    return li.select(key.alias("k"), fp.alias("fp"), F.col("l_returnflag").alias("label"), F.year("l_shipdate").alias("source"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("status"))


ROWS = """
rowset AS (SELECT md5(concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR)) AS k,
                  sha256(concat_ws('|', l_quantity::INT::VARCHAR, round(l_discount * 100)::INT::VARCHAR, round(l_tax * 100)::INT::VARCHAR, floor(l_extendedprice / 100)::INT::VARCHAR)) AS fp,
                  l_returnflag AS label, year(l_shipdate)::INT AS source, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linestatus AS status FROM lineitem)"""


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + body
