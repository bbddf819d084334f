import random

from pyspark.sql import functions as F

from veritab.operators.prefix import running_totals, value_ranks


def test_running_totals_in_many_buckets(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([0.0, 1.5, rng.random() * 10]), rng.randint(0, 5)) for k in "ab" for i in range(300)]
    f = spark.createDataFrame(rows, "k string, i long, x double, n long").repartition(3)
    for descending in (False, True):
        got = {(r["k"], r["i"]): r["cum_n"] for r in running_totals(f, "x", ["n"], "k", descending=descending, ties=("i",), buckets=16).collect()}
        for k in "ab":
            total = 0
            for _, i, x, n in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2] if descending else r[2], r[1])):
                total += n
                assert got[k, i] == total


def test_value_ranks_share_ties(spark):
    f = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert {r["x"]: r["average_rank"] for r in value_ranks(f, "x").collect()} == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}
    assert running_totals(f.filter("x > 9").withColumn("n", F.lit(1)), "x", ["n"]).isEmpty()


def test_running_totals_of_rows_in_any_order(spark):
    n = 400_000

    def shuffled(batches):
        import pandas as pd

        yield pd.concat(batches).sample(frac=1)  # another order whenever Spark computes the rows

    f = spark.range(0, n, 1, 2).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("one"))
    f = f.mapInPandas(shuffled, f.schema)
    # as on a cluster, where Spark may compute the cuts for each side
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        run = running_totals(f, "x", ["one"])
        wrong = F.count_if(F.col("cum_one") != F.col("x") + 1)
        assert tuple(run.agg(F.count("*"), wrong).first()) == (n, 0)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
