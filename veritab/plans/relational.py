"""Queries on fingerprints, joins, samples and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import hashing, labels
from veritab.functions.hashing import unit_sql
from veritab.operators import identity, joins, sampling
from veritab.plans._adapter import ACCOUNTS, PREDICTIONS, ROWS, accounts, predictions, r6, rows, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SPLIT = "CASE WHEN source <= 1995 THEN 'train' WHEN source = 1996 THEN 'validation' ELSE 'test' END"
SPLITTED = ROWS + f""",
s AS (SELECT *, {SPLIT} AS split, sha256(concat_ws('|', floor(price / 50)::INT::VARCHAR, quantity::INT::VARCHAR)) AS fp2 FROM rowset)"""


def splitted(spark, sf_dir):
    split = F.when(F.col("source") <= 1995, "train").when(F.col("source") == 1996, "validation").otherwise("test")
    fp2 = F.sha2(F.concat_ws("|", F.floor(F.col("price") / 50).cast("int").cast("string"), F.col("quantity").cast("int").cast("string")), 256)
    return rows(spark, sf_dir).withColumn("split", split).withColumn("fp2", fp2)


@query("WITH" + SPLITTED + """, c AS (SELECT DISTINCT split, 'fp' AS kind, fp AS f FROM s UNION SELECT DISTINCT split, 'fp2', fp2 FROM s),
p AS (SELECT a.kind, a.split AS left_split, b.split AS right_split, count(*)::BIGINT AS n_shared FROM c a JOIN c b ON a.kind = b.kind AND a.f = b.f
      WHERE (a.split, b.split) IN (('train', 'validation'), ('train', 'test'), ('validation', 'test')) GROUP BY ALL),
e AS (SELECT * FROM (VALUES ('fp'), ('fp2')) k(kind), (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) v(left_split, right_split))
SELECT e.kind, e.left_split, e.right_split, coalesce(n_shared, 0)::BIGINT AS n_shared FROM e LEFT JOIN p USING (kind, left_split, right_split)""")
def row_fingerprint_overlap(spark, sf_dir):
    return identity.overlap(splitted(spark, sf_dir), "split", "fp", "fp2")


@query("WITH" + SPLITTED + """, t AS (SELECT * FROM s WHERE split = 'train'),
v AS (SELECT * FROM s WHERE split = 'validation' AND fp NOT IN (SELECT fp FROM t) AND fp2 NOT IN (SELECT fp2 FROM t)),
e AS (SELECT * FROM s WHERE split = 'test' AND fp NOT IN (SELECT fp FROM t UNION SELECT fp FROM v) AND fp2 NOT IN (SELECT fp2 FROM t UNION SELECT fp2 FROM v))
SELECT split, count(*)::BIGINT AS n, count(DISTINCT fp)::BIGINT AS n_fp FROM (SELECT split, fp FROM t UNION ALL SELECT split, fp FROM v UNION ALL SELECT split, fp FROM e) u GROUP BY split""")
def train_val_test_precedence_guard(spark, sf_dir):
    # digests as 32 bytes: as text they are twice as long, and shuffles make up the work
    narrow = splitted(spark, sf_dir).select("split", *[F.unhex(k).alias(k) for k in ("fp", "fp2")])
    kept = identity.precedence_guard(narrow, "split", "fp", "fp2")
    return kept.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("fp").alias("n_fp"))


@query("""WITH d AS (SELECT sha256(concat_ws('|', p_type, p_size::VARCHAR)) AS fp, p_brand FROM part)
SELECT fp, count(DISTINCT p_brand)::BIGINT AS n_labels, count(*)::BIGINT AS n_rows FROM d GROUP BY fp HAVING count(DISTINCT p_brand) > 1""")
def label_conflict_groups(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.sha2(F.concat_ws("|", "p_type", F.col("p_size").cast("string")), 256).alias("fp"), "p_brand")
    return identity.conflicts(d, "fp", "p_brand")


@query("""SELECT * FROM (VALUES ('quantity', 'quantity', false), ('price', 'price', false), ('quantity_copy', 'quantity', true), ('tax', 'tax', false), ('price_copy', 'price', true)) t(feature, representative, is_duplicate)""")
def duplicate_feature_columns(spark, sf_dir):
    r = rows(spark, sf_dir).withColumn("quantity_copy", F.col("quantity") + 0).withColumn("price_copy", F.col("price") * 1)
    return identity.duplicate_columns(r, "k", ["quantity", "price", "quantity_copy", "tax", "price_copy"])


@query("WITH" + ROWS + f""", p AS (SELECT k, label, source, row_number() OVER (PARTITION BY label ORDER BY {unit_sql('reservoir', 'k')}, k, price) AS n FROM rowset)
SELECT label, count(*)::BIGINT AS n_kept, min(k) AS first_key, max(k) AS last_key, sum(source)::BIGINT AS source_sum FROM p WHERE n <= 500 GROUP BY label""")
def capped_class_reservoir(spark, sf_dir):
    kept = sampling.capped(rows(spark, sf_dir), 500, hashing.unit("reservoir", F.col("k")), "label", ties=[F.col("k"), F.col("price")])
    return kept.groupBy("label").agg(F.count("*").alias("n_kept"), F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.sum("source").cast("long").alias("source_sum"))


@query(f"""WITH c AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {unit_sql('nested-panel', 'event_id')}, event_id) AS n FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {unit_sql('nested-subset', 'event_id')}, event_id) <= 8 AS in_subset FROM c WHERE n <= 128)
SELECT event_id, event_type, in_subset FROM k""")
def nested_panel_sample(spark, sf_dir):
    return sampling.nested_sample(table(spark, sf_dir, "events"), 128, 8, "nested", F.col("event_id"), "event_type").select("event_id", "event_type", "in_subset")


@query(f"""WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {unit_sql('bg-class', 'o_orderkey')}, o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_orderstatus FROM p WHERE n <= 200 ORDER BY (n > 67)::INT, {unit_sql('bg-all', 'o_orderkey')}, o_orderkey LIMIT 200""")
def stratified_background(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "orders"), 200, 3, "bg", F.col("o_orderkey"), "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {unit_sql('split', 'o_orderkey')}, o_orderkey) - 1)::DOUBLE / count(*) OVER (PARTITION BY o_orderstatus) AS s FROM orders)
SELECT o_orderstatus, CASE WHEN s < 0.7::DOUBLE THEN 'train' WHEN s < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS key_sum FROM r GROUP BY ALL""")
def stratified_three_way_split(spark, sf_dir):
    s = sampling.stratified_split(table(spark, sf_dir, "orders"), (0.7, 0.15), "split", F.col("o_orderkey"), "o_orderstatus")
    return s.groupBy("o_orderstatus", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("WITH" + ROWS + """, a AS (SELECT k, fp, label, count(*) OVER (PARTITION BY fp) AS multiplicity, min(label) OVER (PARTITION BY fp) = max(label) OVER (PARTITION BY fp) AS consistent, row_number() OVER (PARTITION BY fp ORDER BY k, price) AS n FROM rowset)
SELECT consistent, count(*)::BIGINT AS n_fp, sum(multiplicity)::BIGINT AS n_rows, max(multiplicity)::BIGINT AS most, min(k) AS first_key FROM a WHERE n = 1 GROUP BY consistent""")
def identity_multiplicity_contract(spark, sf_dir):
    d = identity.deduplicate_with_contract(rows(spark, sf_dir), "fp", [F.col("k"), F.col("price")], ["label"])
    return d.groupBy("consistent").agg(F.count("*").alias("n_fp"), F.sum("multiplicity").alias("n_rows"), F.max("multiplicity").alias("most"), F.min("k").alias("first_key"))


@query("WITH" + SPLITTED + """, a AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY k, price) AS n1 FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY fp2 ORDER BY k, price) AS n2 FROM a WHERE n1 = 1)
SELECT label, count(*)::BIGINT AS n, min(k) AS first_key FROM b WHERE n2 = 1 GROUP BY label""")
def keep_first_per_fingerprint(spark, sf_dir):
    kept = identity.keep_first(splitted(spark, sf_dir), [F.col("k"), F.col("price")], "fp", "fp2")
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("WITH" + PREDICTIONS + """, v AS (SELECT flow, seed, truth, 'one' AS variant, p1 AS value FROM pred UNION ALL SELECT flow, seed, truth, 'two', p2 FROM pred WHERE flow % 50 <> 0)
SELECT flow, seed, truth, count(*) FILTER (WHERE variant = 'one')::BIGINT AS n_one, count(*) FILTER (WHERE variant = 'two')::BIGINT AS n_two FROM v GROUP BY ALL HAVING n_one <> 1 OR n_two <> 1""")
def pairing_contract(spark, sf_dir):
    p = predictions(spark, sf_dir)
    v = p.select("flow", "seed", "truth", F.lit("one").alias("variant"), F.col("p1").alias("value")).unionByName(p.filter("flow % 50 <> 0").select("flow", "seed", "truth", F.lit("two").alias("variant"), F.col("p2").alias("value")))
    return joins.check_pairing(v, "variant", ["one", "two"], "flow", "seed", "truth")


LONG_PRED = PREDICTIONS + """,
v AS (SELECT flow, seed, m AS method, o AS operator, CASE m WHEN 'a' THEN p1 WHEN 'b' THEN p2 ELSE p1 * p2 END * o AS value FROM pred, (SELECT unnest(['a', 'b', 'c']) AS m) x, (SELECT unnest([1, 2, 3]) AS o) y)"""


def long_pred(spark, sf_dir):
    p = predictions(spark, sf_dir)
    methods = F.inline(F.array(*[F.struct(F.lit(n).alias("method"), c.alias("base")) for n, c in (("a", F.col("p1")), ("b", F.col("p2")), ("c", F.col("p1") * F.col("p2")))]))
    return p.select("flow", "seed", methods).select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("operator")).withColumn("value", F.col("base") * F.col("operator"))


@query("WITH" + LONG_PRED + """, d AS (SELECT seed, flow, operator, max(value) FILTER (WHERE method = 'b') - max(value) FILTER (WHERE method = 'a') AS d FROM v GROUP BY ALL),
s AS (SELECT operator, seed, avg(d) AS d FROM d GROUP BY ALL)
SELECT operator, round(avg(d), 6) AS estimate, count(*)::BIGINT AS n_seeds FROM s GROUP BY operator""")
def paired_contrast(spark, sf_dir):
    from veritab.operators.seeds import equal_seed_mean

    d = joins.paired_contrast(long_pred(spark, sf_dir), "method", "b", "a", "value", "seed", "flow", "operator")
    return equal_seed_mean(d, "difference", "operator").select("operator", r6("estimate").alias("estimate"), "n_seeds")


@query("WITH" + LONG_PRED + """, w AS (SELECT seed, flow, method, operator, max(value) AS v FROM v GROUP BY ALL)
SELECT a.method, a.operator, round(avg((a.v - b.v) - (c.v - d.v)), 6) AS second_difference, count(*)::BIGINT AS n FROM w a JOIN w b ON a.seed = b.seed AND a.flow = b.flow AND a.operator = b.operator AND b.method = 'a'
JOIN w c ON a.seed = c.seed AND a.flow = c.flow AND a.method = c.method AND c.operator = 1 JOIN w d ON a.seed = d.seed AND a.flow = d.flow AND d.method = 'a' AND d.operator = 1 WHERE a.method <> 'a' AND a.operator <> 1 GROUP BY ALL""")
def second_difference(spark, sf_dir):
    d = joins.second_difference(long_pred(spark, sf_dir), "method", "operator", "value", "a", 1, "seed", "flow")
    return d.groupBy("method", "operator").agg(r6(F.avg("second_difference")).alias("second_difference"), F.count("*").alias("n"))


@query("WITH" + LONG_PRED + """ SELECT seed, round(avg(value) FILTER (WHERE method = 'a'), 6) AS a, round(avg(value) FILTER (WHERE method = 'b'), 6) AS b, round(avg(value) FILTER (WHERE method = 'c'), 6) AS c FROM v GROUP BY seed""")
def pivot_method_means(spark, sf_dir):
    return long_pred(spark, sf_dir).groupBy("seed").pivot("method", ["a", "b", "c"]).agg(r6(F.avg("value")))


@query("""SELECT coalesce(x.k, y.k) AS k, CASE WHEN x.k IS NULL THEN 'right_only' WHEN y.k IS NULL THEN 'left_only' ELSE 'both' END AS status
FROM (SELECT DISTINCT c_nationkey AS k FROM customer) x FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) y ON x.k = y.k""")
def full_outer_match_status(spark, sf_dir):
    """Of all customers and suppliers."""
    return joins.match_status(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), ["k"])


@query("""SELECT o_custkey % 7 AS bucket, count(*)::BIGINT AS n, count(*) FILTER (WHERE c_custkey IS NOT NULL)::BIGINT AS n_matched, round(sum(c_acctbal), 2) AS balance
FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def left_enrichment(spark, sf_dir):
    """With all customers."""
    e = joins.enrich(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), ["o_custkey"])
    return e.groupBy((F.col("o_custkey") % 7).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH kept AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')),
fresh AS (SELECT o_orderkey, o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0)
SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh) t GROUP BY o_orderstatus""")
def replace_matching_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    match = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    new = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 2 == 0)).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return joins.replace_matching_rows(o, new, match).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH c AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS m FROM orders), n AS (SELECT s, count(*) AS n FROM c GROUP BY s)
SELECT a.s AS left_status, b.s AS right_status, (SELECT count(*) FROM c x JOIN c y ON x.m = y.m WHERE x.s = a.s AND y.s = b.s)::BIGINT AS n_shared,
       (a.n + b.n - (SELECT count(*) FROM c x JOIN c y ON x.m = y.m WHERE x.s = a.s AND y.s = b.s))::BIGINT AS n_union FROM n a JOIN n b ON a.s < b.s""")
def shared_members_between_splits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("member"))
    return joins.set_sizes(o, "status", "member").withColumn("n_shared", F.col("n_shared").cast("long"))


@query("""WITH s AS (SELECT f.vec_id, d.vec_id AS donor, list_sum(list_transform(range(1, 65), lambda i: (f.embedding[i]::DOUBLE - d.embedding[i]::DOUBLE) * (f.embedding[i]::DOUBLE - d.embedding[i]::DOUBLE))) AS dist FROM embeddings f JOIN embeddings d ON f.vec_id <> d.vec_id)
SELECT vec_id, donor, round(dist, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, donor) AS n FROM s) t WHERE n = 1""")
def nearest_donor(spark, sf_dir):
    """Each vector with the nearest of all others."""
    e = table(spark, sf_dir, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double"))
    flows, donors = e.select("vec_id", vector.alias("x")), e.select(F.col("vec_id").alias("donor"), vector.alias("d"))
    return joins.nearest_donor(flows, donors, "vec_id", "donor", "x", "d").select("vec_id", "donor", F.round("distance", 5).alias("distance"))


@query("""SELECT p_partkey, regexp_replace(trim(regexp_replace(replace(p_name, '�', ' '), '\\s+', ' ', 'g')), ' ', '_', 'g') AS family0,
CASE WHEN p_type = 'PROMO' THEN 'Promo' WHEN contains(lower(p_type), 'eco') THEN 'Eco' WHEN contains(lower(p_type), 'standard') THEN 'Standard' ELSE replace(p_type, ' ', '_') END AS family,
regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe, ('0x' || substr(sha256(concat_ws('|', 'task', p_partkey::VARCHAR)), 9, 8))::BIGINT AS seed FROM part""")
def label_normalise_family(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rules = (("eco", "Eco"), ("standard", "Standard"))
    return p.select("p_partkey", F.replace(labels.normalize_label(F.col("p_name")), F.lit(" "), F.lit("_")).alias("family0"), labels.family(F.col("p_type"), {"PROMO": "Promo"}, rules).alias("family"), labels.safe_name(F.col("p_brand")).alias("safe"), hashing.stable_seed(F.lit("task"), F.col("p_partkey")).alias("seed"))


@query("""SELECT k AS session, count(*)::BIGINT AS n FROM (SELECT CASE WHEN a <= b THEN concat_ws('|', a, b, pa, pb, '6') ELSE concat_ws('|', b, a, pb, pa, '6') END AS k
FROM (SELECT 'h' || (user_id % 5)::VARCHAR AS a, 'h' || (event_id % 4)::VARCHAR AS b, (event_id % 3)::VARCHAR AS pa, (user_id % 2)::VARCHAR AS pb FROM events) t) u GROUP BY k""")
def session_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    host = lambda c, m: F.concat(F.lit("h"), (F.col(c) % m).cast("string"))
    key = labels.session_key(host("user_id", 5), host("event_id", 4), F.col("event_id") % 3, F.col("user_id") % 2, F.lit(6))
    return e.groupBy(key.alias("session")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*)::BIGINT AS n, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS mean_k FROM events GROUP BY event_type""")
def json_property_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg(F.get_json_object("props", "$.k").cast("double"))).alias("mean_k"))


@query("WITH" + ROWS + """, q AS (SELECT k, label, price, (rank() OVER (PARTITION BY label ORDER BY price) + (count(*) OVER (PARTITION BY label, price) - 1) / 2.0) / count(*) OVER (PARTITION BY label) AS s FROM rowset)
SELECT label, CASE WHEN ceil(round(s * 3, 9)) <= 1 THEN 'low' WHEN ceil(round(s * 3, 9)) = 2 THEN 'mid' ELSE 'high' END AS bin, count(*)::BIGINT AS n, round(min(price), 2) AS lo, round(max(price), 2) AS hi FROM q GROUP BY ALL""")
def quantile_bins(spark, sf_dir):
    b = sampling.quantile_bins(rows(spark, sf_dir), "price", 3, ["low", "mid", "high"], "label")
    return b.groupBy("label", "bin").agg(F.count("*").alias("n"), F.round(F.min("price"), 2).alias("lo"), F.round(F.max("price"), 2).alias("hi"))


@query("""WITH g AS (SELECT user_id, min(epoch_us(ts)) AS t, count(*) AS n FROM events GROUP BY user_id),
c AS (SELECT *, (sum(n) OVER (ORDER BY t, user_id ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(n) OVER () AS s FROM g)
SELECT CASE WHEN s <= 0.7 THEN 'train' WHEN s <= 0.85 THEN 'validation' ELSE 'test' END AS split, count(*)::BIGINT AS n_groups, sum(n)::BIGINT AS n_rows, min(user_id) AS first_user FROM c GROUP BY ALL""")
def temporal_split(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t"), F.count("*").alias("n"))
    s = sampling.temporal_split(g, "t", "n", (0.7, 0.85))
    return s.groupBy("split").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("user_id").alias("first_user"))


FEATURES = """feat AS (SELECT flow, unnest(m) AS value, generate_subscripts(m, 1)::INT - 1 AS feature FROM acc)"""


def features(spark, sf_dir, decimals: int | None = None):
    f = accounts(spark, sf_dir).select("flow", F.posexplode("m").alias("feature", "value"))
    return f if decimals is None else f.withColumn("value", F.floor(F.col("value") * 10**decimals) / 10**decimals)



@query("WITH" + ACCOUNTS + "," + FEATURES.replace("unnest(m) AS value", "floor(unnest(m) * 10) / 10 AS value") + f""",
g AS (SELECT *, lag(value) OVER (PARTITION BY flow ORDER BY value DESC, feature) - value > greatest(1e-12, max(value) OVER (PARTITION BY flow) * 1e-8) AS j FROM feat),
b AS (SELECT *, sum(coalesce(j::INT, 0)) OVER (PARTITION BY flow ORDER BY value DESC, feature ROWS UNBOUNDED PRECEDING) AS block FROM g),
o AS (SELECT flow, feature, row_number() OVER (PARTITION BY flow ORDER BY block, feature) AS ps, row_number() OVER (PARTITION BY flow ORDER BY block, -feature) AS pr, row_number() OVER (PARTITION BY flow ORDER BY block, {unit_sql('ties', 'flow', 'feature')}, feature) AS ph FROM b)
SELECT flow, sum(ps * feature)::BIGINT AS stable, sum(pr * feature)::BIGINT AS reverse, sum(ph * feature)::BIGINT AS shuffle FROM o GROUP BY flow""")
def tie_policy_rankings(spark, sf_dir):
    out = None
    for policy in ("stable", "reverse", "shuffle"):
        p = sampling.tie_order(features(spark, sf_dir, 1), policy, ["flow"]).groupBy("flow").agg(F.sum(F.col("position") * F.col("feature")).cast("long").alias(policy))
        out = p if out is None else out.join(p, "flow")
    return out


@query("WITH" + ACCOUNTS + "," + FEATURES + f""",
s AS (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY value DESC, feature) <= 10 AS selected, floor((row_number() OVER (PARTITION BY flow ORDER BY value, feature) - 1) * 5 / 64)::INT AS bin FROM feat),
w AS (SELECT *, row_number() OVER (PARTITION BY flow, bin ORDER BY {unit_sql('ctl', 'flow', 'feature')}, feature) <= sum(selected::INT) OVER (PARTITION BY flow, bin) AS matched, row_number() OVER (PARTITION BY flow ORDER BY {unit_sql('uni', 'flow', 'feature')}, feature) <= 10 AS uniform FROM s)
SELECT flow, count(*) FILTER (WHERE matched)::BIGINT AS n_matched, coalesce(sum(feature) FILTER (WHERE matched), 0)::BIGINT AS matched_features, sum(feature) FILTER (WHERE uniform)::BIGINT AS uniform_features FROM w GROUP BY flow""")
def matched_random_controls(spark, sf_dir):
    from pyspark.sql import Window

    top = F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("value"), "feature")) <= 10
    f = features(spark, sf_dir).withColumn("selected", top)
    m = sampling.bin_matched_controls(f, ["flow"], "selected", "value", 5, "ctl").withColumnRenamed("control", "matched")
    u = sampling.uniform_controls(m, ["flow"], 10, "uni").withColumnRenamed("control", "uniform")
    return u.groupBy("flow").agg(F.count_if("matched").alias("n_matched"), F.coalesce(F.sum(F.when(F.col("matched"), F.col("feature"))), F.lit(0)).cast("long").alias("matched_features"), F.sum(F.when(F.col("uniform"), F.col("feature"))).cast("long").alias("uniform_features"))


@query("""SELECT tag, count(*)::BIGINT AS n, round(sum(balance), 2) AS balance, count(segment)::BIGINT AS n_segment FROM (
SELECT 'customer' AS tag, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) t GROUP BY tag""")
def union_by_name_tagged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"))
    u = joins.union_tagged({"customer": c, "supplier": s}, "tag")
    return u.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"), F.count("segment").alias("n_segment"))
