"""Window, sort, top-k and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickwork.operators.joining import best_per_key
from brickwork.operators.rollups import count_by
from brickwork.operators.ranking import densest_span, leading_streak, page, positions, priority_tiers
from brickwork.registry import query, table


@query("outward_top_owner", "WITH c AS (SELECT l_partkey % 50 AS outward, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3) SELECT outward, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY outward ORDER BY n DESC, l_suppkey) AS rn FROM c) x WHERE rn = 1")
def outward_top_owner(spark, d):
    counts = count_by(table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("outward"), "l_suppkey"), "outward", "l_suppkey").where("n >= 3")
    return best_per_key(counts, ["outward"], F.desc("n"), F.col("l_suppkey"))


@query("outcode_top_council", "WITH c AS (SELECT c_mktsegment AS outcode, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) SELECT outcode, c_nationkey, n FROM (SELECT *, row_number() OVER (PARTITION BY outcode ORDER BY n DESC, c_nationkey) AS rn FROM c) x WHERE rn = 1")
def outcode_top_council(spark, d):
    counts = count_by(table(spark, d, "customer").withColumnRenamed("c_mktsegment", "outcode"), "outcode", "c_nationkey")
    return best_per_key(counts, ["outcode"], F.desc("n"), F.col("c_nationkey"))


@query("outward_council_mode", "SELECT DISTINCT ON (p_type) p_type, p_brand, n FROM (SELECT p_type, p_brand, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part) x ORDER BY p_type, n DESC, p_brand")
def outward_council_mode(spark, d):
    return best_per_key(count_by(table(spark, d, "part"), "p_type", "p_brand"), ["p_type"], F.desc("n"), F.col("p_brand"))


@query(
    "priority_tiers",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= hot THEN 'hot' WHEN rn <= greatest(hot + 1, CAST(floor(n * 0.3) AS BIGINT)) THEN 'warm' ELSE 'cold' END AS tier FROM (SELECT *, greatest(1, CAST(floor(n * 0.1) AS BIGINT)) AS hot FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY coalesce(score, 0) DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM (SELECT *, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS score FROM orders) a) b) c",
)
def priority_tiers_query(spark, d):
    o = table(spark, d, "orders").withColumn("score", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")))
    return priority_tiers(o, ["o_orderpriority"], F.coalesce("score", F.lit(0.0)), F.col("o_orderkey")).select("o_orderkey", "o_orderpriority", "tier")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) x WHERE rn = 1")
def latest_per_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


@query("failure_streak", "SELECT user_id, count(*) FILTER (WHERE ok = 0) AS streak FROM (SELECT user_id, sum(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM events) x GROUP BY 1")
def failure_streak(spark, d):
    return leading_streak(table(spark, d, "events"), ["user_id"], F.col("event_type").isin("error", "view"), F.desc("ts"), F.desc("event_id"))


@query(
    "densest_window",
    "WITH w AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN CURRENT ROW AND INTERVAL 365 DAYS FOLLOWING) AS n FROM orders) SELECT o_custkey, CAST(d AS DATE) AS starts, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, d) AS rn FROM w) x WHERE rn = 1 AND n >= 5",
)
def densest_window(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return densest_span(o, ["o_custkey"], "day", 365, 5)


@query(
    "anomalies",
    "WITH r AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), s AS (SELECT user_id, max(CASE WHEN rn = 1 THEN value END) AS latest, avg(CASE WHEN rn BETWEEN 2 AND 8 THEN value END) AS mean FROM r GROUP BY 1) SELECT user_id, latest < 0.5 * mean AS dropped, latest > 2 * mean AS slow FROM s WHERE latest < 0.5 * mean OR latest > 2 * mean",
)
def anomalies(spark, d):
    r = best_per_key(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"), keep=8, rank="rn")
    s = r.groupBy("user_id").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("latest"), F.avg(F.when(F.col("rn") > 1, F.col("value"))).alias("mean"))
    dropped, slow = F.col("latest") < 0.5 * F.col("mean"), F.col("latest") > 2 * F.col("mean")
    return s.where(dropped | slow).select("user_id", dropped.alias("dropped"), slow.alias("slow"))


@query("period_compare", "SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23') AS recent, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-23' AND ts >= TIMESTAMP '2024-01-01') AS earlier FROM events GROUP BY 1")
def period_compare(spark, d):
    cut = F.lit("2024-01-23").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("ts") >= cut).alias("recent"), F.count_if((F.col("ts") < cut) & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp"))).alias("earlier"))


@query("top3_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 3")
def top3_per_group(spark, d):
    return best_per_key(table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"), keep=3, rank="rn").select("o_custkey", "o_orderkey", "rn")


@query("score_changes", "SELECT p_partkey, p_size * 2 AS old, p_size + p_partkey % 30 AS new FROM part WHERE abs(p_size + p_partkey % 30 - p_size * 2) >= 5")
def score_changes(spark, d):
    p = table(spark, d, "part")
    old, new = p.select("p_partkey", (F.col("p_size") * 2).alias("old")), p.select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 30).alias("new"))
    return old.join(new, "p_partkey").where(F.abs(F.col("new") - F.col("old")) >= 5)


NULLED = "(SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS score FROM customer)"


def _nulled(spark, d):
    return table(spark, d, "customer").withColumn("score", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")))


@query("sort_nulls_last", f"SELECT c_custkey, row_number() OVER (ORDER BY score DESC NULLS LAST, c_custkey) AS pos FROM {NULLED} x")
def sort_nulls_last(spark, d):
    return positions(_nulled(spark, d), [F.desc_nulls_last("score"), F.col("c_custkey")]).select("c_custkey", "pos")


@query("sort_nulls_first", f"SELECT c_custkey, row_number() OVER (ORDER BY score ASC NULLS FIRST, c_custkey) AS pos FROM {NULLED} x")
def sort_nulls_first(spark, d):
    return positions(_nulled(spark, d), [F.asc_nulls_first("score"), F.col("c_custkey")]).select("c_custkey", "pos")


@query("page", "SELECT o_orderkey, 40 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, (SELECT count(*) FROM orders) AS total FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40) x")
def page_query(spark, d):
    o = table(spark, d, "orders")
    total = o.agg(F.count("*").alias("total"))
    return page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 40, 20).select("o_orderkey", "pos").crossJoin(F.broadcast(total))  # one row


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("sort_multi", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal ASC NULLS LAST, c_custkey) AS pos FROM customer")
def sort_multi(spark, d):
    return positions(table(spark, d, "customer"), [F.desc_nulls_last("c_mktsegment"), F.asc_nulls_last("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "pos")


@query("sort_bool", "SELECT p_partkey, row_number() OVER (ORDER BY p_size > 25, p_retailprice DESC NULLS LAST, p_partkey) AS pos FROM part")
def sort_bool(spark, d):
    return positions(table(spark, d, "part"), [F.col("p_size") > 25, F.desc_nulls_last("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "pos")


@query("sort_by_count", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON o_custkey = c_custkey ORDER BY 2 DESC, 1 LIMIT 50")
def sort_by_count(spark, d):
    counts = count_by(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "c_custkey").limit(50)


@query("kanban", "SELECT o_orderstatus, o_orderkey FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 100")
def kanban(spark, d):
    return best_per_key(table(spark, d, "orders"), ["o_orderstatus"], F.desc("o_totalprice"), F.col("o_orderkey"), keep=100).select("o_orderstatus", "o_orderkey")


@query(
    "priority_union",
    "WITH u AS (SELECT c_custkey AS id, 1 AS tier FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_totalprice > 490000 UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_nationkey = 4) SELECT id, min(tier) AS tier FROM u GROUP BY 1 ORDER BY 2, 1 LIMIT 120",
)
def priority_union(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    tiers = [c.where("c_acctbal > 9500").select(F.col("c_custkey").alias("id")), o.where("o_totalprice > 490000").select(F.col("o_custkey").alias("id")), c.where("c_nationkey = 4").select(F.col("c_custkey").alias("id"))]
    u = tiers[0].withColumn("tier", F.lit(1)).unionAll(tiers[1].withColumn("tier", F.lit(2))).unionAll(tiers[2].withColumn("tier", F.lit(3)))
    return u.groupBy("id").agg(F.min("tier").alias("tier")).orderBy("tier", "id").limit(120)


@query("tumbling_daily", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_daily(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


@query("sliding_weekly", "WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-26', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS starts) SELECT starts, count(*) AS n FROM s JOIN events ON ts >= starts AND ts < starts + INTERVAL 7 DAY GROUP BY 1")
def sliding_weekly(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("starts"), "n")


@query("due_entities", "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-31 12:00:00'")
def due_entities(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.where(F.col("last") + F.expr("INTERVAL 24 HOURS") <= F.lit("2024-01-31 12:00:00").cast("timestamp"))


@query("value_gap_to_previous", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS gap FROM events")
def value_gap_to_previous(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 4).alias("gap"))
