"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brickwork.operators.joining import best_per_key
from brickwork.operators.rollups import count_by, fill_rates, filled, histogram, zero_filled
from brickwork.registry import query, table

STAGES = ("identified", "researched", "contacted", "meeting", "proposal", "won", "lost")
STAGE_OF = "CASE o_orderkey % 9 WHEN 0 THEN 'identified' WHEN 1 THEN 'researched' WHEN 2 THEN 'contacted' WHEN 3 THEN 'meeting' WHEN 4 THEN 'won' WHEN 5 THEN 'lost' ELSE 'identified' END"


def money(column):
    """Money sums as exact decimals, so that the order of addition does not show."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def sql_money(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


@query("kpi_scalar", f"SELECT count(*) AS schemes, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, coalesce({sql_money('o_totalprice')}, 0) AS value, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 6) AS mean_closed FROM orders")
def kpi_scalar(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count("*").alias("schemes"), F.count_if(status == "O").alias("open"), F.coalesce(money("o_totalprice"), F.lit(0.0)).alias("value"), F.round(F.avg(F.when(status == "F", F.col("o_totalprice"))), 6).alias("mean_closed"))


@query("count_by_key", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def count_by_key(spark, d):
    return count_by(table(spark, d, "orders"), "o_orderpriority")


@query("pipeline_stats", f"SELECT o_orderpriority, o_orderstatus, count(*) AS n, {sql_money('CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END')} AS value FROM orders GROUP BY 1, 2")
def pipeline_stats(spark, d):
    o = table(spark, d, "orders").withColumn("value", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    return o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), money("value").alias("value"))


@query("contract_stats", "SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS mean_value, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS valued FROM customer GROUP BY 1")
def contract_stats(spark, d):
    positive = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(positive), 6).alias("mean_value"), F.count(positive).alias("valued"))


@query("rent_summary", "SELECT o_orderkey, r.rent_from, coalesce(r.tiers, 0) AS tiers FROM orders LEFT JOIN (SELECT l_orderkey, min(l_extendedprice) AS rent_from, count(*) AS tiers FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) r ON l_orderkey = o_orderkey")
def rent_summary(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_extendedprice").alias("rent_from"), F.count("*").alias("tiers"))
    return table(spark, d, "orders").select("o_orderkey").join(r, "o_orderkey", "left").select("o_orderkey", "rent_from", F.coalesce("tiers", F.lit(0)).alias("tiers"))


@query(
    "distressed_operators",
    "SELECT o_custkey, count(*) AS schemes, round(avg(o_totalprice), 6) AS mean, max(o_totalprice) AS worst, count(*) FILTER (WHERE o_totalprice >= 400000) AS critical FROM orders GROUP BY 1 HAVING count(*) >= 3 AND avg(o_totalprice) >= 250000",
)
def distressed_operators(spark, d):
    price = F.col("o_totalprice")
    out = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("schemes"), F.avg(price).alias("mean"), F.max(price).alias("worst"), F.count_if(price >= 400000).alias("critical"))
    return out.where("schemes >= 3 AND mean >= 250000").withColumn("mean", F.round("mean", 6))


@query("owner_targets", "SELECT l_suppkey, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def owner_targets(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"), F.count_distinct("l_orderkey").alias("orders"))


@query("array_agg", "SELECT o_custkey, array_to_string(list_slice(list_sort(list(DISTINCT o_orderpriority)), 1, 3), '|') AS kinds FROM orders GROUP BY 1")
def array_agg(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 3), "|").alias("kinds"))


@query("array_agg_ordered", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_kind FROM orders GROUP BY 1")
def array_agg_ordered(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_kind"))


@query("platform_clusters", "SELECT count(*) AS clusters, coalesce(sum(n), 0)::BIGINT AS members FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) >= 3) x")
def platform_clusters(spark, d):
    groups = count_by(table(spark, d, "customer"), "c_nationkey", "c_mktsegment").where("n >= 3")
    return groups.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


@query("string_agg", "SELECT l_orderkey, string_agg(l_returnflag, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS flags FROM lineitem GROUP BY 1")
def string_agg(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x.l_returnflag), ", ").alias("flags"))


@query("distinct_councils", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def distinct_councils(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("stage_duration", "SELECT o_orderstatus, round(avg(epoch(l_shipdate) - epoch(o_orderdate)) / 86400, 1) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def stage_duration(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return o.groupBy("o_orderstatus").agg(F.round(F.avg(F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")) / 86400, 1).alias("days"))


def _stage_counts(spark, d):
    o = table(spark, d, "orders").select(F.expr(STAGE_OF).alias("stage"))
    stages = spark.createDataFrame(list(enumerate(STAGES)), "position int, stage string")
    return zero_filled(count_by(o, "stage"), stages, "stage", "n")


SQL_STAGES = f"WITH s AS (SELECT unnest({list(STAGES)!r}) AS stage, unnest(range(7))::INTEGER AS position), c AS (SELECT {STAGE_OF} AS stage, count(*) AS n FROM orders GROUP BY 1), z AS (SELECT position, stage, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (stage)) "


@query("funnel_zero_fill", SQL_STAGES + "SELECT * FROM z")
def funnel_zero_fill(spark, d):
    return _stage_counts(spark, d)


@query("funnel", SQL_STAGES + "SELECT stage, n, (sum(n) OVER (ORDER BY position DESC))::BIGINT AS reached FROM z")
def funnel(spark, d):
    # one row per stage, so a single partition is fixed in size
    return _stage_counts(spark, d).select("stage", "n", F.sum("n").over(Window.orderBy(F.desc("position"))).alias("reached"))


@query("daily_trend", "WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (day)")
def daily_trend(spark, d):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))).alias("day"))
    return zero_filled(count_by(table(spark, d, "events").select(F.to_date("ts").alias("day")), "day"), days, "day", "n")


@query("expiry_timeline", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, {sql_money('o_totalprice')} AS value, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def expiry_timeline(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), money("o_totalprice").alias("value"), F.min("o_orderkey").alias("first_id"))


@query(
    "expiry_buckets",
    "SELECT CASE WHEN e IS NULL THEN 'unknown' WHEN e <= DATE '1998-01-01' THEN 'expired' WHEN e <= DATE '1998-01-01' + 182 THEN '6m' WHEN e <= DATE '1998-01-01' + 365 THEN '12m' WHEN e <= DATE '1998-01-01' + 730 THEN '24m' ELSE 'later' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS e FROM orders) x GROUP BY 1",
)
def expiry_buckets(spark, d):
    end, now = F.when(F.col("o_orderkey") % 6 != 0, F.to_date("o_orderdate")), F.lit("1998-01-01").cast("date")
    steps = [("expired", end <= now), *[(name, end <= F.date_add(now, n)) for name, n in (("6m", 182), ("12m", 365), ("24m", 730))]]
    return histogram(table(spark, d, "orders"), end, steps, "later", "unknown")


@query("arrears_buckets", "SELECT CASE WHEN s >= 80 THEN 'critical' WHEN s >= 60 THEN 'distressed' WHEN s >= 35 THEN 'caution' WHEN s >= 0 THEN 'healthy' WHEN s IS NULL THEN 'unknown' ELSE 'other' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN floor(c_acctbal / 100) END AS s FROM customer) x GROUP BY 1")
def arrears_buckets(spark, d):
    score = F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_acctbal") / 100))
    return histogram(table(spark, d, "customer"), score, [("critical", score >= 80), ("distressed", score >= 60), ("caution", score >= 35), ("healthy", score >= 0)], "other", "unknown")


@query("bucket_counts", "SELECT count(*) FILTER (WHERE p_size >= 10 AND p_size < 20) AS b10, count(*) FILTER (WHERE p_size >= 20 AND p_size < 40) AS b20 FROM part")
def bucket_counts(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").agg(F.count_if((size >= 10) & (size < 20)).alias("b10"), F.count_if((size >= 20) & (size < 40)).alias("b20"))


@query("fill_rate", "SELECT round_even(100.0 * count(CASE WHEN p_partkey % 3 = 0 THEN 1 END) / count(*), 0)::BIGINT AS third, floor(100.0 * count(CASE WHEN p_size > 25 THEN 1 END) / count(*))::BIGINT AS large FROM part")
def fill_rate(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).alias("third"), F.when(F.col("p_size") > 25, F.lit("x")).alias("large"))
    return fill_rates(p, {"third": "even", "large": "floor"})


@query(
    "data_quality",
    "SELECT coalesce(round(100.0 * sum(CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER)) / (3 * count(*)), 1), 100.0) AS completeness FROM (SELECT nullif(p_name, '') IS NOT NULL AS a, p_type NOT IN ('', 'PROMO') AS b, CASE WHEN p_size > 10 THEN 1 END IS NOT NULL AS c FROM part) x",
)
def data_quality(spark, d):
    points = filled(F.col("p_name")) + filled(F.col("p_type"), "", "PROMO") + filled(F.when(F.col("p_size") > 10, F.lit("x")))
    return table(spark, d, "part").agg(F.coalesce(F.round(100.0 * F.sum(points) / (3 * F.count("*")), 1), F.lit(100.0)).alias("completeness"))


@query("success_rate", "SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'click' THEN 1.0 END), 0.0), 4) AS zero_rate, round(avg(CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'click' THEN 1.0 END), 4) AS null_rate FROM events GROUP BY 1")
def success_rate(spark, d):
    rate = F.avg(F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "click", 1.0))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.coalesce(rate, F.lit(0.0)), 4).alias("zero_rate"), F.round(rate, 4).alias("null_rate"))


@query("mode_by_key", "SELECT o_custkey, o_orderpriority AS mode FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS rn FROM orders GROUP BY 1, 2) x WHERE rn = 1")
def mode_by_key(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return best_per_key(counts, ["o_custkey"], F.desc("n"), F.col("first")).select("o_custkey", F.col("o_orderpriority").alias("mode"))


@query("epc_weighted", "SELECT l_suppkey, round(sum(CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 80 ELSE 50 END) / count(*), 4) AS mean, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def epc_weighted(spark, d):
    flag = F.col("l_returnflag")
    weight = F.when(flag == "A", 100).when(flag == "N", 80).otherwise(50)
    counts = [F.count_if(flag == x).alias(x.lower()) for x in "ANR"]
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(weight) / F.count("*"), 4).alias("mean"), *counts)


@query(
    "cluster_postcode",
    "WITH k AS (SELECT p_size AS k, count(*) AS n, round(avg(p_retailprice), 6) AS mean, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1 HAVING count(*) >= 5), m AS (SELECT p_size AS k, p_type, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, min(p_partkey)) AS rn FROM part GROUP BY 1, p_type) SELECT k.*, p_type AS dominant FROM k JOIN m USING (k) WHERE rn = 1",
)
def cluster_postcode(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_size", "k")
    kinds = p.groupBy("k", "p_type").agg(F.count("*").alias("c"), F.min("p_partkey").alias("seen"), F.sum("p_retailprice").alias("total"), F.max("p_partkey").alias("latest"))
    best = F.max_by("p_type", F.struct("c", -F.col("seen")))
    out = kinds.groupBy("k").agg(F.sum("c").alias("n"), F.round(F.sum("total") / F.sum("c"), 6).alias("mean"), F.min("seen").alias("first"), F.max("latest").alias("last"), best.alias("dominant"))
    return out.where("n >= 5")


@query("top_owner", "SELECT l_suppkey, l_partkey FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rn FROM lineitem GROUP BY 1, 2) x WHERE rn = 1")
def top_owner(spark, d):
    counts = count_by(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")
    return best_per_key(counts, ["l_suppkey"], F.desc("n"), F.col("l_partkey")).select("l_suppkey", "l_partkey")


@query("portfolio", "SELECT l_suppkey, count(*) AS titles, count(*) FILTER (WHERE l_linestatus = 'F') AS freehold, count(*) FILTER (WHERE l_linestatus = 'O') AS leasehold, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS places FROM lineitem GROUP BY 1")
def portfolio(spark, d):
    status = F.col("l_linestatus")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("titles"), F.count_if(status == "F").alias("freehold"), F.count_if(status == "O").alias("leasehold"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("places")
    )


@query(
    "annual_value",
    f"SELECT l_orderkey, CAST(trunc(v / CASE WHEN days > 0 THEN days / 365.25 ELSE 3.0 END) AS BIGINT) AS annual FROM (SELECT l_orderkey, {sql_money('l_extendedprice')} AS v, date_diff('day', min(l_shipdate), max(l_shipdate)) AS days FROM lineitem GROUP BY 1) x",
)
def annual_value(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(money("l_extendedprice").alias("v"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("days"))
    years = F.when(F.col("days") > 0, F.col("days") / F.lit(365.25).cast("double")).otherwise(3.0)
    return x.select("l_orderkey", (F.col("v") / years).cast("long").alias("annual"))


@query(
    "snapshot_delta",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS before, count(*) AS after, count(*) - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS delta, round(100.0 * (count(*) - count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01')) / count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01'), 1) AS pct FROM orders GROUP BY 1",
)
def snapshot_delta(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("before"), F.count("*").alias("after"))
    delta = F.col("after") - F.col("before")
    return o.select("o_orderpriority", "before", "after", delta.alias("delta"), F.round(F.lit(100.0) * delta / F.nullif("before", F.lit(0)), 1).alias("pct"))


@query("transitions", "SELECT p_type AS old, CASE WHEN p_size >= 40 THEN 'LARGE' WHEN p_size <= 5 THEN 'SMALL' ELSE p_type END AS new, count(*) AS n FROM part GROUP BY 1, 2")
def transitions(spark, d):
    new = F.when(F.col("p_size") >= 40, "LARGE").when(F.col("p_size") <= 5, "SMALL").otherwise(F.col("p_type"))
    return count_by(table(spark, d, "part").select(F.col("p_type").alias("old"), new.alias("new")), "old", "new")


@query("market_analysis", f"SELECT r_name, count(*) AS schemes, {sql_money('o_totalprice')} AS value, count(DISTINCT c_custkey) AS operators FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def market_analysis(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("schemes"), money("o_totalprice").alias("value"), F.count_distinct("c_custkey").alias("operators"))


@query("latest_period", "SELECT o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_period(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("ui_rollups", "SELECT p_type, count(*) AS schemes, sum(p_size)::BIGINT AS units, round(avg(p_retailprice), 6) AS mean_score, round(100.0 * count(*) FILTER (WHERE p_size >= 25) / count(*), 1) AS win_rate FROM part GROUP BY 1")
def ui_rollups(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(
        F.count("*").alias("schemes"), F.sum("p_size").alias("units"), F.round(F.avg("p_retailprice"), 6).alias("mean_score"), F.round(F.lit(100.0) * F.count_if(F.col("p_size") >= 25) / F.count("*"), 1).alias("win_rate")
    )


@query("distinct_dim", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_dim(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("known_minus_new", "SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def known_minus_new(spark, d):
    new = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").select("s_nationkey").subtract(new)
