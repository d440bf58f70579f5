"""Source and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brickwork.operators import alerts
from brickwork.registry import query, table
from brickwork.sources import files
from brickwork.sources.workspace import new_path, written
from brickwork.streaming import metrics


@query(
    "csv_scan",
    "SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id, l_partkey AS price, CAST(l_shipdate AS DATE) AS date, concat('AB', l_suppkey, ' 1CD') AS postcode, l_returnflag AS property_type, 'Leeds' AS town FROM lineitem WHERE l_linenumber % 3 <> 0 AND l_linestatus <> 'F' AND l_suppkey % 10 <> 0 AND l_partkey % 9 <> 0",
)
def csv_scan(spark, d):
    """Lines in the register's form, some of them bad, written as text and scanned."""
    key = F.col("l_partkey")
    fields = [
        F.concat(F.lit("{"), F.col("l_orderkey"), F.lit("}")), F.when(key % 9 == 0, F.lit("n/a")).otherwise(key.cast("string")), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm"),
        F.when(F.col("l_suppkey") % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("ab"), F.col("l_suppkey"), F.lit(" 1cd"))), F.col("l_returnflag"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("N")).otherwise(F.lit("Y")),
        *[F.lit(x) for x in ("F", "1", "", "High Street", "", "Leeds", "", "", "A")], F.when(F.col("l_linestatus") == "F", F.lit("D")).otherwise(F.lit("A")),
    ]
    path = new_path(spark, "price-paid")
    good = table(spark, d, "lineitem").select(F.concat_ws(",", *[F.concat(F.lit('"'), f.cast("string"), F.lit('"')) for f in fields]).alias("value"))
    good.union(spark.createDataFrame([('"short","line"',), ("",)], "value string")).write.text(path)
    return files.price_paid(files.lines(spark, path))


@query("title_scan", "SELECT concat('T', p_partkey) AS title_number, CASE WHEN p_partkey % 4 = 1 THEN 1 WHEN p_partkey % 4 = 2 THEN 2 WHEN p_partkey % 4 = 3 THEN 4 END::INTEGER AS slots, p_name AS first FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0")
def title_scan(spark, d):
    """Slots end at the first empty name: a later filled one does not count."""
    key, name = F.col("p_partkey"), F.col("p_name")
    named = lambda test: F.when(test, name).otherwise("")
    slots = [named(key % 4 > 0), named(key % 4 > 1), named(key % 4 > 2), named(key % 4 != 2)]
    t = table(spark, d, "part").select(F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("T"), key)).alias("Title Number"), F.lit("LS1 1AA").alias("Postcode"), *[s.alias(f"Proprietor Name ({k})") for k, s in enumerate(slots, 1)])
    path = new_path(spark, "titles")
    t.write.csv(path, header=True)
    return files.read_titles(spark, path).select("title_number", F.size("proprietors").alias("slots"), F.get("proprietors", F.lit(0))["name"].alias("first"))


@query(
    "ocds_flatten",
    "SELECT concat('o-', o_orderkey) AS ocid, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2020-01-01' ELSE CAST(o_orderdate AS DATE) END AS starts, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2025-01-01' END AS ends, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS value FROM orders",
)
def ocds_flatten(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.when(key % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    contract = lambda start, amount: F.struct(F.struct(start.alias("startDate")).alias("period"), F.struct(amount.alias("amount")).alias("value"))
    contracts = F.array(contract(F.lit(None).cast("string"), F.lit(0.0)), contract(day, F.when(key % 2 == 0, F.col("o_totalprice"))))
    period = F.struct(F.lit("2020-01-01T00:00:00Z").alias("startDate"), F.when(key % 3 == 0, F.lit("2025-01-01T00:00:00Z")).alias("endDate"))
    tender = F.struct(F.col("o_orderpriority").alias("title"), period.alias("contractPeriod"))
    body = F.to_json(F.struct(F.concat(F.lit("o-"), key).alias("ocid"), contracts.alias("contracts"), tender.alias("tender")))
    path = new_path(spark, "releases")
    o.select(body.alias("value")).write.text(path)
    return files.releases(files.lines(spark, path)).select("ocid", "title", "starts", "ends", "value")


_AWARDED = """SELECT o_orderkey AS k, concat('ocds-', o_orderkey) AS ocid, o_orderpriority AS title, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS INTEGER) AS c, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM {orders}"""


def _awarded(spark, d):
    """Releases as lines of JSON: none to two contracts, none to two awards, a tender; days and values of each differ and are missing in turn."""
    o = spark.sql(_AWARDED, orders=table(spark, d, "orders"))
    k = F.col("k")
    day = lambda test, add: F.when(test, F.date_format(F.date_add("d", add), "yyyy-MM-dd'T'00:00:00'Z'"))
    period = lambda start, end: F.struct(start.alias("startDate"), end.alias("endDate"))
    value = lambda v: F.struct(v.alias("amount"))
    contract = lambda n: F.struct(period(day(k % 2 == n, F.lit(10 + n)), day(k % (3 + n) == 1, F.col("c") % 50 + 100 * n)).alias("period"), value(F.when(k % (4 + n) == 1, F.col("v") + n)).alias("value"))
    award = lambda n: F.struct(F.array(F.struct(F.when(k % (5 + n) != 0, F.concat(F.lit(f"Firm {n} "), "c")).alias("name"))).alias("suppliers"), value(F.when(k % 7 == n, F.col("v") + 10 + n)).alias("value"), period(day(k % 5 == n, F.lit(500 + n)), day(k % 5 == n, F.lit(600 + n))).alias("contractPeriod"))
    tender = F.struct(F.col("title"), value(F.when(k % 3 == 0, F.col("v") + 99)).alias("value"), period(day(k % 11 == 0, F.lit(1000)), day(k % 11 == 0, F.lit(1100))).alias("contractPeriod"), F.array(F.struct(F.struct(F.lpad(F.col("c").cast("string"), F.when(k % 2 == 0, 8).otherwise(7), "7").alias("id")).alias("classification"))).alias("items"))
    body = F.struct("ocid", F.slice(F.array(contract(0), contract(1)), F.lit(1), (k % 3).cast("int")).alias("contracts"), F.slice(F.array(award(0), award(1)), F.lit(1), (k % 4 % 3).cast("int")).alias("awards"), tender.alias("tender"))
    path = new_path(spark, "awarded")
    o.select(F.to_json(body).alias("value")).write.text(path)
    return files.lines(spark, path)


_PARTS = f"""r AS ({_AWARDED.format(orders='orders')}), p AS (SELECT *, k % 3 AS nc, k % 4 % 3 AS na,
  CASE WHEN k % 2 = 0 THEN d + 10 END AS s0, CASE WHEN k % 2 = 1 THEN d + 11 END AS s1, CASE WHEN k % 3 = 1 THEN d + c % 50 END AS e0, CASE WHEN k % 4 = 1 THEN d + c % 50 + 100 END AS e1, CASE WHEN k % 4 = 1 THEN v END AS v0, CASE WHEN k % 5 = 1 THEN v + 1 END AS v1,
  CASE WHEN k % 5 = 0 THEN d + 500 END AS as0, CASE WHEN k % 5 = 1 THEN d + 501 END AS as1, CASE WHEN k % 5 = 0 THEN d + 600 END AS ae0, CASE WHEN k % 5 = 1 THEN d + 601 END AS ae1, CASE WHEN k % 7 = 0 THEN v + 10 END AS av0, CASE WHEN k % 7 = 1 THEN v + 11 END AS av1,
  CASE WHEN k % 5 <> 0 THEN concat('Firm 0 ', c) END AS f0, CASE WHEN k % 6 <> 0 THEN concat('Firm 1 ', c) END AS f1, CASE WHEN k % 11 = 0 THEN d + 1000 END AS ts, CASE WHEN k % 11 = 0 THEN d + 1100 END AS te, CASE WHEN k % 3 = 0 THEN v + 99 END AS tv, CASE WHEN k % 2 = 0 THEN lpad(c::VARCHAR, 8, '7') END AS code FROM r)"""


@query(
    "ocds_awards",
    f"WITH {_PARTS} SELECT ocid, title, coalesce(CASE WHEN nc > 0 THEN s0 END, CASE WHEN nc > 1 THEN s1 END, ts, CASE WHEN na > 0 THEN as0 END, CASE WHEN na > 1 THEN as1 END)::DATE AS starts, coalesce(CASE WHEN nc > 0 THEN e0 END, CASE WHEN nc > 1 THEN e1 END, te, CASE WHEN na > 0 THEN ae0 END, CASE WHEN na > 1 THEN ae1 END)::DATE AS ends, "
    "coalesce(CASE WHEN nc > 0 THEN v0 END, CASE WHEN nc > 1 THEN v1 END, CASE WHEN na > 0 THEN av0 END, CASE WHEN na > 1 THEN av1 END) AS value, coalesce(CASE WHEN na > 0 THEN f0 END, CASE WHEN na > 1 THEN f1 END) AS supplier, coalesce(code, '') AS codes FROM p",
)
def ocds_awards(spark, d):
    return files.releases(_awarded(spark, d)).withColumn("codes", F.array_join("codes", ","))


@query(
    "ocds_signed",
    f"WITH {_PARTS}, q AS (SELECT *, CASE WHEN nc = 0 THEN NULL WHEN nc = 1 THEN 0 WHEN e0 IS NULL AND e1 IS NULL THEN 1 WHEN e1 IS NULL THEN 0 WHEN e0 IS NULL OR e1 > e0 THEN 1 ELSE 0 END AS i FROM p) "
    "SELECT ocid, title, coalesce(CASE i WHEN 0 THEN s0 WHEN 1 THEN s1 END, CASE na WHEN 1 THEN as0 WHEN 2 THEN as1 END, ts)::DATE AS starts, coalesce(CASE i WHEN 0 THEN e0 WHEN 1 THEN e1 END, CASE na WHEN 1 THEN ae0 WHEN 2 THEN ae1 END, te)::DATE AS ends, "
    "coalesce(CASE i WHEN 0 THEN v0 WHEN 1 THEN v1 END, CASE na WHEN 1 THEN av0 WHEN 2 THEN av1 END, tv) AS value, coalesce(CASE na WHEN 1 THEN f0 WHEN 2 THEN f1 END, '') AS supplier, coalesce(code, '') AS codes FROM q",
)
def ocds_signed(spark, d):
    return files.signed_releases(_awarded(spark, d)).withColumn("codes", F.array_join("codes", ","))


@query("next_data", "SELECT page_id, page_id * 3 AS rent, concat('b', page_id) AS building FROM pages WHERE page_id % 4 <> 0 AND contains(html, '</body>')")
def next_data(spark, d):
    key = F.col("page_id")
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"rent":'), key * 3, F.lit(',"name":"b'), key, F.lit('"}}</script></body>'))
    html = F.when(key % 4 != 0, F.replace("html", F.lit("</body>"), script)).otherwise(F.col("html"))
    data = files.embedded_json(html, "__NEXT_DATA__")
    parsed = F.from_json(data, "props struct<rent:long,name:string>")
    return table(spark, d, "pages").select("page_id", data.alias("data"), parsed["props"].alias("p")).where("data IS NOT NULL").select("page_id", "p.rent", F.col("p.name").alias("building"))


@query("replace_partition_load", "SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'new' ELSE 'old' END AS load FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') OR p_size > 10")
def replace_partition_load(spark, d):
    path = new_path(spark, "by-source")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.col("p_brand").alias("source"))
    p.withColumn("load", F.lit("old")).write.partitionBy("source").parquet(path)
    files.replace_partitions(p.where("source IN ('Brand#1', 'Brand#2') AND p_size > 10").withColumn("load", F.lit("new")), path, "source")
    return spark.read.parquet(path).select("id", "load")


@query("stream_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return metrics.latest_table(spark, metrics.daily_counts(metrics.event_stream(spark, d)), "daily")


@query("stream_alerts", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'")
def stream_alerts(spark, d):
    """Run twice with separate checkpoints: the second run raises nothing anew."""
    path = new_path(spark, "alerts")
    for _ in range(2):
        out = metrics.raise_alerts(spark, metrics.event_stream(spark, d), path, new_path(spark, "alerts-checkpoint"))
    return out


@query("stream_streaks", "SELECT user_id, count(*) FILTER (WHERE good = 0) AS streak FROM (SELECT user_id, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM events) x GROUP BY 1")
def stream_streaks(spark, d):
    return written(metrics.latest_streaks(spark, metrics.event_stream(spark, d), new_path(spark, "streaks"), new_path(spark, "streaks-checkpoint")), "streaks-latest")


@query("stream_daily_once", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_once(spark, d):
    """All events read twice, in two streams' worth of files: each counts once."""
    folder = new_path(spark, "read-again")
    for _ in range(2):  # the second reading covers the first one's window again
        table(spark, d, "events").select(*[c.split(" ")[0] for c in metrics.EVENTS.split(", ")]).write.mode("append").parquet(folder)
    return metrics.daily_once(spark, metrics.event_stream(spark, folder, "*.parquet", files_a_batch=1000), new_path(spark, "daily-once"), new_path(spark, "daily-once-checkpoint"))[0]


@query("lookback_window", "SELECT user_id, least(DATE '2024-02-01' - 180, CAST(max(CASE WHEN event_type <> 'error' THEN ts END) AS DATE) - CAST(user_id % 200 AS INTEGER) - 7) AS reads_from FROM events GROUP BY 1")
def lookback_window(spark, d):
    """The day from which each user is read again: half a year back, or a week before the last good run if that is earlier."""
    last = F.date_sub(F.to_date(F.max(F.when(F.col("event_type") != "error", F.col("ts")))), (F.col("user_id") % 200).cast("int"))
    return table(spark, d, "events").groupBy("user_id").agg(metrics.lookback_from(last, F.lit("2024-02-01").cast("date")).alias("reads_from"))


_SEEN = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'contract_expiring' ELSE 'new_application' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'existing_scheme' ELSE 'planning_application' END AS entity, o_orderkey AS id, o_orderkey % 2 = 0 AS is_read FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'scraper_failure', 'scraper_run', event_id, true FROM events WHERE event_id % 4 = 0"


@query(
    "alert_kinds",
    f"WITH known AS ({_SEEN}), a AS (SELECT 'contract_expiring' AS kind, 'existing_scheme' AS entity, o_orderkey AS id, concat('Contract expiring: ', c_name, ' (', date_diff('day', DATE '1998-01-01', CAST(o_orderdate AS DATE)), ' days remaining)') AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-04-01' "
    "UNION ALL SELECT 'new_application', 'planning_application', o_orderkey, concat('High-value application: ', o_orderpriority, ' (score: ', o_orderkey % 101, ')') FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:30:00' - INTERVAL 1 HOUR AND o_orderkey % 101 >= 70 "
    "UNION ALL SELECT 'scraper_failure', 'scraper_run', event_id, concat('Scraper failed: ', coalesce(CASE WHEN event_id % 7 <> 0 THEN concat('u', user_id) END, 'Unknown')) FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR) "
    "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = a.kind AND k.entity = a.entity AND k.id = a.id AND (k.kind <> 'contract_expiring' OR NOT k.is_read))",
)
def alert_kinds(spark, d):
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    schemes = o.join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.to_date("o_orderdate").alias("ends"))
    applications = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("reference"), (F.col("o_orderkey") % 101).alias("score"), F.col("o_orderdate").alias("created"))
    newest = e.agg(F.max("ts").alias("newest"))
    runs = e.crossJoin(F.broadcast(newest)).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("u"), "user_id")).alias("source"), F.when(F.col("event_type") == "error", "failed").alias("status"), F.col("ts").alias("started"), "newest")  # one row
    known = spark.sql(_SEEN.replace("FROM orders", "FROM {orders}").replace("FROM events", "FROM {events}"), orders=o, events=e)
    found = [alerts.expiring(schemes, F.lit("1998-01-01").cast("date")), alerts.high_scores(applications, F.lit("1998-01-01 00:30:00").cast("timestamp")), alerts.failures(runs, F.col("newest"))]
    return alerts.not_yet_raised(found, known)
