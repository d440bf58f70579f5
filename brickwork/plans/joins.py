"""Join queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwork.operators.components import primaries
from brickwork.operators.joining import best_per_key, first_tier, repoint, repoint_all, semi_on_any
from brickwork.operators.similar import best_similar, duplicate_names
from brickwork.registry import query, table


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left_multi", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_multi(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    out = table(spark, d, "orders").join(c.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("join_role_playing", "SELECT o_orderkey, a.c_name AS operator, b.c_name AS owner FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_orderkey % 1000 = b.c_custkey")
def join_role_playing(spark, d):
    c = table(spark, d, "customer")
    role = lambda name: c.select(F.col("c_custkey").alias(f"{name}_id"), F.col("c_name").alias(name))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("operator_id"), (F.col("o_orderkey") % 1000).alias("owner_id"))
    return o.join(role("operator"), "operator_id", "left").join(role("owner"), "owner_id", "left").select("o_orderkey", "operator", "owner")


@query(
    "join_polymorphic",
    "SELECT event_id, CASE WHEN p_partkey IS NOT NULL THEN 'application' WHEN o_orderkey IS NOT NULL THEN 'scheme' END AS linked, CASE WHEN p_partkey IS NOT NULL THEN p_name WHEN o_orderkey IS NOT NULL THEN o_orderpriority END AS title FROM events LEFT JOIN part ON p_partkey = event_id AND p_size > 25 LEFT JOIN orders ON o_orderkey = event_id",
)
def join_polymorphic(spark, d):
    a = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("event_id"), "p_name", F.lit(True).alias("is_app"))
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderpriority", F.lit(True).alias("is_scheme"))
    e = table(spark, d, "events").select("event_id").join(a, "event_id", "left").join(s, "event_id", "left")
    pick = lambda x, y: F.when(F.col("is_app"), x).when(F.col("is_scheme"), y)
    return e.select("event_id", pick(F.lit("application"), F.lit("scheme")).alias("linked"), pick(F.col("p_name"), F.col("o_orderpriority")).alias("title"))


@query("geo_distribution", "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def geo_distribution(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    n = table(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return n.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("semi_or", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 3) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 3)")
def semi_or(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return semi_on_any(li, table(spark, d, "part").where("p_size = 3"), ["l_partkey", "l_suppkey"], "p_partkey").select("l_orderkey", "l_linenumber")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("multi_slot_join", "SELECT DISTINCT o_orderkey FROM orders JOIN supplier ON s_suppkey IN (o_custkey, o_orderkey % 77, o_orderkey % 13) WHERE s_acctbal > 5000")
def multi_slot_join(spark, d):
    slots = F.explode(F.array("o_custkey", F.col("o_orderkey") % 77, F.col("o_orderkey") % 13))
    o = table(spark, d, "orders").select("o_orderkey", slots.alias("s_suppkey"))
    return o.join(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey"), "s_suppkey").select("o_orderkey").distinct()


@query("normalised_key_join", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON upper(replace(p_brand, ' ', '')) = upper(concat('brand#', CAST(s_suppkey AS VARCHAR)))")
def normalised_key_join(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.upper(F.replace("p_brand", F.lit(" "), F.lit(""))).alias("k"))
    b = table(spark, d, "supplier").select("s_suppkey", F.upper(F.concat(F.lit("brand#"), F.col("s_suppkey").cast("string"))).alias("k"))
    return a.join(b, "k").select("p_partkey", "s_suppkey")


@query(
    "neighbour_unique",
    "SELECT a.p_partkey, n.operator FROM (SELECT * FROM part WHERE p_partkey % 3 = 0) a JOIN (SELECT p_size, p_type, max(p_brand) AS operator FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_size, p_type HAVING count(DISTINCT p_brand) = 1) n ON a.p_size = n.p_size AND a.p_type = n.p_type",
)
def neighbour_unique(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_partkey % 3 <> 0").groupBy("p_size", "p_type").agg(F.max("p_brand").alias("operator"), F.min("p_brand").alias("least")).where("operator = least")
    return p.where("p_partkey % 3 = 0").join(known, ["p_size", "p_type"]).select("p_partkey", "operator")


@query(
    "update_from",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(s.l_suppkey, -1) ELSE p_partkey END AS operator FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_partkey) s ON l_partkey = p_partkey",
)
def update_from(spark, d):
    source = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("source"))
    target = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey"))
    return table(spark, d, "part").join(source, "p_partkey", "left").select("p_partkey", F.coalesce(target, "source", F.lit(-1)).alias("operator"))


@query("distinct_on_join", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN (SELECT DISTINCT ON (l_orderkey) * FROM lineitem ORDER BY l_orderkey, l_quantity DESC, l_linenumber, l_partkey, l_suppkey) x ON l_orderkey = o_orderkey")
def distinct_on_join(spark, d):
    best = best_per_key(table(spark, d, "lineitem"), ["l_orderkey"], F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, d, "orders").join(best, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@query("latest_run", "SELECT user_id, event_id, ts FROM events JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) m USING (user_id, ts)")
def latest_run(spark, d):
    e = table(spark, d, "events")
    return e.join(e.groupBy("user_id").agg(F.max("ts").alias("ts")), ["user_id", "ts"]).select("user_id", "event_id", "ts")


CURRENT = "SELECT l_orderkey, max(l_shipdate) AS ends FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey"


@query("effective_end", f"SELECT o_orderkey, coalesce(c.ends, o.stored) AS contract_first, coalesce(o.stored, c.ends) AS scheme_first FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS stored FROM orders) o LEFT JOIN ({CURRENT}) c ON l_orderkey = o_orderkey")
def effective_end(spark, d):
    c = table(spark, d, "lineitem").where("l_linestatus = 'O'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ends"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("stored"))
    return o.join(c, "o_orderkey", "left").select("o_orderkey", F.coalesce("ends", "stored").alias("contract_first"), F.coalesce("stored", "ends").alias("scheme_first"))


@query("current_contract", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_suppkey, l_partkey) AS rn FROM lineitem WHERE l_linestatus = 'O') x WHERE rn = 1")
def current_contract(spark, d):
    li = table(spark, d, "lineitem").where("l_linestatus = 'O'")
    return best_per_key(li, ["l_orderkey"], F.desc("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey"), rank="rn").select("l_orderkey", "l_linenumber", "l_suppkey", "rn")


@query("theta_contains", "SELECT p_partkey, n_name FROM (SELECT p_partkey, concat(p_name, ' nation_', CAST(p_partkey % 40 AS VARCHAR), ' site') AS name FROM part) a JOIN nation ON contains(name, concat(lower(n_name), ' '))")
def theta_contains(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" nation_"), (F.col("p_partkey") % 40).cast("string"), F.lit(" site")).alias("name"))
    n = F.broadcast(table(spark, d, "nation").select("n_name"))  # nations are a fixed, small dimension
    return a.join(n, F.contains("name", F.concat(F.lower("n_name"), F.lit(" ")))).select("p_partkey", "n_name")


@query("like_any", "SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%ring' OR p_name LIKE '%_dg_t'")
def like_any(spark, d):
    patterns = ["red%", "%ring", "%_dg_t"]
    hit = F.lit(False)
    for x in patterns:
        hit = hit | F.col("p_name").like(x)
    return table(spark, d, "part").where(hit).select("p_partkey")


@query(
    "cascade_lookup",
    "WITH a AS (SELECT p_partkey, concat('NATION_', CAST(p_partkey % 60 AS VARCHAR)) AS raw FROM part), t AS (SELECT p_partkey, n_nationkey, 1 AS tier FROM a JOIN nation ON raw = n_name UNION ALL SELECT p_partkey, n_nationkey, 2 FROM a JOIN nation ON substr(raw, 1, 8) = n_name "
    "UNION ALL SELECT p_partkey, n_nationkey, 3 FROM a JOIN nation ON contains(n_name, substr(raw, 8, 1))) SELECT p_partkey, n_nationkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, n_nationkey) AS rn FROM t) x WHERE rn = 1",
)
def cascade_lookup(spark, d):
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))  # nations are a fixed, small dimension
    a = table(spark, d, "part").select("p_partkey", F.concat(F.lit("NATION_"), (F.col("p_partkey") % 60).cast("string")).alias("raw"))
    on = lambda c: a.join(n, c).select("p_partkey", "n_nationkey")
    tiers = [on(F.col("raw") == F.col("n_name")), on(F.substring("raw", 1, 8) == F.col("n_name")), on(F.contains("n_name", F.substring("raw", 8, 1)))]
    return first_tier(tiers, "p_partkey", F.col("n_nationkey")).select("p_partkey", "n_nationkey", "tier")


#: Words of a name, lower-case and sorted; and the score of two such texts a and b by the longest common subsequence, a bit for each letter of a.
_SORTED = "array_to_string(list_sort(string_split(lower(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')), ' ')"
_MASKS = "list_transform(string_split({1}, ''), lambda y: list_sum(list_transform(range(len({0})), lambda i: CASE WHEN {0}[i + 1] = y THEN 1::BIGINT << i ELSE 0 END))::BIGINT)"
_REST = "list_reduce({0}, lambda rest, p: ((rest + (rest & p)) | (rest - (rest & p))) & ((1::BIGINT << {1}) - 1), (1::BIGINT << {1}) - 1)"
_SCORE = f"round_even(200.0 * (len(a) - bit_count({_REST.format(_MASKS.format('a', 'b'), 'len(a)')})) / (len(a) + len(b)), 0)::INTEGER"


@query(
    "fuzzy_match",
    f"WITH s AS (SELECT s_suppkey, {_SORTED.format('name')} AS b FROM (SELECT s_suppkey, s_name AS name FROM supplier UNION ALL SELECT s_suppkey, concat('Customer ', s_suppkey + 1) FROM supplier) x), c AS (SELECT c_custkey, {_SORTED.format('c_name')} AS a FROM customer), "
    f"m AS (SELECT c_custkey, s_suppkey, {_SCORE} AS score FROM c CROSS JOIN s) SELECT c_custkey, s_suppkey, score FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS rn FROM m WHERE score >= 70) y WHERE rn = 1",
)
def fuzzy_match(spark, d):
    """The supplier of each customer whose name or alias ("Customer" and the next number) is most alike, at 70 or more of 100, in any nation."""
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array("s_name", F.concat(F.lit("Customer "), F.col("s_suppkey") + 1))).alias("name"))
    return best_similar(table(spark, d, "customer"), "c_custkey", "c_name", s, "s_suppkey", "name", 70)


@query(
    "dedupe_pairs",
    f"WITH c AS (SELECT c_custkey, {_SORTED.format('c_name')} AS a FROM customer), p AS (SELECT x.c_custkey, y.c_custkey AS other, x.a, y.a AS b FROM c x JOIN c y ON x.c_custkey < y.c_custkey AND abs(len(x.a) - len(y.a)) <= 0.065 * (len(x.a) + len(y.a))) "
    f"SELECT * FROM (SELECT c_custkey, other, {_SCORE} AS score FROM p) z WHERE score >= 94",
)
def dedupe_pairs(spark, d):
    """Pairs of customers, in any nation and segment, whose names are alike at 94 or more of 100; those of one name as members of the first."""
    pairs, members = duplicate_names(table(spark, d, "customer"), "c_custkey", "c_name", 94)
    same = members.where("id <> representative").select(F.col("representative").alias("id"), F.col("id").alias("other"), F.lit(100).alias("score"))
    return pairs.unionByName(same).withColumnRenamed("id", "c_custkey")


@query(
    "token_overlap_join",
    "WITH r AS (SELECT o_orderkey, o_custkey AS k, [o_orderpriority, o_orderstatus, CAST(o_orderkey % 5 AS VARCHAR)] AS w FROM orders), t AS (SELECT c_custkey AS id, c_custkey AS k, ['F', '2-HIGH', CAST(c_custkey % 5 AS VARCHAR)] AS w FROM customer), "
    "m AS (SELECT o_orderkey, id, len(list_intersect(r.w, t.w)) AS score FROM r JOIN t USING (k)) SELECT o_orderkey, id, score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, id) AS rn FROM m WHERE score >= 1) x WHERE rn = 1",
)
def token_overlap_join(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.array("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 5).cast("string")).alias("words"))
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("k"), F.array(F.lit("F"), F.lit("2-HIGH"), (F.col("c_custkey") % 5).cast("string")).alias("other"))
    m = r.join(t, "k").withColumn("score", F.size(F.array_intersect("words", "other")).cast("long")).where("score >= 1")
    return best_per_key(m, ["o_orderkey"], F.desc("score"), F.col("id")).select("o_orderkey", "id", "score")


@query(
    "entity_match",
    "WITH n AS (SELECT l_orderkey AS ref, l_linenumber, l_suppkey AS op, l_partkey AS pc FROM lineitem), t AS (SELECT n.*, o_orderkey AS id, 1 AS tier FROM n JOIN orders ON o_orderkey = ref + 3 AND o_orderstatus = 'P' UNION ALL SELECT n.*, o_orderkey, 2 FROM n JOIN orders ON o_orderkey = ref AND o_orderpriority = '1-URGENT' "
    "UNION ALL SELECT n.*, o_orderkey, 3 FROM n JOIN orders ON o_custkey = pc AND o_orderkey % 100 = op) SELECT ref, l_linenumber, op, pc, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY ref, l_linenumber, op, pc ORDER BY tier, id) AS rn FROM t) x WHERE rn = 1",
)
def entity_match(spark, d):
    n = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref"), "l_linenumber", F.col("l_suppkey").alias("op"), F.col("l_partkey").alias("pc"))
    o = table(spark, d, "orders")
    columns = ["ref", "l_linenumber", "op", "pc", F.col("o_orderkey").alias("id")]
    by_reference = n.join(o.where("o_orderstatus = 'P'"), F.col("o_orderkey") == F.col("ref") + 3).select(*columns)
    by_name = n.join(o.where("o_orderpriority = '1-URGENT'"), F.col("o_orderkey") == F.col("ref")).select(*columns)
    by_place = n.join(o, (F.col("o_custkey") == F.col("pc")) & (F.col("o_orderkey") % 100 == F.col("op"))).select(*columns)
    key = F.struct("ref", "l_linenumber", "op", "pc")
    tiers = [t.withColumn("key", key) for t in (by_reference, by_name, by_place)]
    return first_tier(tiers, "key", F.col("id")).select("ref", "l_linenumber", "op", "pc", "id", "tier")


@query(
    "rule_cascade",
    "WITH a AS (SELECT o_orderkey FROM orders JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 5) s USING (o_custkey)), b AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderkey NOT IN (SELECT * FROM a)), "
    "c AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey NOT IN (SELECT * FROM a) AND o_orderkey NOT IN (SELECT * FROM b)) SELECT *, 'A' AS rule FROM a UNION ALL SELECT *, 'B' FROM b UNION ALL SELECT *, 'C' FROM c",
)
def rule_cascade(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    few = o.groupBy("o_custkey").count().where("count <= 5").select("o_custkey", F.lit(True).alias("few"))
    building = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("building"))
    out = o.join(few, "o_custkey", "left").join(building, "o_custkey", "left")
    rule = F.when(F.col("few"), "A").when(F.col("building"), "B").when(F.col("o_orderpriority") == "2-HIGH", "C")
    return out.select("o_orderkey", rule.alias("rule")).where("rule IS NOT NULL")


@query("cross_reference", "SELECT p_partkey, min(l_orderkey) AS scheme FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey AND o_orderstatus = 'F') GROUP BY p_partkey")
def cross_reference(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("p_partkey"))
    li = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey")
    return table(spark, d, "part").select("p_partkey").join(known, "p_partkey", "left_anti").join(li, "p_partkey").groupBy("p_partkey").agg(F.min("l_orderkey").alias("scheme"))


@query("existing_match", "SELECT DISTINCT a.c_custkey FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND (right(a.c_name, 2) = right(b.s_name, 2) OR a.c_acctbal = b.s_acctbal)")
def existing_match(spark, d):
    """Two equi joins, one for each way to match; their hits are few keys, made distinct."""
    a, b = table(spark, d, "customer"), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name", F.col("s_acctbal").alias("balance")).distinct()
    a = a.select("c_custkey", F.col("c_nationkey").alias("nation"), F.right("c_name", F.lit(2)).alias("tail"), F.col("c_acctbal").alias("balance"))
    tails = b.select("nation", F.right("s_name", F.lit(2)).alias("tail")).distinct()
    by_tail = a.join(tails, ["nation", "tail"], "left_semi").select("c_custkey")
    by_balance = a.join(b, ["nation", "balance"], "left_semi").select("c_custkey")
    return by_tail.unionByName(by_balance).distinct()


@query("fanout_map", "SELECT r_name, n_name, CAST(r_regionkey * 100 AS INTEGER) AS rent FROM region JOIN nation ON n_regionkey = r_regionkey")
def fanout_map(spark, d):
    councils = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_set("n_name").alias("members"))  # a fixed dimension
    return table(spark, d, "region").join(councils, "r_regionkey").select("r_name", F.explode("members").alias("n_name"), (F.col("r_regionkey") * 100).cast("int").alias("rent"))


@query("merge_repoint", "SELECT o_orderkey, coalesce(m.new, o_custkey) AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey AS old, c_custkey - c_custkey % 10 AS new FROM customer WHERE c_custkey % 10 IN (1, 2)) m ON o_custkey = old")
def merge_repoint(spark, d):
    key = F.col("c_custkey")
    merges = table(spark, d, "customer").where(key % 10 < 3).where(key % 10 > 0).select(key.alias("old"), (key - key % 10).alias("new"))
    return repoint(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", merges)


_MERGES = "SELECT c_custkey AS old, CASE WHEN c_custkey % 10 = 7 THEN c_custkey - 4 ELSE c_custkey - 1 END AS new FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 7)"


@query(
    "merge_transitive",
    f"WITH RECURSIVE m AS ({_MERGES}), w AS (SELECT old, new FROM m UNION ALL SELECT w.old, m.new FROM w JOIN m ON m.old = w.new), f AS (SELECT old, new FROM w WHERE new NOT IN (SELECT old FROM m)), "
    "refs AS (SELECT 'operator' AS ref, o_orderkey AS id, o_custkey AS company FROM orders UNION ALL SELECT 'owner', o_orderkey, o_orderkey % 1500 FROM orders UNION ALL SELECT 'manager', o_orderkey, (o_orderkey * 7) % 1500 FROM orders "
    "UNION ALL SELECT 'applicant', p_partkey, p_partkey % 1500 FROM part UNION ALL SELECT 'contact', s_suppkey, s_suppkey FROM supplier UNION ALL SELECT 'alias', c_custkey, c_custkey FROM customer) SELECT ref, id, coalesce(new, company) AS company FROM refs LEFT JOIN f ON old = company",
)
def merge_transitive(spark, d):
    """Merges of merges: every reference goes to the company at the end of the chain, in all six places."""
    merges = primaries(spark.sql(_MERGES.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer")))
    key = F.col("o_orderkey")
    schemes = table(spark, d, "orders").select(key.alias("id"), F.col("o_custkey").alias("operator"), (key % 1500).alias("owner"), (key * 7 % 1500).alias("manager"))
    tables = {
        "schemes": (schemes, ["operator", "owner", "manager"]),
        "applications": (table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 1500).alias("applicant")), ["applicant"]),
        "contacts": (table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("contact")), ["contact"]),
        "aliases": (table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("alias")), ["alias"]),
    }
    merged = repoint_all(tables, merges)
    rows = [merged[name].select(F.lit(column).alias("ref"), "id", F.col(column).alias("company")) for name, (_, columns) in tables.items() for column in columns]
    return reduce(DataFrame.unionByName, rows)


@query("lookup_join", "SELECT o_orderkey, n_name FROM orders JOIN nation ON n_nationkey = o_custkey % 30")
def lookup_join(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("n_nationkey")).join(n, "n_nationkey").select("o_orderkey", "n_name")
