"""Roll-ups, rankings, joins and set operations over the relational tables (severity, domain and task analogues)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from .base import query, shared, table

shared("severity_counts_dense", """
SELECT s.severity, coalesce(c.n, 0) AS n FROM (SELECT * FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) AS t(severity)) s
LEFT JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM {orders} GROUP BY o_orderpriority) c ON c.p = s.severity""")

@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END, o_totalprice DESC, o_orderkey) AS place FROM orders""")
def severity_order(spark, sf_dir):
    """The place of every finding by severity, then weight."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).when(F.col("o_orderpriority") == "3-MEDIUM", 2).otherwise(99)
    ordered = windows.global_rank(table(spark, sf_dir, "orders").withColumn("rank", rank), ["rank", F.desc("o_totalprice"), "o_orderkey"])
    return ordered.select("o_orderkey", "place")


shared("domain_rollup", """
SELECT n.n_name AS domain, o.o_orderpriority AS severity, count(*) AS findings, count(DISTINCT o.o_custkey) AS files, count(DISTINCT o.o_orderstatus) AS states
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE lower(n.n_name) NOT LIKE '%gas%' GROUP BY n.n_name, o.o_orderpriority""")

shared("domain_totals", """
SELECT domain, sum(n) AS findings, count(*) AS severities, max(n) AS largest FROM (
  SELECT c.c_mktsegment AS domain, o.o_orderpriority AS severity, count(*) AS n FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) GROUP BY domain""",
    oracle="""
SELECT domain, CAST(sum(n) AS BIGINT) AS findings, count(*) AS severities, max(n) AS largest FROM (
  SELECT c.c_mktsegment AS domain, o.o_orderpriority AS severity, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) GROUP BY domain""")

shared("multi_distinct", """
SELECT count(DISTINCT l.l_orderkey) AS findings, count(DISTINCT l.l_partkey) AS files, count(DISTINCT o.o_custkey) AS projects, count(DISTINCT o.o_orderpriority) AS severities
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey""")

shared("recent_top10", """
SELECT o.o_orderkey, c.c_name, CASE WHEN length(c.c_name) > 10 THEN concat(substring(c.c_name, 1, 10), '...') ELSE c.c_name END AS shortened, o.o_totalprice
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND lower(c.c_mktsegment) NOT LIKE '%gas%' ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 10""")

shared("log_stats_grouping_sets", """
SELECT event_type, user_band, count(*) AS n, round(avg(value), 6) AS mean_value, min(value) AS least, max(value) AS most
FROM (SELECT event_type, user_id % 10 AS user_band, value FROM {events}) GROUP BY GROUPING SETS ((event_type), (user_band), ())""")

shared("log_shares", """
SELECT event_type, n, round(100.0 * n / (SELECT count(*) FROM {events}), 6) AS share FROM (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type)""",
    spark_sql="""
SELECT event_type, n, round(100D * n / (SELECT count(*) FROM {events}), 6) AS share FROM (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type)""")

shared("stage_timings", """
SELECT event_type AS stage, count(*) AS runs, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM {events} GROUP BY event_type""")

shared("task_status", """
SELECT o_orderpriority AS queue, count(*) AS tasks, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mean_completed FROM {orders} GROUP BY o_orderpriority""")

shared("top3_types", """
SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""")

shared("mode_argmax", """
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r
  FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type)) WHERE r = 1""")

shared("project_quality", """
SELECT d.source, count(*) AS files, round(sum(coalesce(l.quality, 0)) / count(*), 6) AS quality, round(sum(coalesce(l.toxic, 0)) / count(*), 6) AS toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source""")

shared("point_in_interval", """
SELECT o.o_orderkey, count(*) AS hits FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL '30' DAY GROUP BY o.o_orderkey""")

shared("semi_high_risk", """
SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} l WHERE EXISTS (SELECT 1 FROM {part} p WHERE p.p_partkey = l.l_partkey AND p.p_size >= 45)""")

shared("incremental_anti", """
SELECT d.doc_id, d.source FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)""")

shared("entry_points", """
SELECT s.s_suppkey, s.s_name, count(*) AS flows, CASE WHEN count(*) > 600 THEN 'high' ELSE 'medium' END AS severity
FROM {supplier} s JOIN {lineitem} l ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_name""")

shared("outer_merge_defaults", """
SELECT c.c_custkey, coalesce(o.orders, 0) AS orders, coalesce(o.priority, 'Medium') AS priority, greatest(coalesce(o.largest, 0.0), c.c_acctbal) AS confidence
FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS orders, min(o_orderpriority) AS priority, max(o_totalprice) AS largest FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    spark_sql="""
SELECT c.c_custkey, coalesce(o.orders, 0) AS orders, coalesce(o.priority, 'Medium') AS priority, greatest(coalesce(o.largest, 0D), c.c_acctbal) AS confidence
FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS orders, min(o_orderpriority) AS priority, max(o_totalprice) AS largest FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")

shared("anti_append", """
SELECT DISTINCT l_partkey AS part, 'acquired' AS origin FROM {lineitem} WHERE l_quantity > 49
UNION ALL SELECT p_partkey, 'derived' FROM {part} p WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_quantity > 49 AND l.l_partkey = p.p_partkey)""")

shared("substring_join", """
SELECT n.n_nationkey, count(*) AS mentions FROM {nation} n JOIN {customer} c ON c.c_nationkey = n.n_nationkey AND contains(lower(c.c_name), substring(lower(c.c_mktsegment), 1, 1)) GROUP BY n.n_nationkey""")

shared("shared_prior", """
SELECT a.l_orderkey, a.l_linenumber, count(DISTINCT b.l_linenumber) AS shared FROM {lineitem} a
JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND b.l_returnflag = a.l_returnflag GROUP BY a.l_orderkey, a.l_linenumber""")

shared("heatmap_max", """
SELECT line, max(heat) AS heat FROM (SELECT l_partkey AS line, CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) AS heat FROM {lineitem}
  UNION ALL SELECT l_partkey + 1, CAST(floor(l_quantity * (1 - l_discount)) AS BIGINT) - 2 FROM {lineitem}) GROUP BY line""")

shared("exploitability", """
SELECT l_orderkey, l_linenumber, least(10.0, 5.0 + CASE WHEN l_returnflag = 'R' THEN 3.0 WHEN l_returnflag = 'A' THEN 2.0 ELSE 0.5 END + CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END + least(0.5 * l_linenumber, 2.0)) AS score FROM {lineitem}""",
    spark_sql="""
SELECT l_orderkey, l_linenumber, least(10D, 5D + CASE WHEN l_returnflag = 'R' THEN 3D WHEN l_returnflag = 'A' THEN 2D ELSE 0.5D END + CASE WHEN l_linestatus = 'O' THEN 1D ELSE 0D END + least(0.5D * l_linenumber, 2D)) AS score FROM {lineitem}""",
    oracle="""
SELECT l_orderkey, l_linenumber, CAST(least(10.0, 5.0 + CASE WHEN l_returnflag = 'R' THEN 3.0 WHEN l_returnflag = 'A' THEN 2.0 ELSE 0.5 END + CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END + least(0.5 * l_linenumber, 2.0)) AS DOUBLE) AS score FROM lineitem""")

shared("union_findings", """
SELECT type, severity, count(*) AS n FROM (SELECT event_type AS type, CAST(NULL AS STRING) AS severity FROM {events} UNION ALL SELECT 'order', o_orderpriority FROM {orders}) GROUP BY type, severity""")

shared("report_search_page", """
SELECT o_orderkey, o_orderpriority FROM {orders} WHERE (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderstatus), 'f')) ORDER BY o_orderkey DESC LIMIT 12 OFFSET 12""")

@query("""SELECT o_orderpriority, o_orderkey, r AS place, n - 3 AS more FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r,
  count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r <= 3""")
def severity_top_with_more(spark, sf_dir):
    found = windows.top_with_more(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return found.select("o_orderpriority", "o_orderkey", F.col("place").cast("long").alias("place"), "more")


@query("""SELECT doc_id, tier FROM (SELECT doc_id, tier, min(tier) OVER () AS best FROM (
  SELECT doc_id, CASE WHEN CAST(doc_id AS STRING) = 'token' THEN 1 WHEN contains(lower(text), 'token') THEN 2 WHEN contains(source, 'token') THEN 3 END AS tier FROM documents) WHERE tier IS NOT NULL) WHERE tier = best""")
def tiered_search(spark, sf_dir):
    """The rows of the best tier that any row is in; the best tier is one row."""
    tier = F.when(F.col("doc_id").cast("string") == "token", 1).when(F.lower("text").contains("token"), 2).when(F.col("source").contains("token"), 3)
    found = table(spark, sf_dir, "documents").select("doc_id", tier.alias("tier")).where("tier is not null")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier", "left_semi")


shared("quality_filter", """
SELECT d.doc_id, d.lang FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 0) > 0 AND l.toxic = 0""")

shared("json_props", """
SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}""",
    oracle="SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")

shared("histogram", """
SELECT CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM {events} GROUP BY 1""")

shared("pivot_counts", """
SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS low, count(*) FILTER (WHERE user_id % 3 = 1) AS medium, count(*) FILTER (WHERE user_id % 3 = 2) AS high FROM {events} GROUP BY event_type""")


@query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5")
def grouped_limit(spark, sf_dir):
    return windows.top_per_group(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 5).select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("""SELECT event_type, value AS p95, n FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r
  FROM events WHERE value IS NOT NULL) WHERE r = CASE WHEN n >= 20 THEN CAST(floor(n * 0.95) AS BIGINT) + 1 ELSE n END""")
def latency_p95(spark, sf_dir):
    return windows.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95, 20).withColumnRenamed("value", "p95")


@query("""SELECT user_id, group_no, count(*) AS n FROM (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS group_no FROM (
  SELECT user_id, event_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 21600000000 THEN 1 ELSE 0 END AS new FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events)))
GROUP BY user_id, group_no""")
def proximity_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return windows.proximity_groups(events, ["user_id"], ["us", "event_id"], 21_600_000_000, "us").groupBy("user_id", "group_no").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, n, md5(array_to_string(around, '|')) AS digest FROM (
  SELECT conv_id, turn, len(around) AS n, around FROM (SELECT conv_id, turn, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM conversations))""")
def context_frame(spark, sf_dir):
    rows = windows.context(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", 2, 2)
    return rows.select("conv_id", "turn", F.size("context").cast("long").alias("n"), F.md5(F.array_join("context", "|")).alias("digest"))
