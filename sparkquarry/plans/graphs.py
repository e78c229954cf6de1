"""Graph queries on graphs made of customers, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from .base import query, shared, table

#: A graph of customers: one that each leads to, others for some, with cycles; and texts of calls.
EDGES = "SELECT c_custkey AS src, cast(floor(c_custkey / 3) AS bigint) AS dst FROM {customer} UNION ALL SELECT c_custkey, cast(c_nationkey AS bigint) FROM {customer} WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, c_custkey * 2 + 1 FROM {customer} WHERE c_custkey % 50 = 0"
CODE = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('function f() ', chr(123), ' a.', c_mktsegment, '(1); h ( 2 ); ', chr(125)) WHEN 1 THEN concat('x = new Token(1); token.', c_mktsegment, '(to, n', cast(c_custkey AS string), ');') ELSE c_name END AS code FROM {customer}"
PLAIN = EDGES.replace("{customer}", "customer")


def edges(spark, sf_dir):
    return spark.sql(EDGES, customer=table(spark, sf_dir, "customer"))


@query(f"""WITH RECURSIVE e AS ({PLAIN}), r(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.depth + 1 FROM r JOIN e ON r.dst = e.src WHERE r.depth < 10)
  SELECT src, dst, min(depth) AS depth FROM r GROUP BY src, dst""")
def closure_bounded(spark, sf_dir):
    return graph.reachable(edges(spark, sf_dir), 10)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({PLAIN})), r(node, path) AS (SELECT 10::BIGINT, [10::BIGINT] UNION ALL SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN e ON r.node = e.src WHERE NOT list_contains(r.path, e.dst) AND len(r.path) <= 6)
  SELECT array_to_string(path, '>') AS path FROM r""")
def call_tree_paths(spark, sf_dir):
    """All simple paths of up to six steps from one customer."""
    return graph.simple_paths(edges(spark, sf_dir), F.lit(10).cast("long"), 6).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE e AS ({PLAIN}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
  SELECT src AS flow, count(*) AS vulnerable FROM r WHERE dst % 400 = 1 GROUP BY src""")
def transitive_flows(spark, sf_dir):
    """How many weak ones a flow leads to, over any number of steps: found backwards, from the weak ones."""
    weak = edges(spark, sf_dir).select(F.col("dst").alias("weak")).where("weak % 400 = 1").distinct()
    back = edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = graph.reachable(back, 1 << 20, starts=weak)
    return found.groupBy(F.col("dst").alias("flow")).agg(F.count(F.lit(1)).alias("vulnerable"))


@query(rf"""SELECT id, unnest(regexp_extract_all(code, '(?:\w+\.)?(\w+)\s*\(', 1)) AS callee FROM ({CODE.replace('{customer}', 'customer')})""")
def call_extract(spark, sf_dir):
    return spark.sql(CODE, customer=table(spark, sf_dir, "customer")).select("id", F.explode(T.calls(F.col("code"))).alias("callee"))


shared("edges_reverse", """
SELECT dst AS callee, count(DISTINCT src) AS callers, min(src) AS first_caller FROM (SELECT l_suppkey AS src, l_partkey AS dst FROM {lineitem}) GROUP BY dst""")


#: Orders in chains of a thousand, of which every fifth has a cycle of three near its beginning.
PARENTS = "CASE WHEN o_orderkey % 1000 = 0 THEN NULL WHEN o_orderkey % 5000 = 7 THEN o_orderkey + 2 ELSE o_orderkey - 1 END"


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5000 BETWEEN 7 AND 999 AS lost FROM orders)
SELECT id, CASE WHEN NOT lost THEN id - id % 1000 END AS root, CASE WHEN NOT lost THEN id % 1000 END AS depth FROM o""")
def flow_roots(spark, sf_dir):
    """The uppermost flow of each one, and how deep it is; none where sub-flows go in circles."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(PARENTS).alias("parent"))
    return graph.rooted(rows, "id", "parent")
