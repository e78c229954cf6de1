"""Vector search queries over embeddings: each tenth of a hundred vectors is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import vectorindex as V
from .base import query, table

TOP = """SELECT query_id, vec_id, score, rank FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q CROSS JOIN embeddings v)) WHERE rank <= {k}"""


def _top(spark, sf_dir, k):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.cosine_top_k(queries, vectors, k)


@query(TOP.format(k=10))
def knn_topk(spark, sf_dir):
    return _top(spark, sf_dir, 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, max(CASE WHEN rank > 3 AND (score < 0.2 OR before - score > 0.05 * top) THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS stopped FROM (
  SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY rank) AS top, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM ({TOP.format(k=20)}))) WHERE stopped = 0""")
def adaptive_topk(spark, sf_dir):
    return R.adaptive_cutoff(_top(spark, sf_dir, 20), 3, 20, 0.2, 0.05).withColumn("rank", F.col("rank").cast("long"))


@query(f"""SELECT query_id, round(least(avg(coalesce(score, 0)), 1), 6) AS confidence, count(*) AS sources FROM ({TOP.format(k=5)}) GROUP BY query_id""")
def retrieval_confidence(spark, sf_dir):
    return _top(spark, sf_dir, 5).groupBy("query_id").agg(F.round(F.least(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(1.0)), 6).alias("confidence"), F.count(F.lit(1)).alias("sources"))


@query(f"""SELECT query_id, vec_id, score FROM ({TOP.format(k=5)}) WHERE score >= 0.5""")
def gated_matches(spark, sf_dir):
    return _top(spark, sf_dir, 5).where("score >= 0.5").select("query_id", "vec_id", "score")


METADATA = "to_json(named_struct('label', label, 'kind', CASE WHEN vec_id % 2 = 0 THEN 'function' ELSE 'contract' END))"


def _filtered(condition: str) -> str:
    return TOP.format(k=20).replace("CROSS JOIN embeddings v)", f"CROSS JOIN (SELECT * FROM embeddings WHERE {condition}) v)")


@query(f"SELECT 'and' AS how, * FROM ({_filtered('label = 3 AND vec_id % 2 = 0')}) UNION ALL SELECT 'or', * FROM ({_filtered('label = 3 OR vec_id % 2 = 0')})")
def filtered_topk(spark, sf_dir):
    """Search among vectors with the metadata asked for: all of it, or any."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("metadata", F.expr(METADATA))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    wanted = {"label": 3, "kind": "function"}
    found = [R.search(queries, vectors, 20, wanted, how).withColumn("how", F.lit(how)) for how in ("and", "or")]
    return found[0].unionByName(found[1]).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH m AS (SELECT t.query_id, t.score, 'threat' || e.label AS threat FROM ({TOP.format(k=10)}) t JOIN embeddings e USING (vec_id)) SELECT query_id, count(*) AS n, max(score) AS best,
  (SELECT string_agg(threat, ',' ORDER BY score DESC, threat) FROM (SELECT * FROM m i WHERE i.query_id = m.query_id ORDER BY score DESC, threat LIMIT 5)) AS threats FROM m GROUP BY query_id""")
def flow_threats(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("threat"), F.col("label").cast("string")).alias("threat"))
    return R.threat_summary(_top(spark, sf_dir, 10).join(labels, "vec_id"), "query_id").withColumn("threats", F.array_join("threats", ","))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 500 AS item FROM lineitem), n AS (SELECT o, count(*) AS n FROM p GROUP BY o),
  s AS (SELECT a.o AS flow, b.o AS path, count(*) AS n FROM p a JOIN p b USING (item) WHERE a.o % 100 = 0 GROUP BY ALL)
  SELECT flow, path, round(s.n / (x.n + y.n - s.n), 6) AS similarity FROM s JOIN n x ON x.o = flow JOIN n y ON y.o = path WHERE s.n / (x.n + y.n - s.n) >= 0.25""")
def path_similarity(spark, sf_dir):
    """Paths, here orders with their parts, at least a quarter similar to a flow's; flows are the orders of ids divisible by 100."""
    paths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 500).alias("items"))
    found = R.set_matches(paths.where("l_orderkey % 100 = 0"), paths, 0.25, "l_orderkey", "l_orderkey", "items", digits=6)
    return found.select(F.col("query_id").alias("flow"), F.col("row_id").alias("path"), "similarity")


def _indexed(spark, sf_dir, **search):
    """Each hundredth vector against an index of all of them."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = V.build(vectors)
    if not search:
        search = {"nprobe": V.probes_for(queries, index, 10)}
    return V.search(queries, index, 10, **search).withColumn("rank", F.col("rank").cast("long"))


@query()
def ivf_topk(spark, sf_dir):
    """The nearest lists alone, as many as a sample of the queries needs; the tests hold recall to 0.9 of the exact rows."""
    return _indexed(spark, sf_dir)


@query(TOP.format(k=10))
def ivf_exact_topk(spark, sf_dir):
    """Few lists at first, then those that the bounds leave."""
    return _indexed(spark, sf_dir, nprobe=4, exact=True)


@query(TOP.format(k=10).replace("CROSS JOIN embeddings v)", "CROSS JOIN (SELECT * FROM embeddings WHERE label = 3 OR label > 7) v)"))
def ivf_filtered_topk(spark, sf_dir):
    """Of some labels: the condition is applied by the scan of the lists."""
    return _indexed(spark, sf_dir, nprobe=4, exact=True, condition="label = 3 OR label > 7")
