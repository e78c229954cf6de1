"""Each registered query with SQL gives the rows that the SQL gives; the smallest tables."""

import duckdb
import pytest

from sparkquarry.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(row):
    return tuple(round(v, 4) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    found = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted((rounded(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert sorted((rounded(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_all_others_are_tested_here():
    # the last two in test_vectorindex.py and test_tasks.py
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"kmeans_clusters", "line_chunks", "ivf_topk", "task_lifecycles"}


def test_line_chunks(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    want = set()
    for i, text in texts:
        held, fresh, sizes = [], 0, []
        for line in text.split("\n"):
            if fresh and len("\n".join([*held, line])) > 1000:
                sizes.append(len("\n".join(held)))
                held, fresh = held[-2:], 0
            held.append(line)
            fresh += 1
        sizes.append(len("\n".join(held)))
        want |= {(i, n, size) for n, size in enumerate(sizes)}
    assert {tuple(r) for r in registry.QUERIES["line_chunks"](spark, FOLDER).select("doc_id", "chunk_index", "size").collect()} == want


def test_kmeans_clusters(spark):
    rows = registry.QUERIES["kmeans_clusters"](spark, FOLDER).collect()
    texts = " ".join(t.lower() for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall())
    assert sum(r["n"] for r in rows) == 200 and 1 < len(rows) <= 4 and len({r["label"] for r in rows}) == len(rows)
    assert all(len(set(r["terms"])) == 5 and all(t in texts for t in r["terms"]) for r in rows)


def test_made_files_are_dealt_to_tasks(spark, tmp_path):
    from sparkquarry.plans import base, code

    spark.range(200).selectExpr("id AS p_partkey", "'part' AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id % 50 AS int) AS p_size", "1.0D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = [code.files(spark, str(tmp_path)), base.grown(spark, str(tmp_path), [(1, "a"), (2, "b")], "id int, text string", "text")]
    for df in made:  # one small file of parts is no single task of texts
        assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
