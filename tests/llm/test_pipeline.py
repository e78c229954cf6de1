"""The whole pipeline against a brute-force version of its stages, on the smallest tables."""

import re

import duckdb

import corpus_pipeline
from sparkquarry.llm.queries import tokenizer_file

from .test_llm import components, sha, shingles

FOLDER = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    from tokenizers import Tokenizer

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    items = [shingles(t) for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    left = [(i, t) for i, t in docs if re.search(r"[^\W\d_]", t or "")]  # these texts are all in a learned language
    first = {}
    for i, t in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    left = [(i, t) for i, t in left if i in set(first.values())]
    roots = components({i: shingles(t) for i, t in left})
    left = [(i, t) for i, t in left if roots[i] == i]
    left = [(i, t) for i, t in left if not any(100 * len(s & shingles(t)) >= 75 * len(s) for s in items if s)]
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = set()
    for i, t in left:
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()} == want
    assert len(want) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs2 = stage(spark, docs.limit(0), FOLDER)
        assert docs2.columns == docs.columns and docs2.count() == 0


def test_stages_on_odd_rows(spark):
    """Columns named like the operators' own, null and repeated ids, empty and null texts."""
    extra = ["rejected", "__kept_id", "__gone", "__held", "gone", "GONE_", "id", "kept", "keep", "n", "full", "row", "item", "lang_pred", "score"]
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, "same words here", "en"), (None, "same words here", "en"), (1, None, None), (1, "", None), (900, "same words here", "en"), (901, "zwei", "de"), (901, "zwei", "de")], "doc_id long, text string, lang string")
    docs = plain.select("doc_id", "text", "lang").unionByName(odd).selectExpr("*", *(f"cast(doc_id as string) as `{c}`" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert ids.count(901) == 2 and 0 < len(ids) <= docs.count(), name
        assert (ids.count(None), ids.count(900)) == {"language_id": (2, 1), "exact_dedup": (0, 1), "near_dedup": (2, 1), "decontamination": (2, 1)}[name]
    name, encode = corpus_pipeline.STAGES[-1]
    assert encode(spark, docs, FOLDER).count() == docs.count()
