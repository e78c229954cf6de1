"""A store of embedded texts as tables: embedding, indexing without repeats, search by text with context, confidence of answers."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..ship import to_workers
from .chunking import sentence_chunks
from .retrieval import cosine_top_k


def hashed_words(docs: DataFrame, text_col: str = "text", dims: int = 64, name: str = "embedding") -> DataFrame:
    """docs with an embedding of length one: words by the hash of their md5, counted. It stands in for a model's mean-pooled
    vectors, which any function of pandas series to arrays can take the place of in embedded()."""
    return docs.withColumn(name, _counted(F.lower(text_col), dims))


def _counted(texts: Column, dims: int) -> Column:
    @F.arrow_udf("array<double>")
    def counted(texts: pa.Array) -> pa.Array:
        words, places, out = re.compile("[a-z0-9_]+"), {}, np.zeros((len(texts), dims))  # a word's hash is worked out once a batch
        for row, text in zip(out, texts):
            n = Counter(words.findall(text.as_py() or ""))
            for w in n:
                if w not in places:
                    places[w] = int.from_bytes(hashlib.md5(w.encode(), usedforsecurity=False).digest()[:4], "big") % dims
            if n:
                row += np.bincount([places[w] for w in n], list(n.values()), dims)
                row /= np.linalg.norm(row)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * np.int32(dims)), pa.array(out.ravel()))

    return counted(texts)


def embedded(docs: DataFrame, embed=None, text_col: str = "text", dims: int = 64) -> DataFrame:
    to_workers(docs.sparkSession)
    return hashed_words(docs, text_col, dims) if embed is None else docs.withColumn("embedding", embed(F.col(text_col)))


def index_rows(docs: DataFrame, existing: DataFrame | None = None, embed=None, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, overlap: int = 200) -> DataFrame:
    """(id, chunk_index, chunk, digest, embedding): pieces of sentences whose fingerprint the store doesn't have, once each, embedded."""
    pieces = sentence_chunks(docs.select(id_col, text_col), size, overlap, text_col).withColumn("digest", fingerprint(F.col("chunk")))
    if existing is not None:
        pieces = pieces.join(existing.select("digest").distinct(), "digest", "left_anti")
    first = pieces.groupBy("digest").agg(F.min(F.struct(id_col, "chunk_index", "chunk")).alias("p")).select(f"p.{id_col}", "p.chunk_index", "p.chunk", "digest")
    return embedded(first, embed, "chunk")


def search_texts(questions: DataFrame, store: DataFrame, k: int, embed=None, patterns: list[str] | None = None, path_col: str | None = None, id_col: str = "id") -> DataFrame:
    """(query_id, vec_id, score, rank) of questions (query_id, text) among the store's rows (id, embedding), of paths that match one of the patterns where they are given."""
    if patterns is not None and path_col:
        store = store.where(F.greatest(F.lit(False), F.lit(False), *(F.col(path_col).rlike(p) for p in patterns)))
    asked = embedded(questions, embed).select("query_id", F.col("embedding").alias("query"))
    return cosine_top_k(asked, store, k, vec_id=id_col)


def context_of(ranked: DataFrame, store: DataFrame, text_col: str = "text", id_col: str = "id", k: int = 3, size: int = 200) -> DataFrame:
    """(query_id, context): the first characters of the k best texts, the best first."""
    texts = ranked.where(F.col("rank") <= k).join(store.select(F.col(id_col).alias("vec_id"), F.substring(F.col(text_col), 1, size).alias("t")), "vec_id")
    return texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("c")).select("query_id", F.array_join("c.t", "\n").alias("context"))


def answered(questions: DataFrame, ranked: DataFrame, least: float = 0.5) -> DataFrame:
    """(question, parts, answered, confidence) of questions (question, query_id, a row a sub-question): a sub-question is answered if its best match scores enough."""
    best = ranked.where("rank = 1").select("query_id", "score")
    met = questions.join(best, "query_id", "left").withColumn("met", (F.coalesce("score", F.lit(0.0)) >= least).cast("int"))
    return met.groupBy("question").agg(F.count(F.lit(1)).alias("parts"), F.sum("met").alias("answered"), F.least(F.avg("met"), F.lit(1.0)).alias("confidence"))
