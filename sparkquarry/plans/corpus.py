"""Chunking, text statistics, TF-IDF and clustering over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..shared import dealt, written
from ..ship import to_workers
from . import pipeline
from .base import query, table


@query("""SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs, round(avg(least(1000, n - k * 900)), 6) AS mean_size FROM (
  SELECT d.doc_id, d.lang, length(d.text) AS n, unnest(range(0, CASE WHEN length(d.text) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(d.text) - 100) / 900.0) AS BIGINT)) END)) AS k
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0) GROUP BY lang""")
def flagship(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    chunks = chunking.sliding(table(spark, sf_dir, "documents").join(good, "doc_id"))
    return chunks.groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.round(F.avg(F.col("chunk_end") - F.col("chunk_start")), 6).alias("mean_size"))


@query("""SELECT doc_id, k AS chunk_index, k * 900 AS chunk_start, md5(substring(text, k * 900 + 1, 1000)) AS digest FROM (
  SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(text) - 100) / 900.0) AS BIGINT)) END)) AS k FROM documents)""")
def chunk_fixed(spark, sf_dir):
    chunks = chunking.sliding(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_start").cast("long").alias("chunk_start"), F.md5("chunk").alias("digest"))


@query("""SELECT doc_id, h AS fingerprint FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS r FROM (
  SELECT doc_id, sha256(concat(text, '|source:', source)) AS h FROM documents)) WHERE r = 1""")
def fingerprint_dedup(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("text"), source=F.col("source")).alias("fingerprint"))
    return marked.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(lower(text), ' \t\n\r'), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 20""".replace("\\\\", "\\"))
def word_insights(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ','))) AS with_comma,
  round(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ','))) / len(string_split(text, chr(10))), 6) AS ratio FROM documents""")
def doc_metrics(spark, sf_dir):
    lines = F.split("text", "\n")
    some = F.size(F.filter(lines, lambda x: x.contains(",")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), some.cast("long").alias("with_comma"), F.round(some / F.size(lines), 6).alias("ratio"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)(the|und|les|los)[ ,.]')) + 1 AS branches FROM documents""".replace("\\\\", "\\"))
def complexity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit(r"(?i)(the|und|les|los)[ ,.]")) + 1).cast("long").alias("branches"))


@query("""SELECT bias, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  JOIN (VALUES ('anchoring', 'the '), ('anchoring', 'of '), ('authority', 'die '), ('framing', 'les? ')) p(bias, pattern) ON regexp_matches(line, '(?i)' || pattern) GROUP BY bias""".replace("\\\\", "\\"))
def bias_patterns(spark, sf_dir):
    patterns = [("anchoring", r"the "), ("anchoring", r"of "), ("authority", r"die "), ("framing", r"les? ")]
    hits = T.pattern_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), patterns, "text", "bias")
    return hits.groupBy("bias").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("""WITH w AS (SELECT doc_id, w AS word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2),
  n AS (SELECT count(*) AS n FROM documents), d AS (SELECT word, count(*) AS df FROM w GROUP BY word)
  SELECT word, round(sum(tf * (ln((1.0 + n) / (1.0 + df)) + 1.0)), 4) AS weight FROM w JOIN d USING (word) CROSS JOIN n WHERE df >= 2 AND df <= n * 0.8 GROUP BY word""".replace("\\\\", "\\"))
def tfidf_terms(spark, sf_dir):
    """Weight of each word: smoothed idf, ln((1 + n) / (1 + df)) + 1, times its occurrences, within the document frequency limits.

    As idf is the same in all documents, one aggregate by word is enough."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    by_word = words.groupBy("word").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).where("df >= 2 and df <= n * 0.8")  # one row
    return by_word.select("word", F.round(F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0), 4).alias("weight"))


@query()
def kmeans_clusters(spark, sf_dir):
    """Clusters of documents by TF-IDF: label and size, with their five top terms. The 20000 terms of most documents are features,
    a parameter of the feature and not a limit of the data."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover

    stages = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+"), StopWordsRemover(inputCol="w", outputCol="s"), CountVectorizer(inputCol="s", outputCol="tf", vocabSize=20000, minDF=2, maxDF=0.8)]
    stages += [IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"), KMeans(k=4, seed=42, maxIter=10)]
    # a file of few row groups would leave all rounds to few tasks, which hold and read its features each time
    docs = written(dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").sortWithinPartitions("doc_id"))
    model = Pipeline(stages=stages).fit(docs)
    words, centers = model.stages[2].vocabulary, model.stages[-1].clusterCenters()
    terms = [(i, [words[j] for j in c.argsort()[::-1][:5]]) for i, c in enumerate(centers)]
    sizes = model.transform(docs).groupBy(F.col("prediction").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(F.broadcast(spark.createDataFrame(terms, "label int, terms array<string>")), "label")


@query("SELECT doc_id, length(text) AS chars, upper(substring(text, 1, 1)) AS initial FROM documents")
def model_processor(spark, sf_dir):
    """A pluggable batch processor in place of a model: an Arrow function over batches of rows, which writes back by position."""
    import pyarrow as pa

    to_workers(spark)

    def process(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            chars, initials = [None if t is None else len(t) for t in texts], [None if t is None else T.upper_letter(t[:1]) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars, pa.int64()), pa.array(initials, pa.string())], names=["doc_id", "chars", "initial"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(process, "doc_id long, chars long, initial string")


@query("""SELECT branch, count(*) AS n FROM (SELECT 'long' AS branch FROM documents WHERE length(text) > 2000 UNION ALL SELECT 'short' FROM documents WHERE length(text) <= 2000 UNION ALL SELECT 'english' FROM documents WHERE lang = 'en') GROUP BY branch""")
def pipeline_branch(spark, sf_dir):
    named = lambda name, test: pipeline.compose(lambda d: d.where(test), lambda d: d.select(F.lit(name).alias("branch")))
    parts = {"long": "length(text) > 2000", "short": "length(text) <= 2000", "english": "lang = 'en'"}
    run = pipeline.Pipeline().add("branches", pipeline.branch({k: named(k, v) for k, v in parts.items()}))
    return run.run(table(spark, sf_dir, "documents")).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query()
def line_chunks(spark, sf_dir):
    chunks = chunking.packed_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000, 2)
    return chunks.select("doc_id", "chunk_index", F.length("chunk").alias("size"))


@query("SELECT doc_id, md5(replace(replace(text, ',', ''), '.', '')) AS digest FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.delete_characters(F.col("text"), ",.")).alias("digest"))


@query("SELECT doc_id, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens, length(text) / 4.0 >= 1000 AS over FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"), (F.length("text") / 4 >= 1000).alias("over"))
