"""Queries of what functions are for, and of measures of code and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import roles as R
from .base import literal, query, table

NAMES = "onlyOne adminOf getPrice isOpen setFee withdrawAll depositNow receiveIt sendOut transferTo mintIt burnAll approveIt allowAll claimNow stakeIt swapAll exchangeIt initialize other ownerOf getAuth hasView".split()
PICK = f"element_at(array({', '.join(map(literal, NAMES))}), cast(p_partkey % {len(NAMES)} AS int) + 1)"
DUCK_PICK = f"[{', '.join(map(literal, NAMES))}][(p_partkey % {len(NAMES)})::INT + 1]"
#: A file a part: a constructor, a modifier, and two functions whose names and bodies follow from it.
CONTENT = """concat('contract K {', chr(10), ' /* if (a) && */', chr(10), ' constructor() { s = 1; }', chr(10), ' modifier locked(uint x) { require(x > 0); _; }', chr(10), chr(10), ' function ', n, '(uint a) external ', CASE p_partkey % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'payable' ELSE '' END, ' { // for',
 repeat(concat(chr(10), '  if (a > 1 && a < 9) { a = a ? 1 : 2; }'), p_size % 4), chr(10), '  emit("if (x)");', chr(10), ' }', chr(10), ' function second() internal { to.call(""); }', chr(10), '}')"""


def files(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("n", F.expr(PICK))
    return parts.select(F.col("p_partkey").alias("file_id"), F.expr(CONTENT).alias("content"))


TYPE = "CASE " + " ".join(f"WHEN {w} THEN '{t}'" for t, w in [("access_control", f"regexp_matches(lower(n), '{R.ACCESS}')"), ("view", "p_partkey % 4 = 0"), ("payable", "p_partkey % 4 = 1"), *((k, f"regexp_matches(lower(n), '{p}')") for k, p in R.NAMED)]) + " ELSE 'unknown' END"


@query(f"""WITH p AS (SELECT p_partkey AS file_id, {DUCK_PICK} AS n, * FROM part)
SELECT file_id, n AS name, {TYPE} AS type, array_to_string(list_filter([CASE WHEN contains(lower(n), 'transfer') OR contains(n, 'approve') THEN 'token_transfer' END, CASE WHEN contains(n, 'auth') THEN 'access_control' END, 'external_call',
   CASE WHEN contains(n, 'deposit') OR contains(n, 'withdraw') THEN 'fund_management' END], lambda x: x IS NOT NULL), ',') AS traits FROM p
UNION ALL SELECT file_id, 'second', 'unknown', 'external_call' FROM p UNION ALL SELECT file_id, 'constructor', 'constructor', '' FROM p UNION ALL SELECT file_id, 'locked', 'modifier', 'access_control' FROM p""")
def function_types(spark, sf_dir):
    return R.classified(files(spark, sf_dir)).select("file_id", "name", "type", F.array_join("traits", ",").alias("traits"))


@query(f"""SELECT p_partkey AS file_id, {DUCK_PICK} AS name, (1 + 3 * (p_size % 4))::INT AS complexity FROM part UNION ALL SELECT p_partkey, 'second', 1 FROM part""")
def function_complexity(spark, sf_dir):
    return R.branches(files(spark, sf_dir)).select("file_id", "name", "complexity")


@query("""SELECT p_partkey AS file_id, 10 + p_size % 4 AS total, 8 + p_size % 4 AS code, 1 AS comment, 1 AS blank, round((8 + p_size % 4) / (10 + p_size % 4), 6) AS code_ratio, round(1 / (10 + p_size % 4), 6) AS comment_ratio FROM part""")
def code_line_counts(spark, sf_dir):
    counts = files(spark, sf_dir).select("file_id", R.line_counts(F.col("content")).alias("c")).select("file_id", "c.*")
    return counts.withColumns({c: F.round(c, 6) for c in ("code_ratio", "comment_ratio")})


@query("""WITH w AS (SELECT source, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c), s AS (SELECT source, sum(n) AS words, count(*) AS distinct_words, string_agg(word || ':' || n, ',' ORDER BY rank) FILTER (rank <= 5) AS top FROM r GROUP BY source)
SELECT source, texts, words::BIGINT AS words, distinct_words, round(distinct_words / words, 6) AS diversity, round(words / texts, 6) AS mean_words, top FROM (SELECT source, count(*) AS texts FROM documents GROUP BY source) JOIN s USING (source)""")
def text_insights(spark, sf_dir):
    found = R.insights(table(spark, sf_dir, "documents"), ["source"])
    return found.withColumns({"diversity": F.round("diversity", 6), "mean_words": F.round("mean_words", 6), "top": F.array_join("top", ",")})
