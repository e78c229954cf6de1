"""Queries over free texts: markdown, JSON, reports, checks, templates, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import reports as R
from ..functions import scalars as S
from ..functions import text as T
from .base import grown, grown_sql, literal, query, relation, table

#: What refers to elsewhere, for an engine without look-behind: what stands before a mention stays.
REFERENCES = r"<!--(?s:.*?)-->|\[!\[[^\]\n]*\]\([^)\n]*\)\](?:\([^)\n]*\))?|!\[[^\]\n]*\]\([^)\n]*\)|\[([^\]\[\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])|<[^<>\n]+>|https?://\S+|(^|\W)@[A-Za-z0-9-]+|(^|\W)#\d+\b|\bGH-\d+\b"
LINKED = "concat('See [', source, '](http://x.org/', cast(doc_id AS string), ') and ![pic](p.png), <https://a.b/c> (@someone) #', cast(doc_id AS string), ' <!-- no --> ', coalesce(text, ''))"


@query(f"SELECT doc_id AS id, trim(regexp_replace(regexp_replace({LINKED}, {literal(REFERENCES)}, '\\1\\2\\3', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents")
def markdown_strip(spark, sf_dir):
    """Every document behind a line of references."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.strip_markdown(F.expr(LINKED)).alias("plain"))


#: Markdown of a part, by pieces, and what stays of each.
PIECES = (
    ("concat('# ', p_name, ' #', chr(10), chr(10))", "p_name || chr(10) || chr(10)"),
    ("concat('Some **', p_brand, '** and *', p_type, '*, `*', p_brand, '*`.', chr(10))", "'Some ' || p_brand || ' and ' || p_type || ', *' || p_brand || '*.' || chr(10)"),
    ("concat('> quoted ', p_name, chr(10))", "chr(10)"),
    ("concat('- [', p_brand, '](http://x/', cast(p_partkey AS string), ') ![a_b](p.png)', chr(10))", "p_brand || ' a_b' || chr(10)"),
    ("concat('```py', chr(10), 'x = ', cast(p_size AS string), chr(10), '```', chr(10))", "chr(10)"),
    ("concat('2. snake_case_', cast(p_size AS string), ' __end__ a * b')", "'snake_case_' || p_size || ' end a * b'"),
)


@query("SELECT p_partkey AS id, regexp_replace(" + " || ".join(f"({plain})" for _, plain in PIECES) + r", '\n\s*\n\s*', chr(10) || chr(10), 'g') AS plain FROM part")
def markdown_plain(spark, sf_dir):
    markdown = F.concat(*(F.expr(p) for p, _ in PIECES))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.plain_markdown(markdown).alias("plain"))


#: What is meant as JSON of a customer's key and name, broken in as many ways; the ninth has none.
BROKEN = (
    '{{"a": {k}, "b": "{n}"}}', 'Result: {{"a": {k}, "b": "{n}"}} done }}', '```json\n{{"a": {k}, "b": "{n}"}}\n```', '{{"a": {k},, "b": "{n}",}}', "{{'a': {k}, 'b': '{n}'}}",
    'so {{a: {k}, b: "{n}", c: [1, 2,], d: None}}', '{{"a": {k} "b": "{n}" "c": true', '"{{\\"a\\": {k}, \\"b\\": \\"{n}\\"}}"', "no json of {k}", '{{"a": {k}, "b": "{n}',
)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 8 THEN c_custkey::VARCHAR END AS a, CASE WHEN c_custkey % 10 <> 8 THEN c_name END AS b FROM customer")
def json_repair(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "cast(c_custkey AS string) AS k", "c_name AS n")
    made = [F.replace(F.replace(F.lit(b.format(k="\1", n="\2")), F.lit("\1"), F.col("k")), F.lit("\2"), F.col("n")) for b in BROKEN]
    texts = customers.select("id", F.element_at(F.array(*made), (F.col("id") % 10 + 1).cast("int")).alias("text"))
    return texts.select("id", J.extracted(F.col("text")).alias("json")).select("id", F.get_json_object("json", "$.a").alias("a"), F.get_json_object("json", "$.b").alias("b"))


FILES = (
    (1, "src/A.sol", "pragma solidity; contract A { mapping(x => y) m; }"), (2, "b/x.py", "def f(self): import os"), (3, "README", "plain"), (4, "m.go", "package main func x() { a := 1 }"),
    (5, "q/App.TS", "const f = () => {}; function g() { require('x') }"), (6, "n.md", "# Head\n\ntext"), (7, "z.rs", "pub fn a() { let mut x = 1; }"), (8, "u.xyz", ""),
)
SCORES = ", ".join(f"{{'score': {' + '.join(f'contains(code, {literal(w)})::INT' for w in words)}, 'place': {-i}, 'lang': '{lang}'}}" for i, (lang, words) in enumerate(T.KEYWORDS.items()))
KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.EXTENSIONS.items()) + "}"
DOCUMENTED = r"CASE WHEN regexp_matches(code, 'pragma solidity|\bcontract\s+\w+') THEN 'solidity' WHEN regexp_matches(code, '(?m)^\s*(def|class)\s+\w+.*:') THEN 'python' WHEN regexp_matches(code, '\bfunction\b|=>|\bconst\b') THEN 'javascript' WHEN regexp_matches(code, '(?m)^#{1,6} ') THEN 'markdown' ELSE 'unknown' END"


@query(rf"SELECT id, coalesce({KNOWN}[lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))], 'unknown') AS by_path, CASE WHEN best.score > 0 THEN best.lang ELSE 'unknown' END AS guessed, {DOCUMENTED} AS documented FROM (SELECT *, list_max([{SCORES}]) AS best FROM {grown_sql(FILES, 'id, path, code', 'code')})")
def language_guess(spark, sf_dir):
    code = F.col("code")
    return grown(spark, sf_dir, FILES, "id int, path string, code string", "code").select("id", T.language_of_path(F.col("path")).alias("by_path"), T.guess_language(code).alias("guessed"), S.documentation_language(code).alias("documented"))


#: Reports of orders: with parts by heading or in bold, or without any; the words are the order's.
REPORTS = """CASE o_orderkey % 4 WHEN 0 THEN concat('# Report', chr(10), chr(10), 'Opening of ', k, '.', chr(10), chr(10), '## Executive Summary ##', chr(10), w, chr(10), chr(10), '## Findings', chr(10), '- Risk level: ', lower(level), chr(10), chr(10),
   '### Conclusion', chr(10), 'Done with ', k, '.')
 WHEN 1 THEN concat('**Summary:** ', w, chr(10), '**Security rating**: ', level, chr(10), chr(10), '**Conclusion**', chr(10), 'Done with ', k, '.')
 WHEN 2 THEN concat('# Head', chr(10), chr(10), w, chr(10), chr(10), '- a list', chr(10), chr(10), 'There is ', lower(level), ' risk.', chr(10), chr(10), 'Done with ', k, '.')
 ELSE '# Only a head' END"""
ORDER_WORDS = """SELECT o_orderkey, cast(o_orderkey AS string) AS k, concat(o_orderstatus, ' saw ', o_orderpriority, repeat(' and more', cast(o_orderkey % 100 AS int))) AS w,
 CASE o_orderkey % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' ELSE 'Informational' END AS level FROM {orders}"""


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'none' WHEN len(w) > 500 THEN w[1:497] || '...' ELSE w END AS summary,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Medium' ELSE level END AS rating, CASE WHEN o_orderkey % 4 = 3 THEN 'none' ELSE 'Done with ' || k || '.' END AS conclusion FROM ({ORDER_WORDS.replace('{orders}', 'orders')})""")
def report_sections(spark, sf_dir):
    reports = spark.sql(ORDER_WORDS, orders=table(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("id"), F.expr(REPORTS).alias("text"))
    t = F.col("text")
    return reports.select("id", R.summary(t, 500, "none").alias("summary"), R.risk_rating(t, "Medium").alias("rating"), R.conclusion(t, "none").alias("conclusion"))


#: A finding a line item, in one of the forms that reports have them; a validation says of every third that it is false.
FORMS = """CASE l_linenumber % 4 WHEN 0 THEN concat('## ', title, ' (Severity: ', level, ')', chr(10), 'What it ships ', l_returnflag, chr(10), '- Location: P.', cast(l_suppkey AS string), chr(10))
 WHEN 1 THEN concat(cast(l_linenumber AS string), '. **', title, '** - ', upper(level), chr(10), '   Description: What it ships ', l_returnflag, chr(10), '   Location: P.', cast(l_suppkey AS string), chr(10), '   Fix: ', l_linestatus, chr(10))
 WHEN 2 THEN concat('### ', cast(l_linenumber AS string), '. ', title, chr(10), '**Severity**: ', lower(level), chr(10), '**Function:** `P.', cast(l_suppkey AS string), '`', chr(10), 'What it', chr(10), 'ships ', l_returnflag, chr(10))
 ELSE concat('- **', title, '** [', level, ']', chr(10), 'What it ships ', l_returnflag, chr(10), '* Recommendation: ', l_linestatus, chr(10), '#### A heading that is none', chr(10), 'of its text', chr(10)) END"""
SAID = """concat(CASE l_linenumber % 2 WHEN 0 THEN '1. ' ELSE '- **' END, title, CASE l_linenumber % 2 WHEN 0 THEN ' - Status: ' ELSE '**: assessment ' END,
 CASE l_partkey % 3 WHEN 0 THEN 'false positive' WHEN 1 THEN 'Confirmed' ELSE 'unclear' END)"""
LINES_OF = """SELECT *, concat('Finding of part ', cast(l_partkey AS string), ' on line ', cast(l_linenumber AS string)) AS title,
 CASE l_suppkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS level FROM {lineitem}"""


@query(f"""WITH f AS ({LINES_OF.replace('{lineitem}', 'lineitem')})
SELECT l_orderkey AS id, title, CASE WHEN l_partkey % 3 = 0 THEN 'Informational' ELSE level END AS severity, 'What it ships ' || l_returnflag AS description, CASE WHEN l_linenumber % 4 < 3 THEN 'P.' || l_suppkey END AS location,
  CASE WHEN l_linenumber % 4 IN (1, 3) THEN l_linestatus END AS recommendation, CASE l_partkey % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'open' END AS status FROM f""")
def report_findings(spark, sf_dir):
    """Findings of all forms, a report an order, held against its validation."""
    lines = spark.sql(LINES_OF, lineitem=table(spark, sf_dir, "lineitem"))
    parts = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr(FORMS).alias("text"), F.expr(SAID).alias("said")))).alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "\n")
    rows = parts.select("id", F.concat(F.lit("Intro\n"), joined("text")).alias("text"), joined("said").alias("validation"))
    return R.findings(rows.select("id", "text"), rows.select("id", "validation")).drop("ordinal")


RESPONSES = (
    (1, 'Sure: ["check one", "check two"] done', "oracle price"), (2, "- first\n* second \n 3) third\nother", "token transfer"), (3, "none", ""), (4, '[{"sub_question": "q1", "tool_name": "t"}, {"sub_question": "q2"}]', "price"),
    (5, "a -> b -> c\nplain\nx → y", "call"), (6, "```py\nx = 1\n```\nand\n~~~\nraw\n~~~", "oracle"),
)
RULES = {"oracle|price": "Check the price source", "transfer|approve": "Check the token's return value", "call": "Check the call's result"}


@query(r"""SELECT id, array_to_string(CASE WHEN listed <> '' THEN listed::JSON::VARCHAR[] ELSE list_transform(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]+([^\n]+)', 1), lambda b: trim(b)) END, '|') AS checks,
  array_to_string(list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(topic, '{k}') THEN {literal(v)} END" for k, v in RULES.items()) + r"""], lambda x: x IS NOT NULL), '|') AS by_topic FROM (SELECT *, regexp_extract(text, '(?s)\[\s*".*"\s*\]') AS listed FROM """ + grown_sql(RESPONSES, "id, text, topic", "text topic") + ")")
def response_checks(spark, sf_dir):
    rows = grown(spark, sf_dir, RESPONSES, "id int, text string, topic string", "text topic")
    return rows.select("id", F.array_join(R.checks(F.col("text")), "|").alias("checks"), F.array_join(R.keyword_checks(F.col("topic"), RULES), "|").alias("by_topic"))


@query(r"""SELECT id, q ->> 'sub_question' AS sub_question, q ->> 'tool_name' AS tool_name FROM (SELECT id, unnest(regexp_extract(text, '(?s)\[\s*\{.*\}\s*\]')::JSON::JSON[]) AS q FROM """ + grown_sql(RESPONSES, "id, text, topic", "text topic") + r" WHERE regexp_matches(text, '(?s)\[\s*\{.*\}\s*\]'))")
def sub_questions(spark, sf_dir):
    return grown(spark, sf_dir, RESPONSES, "id int, text string, topic string", "text topic").select("id", F.explode(R.sub_questions(F.col("text"))).alias("q")).select("id", "q.*")


@query(r"""SELECT id, 'path' AS kind, array_to_string(list_transform(string_split_regex(line, '->|→'), lambda x: trim(x)), '/') AS value FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM """ + grown_sql(RESPONSES, "id, text, topic", "text topic") + r""") WHERE regexp_matches(line, '->|→')
UNION ALL SELECT id, coalesce(nullif(regexp_extract(b, '^(?:```|~~~)(\w*)', 1), ''), 'text'), regexp_extract(b, '(?s)^[^\n]*\n(.*?)(?:```|~~~)$', 1) FROM (SELECT id, unnest(regexp_extract_all(text, '(?s)```\w*\n.*?```|~~~\w*\n.*?~~~')) AS b FROM """ + grown_sql(RESPONSES, "id, text, topic", "text topic") + ")")
def response_parts(spark, sf_dir):
    """Arrow paths of lines, and fenced blocks by language."""
    rows = grown(spark, sf_dir, RESPONSES, "id int, text string, topic string", "text topic")
    paths = rows.select("id", F.lit("path").alias("kind"), F.explode(T.arrow_paths(F.col("text"))).alias("p")).select("id", "kind", F.array_join("p", "/").alias("value"))
    return paths.unionByName(rows.select("id", F.explode(T.fenced_blocks(F.col("text"))).alias("b")).select("id", F.col("b.language").alias("kind"), F.col("b.code").alias("value")))


RESULTS = ((-1, "A critical Reentrancy bug"), (-2, "minor issue in the info text"), (-3, "an unsafe cast"), (-4, "all is well"), (-5, "Low and HIGH exploit"))


@query(r"""SELECT id, CASE WHEN regexp_matches(t, 'critical|severe|high') THEN 'High' WHEN regexp_matches(t, 'low|minor|info') THEN 'Low' ELSE 'Medium' END AS severity FROM (SELECT id, lower(text) AS t FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM """ + relation(RESULTS, "id, text") + r""")) WHERE regexp_matches(t, 'vulnerability|exploit|attack|bug|issue|reentrancy|overflow|underflow|unsafe')""")
def gated_findings(spark, sf_dir):
    results = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame(list(RESULTS), "id long, text string"))
    return R.gated_findings(results).select("id", "severity")


OUTPUTS = ((1, '======= a.sol =======\n{"x": 1}\n\n======= b/c.sol =======\n[1, 2]\n'), (2, "no sections"), (3, "=== bad ===\nnot json\n=== ok ===\n{}"))


@query(r"""SELECT id, file, json FROM (SELECT id, unnest(files) AS file, regexp_replace(unnest(bodies[2:]), '^\s+|\s+$', '', 'g') AS json FROM (SELECT id, regexp_extract_all(text, '={3,}[ \t]*([^=\n]+?)[ \t]*={3,}', 1) AS files, string_split_regex(text, '={3,}[ \t]*[^=\n]+?[ \t]*={3,}') AS bodies FROM """ + grown_sql(OUTPUTS, "id, text", "text", 'x') + ")) WHERE json_valid(json)")
def compiler_sections(spark, sf_dir):
    return grown(spark, sf_dir, OUTPUTS, "id int, text string", "text", 'x').select("id", F.explode(R.compiler_sections(F.col("text"))).alias("s")).select("id", "s.*")


TEMPLATE = "Part {{name}} ({{brand}}):{{#if big}} big{{/if}}{{#if big}}{{#if cheap}} and cheap{{/if}}{{/if}}{{#each tags}} [{{this.k}}={{v}} of {{name}}]{{/each}} {{unknown}}"


@query("""SELECT p_partkey, 'Part ' || p_name || ' (' || p_brand || '):' || CASE WHEN p_size > 25 THEN ' big' || CASE WHEN p_retailprice < 950 THEN ' and cheap' ELSE '' END ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' [size=' || p_size || ' of ' || p_name || '] [type=' || p_type || ' of ' || p_name || ']' END || ' {{unknown}}' AS text FROM part""")
def template_rendering(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    tag = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v"))
    tags = F.when(F.col("p_size") % 3 != 0, F.array(tag("size", "p_size"), tag("type", "p_type"))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    known = {"name": F.col("p_name"), "brand": F.col("p_brand"), "big": F.col("p_size") > 25, "cheap": F.col("p_retailprice") < 950}
    return parts.select("p_partkey", R.rendered(TEMPLATE, known, {"tags": (tags, ("k", "v"))}).alias("text"))


RECORDS = ((1, '{"title": "x", "n": 1, "tags": []}'), (2, '{"title": 3}'), (3, "not"), (4, '{"title": "y", "n": null, "tags": {}}'), (5, '{"title": "", "n": 2, "tags": ["a"], "more": 1}'))
NEEDS = {"title": "STRING", "n": "BIGINT", "tags": "ARRAY"}
KINDS = {"STRING": "VARCHAR", "BIGINT": "UBIGINT", "ARRAY": "ARRAY"}


@query("SELECT id, CASE WHEN NOT json_valid(text) THEN 'not JSON' ELSE array_to_string(list_filter([" + ", ".join(f"CASE WHEN coalesce(json_type(text, '$.{n}'), 'NULL') = 'NULL' THEN '{n}: missing' WHEN json_type(text, '$.{n}') <> '{KINDS[k]}' THEN '{n}: not {k}' END" for n, k in NEEDS.items()) + "], lambda x: x IS NOT NULL), '|') END AS faults, '{\"title\":\"\",\"n\":0,\"tags\":[]}' AS empty FROM " + grown_sql(RECORDS, "id, text", "text", 'x'))
def schema_faults(spark, sf_dir):
    return grown(spark, sf_dir, RECORDS, "id int, text string", "text", 'x').select("id", F.array_join(R.schema_faults(F.col("text"), NEEDS), "|").alias("faults"), R.empty_of(NEEDS).alias("empty"))


NAMES = (
    (1, "a/b/re port_20240131_235959.md", "v1", "2024-01-01T00:00:00", "2024-01-01T00:01:30.5", 9.5, "if (x > 1) { y(); }", "High Risk", "risk", False),
    (2, "x.sol", "", "bad", "2024-01-01T00:00:00", 4.0, "return;", "same", "same", True), (3, "dir/20241301_000000", "é", "2024-01-01 10:00:00", "2024-01-01 09:00:00", 7.0, "while (1) if(a && b) c();", "Same", "same", True),
)


@query(r"""SELECT id, regexp_replace(concat_ws('_', string_split(path, '/')[-1], suffix), '[^A-Za-z0-9_\-.]', '_', 'g') AS document_id, strftime(try_strptime(regexp_extract(path, '(\d{8}_\d{6})', 1), '%Y%m%d_%H%M%S'), '%Y-%m-%d %H:%M:%S') AS report_date, epoch_us(try_cast(completed AS TIMESTAMP) - try_cast(started AS TIMESTAMP)) / 1e6 AS seconds,
  CASE WHEN score >= 9 THEN 'excellent' WHEN score >= 7 THEN 'good' WHEN score >= 4 THEN 'fair' ELSE 'poor' END AS level, nullif(regexp_extract(code, '\bif\s*\(([^)]*)\)', 1), '') AS condition, CASE WHEN exact THEN result = expected ELSE contains(lower(result), lower(expected)) END AS as_expected,
  md5(concat_ws('/', path, result)) AS key, nullif(suffix, '') AS suffix FROM """ + grown_sql(NAMES, "id, path, suffix, started, completed, score, code, result, expected, exact", "path code result", 'x'))
def record_functions(spark, sf_dir):
    rows = grown(spark, sf_dir, NAMES, "id int, path string, suffix string, started string, completed string, score double, code string, result string, expected string, exact boolean", "path code result", 'x')
    c = F.col
    return rows.select(
        "id", S.document_id(c("path"), c("suffix")).alias("document_id"), F.date_format(S.report_date(c("path")), "yyyy-MM-dd HH:mm:ss").alias("report_date"), S.duration(c("started"), c("completed")).alias("seconds"), S.quality_level(c("score")).alias("level"),
        S.first_condition(c("code")).alias("condition"), S.result_matches(c("result"), c("expected"), c("exact")).alias("as_expected"), S.prompt_key(c("path"), c("result")).alias("key"), S.or_null(c("suffix")).alias("suffix"),
    )


COMBINED = """SELECT c.c_nationkey AS k, c.c_custkey AS o, 'Finding ' || (c.c_custkey % 4) AS title, CASE WHEN c.c_custkey % 4 < 2 THEN 'High' ELSE 'Low' END AS severity, 'Rec ' || c.c_custkey AS rec, 'Summary ' || c.c_custkey AS summary FROM customer c"""


@query(f"""WITH r AS ({COMBINED}) SELECT k, (SELECT string_agg(title || ':' || severity, '|' ORDER BY title, severity) FROM (SELECT DISTINCT title, severity FROM r e WHERE e.k = r.k)) AS findings, string_agg(rec, '|' ORDER BY o) AS recommendations, string_agg(summary, chr(10) ORDER BY o) AS summary FROM r GROUP BY k""")
def combined_results(spark, sf_dir):
    """Results of chunks, a customer each, combined by nation."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("o"), F.array(F.struct(F.concat(F.lit("Finding "), F.col("c_custkey") % 4).alias("title"), F.when(F.col("c_custkey") % 4 < 2, "High").otherwise("Low").alias("severity"))).alias("findings"),
        F.array(F.concat(F.lit("Rec "), "c_custkey")).alias("recommendations"), F.concat(F.lit("Summary "), "c_custkey").alias("summary"),
    )
    out = R.combined(rows, "k", "o")
    return out.select("k", F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["title"], f["severity"])), "|").alias("findings"), F.array_join("recommendations", "|").alias("recommendations"), "summary")
