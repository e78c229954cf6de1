"""Queries of rules over code and facts, and of a store of embedded texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import rules as U
from ..operators import knowledge as K
from ..operators import taint
from .base import grown, grown_sql, literal, query, relation, table
from .code import FILES, FUNCTIONS, LINES, VISIBILITY, files

CHANGES, CALLS = r"(?m)^\s*[A-Za-z_]\w*(\[[^\]]*\])*\s*[-+*/]?=[^=]", r"\.(call|send|transfer|delegatecall)\s*[({]"
OPEN = f"{VISIBILITY} IN ('public', 'external')"
CHECKS = (
    ("unguarded_change", "access_control", "High", "anyone can change state", rf"{OPEN} AND regexp_matches(body, '{CHANGES}') AND NOT (regexp_matches(attributes, '\bonly\w*|\brequiresAuth\b') OR contains(body, 'msg.sender ==') OR contains(body, '== msg.sender'))"),
    ("external_call", "reentrancy", "High", "state must be final before the call", f"regexp_matches(body, '{CALLS}')"),
    ("amount_unchecked", "validation", "Medium", "amount must be checked", r"contains(parameters, 'amount') AND NOT regexp_matches(body, 'require\s*\([^;]*amount')"),
    ("payable", "value", "Medium", "value must be accounted for", "contains(attributes, 'payable')"), ("loop", "gas", "Low", "loop must be bounded", r"regexp_matches(body, '\b(for|while)\s*\(')"),
)


@query(f"WITH {FUNCTIONS} " + " UNION ALL ".join(f"SELECT file_id, name, '{r}' AS rule, '{c}' AS category, '{s}' AS severity, '{t} in ' || name AS expression FROM functions WHERE {w}" for r, c, s, t, w in CHECKS))
def function_checks(spark, sf_dir):
    return U.function_checks(C.functions(files(spark, sf_dir))).select("file_id", "name", "rule", "category", "severity", "expression")


@query(f"WITH {FILES}, {LINES} " + " UNION ALL ".join(f"SELECT file_id, line_no, '{n}' AS rule, '{s}' AS severity, trim(line) AS line FROM lines WHERE regexp_matches(line, {literal(p)})" for n, p, s in U.WEAK))
def weak_lines(spark, sf_dir):
    return U.weak_lines(files(spark, sf_dir))


@query(rf"""WITH {FUNCTIONS}, e AS (SELECT DISTINCT a.file_id, a.name AS caller, b.name AS callee FROM functions a JOIN functions b ON a.file_id = b.file_id AND a.name <> b.name AND regexp_matches(a.body, '\b' || b.name || '\s*\(')),
f AS (SELECT file_id, name, (SELECT count(*) FROM e WHERE e.file_id = g.file_id AND e.callee = g.name) AS callers, regexp_matches(body, '{CHANGES}') AS writes, regexp_matches(body, '{CALLS}') AS transfers FROM functions g)
SELECT file_id, name, 'shared_resource' AS rule, 'consistency' AS category, 'Medium' AS severity FROM f WHERE callers > 1 AND writes UNION ALL SELECT file_id, name, 'value_moves', 'value', 'High' FROM f WHERE transfers UNION ALL SELECT file_id, name, 'dead_code', 'quality', 'Low' FROM f WHERE callers = 0""")
def flow_checks(spark, sf_dir):
    own = C.functions(files(spark, sf_dir))
    callers = taint.call_edges(own, ["file_id"]).groupBy("file_id", F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("callers"))
    facts = own.join(callers, ["file_id", "name"], "left").select("file_id", "name", F.coalesce("callers", F.lit(0)).alias("callers"), F.col("body").rlike(CHANGES).alias("writes"), F.col("body").rlike(CALLS).alias("transfers"))
    return U.flow_checks(facts).select("file_id", "name", "rule", "category", "severity")


@query(rf"""WITH {FUNCTIONS} SELECT file_id, name, len(regexp_extract_all(body, '\b(?:if|for|while|case|catch)\b|&&|\|\||\?'))::INT + 1 AS complexity FROM functions WHERE len(regexp_extract_all(body, '\b(?:if|for|while|case|catch)\b|&&|\|\||\?')) + 1 > 1""")
def complex_functions(spark, sf_dir):
    return U.complex_functions(C.functions(files(spark, sf_dir)), 1).select("file_id", "name", "complexity")


@query(rf"""WITH {FUNCTIONS} SELECT file_id, bool_or(regexp_matches(body, '{CALLS}')) AS has_external_calls, bool_or(contains(attributes, 'payable')) AS has_payable, bool_or(contains(body, 'assembly')) AS has_assembly, count(*) FILTER (WHERE {OPEN}) AS open_functions, bool_and(NOT ({OPEN}) OR contains(body, 'require')) AS all_guarded FROM functions GROUP BY file_id""")
def security_flags(spark, sf_dir):
    return U.security_flags(C.functions(files(spark, sf_dir)), ["file_id"])


LISTED = (("helper(uint) returns(uint)", 2), ("half(uint) returns(uint,uint)", 9), ("run(address,bytes) returns()", 5))


@query(rf"""WITH {FUNCTIONS} SELECT file_id, name FROM functions WHERE NOT (name IN ('nothing')) AND len(string_split(regexp_replace(regexp_extract(body, '(?s)\{{(.*)\}}', 1), '^\s+|\s+$', '', 'g'), ';')) + len(string_split(regexp_replace(regexp_extract(body, '(?s)\{{(.*)\}}', 1), '^\s+|\s+$', '', 'g'), chr(10) || chr(10))) - 1 > 3
AND NOT (name = 'run' AND abs(len(list_filter(string_split(whole, chr(10)), lambda x: x <> '')) - 5) <= 2)""")
def worth_checking(spark, sf_dir):
    return U.worth_checking(C.functions(files(spark, sf_dir)), spark.createDataFrame(list(LISTED), "signature string, lines int")).select("file_id", "name")


ANSWERS = ((1, "Purpose: pay out\n- **Risk Level**: high\nother"), (2, 'Sure {"purpose": "p", "risk_level": "low"} ok'), (3, "nothing"), (4, "## Anchoring \nLocation: f.sol:3\nIt anchors.\nStill.\n## Framing\nseverity: High\n"))
FIELDS = {"purpose": "unknown", "risk_level": "medium"}


def _label(name: str, default: str) -> str:
    pattern = literal(rf"(?im)^[ \t]*(?:[-*][ \t]*)?\**{name.replace('_', '[ _]')}\**[ \t]*:[ \t]*\**[ \t]*([^\n]*)")
    return f"coalesce(CASE WHEN json_valid(j) THEN j ->> '$.{name}' END, nullif(trim(regexp_extract(text, {pattern}, 1)), ''), '{default}') AS {name}"


@query("SELECT id, " + ", ".join(_label(n, d) for n, d in FIELDS.items()) + " FROM (SELECT *, regexp_extract(text, '(?s)\\{.*\\}') AS j FROM " + grown_sql(ANSWERS, "id, text", "text") + ")")
def labelled_fields(spark, sf_dir):
    return grown(spark, sf_dir, ANSWERS, "id int, text string", "text").select("id", U.labelled(F.col("text"), FIELDS).alias("f")).select("id", "f.*")


@query(r"""SELECT id, trim(split_part(s, chr(10), 1)) AS title, coalesce(nullif(trim(regexp_extract(b, '(?im)^location:[ \t]*([^\n]*)', 1)), ''), 'unknown') AS location, coalesce(nullif(trim(regexp_extract(b, '(?im)^severity:[ \t]*([^\n]*)', 1)), ''), 'Medium') AS severity,
 array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT regexp_matches(l, '(?i)^(location|severity):')), ' ') AS description
FROM (SELECT id, s, substr(s, strpos(s, chr(10))) AS b FROM (SELECT id, unnest(string_split_regex(text, '(?m)^##[ \t]+')[2:]) AS s FROM """ + grown_sql(ANSWERS, "id, text", "text") + "))")
def bias_findings(spark, sf_dir):
    return grown(spark, sf_dir, ANSWERS, "id int, text string", "text").select("id", F.explode(U.bias_findings(F.col("text"))).alias("f")).select("id", "f.*")


CODES = ((1, "python", "def a(x):\n  pass\nasync def b(): pass"), (2, "javascript", "function f() {}\nconst g = async (x) => x"), (3, "rust", "pub fn h() {}"), (4, "go", "func (s *S) M() {}\nfunc n() {}"), (5, "cobol", "function x"), (6, "solidity", "function p() external {}"), (7, "java", "public static int q(int a) {}"))


@query("SELECT id, array_to_string(CASE language " + " ".join(f"WHEN '{n}' THEN regexp_extract_all(code, {literal(p)}, 1)" for n, p in U.STARTS.items() if n != "javascript") + r" WHEN 'javascript' THEN list_transform(regexp_extract_all(code, '\bfunction\s+\w+|\b(?:const|let)\s+\w+\s*='), lambda x: regexp_extract(x, '(\w+)\s*=?$', 1)) ELSE [] END, ',') AS names FROM " + grown_sql(CODES, "id, language, code", "code"))
def function_names(spark, sf_dir):
    rows = grown(spark, sf_dir, CODES, "id int, language string, code string", "code")
    return rows.select("id", F.array_join(U.function_names(F.col("code"), F.col("language")), ",").alias("names"))


@query("""SELECT c_custkey AS number, '# ' || c_name || ' (#' || c_custkey || ', ' || CASE WHEN c_acctbal > 0 THEN 'open' ELSE 'closed' END || ')' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Labels: ' || c_mktsegment || ', bug' ELSE '' END || chr(10) || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END ||
 coalesce((SELECT chr(10) || string_agg(o_orderpriority || ': ' || o_orderstatus, chr(10) ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS text FROM customer WHERE c_custkey % 7 <> 0""")
def issue_documents(spark, sf_dir):
    """Customers as issues, their orders as comments; some are pull requests."""
    labels = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit("bug"))).otherwise(F.array().cast("array<string>"))
    issues = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, "open").otherwise("closed").alias("state"), labels.alias("labels"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("body"), (F.col("c_custkey") % 7 == 0).alias("is_pull"))
    comments = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("author"), F.col("o_orderstatus").alias("body"))
    return U.issue_document(issues, comments)


QUESTIONS = {"lorem|the": "Which the?", "der|die": "Welche?", "le ": "Lequel?"}


@query("""SELECT doc_id, md5(concat_ws(chr(10), 'Look at ' || source, nullif(array_to_string(list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{k}') THEN {literal(q)} END" for k, q in QUESTIONS.items()) + """], lambda x: x IS NOT NULL), chr(10)), ''))[1:40]) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'vulnerability' WHEN starts_with(source, 'test') THEN 'test' WHEN ends_with(source, '.sol') THEN 'contract' WHEN ends_with(source, '.md') THEN 'documentation' ELSE 'general' END AS template FROM documents""")
def enhanced_prompts(spark, sf_dir):
    prompt = U.enhanced(F.concat(F.lit("Look at "), "source"), F.col("text"), QUESTIONS, 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt).alias("digest"), U.template_of(F.col("source"), F.when(F.col("doc_id") % 3 == 0, "vulnerability").otherwise("")).alias("template"))


WORDS = r"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS word FROM documents), v AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::UBIGINT % 64 AS place, count(*)::DOUBLE AS n FROM w WHERE word <> '' GROUP BY 1, 2), l AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM v GROUP BY doc_id)"""


@query(f"""WITH {WORDS}, s AS (SELECT a.doc_id AS query_id, b.doc_id AS vec_id, round(sum(a.n * b.n) / (any_value(x.len) * any_value(y.len)), 6) AS score FROM v a JOIN v b USING (place) JOIN l x ON x.doc_id = a.doc_id JOIN l y ON y.doc_id = b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, round(min(score), 4) AS least, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 3 GROUP BY query_id""")
def text_search(spark, sf_dir):
    """The third best score of each question, the documents of ids divisible by 100, among all documents by hashed words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = K.embedded(docs)
    found = K.search_texts(docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), store, 3, id_col="doc_id")
    return found.groupBy("query_id").agg(F.round(F.min("score"), 4).alias("least"), F.count(F.lit(1)).alias("n"))
