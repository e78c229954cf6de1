"""Queries over facts of contracts and flows, derived from the driver's tables so that they grow with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import containment
from ..operators import flows as O
from .base import query, table

#: SQL that both engines read: flows with paths of two nodes, functions, surfaces and the like, from orders and line items.
NODES = "SELECT l_orderkey % 50 AS file_id, l_orderkey AS flow_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'function' ELSE 'source' END AS type, concat('f', cast(l_partkey % 40 AS string)) AS name, CAST(l_quantity AS INT) AS start_line, CAST(l_quantity AS INT) + l_linenumber AS end_line FROM {lineitem} WHERE l_linenumber <= 3"
SCENARIOS = "SELECT p_partkey AS id, p_partkey % 50 AS file_id, concat('f', cast(p_size AS string)) AS function FROM {part}"


def _frame(spark, sf_dir, sql: str):
    names = [t for t in ("lineitem", "part", "orders", "customer", "supplier", "nation", "events", "documents") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})


def _duck(sql: str) -> str:
    for t in ("lineitem", "part", "orders", "customer", "supplier", "nation", "events", "documents"):
        sql = sql.replace("{" + t + "}", t)
    return sql


def flows_of(spark, sf_dir):
    nodes = _frame(spark, sf_dir, NODES)
    return nodes.groupBy("file_id", "flow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "name", "start_line", "end_line"))).alias("path"))


@query(f"""WITH n AS ({_duck(NODES)}), s AS ({_duck(SCENARIOS)}) SELECT id, (SELECT string_agg(flow_id::VARCHAR, ',' ORDER BY flow_id) FROM (SELECT DISTINCT flow_id FROM n WHERE n.file_id = s.file_id AND n.name = s.function AND n.type = 'function')) AS flows, (SELECT count(DISTINCT flow_id) FROM n WHERE n.file_id = s.file_id AND n.name = s.function AND n.type = 'function')::INT AS n_flows FROM s""")
def scenario_flows(spark, sf_dir):
    out = O.with_flows(_frame(spark, sf_dir, SCENARIOS), flows_of(spark, sf_dir))
    return out.select("id", S.or_null(F.array_join(F.transform("flows", lambda x: x.cast("string")), ",")).alias("flows"), "n_flows")


@query(f"""SELECT file_id, flow_id, string_agg(i || '. ' || type || ' ' || name || ' (' || start_line || '-' || end_line || ')', '|' ORDER BY i) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY file_id, flow_id ORDER BY pos, type, name, start_line) AS i FROM ({_duck(NODES)})) GROUP BY ALL""")
def execution_paths(spark, sf_dir):
    return O.steps(flows_of(spark, sf_dir)).select("file_id", "flow_id", F.array_join("steps", "|").alias("steps"))


ITEMS = """SELECT n_nationkey AS id, n_name AS function, concat('x', cast(n_nationkey AS string)) AS contract FROM {nation} UNION ALL SELECT 100, 'the', 'und' UNION ALL SELECT 101, 'nowhere', NULL
 UNION ALL SELECT 1000 + doc_id, regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+) ', 1), concat('nowhere ', cast(doc_id AS string)) FROM {documents} WHERE doc_id % 100 = 0"""
WORDS = r"(?:^|[^\p{L}\p{N}_])"


@query(f"""WITH i AS (SELECT id, lower(unnest([function, contract])) AS name FROM ({_duck(ITEMS)})), t AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low FROM documents),
c AS MATERIALIZED (SELECT id, name, doc_id, text, low FROM t JOIN i ON name <> '' AND contains(low, name))
SELECT DISTINCT id, doc_id, text FROM c WHERE regexp_matches(low, '{WORDS}' || name || '{WORDS.replace('^', '$', 1)}')""")
def issue_texts(spark, sf_dir):
    """Documents as issues, all of them whole, that mention an item: nations, frequent words, and phrases of three words that every
    hundredth document begins with."""
    return O.mentioned(_frame(spark, sf_dir, ITEMS), table(spark, sf_dir, "documents"), ["function", "contract"], "id", "doc_id")


PIECES = """SELECT doc_id AS id, substring(text, 1 + cast(doc_id % 50 AS int), 2 + cast(doc_id % 17 AS int)) AS name FROM {documents} WHERE doc_id % 100 = 0 UNION ALL SELECT -1 - n_nationkey, n_name FROM {nation} UNION ALL SELECT -100, 'é' UNION ALL SELECT -101, '%_' UNION ALL SELECT -102, ''"""


@query(f"WITH p AS ({_duck(PIECES)}) SELECT id, doc_id FROM documents JOIN p ON name <> '' AND contains(text, name) GROUP BY id, doc_id")
def name_mentions(spark, sf_dir):
    """All documents that hold a piece of text, 2 to 18 characters that need not be words, of every hundredth one."""
    return containment.holding(_frame(spark, sf_dir, PIECES), table(spark, sf_dir, "documents"), "id", "name", "doc_id", "text")


DECLARED = "SELECT concat('C', cast(s_suppkey AS string)) AS contract, 'pay' AS n1, 'mint' AS n2 FROM {supplier}"
CHUNKS = "SELECT concat('C', cast(p_partkey % 15 AS string)) AS contract, CASE p_partkey % 3 WHEN 0 THEN 'pay' WHEN 1 THEN 'burn' ELSE 'swap' END AS name, max(p_name) AS code, CASE WHEN p_partkey % 3 = 0 THEN 'mint' ELSE 'pay' END AS call FROM {part} GROUP BY 1, 2, 4"


def chunks_of(spark, sf_dir):
    function = lambda c: F.struct(F.col(c).alias("name"), F.concat(F.lit("declared "), c).alias("code"))
    contracts = _frame(spark, sf_dir, DECLARED).select("contract", F.array(function("n1"), function("n2")).alias("functions"))
    return contracts, _frame(spark, sf_dir, CHUNKS).select("contract", "name", "code", F.array("call").alias("calls"))


@query(f"""WITH d AS (SELECT contract, unnest([n1, n2]) AS name FROM ({_duck(DECLARED)})), c AS ({_duck(CHUNKS)}) SELECT d.contract, d.name, coalesce(c.code, 'declared ' || d.name) AS code, CASE WHEN c.code IS NULL THEN 'declared' ELSE 'chunk' END AS origin FROM d LEFT JOIN c USING (contract, name)
UNION ALL SELECT contract, name, code, 'chunk' FROM c WHERE contract IN (SELECT contract FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.contract = c.contract AND d.name = c.name)""")
def chunk_assembly(spark, sf_dir):
    return O.assembled(*chunks_of(spark, sf_dir))


@query(f"""WITH d AS ({_duck(DECLARED)}), c AS ({_duck(CHUNKS)}) SELECT DISTINCT contract, name AS caller, call AS callee FROM c WHERE contract IN (SELECT contract FROM d)""")
def chunk_call_graph(spark, sf_dir):
    return O.chunk_calls(*chunks_of(spark, sf_dir))


DERIVED = "SELECT concat('flow', cast(c_custkey AS string)) AS name, c_custkey % 10 / 10.0 AS confidence, c_mktsegment AS text, concat('f', cast(c_custkey % 7 AS string)) AS fa, 'shared' AS fb FROM {customer} WHERE c_custkey % 3 <> 0"
ACQUIRED = "SELECT concat('flow', cast(c_custkey AS string)) AS name, c_custkey % 7 / 10.0 AS confidence, c_name AS text, 'shared' AS fa, concat('g', cast(c_custkey % 5 AS string)) AS fb FROM {customer} WHERE c_custkey % 2 = 0"


@query(f"""WITH a AS ({_duck(DERIVED)}), b AS ({_duck(ACQUIRED)}) SELECT coalesce(a.name, b.name) AS name, greatest(a.confidence, b.confidence)::DOUBLE AS confidence, CASE WHEN b.name IS NULL THEN a.fa || ',' || a.fb WHEN a.name IS NULL THEN b.fa || ',' || b.fb ELSE a.fa || ',' || a.fb || ',' || b.fb END AS functions,
  CASE WHEN b.name IS NULL THEN a.text WHEN a.name IS NULL THEN b.text ELSE 'Derived: ' || a.text || chr(10) || 'Acquired: ' || b.text END AS text, CASE WHEN a.name IS NULL THEN 'acquired' WHEN b.name IS NULL THEN 'derived' ELSE 'hybrid' END AS origin FROM a FULL JOIN b ON a.name = b.name""")
def flow_merge(spark, sf_dir):
    part = lambda sql: _frame(spark, sf_dir, sql).select("name", F.col("confidence").cast("double").alias("confidence"), F.array("fa", "fb").alias("functions"), "text")
    return O.merged_flows(part(DERIVED), part(ACQUIRED)).withColumn("functions", F.array_join("functions", ","))


EXPRESSIONS = "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'any' ELSE concat('C', cast(p_partkey % 20 AS string)) END AS contract_pattern, p_brand AS type, cast(p_size % 5 AS string) AS category, p_name AS expression FROM {part}"
CONTRACTS = "SELECT concat('C', cast(s_suppkey AS string)) AS contract FROM {supplier}"
EXISTING = "SELECT concat('C', cast(p_partkey % 10 AS string)) AS contract, p_brand AS type, cast(p_size % 5 AS string) AS category FROM {part} WHERE p_partkey % 2 = 0"


@query(f"""WITH e AS ({_duck(EXPRESSIONS)}), c AS ({_duck(CONTRACTS)}), x AS ({_duck(EXISTING)}) SELECT contract, type, category, expression FROM e JOIN c ON contract_pattern IN (contract, 'any') WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.contract = c.contract AND x.type = e.type AND x.category = e.category)""")
def expression_lookup(spark, sf_dir):
    """What holds for each contract, by its name or for any."""
    found = O.new_expressions(*(_frame(spark, sf_dir, s) for s in (EXPRESSIONS, CONTRACTS, EXISTING)))
    return O.for_each_contract(found, _frame(spark, sf_dir, CONTRACTS))


@query(f"""WITH e AS ({_duck(EXPRESSIONS)}), x AS ({_duck(EXISTING)})
SELECT 'C3' AS contract, type, category, expression FROM e WHERE contract_pattern IN ('C3', 'any') AND NOT EXISTS (SELECT 1 FROM x WHERE x.contract = 'C3' AND x.type = e.type AND x.category = e.category)""")
def expressions_of_contract(spark, sf_dir):
    """The expressions of one contract, by its name and for any."""
    found = O.new_expressions(*(_frame(spark, sf_dir, s) for s in (EXPRESSIONS, CONTRACTS, EXISTING)))
    return O.expressions_for(found, "C3")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)""")
def call_cleaning(spark, sf_dir):
    definitions = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return O.cleaned(table(spark, sf_dir, "lineitem"), definitions, ["l_partkey"]).select("l_orderkey", "l_linenumber")


VALIDATION = "concat('1. ', c_mktsegment, ' is ', CASE WHEN c_custkey % 3 = 0 THEN 'invalid' WHEN c_custkey % 3 = 1 THEN 'confirmed' ELSE 'odd' END, chr(10), 'text', chr(10), '3) ', c_name, CASE WHEN c_custkey % 2 = 0 THEN ' Valid' ELSE ' false' END)"


@query(f"""WITH f AS (SELECT c_custkey AS id, unnest([1, 2, 3]) AS ordinal, {VALIDATION} AS v FROM customer), s AS (SELECT id, ordinal, lower(list_filter(string_split(v, chr(10)), lambda l: regexp_matches(l, '^' || ordinal || '[.)]'))[1]) AS said FROM f)
SELECT id, ordinal, CASE WHEN said IS NULL THEN 'open' WHEN contains(said, 'invalid') OR contains(said, 'false') THEN 'rejected' WHEN contains(said, 'confirm') OR contains(said, 'valid') THEN 'confirmed' ELSE 'unclear' END AS status FROM s""")
def validation_by_ordinal(spark, sf_dir):
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(VALIDATION).alias("validation"))
    findings = given.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ordinal"))
    return O.validated(findings, given, "id")


WORKFLOWS = "SELECT s_suppkey % 12 AS contract, s_suppkey AS workflow, concat('f', cast(s_suppkey % 9 AS string)) AS a, concat('f', cast(s_suppkey % 5 AS string)) AS b, 'absent' AS c FROM {supplier}"
FUNCTIONS = "SELECT p_partkey % 12 AS contract, concat('f', cast(p_partkey % 9 AS string)) AS name, min(p_size) AS start_line, min(p_size) + 3 AS end_line FROM {part} GROUP BY 1, 2"


@query(f"""WITH w AS (SELECT contract, workflow, unnest([1, 2, 3]) AS pos, unnest([a, b, c]) AS name FROM ({_duck(WORKFLOWS)})), m AS (SELECT w.*, start_line, end_line FROM w JOIN ({_duck(FUNCTIONS)}) f USING (contract, name)),
l AS (SELECT DISTINCT contract, workflow, unnest(range(start_line, end_line + 1)) AS line FROM m) SELECT contract, workflow, string_agg(name, ',' ORDER BY pos) AS members, (SELECT string_agg(line::VARCHAR, ',' ORDER BY line) FROM l WHERE l.contract = m.contract AND l.workflow = m.workflow) AS lines FROM m GROUP BY contract, workflow""")
def workflow_flows(spark, sf_dir):
    workflows = _frame(spark, sf_dir, WORKFLOWS).select("contract", "workflow", F.array("a", "b", "c").alias("names"))
    out = O.flow_members(workflows, _frame(spark, sf_dir, FUNCTIONS))
    return out.select("contract", "workflow", F.array_join("members", ",").alias("members"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


FLOWS = "SELECT o_custkey AS contract, concat('f', cast(o_orderkey % 6 AS string)) AS function, CASE o_orderkey % 7 WHEN 0 THEN 'value_transfer' WHEN 1 THEN 'external_call' WHEN 2 THEN 'storage_write' WHEN 3 THEN 'authorization' WHEN 4 THEN 'cross_contract' WHEN 5 THEN 'other' END AS type, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 8 / 8.0 END AS confidence FROM {orders}"


@query(f"""SELECT contract, sum(k)::BIGINT AS n, string_agg(type || '=' || k, ',' ORDER BY type || '=' || k) AS types, (sum(c) / sum(k))::DOUBLE AS average_confidence FROM (SELECT contract, coalesce(type, 'unknown') AS type, count(*) AS k, sum(coalesce(confidence, 0)) AS c FROM ({_duck(FLOWS)}) GROUP BY 1, 2) GROUP BY contract""")
def flow_summaries(spark, sf_dir):
    return O.flows_summary(_frame(spark, sf_dir, FLOWS).withColumn("confidence", F.col("confidence").cast("double")), "contract")


@query(f"""SELECT contract, area, string_agg(function, ',' ORDER BY function) AS functions FROM (SELECT *, CASE WHEN type = 'value_transfer' THEN 'value_transfer' WHEN type IN ('external_call', 'cross_contract') THEN 'external_calls' WHEN type = 'storage_write' THEN 'state_changes' WHEN type = 'authorization' THEN 'access_control' END AS area FROM ({_duck(FLOWS)})) WHERE area IS NOT NULL GROUP BY contract, area""")
def risk_areas(spark, sf_dir):
    return O.risk_areas(_frame(spark, sf_dir, FLOWS), "contract").withColumn("functions", F.array_join("functions", ","))


RISKY = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'selfdestruct(x);' WHEN 1 THEN 'assembly x' WHEN 2 THEN 'a.delegatecall(b); assembly y' ELSE 'return;' END AS code, p_size % 3 = 0 AS payable, p_size % 7 = 0 AS transfers, CAST(p_size % 8 AS INT) AS surfaces, CASE WHEN p_partkey % 3 > 0 THEN p_size / 50.0 END AS confidence FROM {part}"


@query(f"""SELECT id, array_to_string(f, '|') AS factors, CASE WHEN list_has_any(f, ['Contains selfdestruct', 'Uses delegatecall']) THEN 'high' WHEN list_has_any(f, ['Accepts Ether', 'Transfers value']) THEN 'medium' WHEN len(f) > 0 THEN 'low' ELSE 'none' END AS level,
  CASE WHEN surfaces > 5 OR (surfaces > 2 AND c > 0.7) THEN 'high' WHEN surfaces > 2 OR (surfaces > 0 AND c > 0.7) THEN 'medium' ELSE 'low' END AS severity
FROM (SELECT *, coalesce(confidence, 0.5) AS c, list_filter([CASE WHEN payable THEN 'Accepts Ether' END, CASE WHEN contains(code, 'selfdestruct') THEN 'Contains selfdestruct' END, CASE WHEN contains(code, 'delegatecall') THEN 'Uses delegatecall' END, CASE WHEN contains(code, 'assembly') THEN 'Contains assembly code' END, CASE WHEN transfers THEN 'Transfers value' END], lambda x: x IS NOT NULL) AS f FROM ({_duck(RISKY)}))""")
def function_risks(spark, sf_dir):
    factors = S.risk_factors(F.col("code"), F.col("payable"), F.col("transfers"))
    return _frame(spark, sf_dir, RISKY).select("id", F.array_join(factors, "|").alias("factors"), S.risk_level(factors).alias("level"), S.flow_severity(F.col("surfaces"), F.col("confidence")).alias("severity"))


SURFACES = "SELECT c_nationkey AS project, c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS severity, CASE c_custkey % 3 WHEN 0 THEN 'acquired' WHEN 1 THEN 'hybrid' END AS flow_source, concat('v', cast(c_custkey % 5 AS string)) AS v1, c_mktsegment AS v2 FROM {customer}"
LISTED = "coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE {}), '')"


@query("SELECT project, " + ", ".join(LISTED.format(f"coalesce(severity, 'low') = '{s}'") + f" AS {s}_severity" for s in ("high", "medium", "low")) + ", " + ", ".join(LISTED.format(f"coalesce(flow_source, 'derived') = '{s}'") + f" AS {s}_flows" for s in ("derived", "acquired", "hybrid")) + f", (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT unnest([v1, v2]) AS v FROM ({_duck(SURFACES)}) i WHERE i.project = s.project)) AS variables FROM ({_duck(SURFACES)}) s GROUP BY project")
def attack_surface_summary(spark, sf_dir):
    out = O.attack_surfaces(_frame(spark, sf_dir, SURFACES).withColumn("variables", F.array("v1", "v2")), "project")
    ids = [c for c in out.columns if c not in ("project", "variables")]
    return out.select("project", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ids), F.array_join("variables", ",").alias("variables"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE k = 'single') AS single, count(*) FILTER (WHERE k = 'multi') AS multi, count(*) FILTER (WHERE k = 'none') AS none, count(*) FILTER (WHERE k = 'single') / count(*) AS share, avg(l) AS mean, min(l)::INT AS least, max(l)::INT AS most
FROM (SELECT CASE WHEN p_size % 3 > 0 THEN 'single' WHEN p_size % 2 = 0 THEN 'multi' ELSE 'none' END AS k, CASE WHEN p_size % 3 > 0 THEN length(p_name) END AS l FROM part)""")
def prompt_statistics(spark, sf_dir):
    prompts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("prompt"), F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).alias("prompts"))
    return O.prompt_stats(prompts)


@query("""WITH t AS (SELECT o_custkey AS trial, o_orderpriority AS model, floor(o_totalprice / 50000) AS score FROM orders), w AS (SELECT trial, min(model) AS model FROM t JOIN (SELECT trial, max(score) AS score FROM t GROUP BY trial) USING (trial, score) GROUP BY trial)
SELECT model, count(*) AS n, (SELECT count(*) FROM w WHERE w.model = t.model) AS wins, avg(score) AS mean, (SELECT count(*) FROM w WHERE w.model = t.model) / count(*) AS rate FROM t GROUP BY model""")
def model_win_rates(spark, sf_dir):
    return O.model_wins(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trial"), F.col("o_orderpriority").alias("model"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score")))


@query("""SELECT user_id, CASE WHEN count(event_type) = 0 THEN 0 ELSE least(count(*) FILTER (WHERE event_type <> 'view') / count(event_type), 1.0) END::DOUBLE AS confidence FROM events GROUP BY user_id""")
def answer_confidence(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("question"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("answer"))
    return O.answer_confidence(asked, "user_id")


@query("""SELECT user_id, string_agg(event_type[1:1], '' ORDER BY event_id) AS result FROM events GROUP BY user_id""")
def event_fold(spark, sf_dir):
    first = table(spark, sf_dir, "events").withColumn("letter", F.substring("event_type", 1, 1))
    return O.folded(first, "user_id", "event_id", "letter", F.lit(""), lambda acc, x: F.concat(acc, x))


@query("""SELECT c_custkey AS k, 'a' || c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'b' || c_nationkey FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0""")
def parallel_merge(spark, sf_dir):
    parts = [table(spark, sf_dir, "customer").where(f"c_custkey % {m} = 0").select(F.col("c_custkey").alias("k"), F.concat(F.lit(t), F.col("c_nationkey").cast("string")).alias("v")) for m, t in ((2, "a"), (3, "b"))]
    return O.first_wins(parts, "k")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS values FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY user_id""")
def ordered_distinct(spark, sf_dir):
    return O.ordered_distinct(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", F.array_join("values", ",").alias("values"))


CHUNK_LINES = "SELECT l_suppkey AS file_id, l_orderkey AS id, CAST(l_quantity AS INT) * 10 AS start_line, CAST(l_quantity AS INT) * 10 + l_linenumber AS end_line FROM {lineitem} WHERE l_linenumber >= 3"
COVERED = "SELECT l_suppkey AS file_id, CAST(l_quantity AS INT) * 10 AS start_line, CAST(l_quantity AS INT) * 10 + l_partkey % 9 AS end_line FROM {lineitem} WHERE l_linenumber < 3 AND l_partkey % 5 < 2"


@query(f"""WITH k AS (SELECT DISTINCT * FROM ({_duck(CHUNK_LINES)})), c AS (SELECT DISTINCT file_id, unnest(range(start_line, end_line + 1)) AS line FROM ({_duck(COVERED)})), l AS (SELECT *, unnest(range(start_line, end_line + 1)) AS line FROM k)
SELECT DISTINCT file_id, id, start_line, end_line FROM l WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_id = l.file_id AND c.line = l.line)""")
def set_difference(spark, sf_dir):
    """Chunks with a line that no covered interval has."""
    return O.uncovered(_frame(spark, sf_dir, CHUNK_LINES).distinct(), _frame(spark, sf_dir, COVERED), ["file_id"])


FINDINGS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS severity, CASE o_orderkey % 5 WHEN 0 THEN false WHEN 1 THEN true END AS reachable, o_totalprice / 40000 AS exploitability, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS summary FROM {orders}"


@query(f"""SELECT id, coalesce(severity, CASE lower(confidence) WHEN 'high' THEN 'High' ELSE 'Medium' END) AS severity FROM ({_duck(FINDINGS)}) WHERE lower(confidence) IN ('high', 'medium') AND (reachable IS NULL OR reachable)""")
def confident_findings(spark, sf_dir):
    return O.confident(_frame(spark, sf_dir, FINDINGS)).select("id", "severity")


@query(f"""SELECT id FROM ({_duck(FINDINGS)}) WHERE exploitability >= 7 AND summary <> ''""")
def exploitable_flows(spark, sf_dir):
    return O.exploitable(_frame(spark, sf_dir, FINDINGS)).select("id")


@query("""SELECT event_id, completed::BIGINT AS completed, CASE WHEN seconds > 0 THEN completed / seconds END AS rate, CASE WHEN seconds > 0 THEN (100 - completed) / (completed / seconds) END AS left FROM (
 SELECT event_id, count(*) OVER w AS completed, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def progress_eta(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("done"), F.lit(100).alias("total"))
    return O.progress(events, "user_id").select("event_id", "completed", "rate", "left")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20""")
def last_commands(spark, sf_dir):
    return O.latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("""SELECT n_nationkey::BIGINT AS id, n_name AS name, 'node' AS type FROM nation UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY p_brand), p_brand, 'sink' FROM (SELECT DISTINCT p_brand FROM part)""")
def find_or_create(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("node").alias("type"))
    wanted = nodes.select("name", "type").unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit("sink").alias("type")))
    return O.found_or_created(nodes, wanted)
