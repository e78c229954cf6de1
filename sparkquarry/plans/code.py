"""Queries over contract code: extraction, taint, call graphs. Files are a few written out and one made from each part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import structure as S
from ..operators import chunking, dataflow, taint
from ..shared import dealt
from .base import query, table

#: (file_id, content); negative ids, as those of parts are positive.
WRITTEN = (
    (-1, """// SPDX: none
pragma solidity ^0.8.0;
/* A vault,
 * with a lock. */
contract Vault is Owned, Pausable {
    uint256 public total;
    mapping(address => uint256) balances;
    address[] private owners;
    event Paid(address indexed to, uint256 amount);
    event Closed();
    error Denied(address who);

    /// @notice Pays out
    /// @param to who gets it
    /// @param amount how much
    /// @return ok whether it worked
    function pay(address to, uint256 amount) external payable returns (bool ok) {
        require(balances[msg.sender] >= amount && amount > 0, "too little");
        if (amount > total) {
            if (total == 0) { revert Denied(to); }
            total -= amount;
        }
        balances[to] = amount;
        to.call{value: amount}("");
        log(amount);
        return true;
    }

    function log(uint256 amount) internal {
        emit Paid(msg.sender, amount);
        Ledger ledger = new Ledger(amount);
        ledger.add(amount);
    }

    modifier locked(uint256 id) { require(id > 0); _; }
    function close() public { selfdestruct(owner); }
    function nothing() private {}
}
"""),
    (-2, """interface IToken { function transfer(address to, uint amount) external; }
library Maths {
  function half(uint128 a) public pure returns (uint128, uint8) { return half(a / 2); }
}
contract Proxy is Vault {
  bytes32 constant KEY = 0; // http://x.org
  function run(address target, bytes data) {
    for (uint i = 0; i < data.length; i++) { if (data[i] == 0) { break; } }
    target.delegatecall(data);
    assembly { let x := 0 }
    pay(target, 1);
  }
}"""),
    (-3, ""),
    (-4, "no code here; function without braces();"),
)
MADE = """concat('contract P', cast(p_partkey AS string), ' is Base', cast(p_size % 5 AS string), chr(10), '{', chr(10), '    uint256 public total', cast(p_size AS string), ';', chr(10),
 '    event Paid(address indexed to, uint256 amount);', chr(10), '    /// @notice of ', p_brand, chr(10), '    function pay(address to, uint256 amount) external payable {', chr(10), '        require(amount > ', cast(p_size AS string), ');', chr(10),
 CASE WHEN p_size % 2 = 0 THEN concat('        if (amount > total', cast(p_size AS string), ') { total', cast(p_size AS string), ' -= amount; }', chr(10)) ELSE '' END,
 CASE WHEN p_size % 3 = 0 THEN concat('        to.transfer(amount);', chr(10)) ELSE concat('        helper(amount);', chr(10)) END, '    }', chr(10),
 '    function helper(uint256 amount) internal view returns (uint256) { return amount; }', chr(10), '}')"""


def files(spark, sf_dir):
    written = spark.createDataFrame(list(WRITTEN), "file_id long, content string")
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("file_id"), F.expr(MADE).alias("content")).unionByName(written)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FILES = f"files AS (SELECT p_partkey AS file_id, {MADE} AS content FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literal(t)})" for i, t in WRITTEN) + ") w(file_id, content))"
#: Blocks with nested braces, spelled out for an engine without possessive quantifiers.
BLOCK = r"\{[^{}]*\}"
for _ in range(4):
    BLOCK = rf"\{{(?:[^{{}}]|{BLOCK})*\}}"
FUNCTION = rf"\bfunction\s+(\w+)\s*\(([^)]*)\)([^{{}};]*)({BLOCK})"


def found(name: str, pattern: str, *groups: str, source: str = "files", columns: str = "file_id", text: str = "content") -> str:
    """SQL of a CTE with a row a match: i, whole, groups, and lines from window sums of line feeds in gaps and matches."""
    whole = _literal(f"(?s)(.*?)({pattern})")
    lists = ", ".join(f"regexp_extract_all({text}, {whole}, {k}) AS l_{g}" for k, g in enumerate(["gap", "whole", *groups], 1))
    at = ", ".join(f"l_{g}[i] AS {g}" for g in ["gap", "whole", *groups])
    feeds = "len({0}) - len(replace({0}, chr(10), ''))"
    before = f"1 + sum({feeds.format('gap')}) OVER w + coalesce(sum({feeds.format('whole')}) OVER (PARTITION BY {columns} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""{name} AS (SELECT *, start_line + {feeds.format('whole')} AS end_line FROM (SELECT *, ({before})::INT AS start_line FROM (
      SELECT *, {at} FROM (SELECT *, unnest(range(1, len(l_whole) + 1)) AS i FROM (SELECT {columns}, {lists} FROM {source}))) WINDOW w AS (PARTITION BY {columns} ORDER BY i)))"""


VISIBILITY = r"coalesce(nullif(regexp_extract(attributes, '\b(public|private|internal|external)\b', 1), ''), 'public')"
FUNCTIONS = f"{FILES}, {found('functions', FUNCTION, 'name', 'parameters', 'attributes', 'body')}"


@query(rf"""WITH {FUNCTIONS}, b AS (SELECT *, regexp_replace(regexp_extract(whole, '(?s)\{{(.*)\}}', 1), '^\s+|\s+$', '', 'g') AS inner_body FROM functions)
SELECT file_id, name, (i - 1)::INT AS ordinal, start_line, end_line::INT AS end_line, {VISIBILITY} AS visibility, contains(attributes, 'view') AS is_view, contains(attributes, 'pure') AS is_pure, contains(attributes, 'payable') AS is_payable,
  inner_body = '' OR len(string_split(inner_body, ';')) + len(string_split(inner_body, chr(10) || chr(10))) - 1 <= 3 AS is_empty, len(list_filter(string_split(whole, chr(10)), lambda x: x <> ''))::INT AS loc,
  regexp_replace(name || '(' || array_to_string(list_transform(list_filter(string_split(parameters, ','), lambda p: trim(p) <> ''), lambda p: regexp_extract(trim(p), '^\S+')), ',') || ') returns(' ||
   array_to_string(list_transform(list_filter(string_split(regexp_extract(attributes, 'returns\s*\(([^)]*)\)', 1), ','), lambda p: trim(p) <> ''), lambda p: trim(p)), ',') || ')', 'int\d+', 'int', 'g') AS signature
FROM b""")
def code_functions(spark, sf_dir):
    return C.functions(files(spark, sf_dir)).drop("whole", "parameters", "attributes", "body")


@query(rf"""WITH {FILES}, {found('modifiers', rf'\bmodifier\s+(\w+)\s*\(([^)]*)\)\s*({BLOCK})', 'name', 'parameters', 'body')}, {found('events', r'\bevent\s+(\w+)\s*\(([^)]*)\)\s*;', 'name', 'parameters')}
SELECT file_id, 'modifier' AS kind, name, trim(parameters) AS parameters, '' AS indexed, start_line, end_line::INT AS end_line FROM modifiers UNION ALL
SELECT file_id, 'event', name, trim(parameters), array_to_string(list_transform(list_filter(string_split(parameters, ','), lambda p: contains(p, 'indexed')), lambda p: regexp_extract(trim(p), '(\S+)$', 1)), ','), start_line, end_line::INT FROM events""")
def code_modifiers_events(spark, sf_dir):
    given = files(spark, sf_dir)
    modifiers = C.modifiers(given).select("file_id", F.lit("modifier").alias("kind"), "name", "parameters", F.lit("").alias("indexed"), "start_line", "end_line")
    return modifiers.unionByName(C.events(given).select("file_id", F.lit("event").alias("kind"), "name", "parameters", F.array_join("indexed", ",").alias("indexed"), "start_line", "end_line"))


CONTRACTS = f"{FILES}, " + found("contracts", rf"\b(contract|interface|library)\s+(\w+)(?:\s+is\s+([^{{]*?))?\s*({BLOCK})", "kind", "name", "bases", "body")
PARENTS = r"list_filter(list_transform(string_split(coalesce(bases, ''), ','), lambda p: regexp_extract(p, '\w+')), lambda p: p <> '')"


@query(rf"""WITH {CONTRACTS} SELECT file_id, kind, name, array_to_string({PARENTS}, ',') AS parents, start_line, end_line::INT AS end_line FROM contracts""")
def code_contracts(spark, sf_dir):
    return C.contracts(files(spark, sf_dir)).select("file_id", "kind", "name", F.array_join("parents", ",").alias("parents"), "start_line", "end_line")


@query(rf"""WITH {CONTRACTS}, e AS (SELECT DISTINCT name AS child, unnest({PARENTS}) AS parent FROM contracts)
SELECT 'edge' AS what, child AS a, parent AS b FROM e UNION ALL SELECT 'node', name, min(kind) FROM contracts GROUP BY name UNION ALL SELECT DISTINCT 'node', parent, 'external' FROM e WHERE parent NOT IN (SELECT name FROM contracts)""")
def inheritance_graph(spark, sf_dir):
    nodes, edges = C.inheritance(files(spark, sf_dir))
    return edges.select(F.lit("edge").alias("what"), F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(nodes.select(F.lit("node").alias("what"), F.col("name").alias("a"), F.col("kind").alias("b")))


@query(rf"""WITH {FILES} SELECT file_id, regexp_replace(regexp_extract(line, '^[^;]*;'), '\s+', ' ', 'g') AS declaration FROM (
  SELECT file_id, regexp_replace(unnest(string_split(string_split(content, 'function')[1], chr(10))), '^\s+|\s+$', '', 'g') AS line FROM files)
WHERE contains(line, ';') AND NOT starts_with(line, 'event') AND NOT starts_with(line, 'error') AND regexp_matches(line, '^(mapping[^;]+|[A-Za-z_]\w*(\[\])?)\s+[^;]*\w[^;]*;')""")
def code_state_variables(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.explode(C.state_variables(F.col("content"))).alias("declaration"))


# a block's start and end, and lines outside of blocks: without look-behind, "://" is hidden first
@query(rf"""WITH {FILES}, hidden AS (SELECT file_id, replace(content, '://', ':..') AS content FROM files), {found('c', r'/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*', source='hidden')}
SELECT file_id, CASE WHEN starts_with(whole, '/**') THEN 'natspec' ELSE 'block' END AS kind, regexp_replace(regexp_replace(whole[3:len(whole) - 2], '(?m)^\s*\*+ ?', '', 'g'), '^\s+|\s+$', '', 'g') AS text, start_line, end_line::INT AS end_line FROM c WHERE starts_with(whole, '/*')
UNION ALL SELECT file_id, 'inline', replace(trim(regexp_replace(whole, '^///?', '')), ':..', '://'), start_line, end_line::INT FROM c WHERE starts_with(whole, '//')
UNION ALL SELECT file_id, 'natspec', replace(trim(whole[4:]), ':..', '://'), start_line, end_line::INT FROM c WHERE starts_with(whole, '///')""")
def code_comments(spark, sf_dir):
    return C.comments(files(spark, sf_dir))


@query(rf"""WITH {FILES} SELECT file_id, tag, CASE WHEN tag = 'param' THEN regexp_extract(rest, '^\S+') END AS name, CASE WHEN tag = 'param' THEN trim(regexp_replace(rest, '^\S+', '')) ELSE rest END AS text FROM (
  SELECT file_id, regexp_extract(t, '^@(\w+)', 1) AS tag, trim(regexp_extract(t, '^@\w+\s+(.*)$', 1)) AS rest FROM (SELECT file_id, unnest(regexp_extract_all(content, '@\w+[ \t]+[^@\n]*')) AS t FROM files))""")
def code_natspec(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.explode(C.natspec(F.col("content"))).alias("n")).select("file_id", "n.*")


LINES = "lines AS (SELECT file_id, generate_subscripts(l, 1)::INT AS line_no, unnest(l) AS line FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM files))"
CONTROL = " UNION ALL ".join(f"SELECT file_id, line_no, '{k}' AS category, trim(line) AS line FROM lines WHERE regexp_matches(line, {_literal(p)})" for k, p in C.CONTROL.items())


@query(f"WITH {FILES}, {LINES} {CONTROL}")
def code_control_flow(spark, sf_dir):
    return C.control_flow(files(spark, sf_dir))


SOURCES = rf"""sources AS (SELECT file_id, 'parameter' AS type, name, start_line, start_line AS end_line, whole AS code FROM (SELECT file_id, start_line, whole, unnest(list_transform(string_split(parameters, ','), lambda p: regexp_extract(trim(p), '(\S+)$', 1))) AS name FROM functions WHERE {VISIBILITY} IN ('public', 'external')) WHERE name <> ''
  UNION ALL SELECT DISTINCT file_id, CASE WHEN starts_with(name, 'msg.') THEN 'msg_property' ELSE 'tx_property' END, name, line_no, line_no, line FROM (SELECT file_id, line_no, line, unnest(regexp_extract_all(line, '\b(msg\.sender|msg\.value|msg\.data|tx\.origin)\b', 1)) AS name FROM lines))"""
SINKS = "sinks AS (" + " UNION ALL ".join(f"SELECT file_id, '{t}' AS type, regexp_extract(line, {_literal(p)}, 1) AS name, '{v}' AS vulnerability, {s}::DOUBLE AS score, line_no AS start_line, line_no AS end_line, line AS code FROM lines WHERE regexp_matches(line, {_literal(p)})" for t, p, v, s in C.SINKS) + ")"
VARIABLES = r"""variables AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(regexp_replace(condition, '"[^"]*"', '', 'g'), '\b([A-Za-z_]\w*)\b', 1)) AS name FROM (SELECT file_id, unnest(regexp_extract_all(content, '\b(?:if|while|for|require|assert)\s*\(([^;{}]*)\)', 1)) AS condition FROM files))"""


@query(f"WITH {FUNCTIONS}, {LINES}, {SOURCES}, {SINKS}, {VARIABLES} SELECT file_id, 'source' AS role, type AS kind, name, start_line AS line FROM sources UNION ALL SELECT file_id, 'sink', type || '/' || vulnerability, name, start_line FROM sinks UNION ALL SELECT file_id, 'variable', '', name, NULL FROM variables")
def taint_nodes(spark, sf_dir):
    given = files(spark, sf_dir)
    out = C.sources(given).select("file_id", F.lit("source").alias("role"), F.col("type").alias("kind"), "name", F.col("start_line").alias("line"))
    out = out.unionByName(C.sinks(given).select("file_id", F.lit("sink").alias("role"), F.concat_ws("/", "type", "vulnerability").alias("kind"), "name", F.col("start_line").alias("line")))
    return out.unionByName(C.control_variables(given).select("file_id", F.lit("variable").alias("role"), F.lit("").alias("kind"), "name", F.lit(None).cast("int").alias("line")))


@query(rf"""WITH {FUNCTIONS}, {LINES}, {SOURCES}, {SINKS}, {VARIABLES},
p AS (SELECT s.file_id, s.name AS source, s.type, s.start_line AS source_line, s.code AS source_code, k.name AS sink, k.vulnerability, k.score, k.start_line AS sink_line, k.code AS sink_code, f.name AS function, f.start_line AS f_start, f.whole,
   row_number() OVER (PARTITION BY s.file_id, s.name, s.type, s.start_line, k.name, k.vulnerability, k.start_line ORDER BY f.start_line, f.end_line DESC) AS r
  FROM sources s JOIN sinks k ON k.file_id = s.file_id AND s.start_line <= k.start_line JOIN functions f ON f.file_id = s.file_id AND f.start_line <= s.start_line AND f.end_line >= k.end_line AND f.start_line <= k.start_line AND f.end_line >= s.end_line),
a AS (SELECT p.*, (SELECT list(v.name ORDER BY v.name) FROM variables v WHERE v.file_id = p.file_id AND (contains(p.source_code, v.name) OR contains(p.whole, v.name) OR contains(p.sink_code, v.name))) AS names FROM p WHERE r = 1),
f2 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY source_line, source, sink_line, sink, vulnerability) AS n FROM a WHERE len(names) >= 2)
SELECT file_id, source, source_line, sink, sink_line, vulnerability, function, array_to_string(names, ',') AS variables,
  least(10.0, 5.0 + score + CASE WHEN source IN ('msg.sender', 'msg.value', 'tx.origin') THEN 1.5 ELSE 0 END + least(len(names) * 0.5, 2.0))::DOUBLE AS exploitability,
  (SELECT count(*) FROM f2 e WHERE e.file_id = f2.file_id AND e.n < f2.n AND list_has_any([e.source_line, e.f_start, e.sink_line], [f2.source_line, f2.f_start, f2.sink_line]))::INT AS shared FROM f2""")
def taint_flows(spark, sf_dir):
    return taint.data_flows(files(spark, sf_dir)).withColumn("variables", F.array_join("variables", ","))


@query(rf"""WITH {FUNCTIONS} SELECT DISTINCT a.file_id, a.name AS caller, b.name AS callee FROM functions a JOIN functions b ON a.file_id = b.file_id AND a.name <> b.name AND regexp_matches(a.body, '\b' || b.name || '\s*\(')""")
def call_graph_in_files(spark, sf_dir):
    return taint.call_edges(C.functions(files(spark, sf_dir)), ["file_id"])


WITHIN = rf"""WITH {CONTRACTS}, {found('functions', FUNCTION, 'fname', 'parameters', 'attributes', 'fbody', source='(SELECT file_id, name, body FROM contracts)', columns='file_id, name', text='body')},
one AS (SELECT DISTINCT floor(greatest(file_id, -1) / 10)::BIGINT AS project, name, fname, fbody FROM functions)"""


@query(rf"""{WITHIN}, c AS (SELECT project, name, fname, unnest(regexp_extract_all(fbody, '\b(\w+)\s*\(', 1)) AS callee FROM one)
SELECT DISTINCT a.project, a.name AS caller_contract, a.fname AS caller, b.name AS callee_contract, b.fname AS callee FROM c a JOIN one b ON a.project = b.project AND a.callee = b.fname""")
def call_graph_across_contracts(spark, sf_dir):
    """Ten files are a project: calls by name across its contracts, a function's own included."""
    found = C.contracts(files(spark, sf_dir)).select(F.floor(F.greatest("file_id", F.lit(-1)) / 10).alias("project"), F.col("name").alias("contract"), F.col("body").alias("content"))
    functions = C.functions(found).select("project", "contract", "name", "body")
    called = functions.select("project", F.col("contract").alias("caller_contract"), F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("callee"))
    return called.join(functions.select("project", F.col("contract").alias("callee_contract"), F.col("name").alias("callee")).distinct(), ["project", "callee"]).distinct()


@query(rf"""WITH {FUNCTIONS} SELECT caller.file_id, caller.name FROM functions caller WHERE caller.name <> 'helper' AND regexp_matches(caller.body, '\bhelper\s*\(')""")
def callers_of(spark, sf_dir):
    edges = taint.call_edges(C.functions(files(spark, sf_dir)), ["file_id"])
    return taint.callers(edges, "helper").select("file_id", F.col("caller").alias("name"))


@query(rf"""WITH {FUNCTIONS}, u AS (SELECT unnest(regexp_extract_all(body, '\b(\w+)\s*\(', 1)) AS callee FROM functions WHERE name = 'run')
SELECT f.file_id, f.name, f.start_line FROM functions f WHERE f.name IN (SELECT callee FROM u)""")
def callees_of(spark, sf_dir):
    """Definitions, in all files, of the names that run calls; an ambiguous name gives all of them."""
    functions = C.functions(files(spark, sf_dir)).select("file_id", "name", "body", "start_line")
    edges = functions.select(F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("callee"))
    return taint.callees(edges, functions, "run").select("file_id", "name", "start_line")


@query(rf"""WITH {FUNCTIONS}, s AS (SELECT name || '_' || file_id % 7 AS name, replace(replace(whole, 'helper', 'helper_' || file_id % 7), 'pay(', 'pay_' || file_id % 5 || '(') AS content FROM functions WHERE file_id >= 0 OR file_id = -1),
w AS (SELECT DISTINCT name AS src, unnest(regexp_extract_all(lower(content), '\w+')) AS word FROM s), e AS (SELECT DISTINCT src, n.name AS dst FROM w JOIN (SELECT DISTINCT name FROM s) n ON lower(n.name) = word WHERE src <> n.name)
SELECT n.name, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM e WHERE dst = n.name), '') AS upstream, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = n.name), '') AS downstream FROM (SELECT DISTINCT name FROM s) n""")
def function_relationships(spark, sf_dir):
    """Functions of all files, under names by file, and which mention which."""
    own = C.functions(files(spark, sf_dir)).where("file_id >= 0 or file_id = -1")
    number = lambda n: F.concat(F.lit("_"), (F.col("file_id") % n).cast("string"))
    renamed = F.replace(F.replace(F.col("whole"), F.lit("helper"), F.concat(F.lit("helper"), number(7))), F.lit("pay("), F.concat(F.lit("pay"), number(5), F.lit("(")))
    own = own.select(F.concat("name", number(7)).alias("name"), renamed.alias("content"))
    return taint.relationships(own).select("name", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


@query(f"""WITH {FUNCTIONS} SELECT file_id, (i - 1)::INT AS chunk_index, name, start_line, end_line::INT AS end_line, md5(whole) AS digest FROM functions""")
def code_function_chunks(spark, sf_dir):
    return chunking.function_chunks(files(spark, sf_dir)).select("file_id", "chunk_index", "name", "start_line", "end_line", F.md5("code").alias("digest"))


@query(rf"""WITH {CONTRACTS}, {found('functions', FUNCTION, 'fname', 'parameters', 'attributes', 'fbody', source='(SELECT file_id, name, whole AS body FROM contracts WHERE len(whole) > 400)', columns='file_id, name, body', text='body')}
SELECT file_id, 'full_contract' AS kind, md5(content) AS digest FROM files WHERE len(content) BETWEEN 1 AND 400
UNION ALL SELECT c.file_id, 'contract', md5(whole) FROM contracts c JOIN files f USING (file_id) WHERE len(f.content) > 400 AND len(whole) <= 400
UNION ALL SELECT file_id, 'contract_declaration', md5(substr(body, 1, strpos(body, whole) - 1)) FROM functions WHERE i = 1
UNION ALL SELECT file_id, 'function', md5(whole) FROM functions WHERE len(whole) <= 400""")
def code_hierarchical_chunks(spark, sf_dir):
    """Whole files, contracts, declarations and functions within 400 characters; parts of longer functions are held against
    loops in the tests."""
    return chunking.hierarchical_chunks(files(spark, sf_dir), 400).where("kind <> 'function_part'").select("file_id", "kind", F.md5("code").alias("digest"))


@query(f"""WITH {FUNCTIONS}, c AS (SELECT * FROM files WHERE file_id > 0) SELECT c.file_id, CASE WHEN len(c.content) <= 480 THEN 'contract' ELSE 'function' END AS kind, CASE WHEN len(c.content) > 480 THEN f.name END AS name, md5(CASE WHEN len(c.content) <= 480 THEN c.content ELSE f.whole END) AS digest
FROM c JOIN functions f USING (file_id) WHERE len(c.content) > 480 OR f.i = 1""")
def code_cascade_chunks(spark, sf_dir):
    """Of the files made from parts, each a contract: whole within 480 characters, else its functions. Packed lines and what is
    over the limit are held against loops in the tests."""
    made = files(spark, sf_dir).where("file_id > 0")
    return chunking.cascade_chunks(made, 480).select("file_id", "kind", "name", F.md5("code").alias("digest"))


#: A file a part, with blocks as deep as its size, and braces in strings and comments.
NESTED = """concat('contract N', cast(p_partkey AS string), ' { // } {', chr(10), ' string s = "}{";', chr(10), ' function f() public ', repeat(concat('{', chr(10)), p_size), ' x; ', repeat(concat('}', chr(10)), p_size),
 ' function g() { /* } */ } }')"""


@query("""SELECT p_partkey AS file_id, name, start_line::INT AS start_line, end_line::INT AS end_line FROM part, LATERAL (
  VALUES ('f', 3, 2 * p_size + 2), ('g', 2 * p_size + 3, 2 * p_size + 3), ('N' || p_partkey, 1, 2 * p_size + 3), ('blocks and depth', p_size + 2, p_size + 1)) v(name, start_line, end_line)""")
def code_nested_blocks(spark, sf_dir):
    """Functions, contracts and blocks of any depth, whatever strings and comments hold."""
    files = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("file_id"), F.expr(NESTED).alias("content"))
    columns = ["file_id", "name", "start_line", "end_line"]
    blocks = files.select("file_id", S.blocks(S.masked(F.col("content"))).alias("b"))
    counts = blocks.select("file_id", F.lit("blocks and depth").alias("name"), F.size("b").alias("start_line"), F.array_max(F.transform("b", lambda b: b["depth"])).alias("end_line"))
    return C.functions(files).select(*columns).unionByName(C.contracts(files).select(*columns)).unionByName(counts)


#: A file a part: functions that call each other in a row, every other one open; the last has the sink and calls the first again.
CHAIN = """concat('contract P { ', array_join(transform(sequence(0, p_size % 6), i -> concat('function f', cast(i AS string), '(uint a', cast(i AS string), ') ', if(i % 2 = 0, 'external', 'internal'), ' { ',
 if(i < p_size % 6, concat('uint b', cast(i AS string), ' = a', cast(i AS string), ' + 1; f', cast(i + 1 AS string), '(b', cast(i AS string), '); }'), concat('if (a', cast(i AS string), ' > 0) { f0(a', cast(i AS string), '); } to.transfer(a', cast(i AS string), '); }')))), ' '), ' }')"""


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS file_id, p_size % 6 AS k FROM part),
e AS (SELECT file_id, 2 * i AS src, 2 * i + 1 AS dst FROM p, LATERAL unnest(range(k)) t(i) UNION ALL SELECT file_id, 2 * i + 1, 2 * i + 2 FROM p, LATERAL unnest(range(k)) t(i) UNION ALL SELECT file_id, 2 * k, 0 FROM p WHERE k > 0),
r(file_id, node, steps) AS (SELECT file_id, 2 * k, 0 FROM p UNION SELECT e.file_id, e.src, r.steps + 1 FROM r JOIN e ON e.file_id = r.file_id AND e.dst = r.node WHERE r.steps < 13)
SELECT file_id, 'f' || node // 2 AS function, 'a' || node // 2 AS variable, 'f' || k AS sink_function, 'reentrancy' AS vulnerability, min(steps)::INT AS steps FROM r JOIN p USING (file_id) WHERE node % 4 = 0 GROUP BY file_id, node, k""")
def flows_across_functions(spark, sf_dir):
    """What can be chosen from outside and reaches a sink in another function, through calls that recur."""
    files = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("file_id"), F.expr(CHAIN).alias("content"))
    return dataflow.flows_across(files).select("file_id", "function", "variable", "sink_function", "vulnerability", "steps")
