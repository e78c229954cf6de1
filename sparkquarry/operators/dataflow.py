"""Data flow between functions: what is defined and used in statements, arguments and results of calls, and a fixpoint over them.

A node is a variable in a function, or a state variable of the file, whose function is empty. Edges are found by expressions over
masked code; which sources reach which sinks follows semi-naively: each round joins what was found last with the edges and
keeps what is new, so recursive calls end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions.structure import bound, masked
from ..shared import dropped, written

#: How statements of the language define, declare, return and call, and its variables.
NAME = r"(?<![\w.])(?:msg\.(?:sender|value|data)|tx\.origin|[A-Za-z_]\w*)"
ASSIGNED = r"^\s*(?:[A-Za-z_][\w.]*(?:\[\w*\])*\s+)*([A-Za-z_]\w*)(?:\[[^\]]*\]|\.\w+)*\s*(?:[-+*/%|&^]|<<|>>)?=(?![=>])"
DECLARED = r"^\s*(?!return\b|else\b|emit\b|new\b|delete\b)[A-Za-z_][\w.]*(?:\[\w*\])*\s+(?:(?:memory|storage|calldata|payable)\s+)*([A-Za-z_]\w*)\s*(?:=(?![=>])|$)"
RETURNED = r"^\s*return\b"
CALLED = r"(?<![\w.])([A-Za-z_]\w*)\s*\(((?:[^()]|\([^()]*\))*)\)"
INNER = r"(?<![\w.])([A-Za-z_]\w*)\s*\(([^()]*)\)"
#: Sinks by what a statement calls: pattern and what it is prone to.
SINKS = ((r"\.(?:transfer|send|call)\s*(?:\{[^}]*)?\(?", "reentrancy"), (r"\.delegatecall\b", "code_injection"), (r"\bselfdestruct\s*\(", "contract_destruction"))
#: Variables whose values callers choose, in any function.
GIVEN = r"^(?:msg\.(?:sender|value|data)|tx\.origin)$"


def names_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)))


def _some(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def statements(files: DataFrame, file_col: str = "file_id", text_col: str = "content") -> DataFrame:
    """(file, function, open, parameters, locals, at, statement): the statements of each function in order, without strings and
    comments; ``open`` if callers from outside can call it, ``locals`` its parameters and what it declares."""
    found = C.functions(files.select(file_col, text_col), text_col)
    parameters = F.filter(F.transform(F.split("parameters", ","), lambda p: F.regexp_extract(p, r"(\w+)\s*$", 1)), lambda p: p != "")
    parts = F.split(F.regexp_replace(masked(F.col("body")), r"(\.\w+)\s*\{([^{};]*)\}", "$1 $2 "), r"[;{}]")
    own = found.select(file_col, F.col("name").alias("function"), F.col("visibility").isin("public", "external").alias("open"), parameters.alias("parameters"), F.transform(parts, lambda s: F.regexp_replace(s, r"\s+", " ")).alias("parts"))
    declared = F.filter(F.transform("parts", lambda s: F.regexp_extract(s, DECLARED, 1)), lambda v: v != "")
    own = own.withColumn("locals", F.array_union("parameters", declared))
    return own.select(file_col, "function", "open", "parameters", "locals", F.posexplode("parts").alias("at", "statement")).where("trim(statement) <> ''")


def _scope(name: Column, function: Column, local: Column) -> Column:
    """The function of a variable's node: of its own if it is local or given by the caller, else none."""
    return F.when(F.array_contains(local, name) | name.rlike(GIVEN) | (name == "return"), function).otherwise("")


def flow_edges(found: DataFrame, file_col: str = "file_id") -> DataFrame:
    """(file, f, v, to_f, to_v): the value of a variable may reach another, by assignment, argument or result.

    The result of a function is its variable ``return``; where it is called, it is a variable of the function's name.
    """
    s = F.col("statement")
    node = lambda c: F.struct(_scope(c, F.col("function"), F.col("locals")).alias("f"), c.alias("v"))
    calls = F.array_distinct(F.concat(*(F.arrays_zip(F.regexp_extract_all(s, F.lit(p), F.lit(1)).alias("g"), F.regexp_extract_all(s, F.lit(p), F.lit(2)).alias("args")) for p in (CALLED, INNER))))
    rows = found.withColumns({"target": F.when(s.rlike(RETURNED), "return").otherwise(_some(F.regexp_extract(s, ASSIGNED, 1))), "calls": calls})

    moved = rows.where("target is not null").select(file_col, F.explode(names_in(s)).alias("name"), "target", "function", "locals")
    moved = moved.select(file_col, node(F.col("name")).alias("a"), node(F.col("target")).alias("b"))

    called = rows.select(file_col, "function", "locals", F.explode("calls").alias("c"))
    args = called.select(file_col, "function", "locals", F.col("c.g").alias("g"), F.split("c.args", r",(?![^()]*\))").alias("args"))
    known = found.select(file_col, F.col("function").alias("g"), "parameters").distinct()
    met = args.join(known, [file_col, "g"]).where((F.size("args") == F.size("parameters")) | ((F.size("parameters") == 0) & (F.trim(F.get("args", F.lit(0))) == "")))
    given = met.select(file_col, "function", "locals", "g", F.explode(F.arrays_zip("args", "parameters")).alias("z"))
    given = given.select(file_col, "function", "locals", "g", F.col("z.parameters").alias("p"), F.explode(names_in(F.col("z.args"))).alias("name"))
    passed = given.select(file_col, node(F.col("name")).alias("a"), F.struct(F.col("g").alias("f"), F.col("p").alias("v")).alias("b"))
    result = met.select(file_col, F.struct(F.col("g").alias("f"), F.lit("return").alias("v")).alias("a"), F.struct(_scope(F.col("g"), F.col("function"), F.col("locals")).alias("f"), F.col("g").alias("v")).alias("b"))
    every = moved.unionByName(passed).unionByName(result).where("a <> b")
    return every.select(file_col, "a.f", "a.v", F.col("b.f").alias("to_f"), F.col("b.v").alias("to_v")).distinct()


def sink_uses(found: DataFrame, file_col: str = "file_id") -> DataFrame:
    """(file, f, v, sink_function, sink, vulnerability): variables that a statement with a sink uses."""
    kinds = F.array_compact(F.array(*(F.when(F.col("statement").rlike(p), F.lit(k)) for p, k in SINKS)))
    uses = found.select(file_col, "function", "locals", F.trim("statement").alias("sink"), F.explode(kinds).alias("vulnerability"), names_in(F.col("statement")).alias("names"))
    uses = uses.select(file_col, "function", "locals", "sink", "vulnerability", F.explode("names").alias("v"))
    return uses.select(file_col, _scope(F.col("v"), F.col("function"), F.col("locals")).alias("f"), "v", F.col("function").alias("sink_function"), "sink", "vulnerability").distinct()


def reaching(edges: DataFrame, ends: DataFrame, scope: list[str], node: list[str], following: list[str], end: list[str]) -> DataFrame:
    """(scope, node, end, steps, path): all nodes from which an end of the same scope can be reached, with the least number of edges
    and, of such, the least path.

    ``edges`` has scope, node and following, ``ends`` has scope, node and end; keys aren't null. Each round goes one edge back from
    what was found last; what is known already is left out, so cycles end, after as many rounds as the longest shortest path has edges.
    """
    made: list[str] = []
    name, keys = F.concat_ws(".", *node), [*scope, *node, *end]
    back = written(edges.select(*scope, *node, *following).distinct(), made)
    last = written(ends.select(*keys).distinct().select(*keys, F.lit(0).alias("steps"), F.array(name).alias("path")), made)
    found, number = last, 0
    while not last.isEmpty():
        number += 1
        ahead = last.drop("steps").withColumnsRenamed(dict(zip(node, following)))
        fresh = back.join(ahead, [*scope, *following]).select(*keys, F.concat(F.array(name), "path").alias("path")).groupBy(*keys).agg(F.min("path").alias("path"))
        last = written(fresh.join(found.select(*keys), keys, "left_anti").select(*keys, F.lit(number).alias("steps"), "path"), made)
        found = found.unionByName(last)
    out = written(found)
    dropped(edges.sparkSession, made)
    return out


def summaries(files: DataFrame, file_col: str = "file_id", text_col: str = "content") -> DataFrame:
    """(file, function, variable, sink_function, sink, vulnerability, steps, path): parameters of functions, and values that callers choose,
    that reach a sink, in the same function or in any that calls lead to, by state variables and results too."""
    found = statements(files, file_col, text_col)
    made: list[str] = []
    found = written(found, made)
    end = ["sink_function", "sink", "vulnerability"]
    reached = reaching(flow_edges(found, file_col), sink_uses(found, file_col), [file_col], ["f", "v"], ["to_f", "to_v"], end)
    parameters = found.select(file_col, F.col("function").alias("f"), F.explode("parameters").alias("v"), "open").distinct()
    given = found.select(file_col, F.col("function").alias("f"), F.explode(names_in(F.col("statement"))).alias("v"), F.lit(True).alias("open")).where(F.col("v").rlike(GIVEN)).distinct()
    out = written(parameters.unionByName(given).join(reached, [file_col, "f", "v"]).select(file_col, F.col("f").alias("function"), F.col("v").alias("variable"), *end, "steps", "path", "open"))
    dropped(files.sparkSession, made)
    return out


def flows_across(files: DataFrame, file_col: str = "file_id", text_col: str = "content") -> DataFrame:
    """summaries() of what can be chosen from outside: parameters of open functions, and the message's and transaction's properties."""
    return summaries(files, file_col, text_col).where("open").drop("open")
