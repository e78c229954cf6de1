"""Extraction from contract code: functions, modifiers, events, contracts, comments, control flow, taint, all with line numbers.

All are expressions over a text column, of built-in functions but for headers with their blocks; table functions explode them to one row a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import to_workers
from .structure import headed, masked, newlines, spans

#: How the language writes functions, modifiers, events and contracts.
FUNCTION = r"\bfunction\s+(\w+)\s*\(([^)]*)\)([^{};]*)"
MODIFIER = r"\bmodifier\s+(\w+)\s*\(([^)]*)\)\s*"
EVENT = r"\bevent\s+(\w+)\s*\(([^)]*)\)\s*;"
CONTRACT = r"\b(contract|interface|library)\s+(\w+)(?:\s+is\s+([^{;]*?))?\s*"


def rows_of(files: DataFrame, text_col: str, pattern: str, *names: str, scan: Column | None = None) -> DataFrame:
    """One row a match in ``scan``, the text by default: ordinal, start_line, end_line, whole, groups by name, beside the columns
    of files but the text."""
    kept = [c for c in files.columns if c != text_col]
    found = spans(F.col(text_col) if scan is None else scan, pattern, *names)
    return files.select(*kept, F.posexplode(found).alias("ordinal", "m")).select(*kept, "ordinal", "m.start_line", "m.end_line", "m.whole", *(f"m.{n}" for n in names))


def blocks_of(files: DataFrame, text_col: str, header: str, *names: str) -> DataFrame:
    """One row a header with its block, at any depth, beside the columns of files but the text."""
    to_workers(files.sparkSession)
    kept = [c for c in files.columns if c != text_col]
    found = files.select(*kept, F.explode(headed(F.col(text_col), header, *names)).alias("m"))
    return found.select(*kept, "m.ordinal", "m.start_line", "m.end_line", "m.whole", *(f"m.{n}" for n in names), "m.body")


# Functions


def is_empty_function(code: Column) -> Column:
    """Whether a function has no braces, nothing in them, or at most three parts: statements' ends and blank lines."""
    body = F.trim(F.regexp_extract(code, r"(?s)\{(.*)\}", 1))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    parts = F.size(F.split(body, ";")) + F.size(F.split(body, "\n\n")) - 1
    return ~code.contains("{") | (body == "") | (parts <= 3)


def lines_of_code(code: Column) -> Column:
    return F.size(F.filter(F.split(code, r"\r\n|[\n\r]"), lambda x: x != ""))


def signature(name: Column, parameters: Column, attributes: Column) -> Column:
    """name(types) returns(types), sizes of integers left out."""
    types = F.transform(F.filter(F.split(parameters, ","), lambda p: F.trim(p) != ""), lambda p: F.split(F.trim(p), r"\s+")[0])
    returned = F.transform(F.filter(F.split(F.regexp_extract(attributes, r"returns\s*\(([^)]*)\)", 1), ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p))
    return F.regexp_replace(F.concat(name, F.lit("("), F.array_join(types, ","), F.lit(") returns("), F.array_join(returned, ","), F.lit(")")), r"int\d+", "int")


def functions(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a function: name, parameters, attributes, body, lines, visibility (public by default), flags of its attributes,
    is_empty, loc and signature. Bodies are whole, at any depth; what stands in strings and comments isn't code."""
    rows = blocks_of(files, text_col, FUNCTION, "name", "parameters", "attributes")
    visibility = F.coalesce(F.nullif(F.regexp_extract("attributes", r"\b(public|private|internal|external)\b", 1), F.lit("")), F.lit("public"))
    flags = {f"is_{w}": F.col("attributes").contains(w) for w in ("view", "pure", "payable")}
    return rows.withColumns({"visibility": visibility, **flags, "is_empty": is_empty_function(F.col("whole")), "loc": lines_of_code(F.col("whole")), "signature": signature(F.col("name"), F.col("parameters"), F.col("attributes"))})


def modifiers(files: DataFrame, text_col: str = "content") -> DataFrame:
    return blocks_of(files, text_col, MODIFIER, "name", "parameters").withColumn("parameters", F.trim("parameters"))


def indexed_parameters(parameters: Column) -> Column:
    """Names of the parameters that are marked as indexed."""
    marked = F.filter(F.split(parameters, ","), lambda p: p.contains("indexed"))
    return F.transform(marked, lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1))


def events(files: DataFrame, text_col: str = "content") -> DataFrame:
    return rows_of(files, text_col, EVENT, "name", "parameters", scan=masked(F.col(text_col))).withColumn("indexed", indexed_parameters(F.col("parameters"))).withColumn("parameters", F.trim("parameters"))


def contracts(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a contract, interface or library: kind, name, parents (array), body, lines."""
    rows = blocks_of(files, text_col, CONTRACT, "kind", "name", "bases")
    parents = F.filter(F.transform(F.split(F.coalesce("bases", F.lit("")), ","), lambda p: F.regexp_extract(p, r"\w+", 0)), lambda p: p != "")
    return rows.withColumn("parents", parents).drop("bases")


def inheritance(files: DataFrame, text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Nodes (name, kind), once each, unknown parents as ``external``, and edges (child, parent)."""
    found = contracts(files, text_col)
    edges = found.select(F.col("name").alias("child"), F.explode("parents").alias("parent")).distinct()
    known = found.groupBy("name").agg(F.min("kind").alias("kind"))
    outside = edges.select(F.col("parent").alias("name")).distinct().join(known.select("name"), "name", "left_anti").withColumn("kind", F.lit("external"))
    return known.unionByName(outside), edges


def state_variables(code: Column) -> Column:
    """Array of the declarations before the first function: lines with a semicolon that aren't events, errors or headers."""
    head = F.split(code, "function", 2)[0]
    lines = F.transform(F.split(head, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: x.contains(";") & ~x.startswith("event") & ~x.startswith("error") & x.rlike(r"^(mapping[^;]+|[A-Za-z_]\w*(\[\])?)\s+[^;]*\w[^;]*;"))
    return F.transform(kept, lambda x: F.regexp_replace(F.regexp_extract(x, r"^[^;]*;", 0), r"\s+", " "))


# Lines


def lines(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a line: line_no from 1, line."""
    kept = [c for c in files.columns if c != text_col]
    return files.select(*kept, F.posexplode(F.split(text_col, "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")


def comments(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a comment: kind (block, inline or natspec), text, start_line, end_line. A ``///`` line gives an inline and a
    natspec row; ``//`` or ``/*`` inside a block or a string, or after ``:`` as in an address, opens none."""
    pattern = r"/\*(?s:(.*?))\*/|(?<!:)//(/?)([^\n]*)"
    rows = rows_of(files, text_col, pattern, "block", "third", "inline", scan=masked(F.col(text_col), comments=False))
    block = rows.where("whole like '/*%'").select("*", F.when(F.col("whole").startswith("/**"), "natspec").otherwise("block").alias("kind"), F.regexp_replace(F.regexp_replace("block", r"(?m)^\s*\*+ ?", ""), r"^\s+|\s+$", "").alias("text"))
    line = rows.where("whole like '//%'").select("*", F.explode(F.when(F.col("third") == "/", F.array(F.lit("inline"), F.lit("natspec"))).otherwise(F.array(F.lit("inline")))).alias("kind"), F.trim("inline").alias("text"))
    return block.unionByName(line).drop("block", "third", "inline", "whole", "ordinal")


def natspec(text: Column) -> Column:
    """Array of (tag, name, text) of the tags in comments; only parameters have names."""
    tags = F.regexp_extract_all(text, F.lit(r"@(\w+)[ \t]+([^@\n]*)"), F.lit(0))

    def parsed(t: Column) -> Column:
        tag, rest = F.regexp_extract(t, r"^@(\w+)", 1), F.trim(F.regexp_extract(t, r"^@\w+\s+(.*)$", 1))
        named = tag == "param"
        return F.struct(tag.alias("tag"), F.when(named, F.regexp_extract(rest, r"^\S+", 0)).alias("name"), F.when(named, F.trim(F.regexp_replace(rest, r"^\S+", ""))).otherwise(rest).alias("text"))

    return F.transform(tags, parsed)


#: What a line is, by pattern.
CONTROL = {
    "control": r"\b(if|else|for|while|do|switch|try|catch)\b\s*[({]",
    "state_change": r"^\s*[A-Za-z_]\w*(\[[^\]]*\])*(\.\w+)*\s*([-+*/]?=)[^=]",
    "external_call": r"\b\w+\.\w+\s*\(",
    "value_transfer": r"\.(transfer|send)\s*\(|\.call\s*\{\s*value",
    "check": r"\b(require|assert|revert)\s*\(",
}


def control_flow(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row for each line and category that it is of: line_no, category, line without white space around."""
    kinds = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(k)) for k, p in CONTROL.items())))
    return lines(files, text_col).withColumn("category", F.explode(kinds)).withColumn("line", F.trim("line"))


# Taint

#: What user-controlled values are called, and what sinks call and are prone to, with their scores.
SOURCES = r"\b(msg\.sender|msg\.value|msg\.data|tx\.origin)\b"
SINKS = (
    ("external_call", r"\.(transfer|send|call)\s*[({]", "reentrancy", 3.0), ("delegatecall", r"\.(delegatecall)\s*[({]", "code_injection", 4.0),
    ("selfdestruct", r"\b(selfdestruct)\s*\(", "contract_destruction", 5.0), ("assembly", r"\b(assembly)\s*\{", "low_level_operation", 2.0),
    ("state_write", r"^\s*[A-Za-z_]\w*(?:\[[^\]]*\])*\s*([-+*/]?=)[^=]", "state_manipulation", 2.5),
)


def sources(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a source: parameters of public and external functions, over the function's lines; message and transaction properties by line."""
    kept = [c for c in files.columns if c != text_col]
    open_ = functions(files, text_col).where("visibility in ('public', 'external')")
    names = F.filter(F.transform(F.split("parameters", ","), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1)), lambda p: p != "")
    by_parameter = open_.select(*kept, F.lit("parameter").alias("type"), F.explode(names).alias("name"), "start_line", F.col("start_line").alias("end_line"), F.col("whole").alias("code"))
    found = lines(files, text_col).select(*kept, F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(SOURCES), F.lit(1)))).alias("name"), "line_no", "line")
    kind = F.when(F.col("name").startswith("msg."), "msg_property").otherwise("tx_property")
    by_property = found.select(*kept, kind.alias("type"), "name", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("code"))
    return by_parameter.unionByName(by_property)


def sinks(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row a line and kind of sink in it: type, name, vulnerability, score, lines, code."""
    kinds = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(t).alias("type"), F.regexp_extract("line", p, 1).alias("name"), F.lit(v).alias("vulnerability"), F.lit(s).alias("score"))) for t, p, v, s in SINKS)))
    kept = [c for c in files.columns if c != text_col]
    return lines(files, text_col).select(*kept, F.explode(kinds).alias("k"), F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("code")).select(*kept, "k.*", "start_line", "end_line", "code")


def control_variables(files: DataFrame, text_col: str = "content") -> DataFrame:
    """(name) once a file: identifiers in the conditions of if, while, for, require and assert."""
    kept = [c for c in files.columns if c != text_col]
    conditions = F.regexp_extract_all(text_col, F.lit(r"\b(?:if|while|for|require|assert)\s*\(([^;{}]*)\)"), F.lit(1))
    words = F.flatten(F.transform(conditions, lambda c: F.regexp_extract_all(F.regexp_replace(c, r'"[^"]*"', ""), F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1))))
    return files.select(*kept, F.explode(F.array_distinct(words)).alias("name"))
