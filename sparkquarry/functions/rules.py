"""Rules as data: each gives rows where its condition holds. Checks of functions, weak lines, prompts, labelled answers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import code as C


def rule_rows(rows: DataFrame, rules: Sequence[tuple[str, Column, Mapping[str, object]]]) -> DataFrame:
    """One row for each row and rule (name, condition, values) that holds: the row's columns, ``rule``, and the values, of equal names in all rules."""
    names = list(rules[0][2])
    hit = lambda name, values: F.struct(F.lit(name).alias("rule"), *(values[n].alias(n) if isinstance(values[n], Column) else F.lit(values[n]).alias(n) for n in names))
    hits = F.array_compact(F.array(*(F.when(condition, hit(name, values)) for name, condition, values in rules)))
    return rows.select("*", F.explode(hits).alias("__hit")).select(*rows.columns, "__hit.*")


def function_checks(functions: DataFrame) -> DataFrame:
    """Candidate checks of functions (name, visibility, attributes, parameters, body): rule, category, severity, expression."""
    body, open_ = F.col("body"), F.col("visibility").isin("public", "external")
    guarded = F.col("attributes").rlike(r"\bonly\w*|\brequiresAuth\b") | body.contains("msg.sender ==") | body.contains("== msg.sender")
    changes = body.rlike(r"(?m)^\s*[A-Za-z_]\w*(\[[^\]]*\])*\s*[-+*/]?=[^=]")
    calls = body.rlike(r"\.(call|send|transfer|delegatecall)\s*[({]")
    text = lambda t: F.concat(F.lit(t), F.lit(" in "), "name")
    return rule_rows(functions, [
        ("unguarded_change", open_ & changes & ~guarded, {"category": "access_control", "severity": "High", "expression": text("anyone can change state")}),
        ("external_call", calls, {"category": "reentrancy", "severity": "High", "expression": text("state must be final before the call")}),
        ("amount_unchecked", F.col("parameters").contains("amount") & ~body.rlike(r"require\s*\([^;]*amount"), {"category": "validation", "severity": "Medium", "expression": text("amount must be checked")}),
        ("payable", F.col("attributes").contains("payable"), {"category": "value", "severity": "Medium", "expression": text("value must be accounted for")}),
        ("loop", body.rlike(r"\b(for|while)\s*\("), {"category": "gas", "severity": "Low", "expression": text("loop must be bounded")}),
    ])


def flow_checks(facts: DataFrame) -> DataFrame:
    """Candidate checks of joined call facts (function, callers, writes, transfers): what several callers share, and what moves value."""
    return rule_rows(facts, [
        ("shared_resource", (F.col("callers") > 1) & F.col("writes"), {"category": "consistency", "severity": "Medium"}),
        ("value_moves", F.col("transfers"), {"category": "value", "severity": "High"}),
        ("dead_code", F.col("callers") == 0, {"category": "quality", "severity": "Low"}),
    ])


#: Weak lines by pattern, with their severity.
WEAK = (
    ("tx_origin", r"\btx\.origin\b", "High"), ("unchecked_call", r"^\s*\w+(\[[^\]]*\])*\.(call|send)\s*[({]", "Medium"), ("selfdestruct", r"\bselfdestruct\s*\(", "High"),
    ("delegatecall", r"\.delegatecall\s*\(", "High"), ("timestamp", r"\b(block\.timestamp|now)\b", "Low"), ("assembly", r"\bassembly\b", "Low"),
)


def weak_lines(files: DataFrame, text_col: str = "content") -> DataFrame:
    """One row for each line and pattern of weakness: rule, severity, line_no, line."""
    lines = C.lines(files, text_col)
    return rule_rows(lines, [(n, F.col("line").rlike(p), {"severity": s}) for n, p, s in WEAK]).withColumn("line", F.trim("line"))


def complex_functions(functions: DataFrame, most: int = 25) -> DataFrame:
    """Findings of functions with more branches than ``most``: title, severity, complexity."""
    branches = F.regexp_count("body", F.lit(r"\b(if|for|while|case|catch)\b|&&|\|\||\?")) + 1
    return functions.withColumn("complexity", branches).where(F.col("complexity") > most).withColumn("title", F.concat(F.lit("High complexity in "), "name")).withColumn("severity", F.lit("Medium"))


def labelled(text: Column, fields: Mapping[str, str]) -> Column:
    """Struct of the fields ``Label: value`` of a text, or of the member of that name where the text holds JSON; else their defaults."""
    def value(name: str, default: str) -> Column:
        label = re.escape(name).replace("_", "[ _]")
        inside = F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), f"$.{name}")
        line = F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^[ \t]*(?:[-*][ \t]*)?\**{label}\**[ \t]*:[ \t]*\**[ \t]*([^\n]*)", 1)), F.lit(""))
        return F.coalesce(inside, line, F.lit(default)).alias(name)

    return F.struct(*(value(n, d) for n, d in fields.items()))


def bias_findings(text: Column) -> Column:
    """Array of (title, location, severity, description) of an answer in sections ``## title`` with lines ``Location:``, ``Severity:``, and others that describe."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^##[ \t]+([^\n]+)"), F.lit(1))
    bodies = F.slice(F.split(text, r"(?m)^##[ \t]+[^\n]+"), F.lit(2), F.size(heads))

    def parsed(x: Column) -> Column:
        lines = F.filter(F.transform(F.split(x["b"], "\n"), lambda l: F.trim(l)), lambda l: (l != "") & ~l.rlike("(?i)^(location|severity):"))
        part = lambda n, d: F.coalesce(F.nullif(F.trim(F.regexp_extract(x["b"], rf"(?im)^{n}:[ \t]*([^\n]*)", 1)), F.lit("")), F.lit(d))
        return F.struct(F.trim(x["h"]).alias("title"), part("location", "unknown").alias("location"), part("severity", "Medium").alias("severity"), F.array_join(lines, " ").alias("description"))

    return F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), parsed)


#: How functions begin in a language.
STARTS = {"solidity": r"\bfunction\s+(\w+)", "python": r"(?m)^\s*(?:async\s+)?def\s+(\w+)", "javascript": r"\bfunction\s+(\w+)|\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "rust": r"\bfn\s+(\w+)", "go": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)", "java": r"\b(?:public|private|protected)\s+[\w<>\[\] ]+\s+(\w+)\s*\("}


def function_names(code: Column, language: Column) -> Column:
    """Names of the functions of a code by its language; empty for one that isn't known."""
    out = F.array().cast("array<string>")
    for name, pattern in STARTS.items():
        found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
        if name == "javascript":
            found = F.zip_with(found, F.regexp_extract_all(code, F.lit(pattern), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))
        out = F.when(language == name, found).otherwise(out)
    return out


def issue_document(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """(number, text) of issues (number, title, state, labels, body) that are no pull requests, with their comments (number, at, author, body) in order."""
    said = comments.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "author", "body"))).alias("c"))
    own = issues.where("not coalesce(is_pull, false)").join(said, "number", "left")
    lines = F.array_join(F.transform("c", lambda x: F.concat(x["author"], F.lit(": "), x["body"])), "\n")
    head = F.concat(F.lit("# "), "title", F.lit(" (#"), F.col("number").cast("string"), F.lit(", "), "state", F.lit(")"))
    return own.select("number", F.concat_ws("\n", head, F.when(F.size("labels") > 0, F.concat(F.lit("Labels: "), F.array_join("labels", ", "))), F.coalesce("body", F.lit("")), F.nullif(lines, F.lit(""))).alias("text"))


def security_flags(functions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, has_external_calls, has_payable, has_assembly, open_functions, all_guarded) of contracts from their functions."""
    body = F.col("body")
    return functions.groupBy(*keys).agg(
        F.bool_or(body.rlike(r"\.(call|send|transfer|delegatecall)\s*[({]")).alias("has_external_calls"), F.bool_or(F.col("attributes").contains("payable")).alias("has_payable"), F.bool_or(body.contains("assembly")).alias("has_assembly"),
        F.count_if(F.col("visibility").isin("public", "external")).alias("open_functions"), F.bool_and(~F.col("visibility").isin("public", "external") | body.contains("require")).alias("all_guarded"),
    )


def worth_checking(functions: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Functions that are neither empty nor known: of a whitelisted signature, and of its lines give or take two."""
    listed = whitelist.select(F.col("signature").alias("w_signature"), F.col("lines").alias("w_lines"))
    return functions.where(~F.col("is_empty")).join(listed, (F.col("signature") == F.col("w_signature")) & (F.abs(F.col("loc") - F.col("w_lines")) <= 2), "left_anti")


def enhanced(prompt: Column, text: Column, questions: Mapping[str, str], limit: int = 8000) -> Column:
    """The prompt and the questions whose keyword the text has, within a length."""
    extra = F.array_join(F.array_compact(F.array(*(F.when(F.lower(text).rlike(k), F.lit(q)) for k, q in questions.items()))), "\n")
    return F.substring(F.concat_ws("\n", prompt, F.nullif(extra, F.lit(""))), 1, limit)


def template_of(path: Column, kind: Column) -> Column:
    """Which template a document is prompted with, by its type, then the prefix and ending of its path."""
    return F.when(kind == "vulnerability", "vulnerability").when(path.startswith("test"), "test").when(path.endswith(".sol"), "contract").when(path.endswith(".md"), "documentation").otherwise("general")


def plain_json(column: Column) -> Column:
    """A value as JSON text with null members left in; null becomes the JSON null."""
    return F.coalesce(F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"}), F.lit('{"v":null}'))


def is_pattern(pattern: str) -> bool:
    """Whether a text is a pattern that the engine can use."""
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False
