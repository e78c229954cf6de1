"""Reports, findings and checks out of free text; templates; schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import bound, spans

#: Levels of risk, and words that hint at a weakness, a grave and a slight one.
LEVELS = ("Critical", "High", "Medium", "Low", "Informational")
WEAKNESS, GRAVE, SLIGHT = "vulnerability|exploit|attack|bug|issue|reentrancy|overflow|underflow|unsafe", "critical|severe|high", "low|minor|info"
#: A line that begins a part of a report: a heading, or a name in bold that stands alone or before its text.
HEADING = r"(?m)^[ \t]*(?:(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$|\*\*([^*\n]+?):?\*\*:?)"
#: Names of the parts that are asked for, and of the field that has the rating.
SUMMARIES, CONCLUSIONS = ("summary", "executive summary", "overview"), ("conclusion", "conclusions", "closing remarks")
RATING = r"(?i)\b(?:risk|security)[ \t]+(?:rating|assessment|level|score)\**[ \t]*[:=][ \t\n*]*(\w+)"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def outline(text: Column) -> Column:
    """Array of (level, title, body): the report's parts in order; a name in bold has level 7. What stands before the first one has level
    0 and no title."""
    def cut(found: Column) -> Column:
        first = F.struct(F.lit(0).alias("level"), F.lit("").alias("title"), F.lit(0).alias("start"))
        heads = F.transform(found, lambda m: F.struct(F.when(m["marks"] != "", F.length(m["marks"])).otherwise(7).alias("level"), trimmed(F.concat(F.coalesce(m["heading"], F.lit("")), F.coalesce(m["bold"], F.lit("")))).alias("title"), m["end"].alias("start")))
        begins = F.concat(F.transform(found, lambda m: m["start"]), F.array(F.length(text)))
        return F.transform(F.arrays_zip(F.concat(F.array(first), heads).alias("h"), begins.alias("upto")), lambda z: F.struct(z["h"]["level"].alias("level"), z["h"]["title"].alias("title"), trimmed(F.substr(text, z["h"]["start"] + 1, z["upto"] - z["h"]["start"])).alias("body")))

    return bound(spans(text, HEADING, "marks", "heading", "bold"), cut)


def section(text: Column, names: Sequence[str]) -> Column:
    """Body of the report's first part that has one of the names; null without such, or if it is empty."""
    part = F.get(F.filter(outline(text), lambda p: F.lower(p["title"]).isin(*names) & (p["body"] != "")), F.lit(0))
    return F.when(text.rlike("(?i)" + "|".join(names)), part["body"])


def prose(text: Column) -> Column:
    """Paragraphs in order, without headings, names in bold, lists, quotes and tables."""
    paragraphs = F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: trimmed(p))
    return F.filter(paragraphs, lambda p: ~p.rlike(r"^(?:$|[#*>|-]|\d+[.)])"))


def summary(text: Column, limit: int | None = None, default: str | None = None) -> Column:
    """The part of that name, else the first paragraph of prose, else ``default``; longer ones end in three dots within ``limit``."""
    found = F.coalesce(section(text, SUMMARIES), F.get(prose(text), F.lit(0)), F.lit(default))
    return found if limit is None else bound(found, lambda s: F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s))


def conclusion(text: Column, default: str | None = None) -> Column:
    """The part of that name, else the last paragraph of prose, else ``default``."""
    return F.coalesce(section(text, CONCLUSIONS), F.try_element_at(prose(text), F.lit(-1)), F.lit(default))


def risk_rating(text: Column, default: str | None = None) -> Column:
    """The level that a rating names, else the gravest that stands before ``risk`` or behind ``overall``, else ``default``."""
    named = F.initcap(F.regexp_extract(text, RATING, 1))
    mentioned = [F.when(text.rlike(rf"(?i)\b(?:{level}[ \t]+risk|overall[ \t]+{level})\b"), level) for level in LEVELS]
    return F.coalesce(F.when(named.isin(*LEVELS), named), *mentioned, F.lit(default))


def gated_findings(results: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text hints at a weakness, with a severity by its words: high before low, else Medium."""
    low = F.lower(text_col)
    kept = results.where(low.rlike(WEAKNESS))
    return kept.withColumn("severity", F.when(low.rlike(GRAVE), "High").when(low.rlike(SLIGHT), "Low").otherwise("Medium"))


#: Where its first line has a severity: in brackets, maybe named, or after a dash or colon; and what its fields are called.
IN_BRACKETS = r"(?i)[(\[][ \t]*(?:(?:severity|priority|risk)[ \t]*:[ \t]*)?(critical|high|medium|low|info(?:rmational)?)[ \t]*[)\]]"
AT_THE_END = r"(?i)[ \t]*(?:[-–—:|]|\*\*:?)[ \t]*(?:severity[ \t]*:?[ \t]*)?(critical|high|medium|low|informational)(?:[ \t]+(?:severity|risk))?[ \t*.]*$"
FIELDS = {"severity": "severity|priority|risk level|impact", "location": "location|line|lines|function|file", "description": "description|details", "recommendation": "recommendation|mitigation|fix|remediation"}
EVERY = "|".join(FIELDS.values())
#: A line that begins a finding: a heading, a numbered line, or a name in bold, maybe in a list, that isn't a field.
ENTRY = rf"(?m)^[ \t]*(?:#{{1,6}}[ \t]+(?:\d+[.)][ \t]*)?|\d+[.)][ \t]+|(?:[-*][ \t]+)?(?=\*\*))(?!(?i:\**(?:{EVERY})\**[ \t]*:))([^\n]+)$"


def _field(body: Column, names: str) -> Column:
    found = trimmed(F.regexp_replace(F.regexp_extract(body, rf"(?im)^[ \t]*(?:[-*][ \t]+)?\**(?:{names})\**[ \t]*:\**[ \t]*([^\n]+)$", 1), r"\*\*|`", ""))
    return F.nullif(found, F.lit(""))


def cut(text: Column) -> Column:
    """Array of (line, body) of the entries of a text: what their first line says, and what stands up to the next one's.

    Entries begin at the beginnings of lines, so a text is split there. Where characters other than line feeds may begin a line,
    one entry's line could hold another's beginning; such texts are taken by the leftmost matches that don't overlap.
    """
    pieces = F.filter(F.split(text, rf"(?={ENTRY})"), lambda p: p.rlike(rf"\A{ENTRY}"))
    plain = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, rf"\A{ENTRY}", 1).alias("line"), F.regexp_replace(p, r"\A[^\n]*", "").alias("body")))

    def matched(m: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(m, i + 1)["start"], F.length(text))
        return F.transform(m, lambda x, i: F.struct(x["line"].alias("line"), F.substr(text, x["end"] + 1, upto(i) - x["end"]).alias("body")))

    return F.when(text.rlike(r"[\r\x{85}\x{2028}\x{2029}]"), bound(spans(text, ENTRY, "line"), matched)).otherwise(plain)


def entries(reports: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, ordinal, title, severity, description, location, recommendation) of each finding of a report, in any of its forms.

    A finding begins with a heading, a numbered line or a name in bold that has a severity, in brackets or at its end, or whose
    text up to the next such line has it as a field. Its description is that field, else its text without its fields, on one line.
    """
    rows = reports.select(id_col, F.posexplode(cut(F.col(text_col))).alias("ordinal", "z")).select(id_col, "ordinal", "z.*")
    level = F.coalesce(F.nullif(F.regexp_extract("line", IN_BRACKETS, 1), F.lit("")), F.nullif(F.regexp_extract("line", AT_THE_END, 1), F.lit("")), F.regexp_extract(_field(F.col("body"), FIELDS["severity"]), r"\w+", 0))
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", IN_BRACKETS, ""), AT_THE_END, ""), r"\*\*|^(?i:finding|issue)[ \t]*#?\d*[ \t]*:", "")
    title = F.regexp_replace(title, r"^[\s:–—-]+|[\s:–—-]+$", "")
    # made once a row: a condition on columns of a projection would be worked out apart from them, patterns and all
    rows = rows.select(id_col, "ordinal", "body", F.explode(F.array(F.struct(level.alias("level"), title.alias("title")))).alias("h"))
    level = F.initcap(F.when(F.lower("h.level") == "info", "informational").otherwise(F.col("h.level")))
    rest = F.regexp_replace(F.col("body"), rf"(?im)^[ \t]*(?:[-*][ \t]+)?\**(?:{EVERY})\**[ \t]*:[^\n]*$", "")
    rest = F.nullif(trimmed(F.regexp_replace(F.regexp_replace(rest, r"(?m)^[ \t]*[-*>][ \t]+", ""), r"\s+", " ")), F.lit(""))
    return rows.where(level.isin(*LEVELS) & (F.col("h.title") != "")).select(
        id_col, "ordinal", F.col("h.title").alias("title"), level.alias("severity"), F.coalesce(_field(F.col("body"), FIELDS["description"]), rest).alias("description"),
        _field(F.col("body"), FIELDS["location"]).alias("location"), _field(F.col("body"), FIELDS["recommendation"]).alias("recommendation"),
    )


def findings(reports: DataFrame, validations: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """entries() with a status: what the validation of the same id says in its line of the title, whose marks don't count: rejected
    if it is false or invalid, which makes the finding informational, confirmed if it is confirmed, true or valid, else open."""
    line = F.explode(F.regexp_extract_all("validation", F.lit(r"(?m)^[ \t]*(?:\d+[.)]|[*-]|#{1,6})[ \t]+([^\n]*)"), F.lit(1)))
    said = validations.select(id_col, line.alias("line")).select(id_col, F.lower(trimmed(F.regexp_replace(F.regexp_extract("line", r"^(.*?)[ \t]*(?:[:(]|[ \t]-)", 1), r"\*\*", ""))).alias("key"), F.lower("line").alias("line"))
    verdict = F.max(F.when(F.col("line").rlike(r"\b(?:false|invalid|rejected)\b"), 2).when(F.col("line").rlike(r"\b(?:confirmed|confirms|true|valid)\b"), 1).otherwise(0))
    status = said.where("key <> ''").groupBy(id_col, "key").agg(verdict.alias("verdict"))
    joined = entries(reports, id_col, text_col).withColumn("key", F.lower("title")).join(status, [id_col, "key"], "left")
    kind = F.when(F.col("verdict") == 2, "rejected").when(F.col("verdict") == 1, "confirmed").otherwise("open")
    return joined.select(id_col, "ordinal", "title", F.when(kind == "rejected", "Informational").otherwise(F.col("severity")).alias("severity"), "description", "location", "recommendation", kind.alias("status"))


def checks(response: Column) -> Column:
    """Array of checks: the first JSON array of texts in the response, else its bulleted and numbered lines."""
    listed = F.from_json(F.regexp_extract(response, r'(?s)\[\s*".*"\s*\]', 0), "array<string>")
    bullets = F.regexp_extract_all(response, F.lit(r"(?m)^[ \t]*(?:[-*•]|\d+[.)])[ \t]+([^\n]+)"), F.lit(1))
    return F.when(F.size(listed) > 0, listed).otherwise(F.transform(bullets, lambda b: trimmed(b)))


def keyword_checks(text: Column, rules: Mapping[str, str]) -> Column:
    """Array of the checks whose keyword pattern is in the text."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(k), F.lit(v)) for k, v in rules.items())))


def sub_questions(text: Column) -> Column:
    """Array of (question, tool) of the JSON array of objects in a text; empty without one."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\[\s*\{.*\}\s*\]", 0), "array<struct<sub_question:string,tool_name:string>>")
    return F.coalesce(found, F.array().cast("array<struct<sub_question:string,tool_name:string>>"))


def compiler_sections(output: Column) -> Column:
    """Array of (file, json) of compiler output in sections that begin with a line ``======= file =======``."""
    header = r"={3,}[ \t]*([^=\n]+?)[ \t]*={3,}"
    files, bodies = F.regexp_extract_all(output, F.lit(header), F.lit(1)), F.split(output, header)
    zipped = F.arrays_zip(files.alias("file"), F.slice(bodies, F.lit(2), F.size(files)).alias("json"))
    return F.filter(F.transform(zipped, lambda s: F.struct(s["file"].alias("file"), trimmed(s["json"]).alias("json"))), lambda s: F.try_parse_json(s["json"]).isNotNull())


def rendered(template: str, values: Mapping[str, Column], lists: Mapping[str, tuple[Column, Sequence[str]]] | None = None) -> Column:
    """A template over columns: ``{{name}}``, ``{{#if name}}..{{/if}}`` (not null, not empty, not zero, not false), and
    ``{{#each name}}..{{/each}}`` over an array of structs (column, fields) or of texts (column, ()), whose elements are
    ``{{this}}`` and ``{{this.field}}``. The template is taken apart once; rows are rendered by built-in functions."""
    lists = lists or {}

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    def plain(part: str, known: Mapping[str, Column]) -> Column:
        pieces = re.split(r"\{\{\s*([\w.]+)\s*\}\}", part)
        columns = [F.lit(p) if i % 2 == 0 else text(known[p]) if p in known else F.lit("{{" + p + "}}") for i, p in enumerate(pieces)]
        return F.concat(*columns)

    def truth(name: str, known: Mapping[str, Column]) -> Column:
        if name in lists and name not in known:
            return F.coalesce(F.size(lists[name][0]) > 0, F.lit(False))
        return F.coalesce(~text(known[name]).isin("", "0", "0.0", "false"), F.lit(False)) if name in known else F.lit(False)

    def block(part: str, known: Mapping[str, Column]) -> Column:
        at = re.search(r"\{\{#(if|each)\s+([\w.]+)\s*\}\}", part)
        if not at:
            return plain(part, known)
        depth, end = 1, None
        for m in re.compile(r"\{\{(#|/)" + at[1] + r"\b[^}]*\}\}").finditer(part, at.end()):
            depth += 1 if m[1] == "#" else -1
            if depth == 0:
                end = m
                break
        if end is None:
            raise ValueError(f"{at[0]} is not closed")
        inner = part[at.end() : end.start()]
        if at[1] == "if":
            middle = F.when(truth(at[2], known), block(inner, known)).otherwise("")
        elif at[2] in lists:
            column, fields = lists[at[2]]
            middle = F.coalesce(F.array_join(F.transform(column, lambda x: block(inner, {**known, "this": x, **{f: x[f] for f in fields}, **{f"this.{f}": x[f] for f in fields}} if fields else {**known, "this": x})), ""), F.lit(""))
        else:
            middle = F.lit("")
        return F.concat(plain(part[: at.start()], known), middle, block(part[end.end() :], known))

    return block(template, dict(values))


def schema_faults(text: Column, required: Mapping[str, str]) -> Column:
    """Array of what a JSON object lacks: ``name: missing`` or ``name: not a type``, for (name, type) in STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT."""
    value = F.try_parse_json(text)

    def fault(name: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
        number = ["BIGINT", "DECIMAL", "DOUBLE"] if kind == "DOUBLE" else [kind]
        fits = F.greatest(*(found.startswith(k) for k in number), F.lit(False))
        return F.when(found.isNull() | (found == "VOID"), f"{name}: missing").when(~fits, f"{name}: not {kind}")

    return F.when(value.isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*(fault(n, k) for n, k in required.items()))))


def empty_of(required: Mapping[str, str]) -> Column:
    """A JSON object with an empty value of each type."""
    zero = {"STRING": '""', "BIGINT": "0", "DOUBLE": "0.0", "BOOLEAN": "false", "ARRAY": "[]", "OBJECT": "{}"}
    return F.lit("{" + ",".join(f'"{n}":{zero[k]}' for n, k in required.items()) + "}")


def combined(results: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: findings deduplicated by title and severity, all recommendations, and the summaries joined, in order.

    ``results`` has findings (array of title, severity), recommendations (array of text) and summary.
    """
    found = results.select(key, F.explode("findings").alias("f")).select(key, "f.title", "f.severity").distinct()
    found = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("title", "severity"))).alias("findings"))
    rest = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "recommendations", "summary"))).alias("r"))
    joined = rest.join(found, key, "left")
    none = F.array().cast("array<struct<title:string,severity:string>>")
    return joined.select(key, F.coalesce("findings", none).alias("findings"), F.flatten("r.recommendations").alias("recommendations"), F.array_join("r.summary", "\n").alias("summary"))
