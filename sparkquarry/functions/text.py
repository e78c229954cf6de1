"""Column functions on texts and code: cleaning, classification, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File extensions and keywords by language.
EXTENSIONS = {"sol": "solidity", "py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "md": "markdown"}
KEYWORDS = {
    "solidity": ("pragma solidity", "contract ", "mapping(", "msg.sender"),
    "python": ("def ", "import ", "self.", "elif "),
    "javascript": ("function ", "const ", "=>", "require("),
    "rust": ("fn ", "let mut", "impl ", "pub fn"),
    "go": ("func ", "package ", ":=", "chan "),
}
#: What markdown is made of, each alternative with at most one group, whose text stays: one scan takes the first that fits at a
#: place, so an image isn't taken for a link, nor a mark in code for emphasis.
FENCED = r"(?m:^[ \t]*```[^\n]*\n(?s:.*?)(?:^[ \t]*```[^\n]*$|\z))"
IMAGE, LINK = r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\[([^\]\[\n]*)\](?:\([^)\n]*\)|\[[^\]\n]*\])"
LINE_MARKS = r"(?m:^[ \t]*>[^\n]*$|^[ \t]{0,3}#{1,6}[ \t]+|[ \t]+#+[ \t]*$|^[ \t]*(?:[-*+]|\d+[.)])[ \t]+)"
EMPHASIS = r"(?<![\w*\\])(?:\*{1,3}|_{1,3})(?=[^\s*_])|(?<=[^\s*_])(?:\*{1,3}|_{1,3})(?![\w*])"
MARKS = "|".join((FENCED, LINE_MARKS, IMAGE, LINK, r"`([^`\n]+)`", EMPHASIS))
#: What refers to elsewhere: comments, images, links, addresses and tags in angle brackets, bare addresses, mentions, issues.
REFERENCES = "|".join((r"<!--(?s:.*?)-->", r"\[!\[[^\]\n]*\]\([^)\n]*\)\](?:\([^)\n]*\))?", r"!\[[^\]\n]*\]\([^)\n]*\)", LINK, r"<[^<>\n]+>", r"https?://\S+", r"(?<!\w)@[A-Za-z0-9-]+", r"(?<!\w)#\d+\b", r"\bGH-\d+\b"))
#: Fixed value: a call, by its own or a qualified name.
CALL = r"(?:\w+\.)?(\w+)\s*\("
SEVERITIES = ("Critical", "High", "Medium", "Low", "Informational")


def strip_markdown(text: Column) -> Column:
    """The text without what refers to elsewhere but the texts of links, on one line with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, REFERENCES, "$1"), r"\s+", " "))


def plain_markdown(text: Column) -> Column:
    """Markdown as text: code blocks and quotes go, marks of headings, lists and emphasis go, code, images and links leave their
    text; at most one empty line in a row."""
    plain = F.regexp_replace(F.regexp_replace(text, MARKS, "$1$2$3"), r"\n[ \t]*\n\s*", "\n\n")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")


def delete_characters(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def language_of_path(path: Column, unknown: str | None = "unknown") -> Column:
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit(unknown))


def guess_language(code: Column) -> Column:
    """Language with most of its keywords in the code; the first of equals, ``unknown`` if none."""
    scored = F.array(*(F.struct(sum((code.contains(w).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("place"), F.lit(lang).alias("lang")) for i, (lang, words) in enumerate(KEYWORDS.items())))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["lang"]).otherwise("unknown")


def severity_rank(severity: Column) -> Column:
    """Rank of a severity; a missing one counts as Low, an unknown one is last."""
    out = F.when(severity.isNull(), 3)
    for i, name in enumerate(SEVERITIES):
        out = out.when(severity == name, i)
    return out.otherwise(99)


def shortened(text: Column, limit: int = 100) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def fingerprint(text: Column, **metadata: Column) -> Column:
    """sha256 of the text and the non-empty metadata as name:value, joined by a pipe."""
    parts = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}:"), v.cast("string"))) for k, v in metadata.items()]
    return F.sha2(F.concat_ws("|", text, *parts), 256)


def location(text: Column) -> tuple[Column, Column]:
    """(start, end) of ``file:start-end`` or ``file:line``; null where it doesn't parse."""
    tail = F.element_at(F.split(text, ":"), -1)
    start, end = F.regexp_extract(tail, r"^(\d+)(-\d+)?$", 1), F.regexp_extract(tail, r"^\d+-(\d+)$", 1)
    whole = F.when(text.contains(":"), F.nullif(start, F.lit("")).cast("int"))
    return whole, F.coalesce(F.nullif(end, F.lit("")).cast("int"), whole)


def calls(code: Column) -> Column:
    """Names that are called in the code, in order."""
    return F.regexp_extract_all(code, F.lit(CALL), 1)


def arrow_paths(text: Column) -> Column:
    """Array of paths (arrays of names) of lines that have arrows."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("->") | x.contains("→"))
    return F.transform(lines, lambda x: F.transform(F.split(x, "->|→"), lambda y: F.trim(y)))


def pattern_lines(texts: DataFrame, patterns: list[tuple[str, str]], text_col: str, name: str = "name") -> DataFrame:
    """One row for each line and (name, pattern) that matches it, whatever the case: name, line_no (from 1) and line.

    Patterns are literals of the plan, each compiled once a task.
    """
    lines = texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(F.split(text_col, "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")
    met = F.array_compact(F.array(*(F.when(F.col("line").rlike(f"(?i){p}"), F.lit(n)) for n, p in patterns)))
    return lines.withColumn(name, F.explode(met))


def fenced_blocks(text: Column) -> Column:
    """Array of (language, code) of fenced blocks; ``text`` where none is named."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"(?s)(```|~~~)(\w*)\n(.*?)\1"), 2).alias("language"), F.regexp_extract_all(text, F.lit(r"(?s)(```|~~~)(\w*)\n(.*?)\1"), 3).alias("code"))
    return F.transform(parts, lambda p: F.struct(F.coalesce(F.nullif(p["language"], F.lit("")), F.lit("text")).alias("language"), p["code"].alias("code")))


def upper_letter(letter: str) -> str:
    """A character's capital, if that is one character too; str.upper() makes two or three of some, such as a sharp s or a ligature."""
    if len(upper := letter.upper()) <= 1:
        return upper
    return "\u1e9e" if letter == "\u00df" else title if len(title := letter.title()) == 1 else letter
