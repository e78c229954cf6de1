"""Structural index of source code: strings and comments by one scan, blocks of braces at any depth, headers with their blocks.

All are expressions over a text column, in time about linear in the text. They are of built-in functions, where arrays are folded by
chunks, so that appending to one doesn't copy what was there before, and braces are matched by sorting them by depth; headers with
their blocks, which most queries over code need, are scanned in batches instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an array that are folded at a time.
CHUNK = 128
#: How strings and comments are written; ``//`` after ``:``, as in an address, opens none. What ends neither by its
#: line's nor by the text's end runs to it.
ESCAPED = r"\\[\"'\\]"
LITERAL = r"""(?<!:)//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|"[^"\n]*"?|'[^'\n]*'?"""


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """Array of out(before, after, x), of type ``kind``, for each x of items in order; ``after`` = step(before, x), the first
    ``before`` is start, which step() keeps the type of."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return bound(step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(out(acc["s"], s, x)).cast(f"array<{kind}>")).alias("out")))

    def folded(own: Column) -> Column:
        def chunk(acc: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(own, i * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["s"].alias("s"), none.alias("out")), one)
            return bound(part, lambda p: F.struct(p["s"].alias("s"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))
        whole = F.aggregate(chunks, F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(own) > 0, whole).otherwise(none)

    return bound(items, folded)


def spans(text: Column, pattern: str, *names: str) -> Column:
    r"""Array of (start, end, start_line, end_line, whole, groups by name) of the leftmost non-overlapping matches, in code points
    from 0 and lines from 1. ``\G`` ties each match to the one before, so that gaps and matches cover the text up to the last."""
    tied = r"\G(?s:(.*?))(" + pattern + ")"
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(tied), F.lit(i)).alias(n) for i, n in enumerate(["gap", "whole", *names], 1)))
    place = lambda at, line: F.struct(at.cast("int").alias("at"), line.cast("int").alias("line"))

    def step(s: Column, x: Column) -> Column:
        return place(s["at"] + F.length(x["gap"]) + F.length(x["whole"]), s["line"] + newlines(x["gap"]) + newlines(x["whole"]))

    def out(before: Column, after: Column, x: Column) -> Column:
        return F.struct((before["at"] + F.length(x["gap"])).alias("start"), after["at"].alias("end"), (before["line"] + newlines(x["gap"])).alias("start_line"), after["line"].alias("end_line"), x["whole"].alias("whole"), *(x[n].alias(n) for n in names))

    kind = "struct<start:int,end:int,start_line:int,end_line:int,whole:string" + "".join(f",{n}:string" for n in names) + ">"
    return running(parts, place(F.lit(0), F.lit(1)), step, out, kind)


def masked(text: Column, strings: bool = True, comments: bool = True) -> Column:
    """The text, as long as it is, with blanks for the characters of strings and comments but line feeds; quotes of strings too."""
    plain = F.regexp_replace(text, ESCAPED, "  ")
    tied = r"\G(?s:(.*?))(" + LITERAL + ")"

    def blank(token: Column) -> Column:
        hidden = F.regexp_replace(token, r"[^\n]", " ")
        comment = token.startswith("/")
        if strings and comments:
            return hidden
        return F.when(comment if comments else ~comment, hidden).otherwise(token)

    def parts(own: Column) -> Column:
        found = F.arrays_zip(*(F.regexp_extract_all(own, F.lit(tied), F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "token"))))
        return bound(found, lambda p: F.concat(F.array_join(F.transform(p, lambda x: F.concat(x["gap"], blank(x["token"]))), ""), F.substr(own, F.aggregate(p, F.lit(1), lambda n, x: n + F.length(x["gap"]) + F.length(x["token"])))))

    return F.when(text.contains("/") | text.contains('"') | text.contains("'"), bound(plain, parts)).otherwise(text)


def literals(text: Column) -> Column:
    """Array of (start, end, start_line, end_line, whole, kind) of strings and comments; kind is string, line or block."""
    kind = lambda w: F.when(w.startswith("//"), "line").when(w.startswith("/*"), "block").otherwise("string")
    return F.transform(spans(F.regexp_replace(text, ESCAPED, "  "), LITERAL), lambda m: m.withField("kind", kind(m["whole"])))


def blocks(code: Column) -> Column:
    """Array of (open, close, depth), by open, of the pairs of braces that belong together in masked code, at any depth.

    A running sum gives each brace its depth; in the order of depth, then place, a block's end follows its beginning. Closing
    braces that nothing opened are passed over; a block that isn't closed has none.
    """
    pieces = F.regexp_extract_all(code, F.lit(r"[^{}]*+[{}]"), F.lit(0))
    items = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), F.when(p.endswith("{"), 1).otherwise(-1).alias("d")))
    state = lambda at, depth: F.struct(at.cast("int").alias("at"), depth.cast("int").alias("depth"))
    braces = running(
        items, state(F.lit(0), F.lit(0)), lambda s, x: state(s["at"] + x["n"], F.greatest(s["depth"] + x["d"], F.lit(0))),
        lambda before, after, x: F.struct(F.greatest(before["depth"], after["depth"]).alias("depth"), (after["at"] - 1).alias("at"), x["d"].alias("d")), "struct<depth:int,at:int,d:int>",
    )
    ordered = F.array_sort(F.filter(braces, lambda b: b["depth"] > 0))

    def pairs(own: Column) -> Column:
        both = F.arrays_zip(own.alias("a"), F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))).alias("b"))
        met = F.filter(both, lambda p: (p["a"]["d"] == 1) & (p["b"]["d"] == -1) & (p["a"]["depth"] == p["b"]["depth"]))
        return F.array_sort(F.transform(met, lambda p: F.struct(p["a"]["at"].alias("open"), p["b"]["at"].alias("close"), p["a"]["depth"].alias("depth"))))

    return bound(ordered, pairs)


def java(pattern: str) -> re.Pattern:
    r"""A pattern with the meaning that the engine's own functions give it: classes are of ASCII, ``\b`` is not."""
    return re.compile(pattern.replace(r"\b", r"(?u:\b)").replace(r"\z", r"\Z"), re.ASCII)


def masked_text(text: str, escaped: re.Pattern = re.compile(ESCAPED), literal: re.Pattern = java(LITERAL), seen: re.Pattern = re.compile(r"[^\n]")) -> str:
    """masked() of one text."""
    if "/" not in text and '"' not in text and "'" not in text:
        return text
    return literal.sub(lambda m: seen.sub(" ", m[0]), escaped.sub("  ", text))


def closes(code: str, first: int, braces: re.Pattern = re.compile("[{}]")) -> dict[int, int]:
    """Offset behind the end of each block of masked code that begins at ``first`` or later, by that of its opening brace."""
    opened: list[int] = []
    out = {}
    for m in braces.finditer(code, first):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def heads(text: str, head: re.Pattern) -> list[tuple]:
    """Rows of headed() of one text; ``head`` ends with the brace."""
    code, out, ends, at, line = masked_text(text), [], None, 0, 1
    for i, m in enumerate(head.finditer(code)):
        start, brace = m.start(), m.end() - 1
        ends = closes(code, brace) if ends is None else ends
        end = ends.get(brace, len(text))
        line, at = line + text.count("\n", at, start), start
        out.append((i, start, end, line, line + text.count("\n", start, end), text[start:end], *(g or "" for g in m.groups()), text[brace:end]))
    return out


def headed(text: Column, header: str, *names: str) -> Column:
    r"""Array of (ordinal, start, end, start_line, end_line, whole, groups by name, body) of what a header, a pattern that ends before
    ``{``, stands before: nested ones too. Headers and braces in strings and comments don't count; groups are of masked code.
    ``body`` is the block with its braces; one that isn't closed ends with the text. Offsets are code points from 0.

    One scan of each text in its task, a batch at a time. The caller sends the package to the workers.
    """
    kinds = {**dict.fromkeys(("ordinal", "start", "end", "start_line", "end_line"), "int"), **dict.fromkeys(("whole", *names, "body"), "string")}

    @F.arrow_udf("array<struct<" + ",".join(f"{n}:{k}" for n, k in kinds.items()) + ">>")
    def found(texts: pa.Array) -> pa.Array:
        head, rows, offsets = java(header + r"\{"), [], [0]
        for t in texts.to_pylist():
            rows += heads(t, head) if t else ()
            offsets.append(len(rows))
        columns = zip(*rows) if rows else ((),) * len(kinds)
        fields = [pa.array(c, pa.int32() if k == "int" else pa.string()) for c, k in zip(columns, kinds.values())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(kinds)))

    return found(text)
