"""JSON out of free text, with repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import blocks, bound, masked, running

#: Tokens of what is meant as JSON: strings in either quotes (an unclosed one runs to the end), punctuation, and bare words.
TOKEN = r"""\"(?:[^"\\]|\\(?s:.))*+"?|'(?:[^'\\]|\\(?s:.))*+'?|[{}\[\],:]|[^\s{}\[\],:"']+"""
NUMBER = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$"
#: How other languages write constants.
CONSTANTS = {"None": "null", "undefined": "null", "NaN": "null", "True": "true", "False": "false", "null": "null", "true": "true", "false": "false"}


def _value(token: Column) -> Column:
    """A string in double quotes, closed; a number or constant; any other word as a string."""
    double = F.when((F.length(token) > 1) & token.endswith('"') & ~token.rlike(r'[^\\](?:\\\\)*\\"$'), token).otherwise(F.concat(token, F.lit('"')))
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "^'|'$", ""), r"\\'", "'"), r'(?<!\\)"', '\\\\"')
    known = F.create_map(*(F.lit(x) for pair in CONSTANTS.items() for x in pair))
    word = F.coalesce(F.try_element_at(known, token), F.when(token.rlike(NUMBER), token), F.concat(F.lit('"'), F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit('"')))
    return F.when(token.startswith('"'), double).when(token.startswith("'"), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(word)


def repaired(text: Column) -> Column:
    """The first object or array in a text as JSON, by one scan over tokens with a stack of what is open.

    Commas come from the order of values: one between two of them, none before an end. Strings get double quotes, bare words
    too, but numbers and constants. An end closes what was opened inside of it; one that nothing opened is passed over, and
    the text's end closes all. What stands before the first opening and after its end is left out. Null without one.
    """
    kind = lambda t: F.when(t.isin("{", "["), "open").when(t.isin("}", "]"), "close").when(t == ",", "comma").when(t == ":", "colon").otherwise("value")
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("t"), kind(t).alias("kind")))
    state = lambda stack, last: F.struct(stack.cast("string").alias("stack"), last.cast("string").alias("last"))

    def opener(x: Column) -> Column:
        return F.translate(x["t"], "}]", "{[")

    def depth(s: Column, x: Column) -> Column:
        """How many of the open ones an end closes; 0 if nothing opened it."""
        return F.instr(F.reverse(s["stack"]), opener(x))

    def off(s: Column) -> Column:
        return (s["stack"] == "") & (s["last"] != "start")

    def step(s: Column, x: Column) -> Column:
        closed, begun = depth(s, x), s["last"] != "start"
        return (
            F.when(off(s) | (x["kind"] == "comma"), s)
            .when(x["kind"] == "open", state(F.concat(s["stack"], x["t"]), F.lit("open")))
            .when((x["kind"] == "close") & (closed > 0), state(F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - closed), F.lit("value")))
            .when((x["kind"] == "colon") & (s["last"] == "value"), state(s["stack"], F.lit("colon")))
            .when((x["kind"] == "value") & begun, state(s["stack"], F.lit("value")))
            .otherwise(s)
        )

    def out(before: Column, after: Column, x: Column) -> Column:
        comma = F.when(before["last"] == "value", ",").otherwise("")
        ends = F.translate(F.substring(F.reverse(before["stack"]), F.lit(1), depth(before, x)), "{[", "}]")
        return (
            F.when(off(before), "")
            .when(x["kind"] == "open", F.concat(comma, x["t"]))
            .when((x["kind"] == "value") & (before["last"] != "start"), F.concat(comma, _value(x["t"])))
            .when((x["kind"] == "close") & (before["last"] == "colon"), F.concat(F.lit("null"), ends))
            .when(x["kind"] == "close", ends)
            .when((x["kind"] == "colon") & (before["last"] == "value"), ":")
            .otherwise("")
        )

    def closed(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        rest = F.concat(F.when(last["last"] == "colon", "null").otherwise(""), F.translate(F.reverse(last["stack"]), "{[", "}]"))
        return F.nullif(F.concat(F.array_join(F.transform(parts, lambda p: p["out"]), ""), rest), F.lit(""))

    traced = running(tokens, state(F.lit(""), F.lit("start")), step, lambda b, a, x: F.struct(out(b, a, x).alias("out"), a["stack"].alias("stack"), a["last"].alias("last")), "struct<out:string,stack:string,last:string>")
    return bound(traced, lambda parts: F.when(F.size(parts) > 0, closed(parts)))


def extracted(text: Column) -> Column:
    """JSON in a text: of the text itself, its fenced block, what begins with its first brace or bracket, its first block of
    braces, and the text without the escapes of a text in a text, the first that is JSON; else the first that is when repaired."""
    fenced = F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)```", 1)
    begun = F.regexp_extract(text, r"(?s)[{\[].*", 0)
    outer = lambda code: F.filter(blocks(code), lambda b: b["depth"] == 1)
    balanced = bound(F.get(outer(masked(text, comments=False)), F.lit(0)), lambda b: F.substr(text, b["open"] + 1, b["close"] - b["open"] + 1))
    unescaped = F.replace(F.regexp_replace(text, r'^"|"$', ""), F.lit('\\"'), F.lit('"'))
    raw = (text, fenced, begun, balanced, unescaped)
    good = lambda raw: bound(raw, lambda c: F.when(c.rlike(r"^\s*[\[{](?s:.*)[\]}]\s*$") & F.try_parse_json(c).isNotNull(), c))
    return F.coalesce(*map(good, raw), *(good(repaired(c)) for c in (fenced, begun, unescaped)))


def field(text: Column, path: str, default: str | None = None) -> Column:
    return F.coalesce(F.get_json_object(text, path), F.lit(default))


def metadata_filter(metadata: Column, filters: dict, how: str = "and") -> Column:
    """Equality on fields of a JSON column, joined by and / or; no filter passes all."""
    tests = [F.coalesce(F.get_json_object(metadata, f"$.{k}") == str(v), F.lit(False)) for k, v in filters.items()]
    out = tests[0] if tests else F.lit(True)
    for test in tests[1:]:
        out = (out & test) if how == "and" else (out | test)
    return out
