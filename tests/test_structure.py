"""The structural index of code against a scan with a stack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import code as C
from sparkquarry.functions import structure as S


def plain_tokens(text):
    """(start, end, kind) of strings and comments, character by character."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "//" and not (i and text[i - 1] == ":"):
            end = text.find("\n", i)
            end, kind = len(text) if end < 0 else end, "line"
        elif two == "/*":
            end = text.find("*/", i + 2)
            end, kind = len(text) if end < 0 else end + 2, "block"
        elif text[i] in "\"'":
            end, kind = i + 1, "string"
            while end < len(text) and text[end] not in (text[i], "\n"):
                end += 2 if text[end] == "\\" and text[end + 1 : end + 2] in ("\\", '"', "'") else 1
            end = end + 1 if end < len(text) and text[end] == text[i] else end
        else:
            i += 2 if text[i] == "\\" and text[i + 1 : i + 2] in ("\\", '"', "'") else 1
            continue
        out.append((i, end, kind))
        i = end
    return out


def plain_masked(text, kinds=("string", "line", "block")):
    chars = list(text)
    for start, end, kind in plain_tokens(text):
        if kind in kinds:
            chars[start:end] = ["\n" if c == "\n" else " " for c in chars[start:end]]
    return re.sub(r"\\[\"'\\]", "  ", "".join(chars)) if kinds else "".join(chars)


def plain_blocks(code):
    stack, out = [], []
    for i, c in enumerate(code):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            out.append((stack[-1], i, len(stack)))
            stack.pop()
    return sorted(out)


def plain_functions(text):
    code, out = plain_masked(text), []
    closes = {o: c for o, c, _ in plain_blocks(code)}
    for m in re.finditer(C.FUNCTION + r"\{", code):
        end = closes.get(m.end() - 1, len(text) - 1) + 1
        out.append((m[1], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, end) + 1, text[m.start() : end]))
    return out


PARTS = ["{", "}", "\n", " ", "a", "é😀", '"', "'", "\\", "/*", "*/", "//", ":", ";", "function f(uint a) public {", "function g()", "contract C is D, E {", "http://x", '"{"', "'}'", "// {\n", "/* } */", "\\\"", "modifier m(x) {"]


def random_code(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 80)))


def cases():
    rng = random.Random(11)
    deep = "contract Deep {\n function f() public {" + "{" * 400 + " x; " + "}" * 400 + "}\n function g() internal { } }"
    fixed = [
        "", "}", "{", "}}{{}", deep, "/* unclosed { function f() {", 'x = "unclosed {\nfunction f() { }', "// function f() { }\nfunction g() { /* } */ y = \"}\"; }", "function h() { if (a) {",
        "function long() {\n" + "  a = b; // don't\n" * 3000 + "}\nfunction after() { }", "{}" * 2000,
    ]
    return fixed + [random_code(rng) for _ in range(300)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = list(enumerate(cases()))
    return rows, spark.createDataFrame(rows, "file_id int, content string").cache()


def test_masks(texts):
    rows, df = texts
    for strings, comments, kinds in ((True, True, ("string", "line", "block")), (True, False, ("string",)), (False, True, ("line", "block"))):
        got = dict(df.select("file_id", S.masked(F.col("content"), strings, comments)).collect())
        for i, text in rows:
            blank = lambda t: re.sub(r"\\[\"'\\]", "  ", t)
            want = plain_masked(text, kinds)
            assert blank(got[i]) == blank(want) and len(got[i]) == len(text), (kinds, text)


def test_literals(texts):
    rows, df = texts
    got = dict(df.select("file_id", S.literals(F.col("content"))).collect())
    for i, text in rows:
        assert [(r["start"], r["end"], r["kind"]) for r in got[i]] == plain_tokens(text), text
        assert [r["start_line"] for r in got[i]] == [text.count("\n", 0, s) + 1 for s, _, _ in plain_tokens(text)]


def test_blocks(texts):
    rows, df = texts
    got = dict(df.select("file_id", S.blocks(S.masked(F.col("content")))).collect())
    for i, text in rows:
        assert [tuple(b) for b in got[i]] == plain_blocks(plain_masked(text)), text


def test_functions(texts):
    rows, df = texts
    got = {}
    for r in C.functions(df).orderBy("file_id", "ordinal").collect():
        got.setdefault(r["file_id"], []).append((r["name"], r["start_line"], r["end_line"], r["whole"]))
    for i, text in rows:
        assert got.get(i, []) == plain_functions(text), text


def test_contracts_and_comments(spark):
    text = 'contract A is B, C { /* } */ string s = "}"; // contract X { }\n function f() { } }\n"// not one" /* two */'
    df = spark.createDataFrame([(1, text)], "file_id int, content string")
    (one,) = C.contracts(df).collect()
    assert (one["name"], one["parents"], one["end_line"]) == ("A", ["B", "C"], 2) and one["whole"].endswith("function f() { } }")
    assert sorted(r["text"] for r in C.comments(df).collect()) == ["contract X { }", "two", "}"]


def test_chunks(texts):
    """Python's form of the mask and native chunks agree with the same loop."""
    from sparkquarry.operators import chunking

    rows, df = texts
    scopes = {}
    for r in chunking.scope_chunks(df).collect():
        scopes.setdefault(r["file_id"], []).append((r["kind"], r["name"], r["start_line"], r["end_line"], r["code"]))
    chunks = {}
    for r in chunking.function_chunks(df).orderBy("file_id", "chunk_index").collect():
        chunks.setdefault(r["file_id"], []).append((r["name"], r["start_line"], r["end_line"], r["code"]))
    for i, text in rows:
        assert chunking.hidden(text) == plain_masked(text)
        assert scopes.get(i, []) == chunking.scopes(text)
        assert chunks.get(i, []) == plain_functions(text)


def test_headers_as_the_engine_matches_them(spark):
    """Classes are of ASCII and word boundaries aren't, for the scan in batches as for the engine's own functions."""
    gaps = ["", " ", " ", " ", "\t", "\x0b", "\x1c", "\x85", "\n"]
    texts = [f"{before}function{gap}{name}(a){after}{{ }}" for before in ("", "é", "_", "9", "-", "́") for gap in gaps for name in ("f", "é", "f9", "٣") for after in ("", " is é")]
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    want = df.select("file_id", F.explode(S.spans(S.masked(F.col("content")), C.FUNCTION + r"\{", "name", "parameters", "attributes")).alias("m")).select("file_id", "m.start", "m.start_line", "m.name", "m.parameters", "m.attributes")
    got = df.select("file_id", F.explode(S.headed(F.col("content"), C.FUNCTION, "name", "parameters", "attributes")).alias("m")).select("file_id", "m.start", "m.start_line", "m.name", "m.parameters", "m.attributes")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() >= 40


def test_headers_are_scanned_in_batches(spark, tmp_path):
    """Each text is scanned once for a use of its headers, by no folds of arrays, whose steps took most of the time of these queries."""
    from sparkquarry.plans import registry

    spark.range(20).selectExpr("id AS p_partkey", "'part' AS p_name", "'b' AS p_brand", "'t' AS p_type", "cast(id AS int) AS p_size", "1.0D AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for name, uses in (("code_contracts", 1), ("function_checks", 1), ("call_graph_in_files", 2), ("callers_of", 2), ("callees_of", 2)):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"ArrowEvalPython", plan)) == uses and "aggregate(" not in plan, (name, plan)
