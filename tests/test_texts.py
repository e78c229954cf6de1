"""JSON, markdown and reports out of free text: what is meant comes out."""

import json
import random

from pyspark.sql import functions as F

from sparkquarry.functions import json as J
from sparkquarry.functions import reports as R
from sparkquarry.functions import text as T


def value(rng, depth=0):
    kinds = ["number", "text", "constant"] + ["object", "array"] * (depth < 4)
    kind = rng.choice(kinds if depth else ["object", "array"])
    if kind == "number":
        return rng.choice([0, -3, 2.5, 1e30, 17])
    if kind == "text":
        return "".join(rng.choice(["a", " ", '"', "\\", "{", "]", ",", ":", "é", "\n", "None"]) for _ in range(rng.randint(0, 6)))
    if kind == "constant":
        return rng.choice([True, False, None])
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 4))} if kind == "object" else [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_repairs_leave_json_as_it_is(spark):
    rng = random.Random(2)
    values = [value(rng) for _ in range(200)]
    texts = [json.dumps(v, indent=rng.choice([None, 1])) for v in values]
    assert [json.loads(x) for x in column(spark, texts, J.repaired)] == values
    assert [json.loads(x) for x in column(spark, texts, J.extracted)] == values
    cut = [t.rstrip("}]\n ") for t in texts]  # ends that are missing come back, unless a string had them
    whole = [(v, c) for v, c, t in zip(values, cut, texts) if '"' not in t[len(c) :] and not c.endswith((",", ":"))]
    assert [json.loads(x) for x in column(spark, [c for _, c in whole], J.repaired)] == [v for v, _ in whole]


def test_repairs(spark):
    cases = {
        "{a: 7, \"b\": [1, 2,]}": {"a": 7, "b": [1, 2]}, "{'a': 'say \"hi\"', c: None}": {"a": 'say "hi"', "c": None}, '{"a": "x" "b": [1 2 {x: y]}': {"a": "x", "b": [1, 2, {"x": "y"}]}, '{"a": "cut': {"a": "cut"}, '{"a":': {"a": None},
        'x } {"a": 1}}} tail': {"a": 1}, '{"z": 01, "t": True}': {"z": "01", "t": True}, "{'a': 'b\\'c'}": {"a": "b'c"},
    }
    assert [json.loads(x) for x in column(spark, cases, J.repaired)] == list(cases.values())
    assert column(spark, ["", "nothing", None], J.repaired) == [None, None, None]


def test_markdown(spark):
    cases = {
        "# Title #\n\nSome **bold** and *it* [link](u) ![pic](p), `*c*`.\n> quote\n1. one\n- two": "Title\n\nSome bold and it link pic, *c*.\n\none\ntwo", "a_b_c 2 * 3 __x__": "a_b_c 2 * 3 x", "```\n# not\n```\nend": "end", "": "",
    }
    assert column(spark, cases, T.plain_markdown) == list(cases.values())
    links = {"[![i](u)](v) see [here][1] <https://a.b> @me a@b.c #12 x#3 GH-7": "see here a@b.c x#3", "<!-- a\nb --> http://x.y/z ok": "ok"}
    assert column(spark, links, T.strip_markdown) == list(links.values())


def test_reports(spark):
    text = "Opening.\n\n**Overview**\nIn short.\n\n## Risk\nSecurity rating: *low*\n\n- Last: list"
    assert column(spark, [text, "", "# Head", None], lambda t: R.summary(t, 6, "none")) == ["In ...", "none", "none", "none"]
    assert column(spark, [text, "", "an overall HIGH one"], lambda t: R.risk_rating(t, "Medium")) == ["Low", "Medium", "High"]
    parts = column(spark, [text], R.outline)[0]
    assert [(p["level"], p["title"]) for p in parts] == [(0, ""), (7, "Overview"), (2, "Risk")]


def test_capital_of_a_letter():
    from sparkquarry.functions import text

    assert [text.upper_letter(c) for c in ("", "a", "é", "ß", "ŉ", "ᾀ", "ﬁ", "ǆ", "1")] == ["", "A", "É", "ẞ", "ŉ", "ᾈ", "ﬁ", "Ǆ", "1"]


def test_processor_of_odd_texts(spark, tmp_path):
    from sparkquarry.plans import registry

    spark.createDataFrame([(1, "ßa"), (2, None), (3, ""), (4, "ﬁn")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["model_processor"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "ẞ"), (2, None, None), (3, 0, ""), (4, 2, "ﬁ")]


def test_clusters_are_fitted_by_more_tasks_than_a_file_has_row_groups(spark, monkeypatch):
    from pyspark.ml import Pipeline

    from sparkquarry.plans import registry

    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    registry.QUERIES["kmeans_clusters"](spark, "/root/testdata/sf0.001")
    assert min(seen) > 1


def test_entries_split_at_their_beginnings(spark):
    """As the leftmost matches that don't overlap, whatever ends lines; and an entry's patterns are matched in one place of the plan."""
    from pyspark.sql import functions as F

    from sparkquarry.functions import reports as R
    from sparkquarry.functions import structure as S

    starts, ends = ["# A (High)", "## 2. B", "1. **C** - LOW", "- **D** [Low]", "**Severity**: high", "* **Fix:** x", "text", "", "  3) E", "#", "**", "- **"], ["\n", "\n\n", "\r\n", "\r", "\u2028", "\x85", " "]
    texts = [a + e + b + e + c for e in ends for a in starts for b in starts for c in ("# A (High)", "", "1. x")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spans = dict(df.select("id", S.spans(F.col("text"), R.ENTRY, "line")).collect())
    for i, found in df.select("id", R.cut(F.col("text"))).collect():
        ends_at = [m["start"] for m in spans[i]][1:] + [len(texts[i])]
        assert [tuple(x) for x in found] == [(m["line"], texts[i][m["end"] : e]) for m, e in zip(spans[i], ends_at)], repr(texts[i])
    plan = R.entries(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(R.AT_THE_END[:40]) <= 3  # twice for the level, which may be empty, once for the title; none for the condition
