"""Data flows from sources to sinks, call graphs and function relationships, as joins on keys with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as C
from ..shared import written
from .graph import exploitability
from .intervals import overlap_join

#: Lines of a bin in which functions meet what stands in them.
LINES = 64


def data_flows(files: DataFrame, file_col: str = "file_id", text_col: str = "content", least: int = 2) -> DataFrame:
    """(file, source, source_line, sink, sink_line, vulnerability, function, variables, exploitability, shared), one row a flow.

    A source flows to a sink that stands no earlier in the same function, the first in the file that holds both. At least
    ``least`` control variables occur in the code of source, function or sink. ``shared`` counts the flows before it, by
    source then sink, that begin, pass or end on one of its lines. Source and sink meet by the function that holds
    them, so pairs are of one function only.
    """
    text = files.select(file_col, text_col)
    bodies = C.functions(text, text_col).select(file_col, F.col("name").alias("function"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"), F.col("whole").alias("f_code"))

    def held(rows: DataFrame, *names: str) -> DataFrame:
        met = overlap_join(rows, bodies, [file_col], "start_line", "end_line", "f_start", "f_end", bin_size=LINES)
        return met.where("start_line >= f_start and end_line <= f_end").select(file_col, "function", "f_start", "f_end", "f_code", *names)

    sources = held(C.sources(text, text_col).withColumnsRenamed({"code": "source_code"}).withColumn("source_line", F.col("start_line")), F.col("name").alias("source"), "type", "source_line", "source_code")
    sinks = held(C.sinks(text, text_col).withColumn("sink_line", F.col("start_line")), F.col("name").alias("sink"), "vulnerability", "score", "sink_line", F.col("code").alias("sink_code"))
    place = [file_col, "function", "f_start", "f_end"]
    pairs = sources.join(sinks.drop("f_code"), place).where("source_line <= sink_line")
    first = Window.partitionBy(file_col, "source", "type", "source_line", "sink", "vulnerability", "sink_line").orderBy("f_start", F.desc("f_end"))
    pairs = pairs.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    named = C.control_variables(text, text_col).groupBy(file_col).agg(F.sort_array(F.collect_set("name")).alias("names"))
    code = F.concat_ws("\n", "source_code", "f_code", "sink_code")
    flows = pairs.join(named, file_col).withColumn("code", code).withColumn("variables", F.expr("filter(names, n -> contains(code, n))")).where(F.size("variables") >= least)
    bonus = F.when(F.col("source").isin("msg.sender", "msg.value", "tx.origin"), 1.5).otherwise(0.0)
    flows = flows.withColumn("exploitability", exploitability(F.col("score"), bonus, F.size("variables")))
    return shared_before(flows, [file_col], ["source_line", "source", "sink_line", "sink", "vulnerability"], ["source_line", "f_start", "sink_line"]).select(
        file_col, "source", "source_line", "sink", "sink_line", "vulnerability", "function", "variables", "exploitability", "shared"
    )


def shared_before(rows: DataFrame, group: list[str], order: list[str], lines: list[str]) -> DataFrame:
    """rows with ``shared``: how many before it, in the group's order, have one of its lines, which are at most three columns.

    By inclusion and exclusion: the rows before that have a line, less those that have two, and so on. Each set of a row's lines
    is counted by a running number within its equals, so nothing is gathered that grows with the group.
    """
    own = rows.withColumn("own", F.array_sort(F.array_distinct(F.array(*lines)))).withColumn("row", F.monotonically_increasing_id())
    own = written(own)
    pairs = "filter(flatten(transform(own, x -> transform(own, y -> array(x, y)))), p -> p[0] < p[1])"
    sets = own.select(*group, *order, "row", F.explode(F.expr(f"concat(transform(own, x -> array(x)), {pairs}, if(size(own) = 3, array(own), array()))")).alias("set"))
    before = F.rank().over(Window.partitionBy(*group, "set").orderBy(*order, "row")) - 1
    sums = sets.withColumn("n", F.when(F.size("set") % 2 == 1, before).otherwise(-before)).groupBy("row").agg(F.sum("n").cast("int").alias("shared"))
    return own.join(sums, "row").drop("own", "row")


def _called(body: Column, name: Column) -> Column:
    return F.regexp_like(body, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\(")))


def call_edges(functions: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, caller, callee) of functions (scope, name, body) in the same scope whose body calls another by name.

    Names that bodies call meet names of functions by equality; no pair of functions is formed to be tested.
    """
    called = functions.select(*scope, F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), F.lit(1)))).alias("callee"))
    known = functions.select(*scope, F.col("name").alias("callee")).distinct()
    return called.where("caller <> callee").join(known, [*scope, "callee"]).select(*scope, "caller", "callee").distinct()


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("callee") == name)


def callees(edges: DataFrame, functions: DataFrame, caller: str) -> DataFrame:
    """Forward edges of a function with the definitions of the names it calls, all of them where a name is ambiguous."""
    return edges.where(F.col("caller") == caller).select("callee").distinct().join(functions, F.col("callee") == F.col("name"))


def relationships(functions: DataFrame) -> DataFrame:
    """(name, upstream, downstream): sorted sets of functions that mention it and that it mentions as whole words, whatever the case.

    Words of contents meet names by equality.
    """
    short = functions.select(F.element_at(F.split("name", r"\."), -1).alias("name"), "content")
    words = short.select(F.col("name").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    names = short.select("name").distinct()
    edges = words.join(names.select(F.col("name").alias("dst"), F.lower("name").alias("word")), "word").where("src <> dst").select("src", "dst").distinct()
    up = edges.groupBy(F.col("dst").alias("name")).agg(F.sort_array(F.collect_set("src")).alias("upstream"))
    down = edges.groupBy(F.col("src").alias("name")).agg(F.sort_array(F.collect_set("dst")).alias("downstream"))
    none = F.array().cast("array<string>")
    return names.join(up, "name", "left").join(down, "name", "left").select("name", F.coalesce("upstream", none).alias("upstream"), F.coalesce("downstream", none).alias("downstream"))
