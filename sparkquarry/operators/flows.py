"""Facts about contracts, functions and flows joined, merged and summed up. All joins are equality joins with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dealt
from .containment import holding
from .intervals import overlap_join
from .windows import global_rank

NONE = "array<string>"


def with_flows(scenarios: DataFrame, flows: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Each scenario (file, function, ...) with the sorted ids of the flows of its file whose path passes the function, and their number.

    ``flows``: file, flow_id, path (array of type, name). Scenarios without any stay, with none.
    """
    passed = flows.select(file_col, "flow_id", F.explode(F.expr("array_distinct(transform(filter(path, n -> n.type = 'function'), n -> n.name))")).alias("function"))
    ids = passed.groupBy(file_col, "function").agg(F.sort_array(F.collect_set("flow_id")).alias("flows"))
    joined = scenarios.join(ids, [file_col, "function"], "left")
    return joined.withColumn("flows", F.coalesce("flows", F.array().cast(flows.select(F.array("flow_id")).schema[0].dataType))).withColumn("n_flows", F.size("flows"))


def mentioned(items: DataFrame, texts: DataFrame, names: list[str], item_id: str, text_id: str, text_col: str = "text") -> DataFrame:
    """(item, text_id, text): the texts that hold one of the item's names, of any number of words, as words, whatever the case; a row
    a text, so that an item that many texts mention is no large group."""
    wanted = items.select(item_id, F.explode(F.array(*names)).alias("name"))
    return holding(wanted, texts, item_id, "name", text_id, text_col, ignore_case=True, words=True, keep=True)


def assembled(contract_chunks: DataFrame, function_chunks: DataFrame) -> DataFrame:
    """(contract, name, code, origin): functions that contracts declare (array of name, code), each replaced by the chunk of the
    same contract and name, and chunks of known contracts that are not declared."""
    declared = contract_chunks.select("contract", F.explode("functions").alias("f")).select("contract", "f.name", F.col("f.code").alias("declared"))
    known = function_chunks.join(contract_chunks.select("contract").distinct(), "contract", "left_semi").select("contract", "name", F.col("code").alias("chunk"))
    joined = declared.join(known, ["contract", "name"], "full_outer")
    return joined.select("contract", "name", F.coalesce("chunk", "declared").alias("code"), F.when(F.col("chunk").isNotNull(), "chunk").otherwise("declared").alias("origin"))


def chunk_calls(contract_chunks: DataFrame, function_chunks: DataFrame) -> DataFrame:
    """(contract, caller, callee): calls (array of name) of function chunks whose contract has a chunk too."""
    return function_chunks.join(contract_chunks.select("contract").distinct(), "contract").select("contract", F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct()


def merged_flows(derived: DataFrame, acquired: DataFrame) -> DataFrame:
    """(name, confidence, functions, text, origin): two versions of flows by name; the higher confidence, the derived functions
    with the acquired ones that are new behind them, and both texts under their labels."""
    a = derived.select("name", F.col("confidence").alias("ca"), F.col("functions").alias("fa"), F.col("text").alias("ta"))
    b = acquired.select("name", F.col("confidence").alias("cb"), F.col("functions").alias("fb"), F.col("text").alias("tb"))
    none = F.array().cast(NONE)
    joined = a.join(b, "name", "full_outer")
    both = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    text = F.when(both, F.concat(F.lit("Derived: "), "ta", F.lit("\nAcquired: "), "tb")).otherwise(F.coalesce("ta", "tb"))
    origin = F.when(F.col("fa").isNull(), "acquired").when(F.col("fb").isNull(), "derived").otherwise("hybrid")
    return joined.select("name", F.greatest("ca", "cb").alias("confidence"), F.concat(F.coalesce("fa", none), F.array_except(F.coalesce("fb", none), F.coalesce("fa", none))).alias("functions"), text.alias("text"), origin.alias("origin"))


def new_expressions(expressions: DataFrame, contracts: DataFrame, existing: DataFrame) -> DataFrame:
    """(contract, type, category, expression) of stored expressions whose pattern is the contract's name or any, but for those
    whose contract, type and category exist.

    What holds for any contract is one row an expression, whose contract is null, with the contracts that it exists for beside
    it (``but``): looking a contract up is a filter, and nothing is paired with all contracts.
    """
    named = expressions.join(contracts, F.col("contract_pattern") == F.col("contract")).select("contract", "type", "category", "expression")
    named = named.join(existing, ["contract", "type", "category"], "left_anti").withColumn("but", F.array().cast(NONE))
    taken = existing.join(contracts, "contract", "left_semi").groupBy("type", "category").agg(F.sort_array(F.collect_set("contract")).alias("but"))
    general = expressions.where("contract_pattern = 'any'").join(taken, ["type", "category"], "left")
    return named.unionByName(general.select(F.lit(None).cast("string").alias("contract"), "type", "category", "expression", F.coalesce("but", F.array().cast(NONE)).alias("but")))


def expressions_for(found: DataFrame, contract: Column | str) -> DataFrame:
    """The rows of new_expressions() for one contract."""
    name = F.lit(contract) if isinstance(contract, str) else contract
    return found.where((F.col("contract") == name) | (F.col("contract").isNull() & ~F.array_contains("but", name))).withColumn("contract", name).drop("but")


def for_each_contract(found: DataFrame, contracts: DataFrame, most: int = 2000) -> DataFrame:
    """The rows of new_expressions() for all contracts: what holds for any is given with each contract but some. All these pairs are
    the result; contracts are dealt by hash to lists of some ``most``, each expression meets every list, and nothing is shuffled behind
    the join. A list is exploded, which makes rows twice as fast as a join does. Only contracts that some expression exists for
    are looked for in ``but``; the pairs of the others, which are most, have no condition."""
    columns, known = ["type", "category", "expression"], contracts.where("contract is not null")
    parts = max(1, -(-known.count() // most))
    number = F.pmod(F.xxhash64("contract"), F.lit(parts)).alias("__part")
    general = found.where("contract is null").select(*columns, "but")
    taken = general.select(F.explode("but").alias("contract")).distinct()

    def met(rows: DataFrame, some: DataFrame, wanted) -> DataFrame:
        lists = some.groupBy(number).agg(F.collect_list("contract").alias("__contracts"))
        spread = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return dealt(spread, *columns, "__part", tasks=8).join(lists, "__part").select(F.explode(wanted).alias("contract"), *columns)

    free = met(general.drop("but"), known.join(taken, "contract", "left_anti"), F.col("__contracts"))
    some = met(general, known.join(taken, "contract", "left_semi"), F.filter("__contracts", lambda c: ~F.array_contains("but", c)))
    return found.where("contract is not null").select("contract", *columns).unionByName(free).unionByName(some)


def cleaned(calls: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """Calls whose file, contract and function still exist."""
    return calls.join(definitions.select(*keys).distinct(), keys, "left_semi")


def validated(findings: DataFrame, text: DataFrame, id_col: str) -> DataFrame:
    """Findings (id, ordinal, ...) with a status by what the numbered items of a validation text (id, validation) say of them."""
    items = text.select(id_col, F.explode(F.regexp_extract_all("validation", F.lit(r"(?m)^(\d+)[.)][ \t]+([^\n]*)"), F.lit(0))).alias("item"))
    items = items.select(id_col, F.regexp_extract("item", r"^(\d+)", 1).cast("int").alias("ordinal"), F.lower("item").alias("said"))
    items = items.groupBy(id_col, "ordinal").agg(F.min("said").alias("said"))
    said = F.col("said")
    status = F.when(said.rlike("invalid|false"), "rejected").when(said.rlike("confirm|valid"), "confirmed").otherwise("unclear")
    return findings.join(items, [id_col, "ordinal"], "left").withColumn("status", F.when(said.isNull(), "open").otherwise(status)).drop("said")


def flow_members(workflows: DataFrame, functions: DataFrame) -> DataFrame:
    """(contract, workflow, members, lines): functions that a workflow (contract, workflow, names) names and the contract has, and
    their lines, each once; workflows without any go."""
    named = workflows.select("contract", "workflow", F.posexplode("names").alias("at", "name"))
    met = named.join(functions.select("contract", "name", "start_line", "end_line"), ["contract", "name"])
    out = met.groupBy("contract", "workflow").agg(F.array_sort(F.collect_list(F.struct("at", "name", "start_line", "end_line"))).alias("m"))
    return out.select("contract", "workflow", F.col("m.name").alias("members"), F.expr("array_sort(array_distinct(flatten(transform(m, x -> sequence(x.start_line, x.end_line)))))").alias("lines"))


def flows_summary(flows: DataFrame, key: str) -> DataFrame:
    """(key, n, types, average_confidence): flows by type as text ``type=n``, in order; a missing type is unknown, a missing confidence 0."""
    counted = flows.groupBy(key, F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    return counted.groupBy(key).agg(F.sum("k").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "type", F.col("k").cast("string")))), ",").alias("types"), (F.sum("c") / F.sum("k")).alias("average_confidence"))


#: Areas of flow types.
AREAS = {"value_transfer": ("value_transfer", "ether_transfer"), "external_calls": ("external_call", "cross_contract"), "state_changes": ("state_change", "storage_write"), "access_control": ("access_control", "authorization")}


def risk_areas(flows: DataFrame, key: str) -> DataFrame:
    """(key, area, functions): functions with a flow of the area's types, as often as they have one, in order."""
    area = F.coalesce(*(F.when(F.col("type").isin(*types), a) for a, types in AREAS.items()))
    return flows.withColumn("area", area).where("area is not null").groupBy(key, "area").agg(F.sort_array(F.collect_list("function")).alias("functions"))


def attack_surfaces(surfaces: DataFrame, key: str) -> DataFrame:
    """One row a key: ids by severity and by source of the flow, and distinct variables, all in order."""
    of = lambda c, v: F.sort_array(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("derived" if c == "flow_source" else "low")) == v, F.col("id"))))
    cells = [of("severity", v).alias(f"{v}_severity") for v in ("high", "medium", "low")] + [of("flow_source", v).alias(f"{v}_flows") for v in ("derived", "acquired", "hybrid")]
    return surfaces.groupBy(key).agg(*cells, F.sort_array(F.array_distinct(F.flatten(F.collect_list("variables")))).alias("variables"))


def prompt_stats(prompts: DataFrame) -> DataFrame:
    """One row: prompts by what they hold (a prompt, several, none) with their shares, and lengths of those that hold text."""
    kind = F.when(F.coalesce(F.length("prompt"), F.lit(0)) > 0, "single").when(F.coalesce(F.size("prompts"), F.lit(0)) > 0, "multi").otherwise("none")
    n = F.count(F.lit(1))
    size = F.when(F.length("prompt") > 0, F.length("prompt"))
    counts = [F.count_if(kind == k).alias(k) for k in ("single", "multi", "none")]
    return prompts.agg(n.alias("n"), *counts, F.try_divide(F.count_if(kind == "single"), n).alias("share"), F.avg(size).alias("mean"), F.min(size).alias("least"), F.max(size).alias("most"))


def model_wins(trials: DataFrame) -> DataFrame:
    """(model, n, wins, mean, rate) of trials (trial, model, score): a trial is won by its best score, the first model of equals."""
    best = trials.groupBy("trial").agg(F.max_by("model", F.struct("score", F.expr("-hash(model)"))).alias("any"), F.max("score").alias("score"))
    winner = trials.join(best.select("trial", "score"), ["trial", "score"]).groupBy("trial").agg(F.min("model").alias("model"))
    wins = winner.groupBy("model").agg(F.count(F.lit(1)).alias("wins"))
    return trials.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).join(wins, "model", "left").select("model", "n", F.coalesce("wins", F.lit(0)).alias("wins"), "mean", (F.coalesce("wins", F.lit(0)) / F.col("n")).alias("rate"))


def answer_confidence(questions: DataFrame, key: str) -> DataFrame:
    """(key, confidence): share of sub-questions with an answer, at most 1, and 0 without questions."""
    return questions.groupBy(key).agg(F.coalesce(F.least(F.try_divide(F.count_if((F.col("answer").isNotNull()) & (F.col("answer") != "")), F.count("question")), F.lit(1.0)), F.lit(0.0)).alias("confidence"))


def folded(rows: DataFrame, key: str, order: str, value: str, start: Column, step) -> DataFrame:
    """(key, result): a left fold of a key's values in order; ``step(acc, x)`` are expressions. A key is one row of its values."""
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("xs"))
    return ordered.select(key, F.aggregate("xs", start, lambda acc, x: step(acc, x["v"])).alias("result"))


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the parts, of each key those of the first part that has it."""
    ranked = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    least = ranked.groupBy(key).agg(F.min("__part").alias("__part"))
    return ranked.join(least, [key, "__part"], "left_semi").drop("__part")


def ordered_distinct(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values in order of their first occurrence."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))).alias("xs")).select(key, F.col("xs.v").alias("values"))


def uncovered(chunks: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (start_line, end_line) that hold a line which no covered interval of the same keys has.

    Covered intervals are merged first, so a chunk is covered if and only if one merged interval holds it.
    """
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start_line") > reach + 1).cast("int"), F.lit(1))
    merged = covered.select(*keys, "start_line", "end_line").withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w)).groupBy(*keys, "island").agg(F.min("start_line").alias("c_start"), F.max("end_line").alias("c_end"))
    held = chunks.alias("k").join(merged.alias("m"), keys).where("start_line >= c_start and end_line <= c_end").select(*chunks.columns)
    return chunks.join(held.distinct(), chunks.columns, "left_anti")


def confident(findings: DataFrame) -> DataFrame:
    """Findings of high or medium confidence that are not said to be unreachable, with the confidence as severity where none is given."""
    kept = findings.where("lower(confidence) in ('high', 'medium') and coalesce(reachable, true)")
    return kept.withColumn("severity", F.coalesce("severity", F.initcap("confidence")))


def exploitable(flows: DataFrame, least: float = 7.0) -> DataFrame:
    return flows.where((F.col("exploitability") >= least) & (F.coalesce(F.length("summary"), F.lit(0)) > 0))


def progress(events: DataFrame, key: str) -> DataFrame:
    """Completions (key, at, done, total) with a running number, the rate a second since the first, and the seconds left at it."""
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    seconds = (F.unix_micros("at") - F.min(F.unix_micros("at")).over(w)) / 1e6
    out = events.withColumn("completed", F.sum("done").over(w)).withColumn("rate", F.try_divide(F.col("completed"), seconds))
    return out.withColumn("left", F.try_divide(F.col("total") - F.col("completed"), F.col("rate")))


def latest(rows: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def steps(flows: DataFrame) -> DataFrame:
    """(file_id, flow_id, steps): texts ``n. type name (lines)`` of a path's nodes, in order."""
    step = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["type"], F.lit(" "), x["name"], F.lit(" ("), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit(")"))
    return flows.select("file_id", "flow_id", F.transform("path", step).alias("steps"))


def found_or_created(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, name, type): the nodes, and a node with an id of its own after theirs for each wanted (name, type) that isn't there."""
    missing = wanted.select("name", "type").distinct().join(nodes, ["name", "type"], "left_anti")
    top = nodes.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("top")).first()["top"]  # one number
    numbered = global_rank(missing, ["name", "type"], "n")
    return nodes.select("id", "name", "type").unionByName(numbered.select((F.col("n") + top).cast(nodes.schema["id"].dataType).alias("id"), "name", "type"))


def calls_of(functions: DataFrame, calls: DataFrame, id_col: str = "function_id") -> DataFrame:
    """(function, call_id): calls that a function makes or takes, once each; two equality joins, not one on a disjunction."""
    made = functions.select(id_col).join(calls.select(F.col("caller_id").alias(id_col), "call_id"), id_col)
    taken = functions.select(id_col).join(calls.select(F.col("callee_id").alias(id_col), "call_id"), id_col)
    return made.unionByName(taken).distinct()


def shared_lines(left: DataFrame, right: DataFrame, key: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(key, lines): lines that intervals of both sides have, sorted, once each; keys without one go."""
    lines = lambda df: df.select(key, F.explode(F.sequence(start, end)).alias("line")).distinct()
    return lines(left).join(lines(right), [key, "line"]).groupBy(key).agg(F.sort_array(F.collect_list("line")).alias("lines"))


def variables_at_risk(flows: DataFrame, key: str, least: float = 7.0) -> DataFrame:
    """(key, variables): variables of flows that are exploitable enough, sorted, once each."""
    return flows.where(F.col("exploitability") >= least).select(key, F.explode("variables").alias("v")).groupBy(key).agg(F.sort_array(F.collect_set("v")).alias("variables"))


def findings_with_flows(findings: DataFrame, flows: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (keys, start_line, end_line) with the sorted ids of the flows (keys, flow_id, f_start, f_end) whose lines overlap theirs, none for some."""
    met = overlap_join(findings, flows, keys, "start_line", "end_line", "f_start", "f_end").groupBy(*findings.columns).agg(F.sort_array(F.collect_set("flow_id")).alias("flows"))
    return findings.join(met, findings.columns, "left")


def severity_summary(findings: DataFrame, key: str) -> DataFrame:
    """(key, total, high, medium, low) of findings, by severity whatever the case."""
    of = lambda s: F.count_if(F.lower("severity") == s).alias(s)
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("total"), of("high"), of("medium"), of("low"))
