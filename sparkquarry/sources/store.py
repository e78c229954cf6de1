"""Tables of a project on shared storage: collections, logs, threat patterns, reports with siblings, caches and task results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import upsert

#: Threat patterns where no file is given: name, pattern, severity.
THREATS = (("reentrancy", r"\.call\s*[({]", "high"), ("access control", r"tx\.origin", "high"), ("randomness", r"block\.timestamp|blockhash", "medium"), ("overflow", r"unchecked\s*\{", "medium"), ("denial of service", r"\bfor\s*\(", "low"))


def threat_patterns(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name, pattern, severity) of a JSON list, or the ones that come with the library."""
    schema = "name string, pattern string, severity string"
    return spark.createDataFrame(list(THREATS), schema) if path is None else spark.read.schema(schema).json(path, multiLine=True).where("pattern is not null")


def detected(lines: DataFrame, patterns: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with the names of the patterns that match them, whatever the case; the patterns are a table of rules, counted before
    they become literals of the plan."""
    rules = patterns.limit(1001).collect()
    if len(rules) > 1000:
        raise ValueError("more patterns than a plan should hold")
    found = F.array_compact(F.array(*(F.when(F.col(line_col).rlike(f"(?i){r['pattern']}"), F.lit(r["name"])) for r in rules)))
    return lines.withColumn("threats", found).where(F.size("threats") > 0)


def collections(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in a folder of a file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()) if system.exists(path) else []


def log_interactions(rows: DataFrame, folder: str, per_file: int = 100_000) -> None:
    """Append interactions (timestamp, request_id, provider, model, endpoint, duration_ms, error) as JSON lines, in files of bounded length, by day."""
    kind = F.when(F.col("error").isNotNull(), F.regexp_extract("error", r"^(\w+)", 1))
    rows.withColumn("error_type", kind).withColumn("day", F.to_date("timestamp")).write.mode("append").option("maxRecordsPerFile", per_file).partitionBy("day").json(folder)


def result_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(name, modified, findings, has_report) of the JSON results of a folder, with whether a markdown report of the same name stands beside; the newest first."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    results = listed.where("path like '%.json'").select("name", F.col("modificationTime").alias("modified"), F.coalesce(F.size(F.from_json(F.get_json_object("text", "$.findings"), "array<string>")), F.lit(0)).alias("findings"))
    reports = listed.where("path like '%.md'").select("name").distinct().withColumn("has_report", F.lit(True))
    return results.join(reports, "name", "left").select("name", "modified", F.greatest("findings", F.lit(0)).alias("findings"), F.coalesce("has_report", F.lit(False)).alias("has_report")).orderBy(F.desc("modified"), "name")


def context_json(files: DataFrame, contracts: DataFrame, functions: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_id, summary): each file without its content, as JSON: path, number of findings, whether it has contracts and functions."""
    has = lambda df, name: df.select("file_id").distinct().withColumn(name, F.lit(True))
    n = findings.groupBy("file_id").agg(F.count(F.lit(1)).alias("findings"))
    joined = files.select("file_id", "path").join(has(contracts, "has_contracts"), "file_id", "left").join(has(functions, "has_functions"), "file_id", "left").join(n, "file_id", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has_contracts", "has_functions")]
    return joined.select("file_id", F.to_json(F.struct("path", F.coalesce("findings", F.lit(0)).alias("findings"), *flags)).alias("summary"))


def cached(cache: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing): cached rows of the wanted keys, and the wanted rows that the cache lacks."""
    keys = wanted.select(key).distinct()
    return cache.join(keys, key, "left_semi"), wanted.join(cache.select(key).distinct(), key, "left_anti")


def stored(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return upsert(cache, rows, [key])


def recovered(table: DataFrame, required: list[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a store: good ones have all required fields, one row of each id; bad ones lack some."""
    whole = None
    for c in required:
        test = F.col(c).isNotNull()
        whole = test if whole is None else whole & test
    return table.where(whole).dropDuplicates([id_col]), table.where(~whole)


def prompts_fixed(prompts: DataFrame) -> DataFrame:
    """Prompts with ids and paths as the store has them: slashes and odd characters of ids replaced, empty texts null, spaces around gone."""
    return prompts.withColumn("id", F.regexp_replace(F.replace("id", F.lit("/"), F.lit("_")), r"[^\w\-.]", "_")).withColumn("text", F.nullif(F.trim("text"), F.lit("")))


def validation_totals(validations: DataFrame, key: str) -> DataFrame:
    """(key, confirmed, rejected, open, total) of validations (key, status)."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return validations.groupBy(key).agg(of("confirmed"), of("rejected"), of("open"), F.count(F.lit(1)).alias("total"))


def tool_metrics(calls: DataFrame, key: str) -> DataFrame:
    """(key, calls, success_rate, mean_ms) of calls (key, ok, duration_ms); rate and mean are 0 without any that count."""
    return calls.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.try_divide(F.count_if("ok"), F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg(F.when(F.col("ok"), F.col("duration_ms"))), F.lit(0.0)).alias("mean_ms"))


def overview(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table, by name, each counted where it lies."""
    out = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
