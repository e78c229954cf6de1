"""Readers and sinks: source trees, datasets and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_of_path


def files(spark: SparkSession, folder, pattern: str = "*", exclude: list[str] = (), source_extension: str = "sol") -> DataFrame:
    """Text files under a folder (or list of paths) as rows; bytes that aren't UTF-8 are replaced. Names matching an ``exclude`` regex go."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select(
        F.sha2("path", 256).alias("file_id"), "path", name.alias("name"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"),
        F.col("length").alias("size"), "modificationTime", F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
    for regex in exclude:
        out = out.where(~F.col("name").rlike(regex))
    return out.withColumn("is_source", F.col("extension") == source_extension).withColumn("language", language_of_path(F.col("path")))


def scan_patterns(spark: SparkSession, folder: str, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Files by glob patterns, one row for each pattern that a file matches, without those that match an exclude pattern."""
    to_regex = lambda g: "^" + "".join(".*" if c == "*" else "." if c == "?" else ("\\" + c if not c.isalnum() and c != "/" else c) for c in g.replace("**/", "*")) + "$"
    found = files(spark, folder)
    parts = [found.where(F.col("name").rlike(to_regex(p)) | F.col("path").rlike(to_regex("*/" + p))).withColumn("pattern", F.lit(p)) for p in include]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    for p in exclude:
        out = out.where(~(F.col("name").rlike(to_regex(p)) | F.col("path").rlike(to_regex("*/" + p))))
    return out


def jsonl(spark: SparkSession, path, schema: str | None = None, keep_bad: bool = False) -> DataFrame:
    reader = spark.read.option("mode", "PERMISSIVE" if keep_bad else "DROPMALFORMED").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema else reader).json(path)


def json_items(spark: SparkSession, path, element_schema: str | None = None) -> DataFrame:
    """A list, an object with ``items``, or a single object, as rows."""
    df = spark.read.option("multiLine", "true").json(path) if element_schema is None else spark.read.option("multiLine", "true").schema(f"items array<struct<{element_schema}>>, {element_schema}").json(path)
    if "items" not in df.columns:
        return df
    own = [c for c in df.columns if c != "items"]
    listed = df.where(F.col("items").isNotNull()).select(F.explode("items").alias("i")).select("i.*")
    return listed.unionByName(df.where(F.col("items").isNull()).select(*own), allowMissingColumns=True) if own else listed


def csv_documents(spark: SparkSession, path) -> DataFrame:
    """Header CSV: title (first of title, name, heading, id), content (labelled known fields, else all fields); rows without any value go."""
    df = spark.read.option("header", "true").csv(path)
    low = {c.lower(): c for c in df.columns}
    known = [low[c] for c in ("description", "content", "text", "body", "details") if c in low]
    titles = [F.nullif(F.trim(F.col(f"`{low[c]}`")), F.lit("")) for c in ("title", "name", "heading", "id") if c in low]
    label = lambda c: F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`")))
    some = F.concat_ws("\n\n", *map(label, known or df.columns))
    content = F.when(some != "", some).otherwise(F.concat_ws("\n\n", *map(label, df.columns)))
    return df.withColumn("__title", F.coalesce(*titles, F.lit("Untitled"))).withColumn("__content", content).where("__content <> ''").withColumnsRenamed({"__title": "doc_title", "__content": "doc_content"})


def vulnerability_items(items: DataFrame) -> DataFrame:
    """Records with aliased fields as (title, description, severity, category)."""
    pick = lambda names, default: F.coalesce(*(F.col(n).cast("string") for n in names if n in items.columns), F.lit(default))
    return items.select(pick(("title", "name", "id"), "Untitled").alias("title"), pick(("description", "details", "text", "content"), "").alias("description"), pick(("severity", "risk", "impact"), "Unknown").alias("severity"), pick(("category", "type", "class"), "general").alias("category"))


def reader_for(kind: str):
    return {"json": json_items, "jsonl": jsonl, "csv": csv_documents, "source": files, "parquet": lambda spark, path: spark.read.parquet(path), "log": lambda spark, path: jsonl(spark, path, keep_bad=True), "vulnerabilities": lambda spark, path: vulnerability_items(json_items(spark, path))}[kind]


def report_lines(findings: DataFrame, kind: str, title: str = "Report") -> DataFrame:
    """(place, text) of a report: a title, counts by severity, and the findings in severity order; kind is ``md`` or ``html``."""
    from ..functions.text import SEVERITIES, severity_rank

    severity, description = F.coalesce("severity", F.lit("Low")), F.coalesce("description", F.lit(""))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rank = severity_rank(F.col("severity")).cast("int")
    if kind == "html":
        heads = ("<h1>%s</h1>", "<p>%s: %s</p>")
        lines = F.format_string("<li><b>%s</b> (%s): %s</li>", escape(F.col("title")), escape(severity), escape(description))
    else:
        heads = ("# %s", "- %s: %s")
        lines = F.format_string("- **%s** (%s): %s", "title", severity, description)
    spark = findings.sparkSession
    counts = spark.createDataFrame([(i, s) for i, s in enumerate(SEVERITIES)], "n int, s string").join(findings.groupBy(severity.alias("s")).count(), "s", "left")
    head = spark.range(1).select(F.struct(F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit("").alias("title")).alias("place"), F.lit(heads[0] % title).alias("text"))
    middle = counts.select(F.struct(F.lit(1).alias("part"), F.col("n").alias("rank"), F.col("s").alias("title")).alias("place"), F.format_string(heads[1], "s", F.coalesce("count", F.lit(0))).alias("text"))
    return head.unionByName(middle).unionByName(findings.select(F.struct(F.lit(2).alias("part"), rank.alias("rank"), F.col("title").alias("title")).alias("place"), lines.alias("text")))


def write_report(findings: DataFrame, path: str, kind: str = "json", title: str = "Report") -> None:
    """Findings (title, severity, description) in severity order, as JSON lines, markdown or html."""
    from ..functions.text import severity_rank

    if kind == "json":
        findings.orderBy(severity_rank(F.col("severity")), "title").write.json(path)
    elif kind in ("md", "html"):
        report_lines(findings, kind, title).orderBy("place").select("text").write.text(path)
    else:
        raise ValueError(f"no report of kind {kind}")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row a markdown report of a folder: path, title (of its first heading), reported (time in its name), findings (number of its entries)."""
    from ..functions.scalars import report_date

    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return texts.select("path", F.regexp_extract("value", r"(?m)^#[ \t]+([^\n]+)", 1).alias("title"), report_date(F.col("path")).alias("reported"), F.size(F.regexp_extract_all("value", F.lit(r"(?m)^- \*\*"), F.lit(0))).alias("findings"))


def directory_tree(paths: DataFrame, depth: int = 3, path_col: str = "path") -> DataFrame:
    """(folder, level, files): folders of relative paths down to a depth, each with the number of files below it."""
    parts = F.split(path_col, "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth)))
    folders = paths.where(F.size(parts) > 1).select(F.explode(F.transform(levels, lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), i.alias("level")))).alias("f"))
    return folders.groupBy("f.folder", "f.level").agg(F.count(F.lit(1)).alias("files"))


def prompts_by(prompts: DataFrame, name: str | None = None, kind: str | None = None, project: str | None = None) -> DataFrame:
    """Prompts of a name, type and project; what is not given does not matter."""
    for column, value in (("name", name), ("type", kind), ("project", project)):
        if value is not None:
            prompts = prompts.where(F.col(column) == value)
    return prompts


def export_prompts(prompts: DataFrame, path: str) -> None:
    prompts.write.json(path)


def import_prompts(existing: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Existing prompts with those of a JSON lines export put in place of those of the same keys."""
    rows = existing.sparkSession.read.schema(existing.schema).json(path)
    return upsert(existing, rows, keys)


def write_families(docs: DataFrame, path: str, key: str, families: dict[str, list[str]]) -> None:
    """Vertical partitions of a document table: one table of the key and its columns for each family."""
    for name, columns in families.items():
        docs.select(key, *columns).write.parquet(f"{path}/{name}")


def append_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose keys aren't there, the first of each key."""
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def upsert(existing: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Existing rows, replaced by new ones of the same keys; of new rows of one key the last by ``order``, or any without it. Null
    keys are equal to each other."""
    if order is None:
        last = rows.dropDuplicates(keys)
    else:
        best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("o"), F.struct(*rows.columns).alias("r"))).alias("m"))
        last = best.select("m.r.*")
    held = last.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return existing.join(held, same, "left_anti").unionByName(last)


def repository(spark: SparkSession, clone: str, pattern: str = "*.sol", exclude: list[str] = ()) -> DataFrame:
    """Files of a repository that was cloned to shared storage beforehand; what git keeps for itself is left out."""
    return files(spark, clone, pattern, [r"/\.git/", *exclude])


def issues(spark: SparkSession, path: str, labels: list[str] | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Issues of exported pages of an issue tracker's JSON lists: number, title, state, labels, body, updated_at, is_pull; the last
    updated first, of all the labels and not before ``since`` where they are given."""
    schema = "number long, title string, state string, body string, updated_at string, labels array<struct<name:string>>, pull_request struct<url:string>"
    rows = spark.read.schema(schema).json(path, multiLine=True).where("number is not null").select("number", "title", "state", F.col("labels.name").alias("labels"), "body", "updated_at", F.col("pull_request").isNotNull().alias("is_pull"))
    if labels:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, labels)), "labels")) == 0)
    if since:
        rows = rows.where(F.col("updated_at") >= since)
    rows = rows.orderBy(F.desc("updated_at"), "number")
    return rows.limit(limit) if limit is not None else rows
