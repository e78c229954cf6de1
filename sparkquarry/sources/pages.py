"""Python data source ``json_pages``: lists of JSON records in pages behind an address, and logs of JSON lines that rotate by bytes.

    spark.dataSource.register(JsonPages)
    spark.read.format("json_pages").schema(...).option("url", "https://host/issues?page={page}&per_page=100").load()
    df.write.format("json_pages").option("rotate", 10_000_000).mode("append").save(folder)
    spark.read.format("json_pages").schema(...).load(folder)

A read has a partition a page or file. Conditions of labels, time and state go to the address or drop records in the reader, before
they reach Spark. A write makes hidden files that a commit names, so failed tasks and jobs leave none.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

#: Bytes of a log file after which the next one is begun, and how long an answer is waited for, in seconds.
ROTATE, PATIENCE = 10 << 20, 60
#: How a server names its last page.
LAST = re.compile(r'<[^>]*[?&]page=(\d+)[^>]*>;\s*rel="last"')


def _files(path: str):
    """(file system, folder) of a path: any that Arrow knows, or of this machine."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def fetched(address: str) -> tuple[list[dict], str]:
    """The records of a page, and what its head says about others."""
    from urllib.request import Request, urlopen

    with urlopen(Request(address, headers={"Accept": "application/json"}), timeout=PATIENCE) as answer:  # noqa: S310
        found = json.load(answer)
        return (found if isinstance(found, list) else [found]), answer.headers.get("Link") or ""


@dataclass
class Page(InputPartition):
    address: str
    lines: bool


class PagesReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        self.equal: dict[str, object] = {}
        self.least: list[tuple[str, object, bool]] = []
        self.labels = [x for x in (options.get("labels") or "").split(",") if x]
        if since := options.get("since"):
            self.least.append((options.get("since_field", "updated_at"), since, True))

    def pushFilters(self, filters) -> Iterator:
        """Equality and lower bounds of top-level strings and numbers are applied here; others stay with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)):
                self.equal[f.attribute[0]] = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)):
                self.least.append((f.attribute[0], f.value, isinstance(f, GreaterThanOrEqual)))
            else:
                yield f

    def _query(self) -> str:
        """What the server can leave out: labels, and records before a time."""
        from urllib.parse import urlencode

        since = [v for c, v, _ in self.least if c == self.options.get("since_field", "updated_at")]
        return "".join("&" + urlencode({k: v}) for k, v in (("labels", ",".join(self.labels)), ("since", max(since, default=None))) if v)

    def partitions(self) -> list[InputPartition]:
        if url := self.options.get("url"):
            address = lambda n: url.format(page=n) + self._query()
            pages = int(self.options.get("pages") or 0)
            if not pages:
                last = LAST.search(fetched(address(1))[1])
                pages = int(last[1]) if last else 1
            return [Page(address(n), False) for n in range(1, pages + 1)]
        from pyarrow import fs

        system, folder = _files(self.options["path"])
        names = [i.path for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and not i.base_name.startswith((".", "_"))]
        prefix = self.options["path"].rstrip("/")
        return [Page(f"{prefix}/{name.rsplit('/', 1)[-1]}", name.endswith(".jsonl")) for name in sorted(names)]

    def _kept(self, record: dict) -> bool:
        names = {x.get("name") if isinstance(x, dict) else x for x in record.get("labels") or ()} if self.labels else set()
        least = all(record.get(c) is not None and (record[c] >= v if closed else record[c] > v) for c, v, closed in self.least)
        return least and all(record.get(c) == v for c, v in self.equal.items()) and names.issuperset(self.labels)

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # no pages at all
            return
        columns = [(f.name, f.dataType.typeName()) for f in self.schema]
        limit = int(self.options.get("limit") or -1)
        for record in self._records(partition):
            if limit == 0:
                return
            if self._kept(record):
                limit -= 1
                yield tuple(self._value(record.get(name), kind) for name, kind in columns)

    def _records(self, partition: Page) -> Iterator[dict]:
        if "path" not in self.options:
            yield from fetched(partition.address)[0]
            return
        system, name = _files(partition.address)
        with system.open_input_stream(name) as stream:
            if partition.lines:
                import io

                yield from (json.loads(line) for line in io.TextIOWrapper(stream, "utf-8", newline="\n") if line.strip())
            else:
                yield from json.load(stream)

    @staticmethod
    def _value(value, kind: str):
        if value is None:
            return None
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if kind in ("double", "float"):
            return float(value)
        if kind == "timestamp":
            from datetime import datetime

            return datetime.fromisoformat(value)
        return [x.get("name") if isinstance(x, dict) else x for x in value] if kind == "array" else value


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class LogWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.rotate, self.overwrite = options["path"], int(options.get("rotate") or ROTATE), overwrite

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        system, folder = _files(self.path)
        system.create_dir(folder, recursive=True)
        task, names, stream, size = TaskContext.get().partitionId(), [], None, 0
        try:
            for row in rows:
                line = (json.dumps(row.asDict(True), ensure_ascii=False, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v)) + "\n").encode()
                if stream is not None and size + len(line) > self.rotate:
                    stream.close()
                    stream = None
                if stream is None:
                    name = f"part-{task:05d}-{len(names):05d}-{uuid.uuid4()}.jsonl"
                    names.append((f"{folder}/_{name}", f"{folder}/{name}"))
                    stream, size = system.open_output_stream(names[-1][0]), 0
                stream.write(line)
                size += len(line)
        except BaseException:
            if stream is not None:
                stream.close()
                stream = None
            for hidden, _ in names:
                system.delete_file(hidden)
            raise
        finally:
            if stream is not None:
                stream.close()
        return Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, folder = _files(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.is_file and not info.base_name.startswith("_"):
                    system.delete_file(info.path)
        for message in messages:
            for hidden, name in message.names if message else ():
                system.move(hidden, name)

    def abort(self, messages) -> None:
        system, _ = _files(self.path)
        for message in messages:
            for hidden, _ in message.names if message else ():
                system.delete_file(hidden)


class JsonPages(DataSource):
    """Options of reads: ``url`` with ``{page}`` and maybe ``pages``, else a folder; ``labels`` (all of them, comma-joined), ``since``
    and ``since_field``, ``limit`` (records a page). Of writes: a folder, ``rotate`` (bytes). Strings take any value as JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self):
        return "number long, title string, state string, body string, updated_at string, labels array<string>"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LogWriter(dict(self.options), overwrite)


def register(spark) -> None:
    """Make the format known to the session, and its filters pushed down."""
    from ..ship import to_workers

    to_workers(spark)
    spark.dataSource.register(JsonPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
