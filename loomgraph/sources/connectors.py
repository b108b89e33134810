"""Connectors as data sources of Spark, in batch and as streams, and the projection of what they read to intake envelopes.

"loomgraph_tree": files of a folder tree, one row each. As a stream, its offset is the last (time of change, path) seen,
so it doesn't grow with the tree.
"loomgraph_trajectories": lines of append-only logs, one row each. As a stream, its offset names for each log how far it
was read, up to the end of a line, and a hash of its first bytes: a log that was cut or replaced is read anew.

Files are reached through pyarrow's file systems, so a path may be a local one or the URI of a store. A link that leads
out of the tree is not followed. Large logs are cut into ranges of RANGE_BYTES; lines belong to the range they begin in.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import rules, text as X

RANGE_BYTES = 32 << 20
FILES_A_TASK = 256
HEAD_BYTES = 4096
#: Fixed value: the largest source that is taken in.
MOST_BYTES = 25 << 20
PAYLOAD = pa.schema([("source_path", pa.string()), ("byte_offset", pa.int64()), ("content", pa.binary()), ("occurred_at", pa.string()), ("collected_at", pa.string())])
PAYLOAD_DDL = "source_path string, byte_offset long, content binary, occurred_at string, collected_at string"


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.realpath(path)
    system, base = fs.FileSystem.from_uri(path)
    return system, os.path.realpath(base) if isinstance(system, fs.LocalFileSystem) else base.rstrip("/")


def listed(path: str, pattern: str) -> list[tuple[str, int, int]]:
    """(path below the root, size, time of change in ns) of the files whose name matches, hidden ones and links that lead
    out of the tree left out, in order of path."""
    system, base = place(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        below = info.path.removeprefix(base).lstrip("/")
        if info.type != fs.FileType.File or not fnmatch(info.base_name, pattern) or any(p.startswith((".", "_")) for p in below.split("/")):
            continue
        if isinstance(system, fs.LocalFileSystem) and not os.path.realpath(info.path).startswith(base.rstrip("/") + "/"):
            continue
        found.append((below, info.size, info.mtime_ns or 0))
    return sorted(found)


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PAYLOAD.types)], schema=PAYLOAD)


class Files(InputPartition):
    def __init__(self, names: list[str], collected: str):
        self.names, self.collected = names, collected


class Range(InputPartition):
    """Lines of a log that begin in [first, stop); the log's new part begins at start."""

    def __init__(self, name: str, start: int, first: int, stop: int, end: int, collected: str):
        self.name, self.start, self.first, self.stop, self.end, self.collected = name, start, first, stop, end, collected


class _Tree:
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.md")
        self.collected = options.get("collected_at")

    def tasks(self, files: list[tuple]) -> list[Files]:
        names = [f[0] for f in files]
        return [Files(names[k : k + FILES_A_TASK], self.collected or _now()) for k in range(0, len(names), FILES_A_TASK)]

    def rows(self, part: Files) -> Iterator[pa.RecordBatch]:
        system, base = place(self.path)
        for name in part.names:
            with system.open_input_stream(f"{base}/{name}") as stream:
                yield _batch([(name, 0, stream.read(), None, part.collected)])


class TreeReader(_Tree, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.tasks(listed(self.path, self.pattern))

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition else iter(())


class TreeStream(_Tree, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(((t, p) for p, _, t in listed(self.path, self.pattern)), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self.tasks([f for f in listed(self.path, self.pattern) if after < (f[2], f[0]) <= upto])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _Logs:
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.width = int(options.get("rangeBytes", RANGE_BYTES))
        self.collected = options.get("collected_at")

    def _head(self, name: str, n: int) -> str:
        system, base = place(self.path)
        with system.open_input_file(f"{base}/{name}") as log:
            return hashlib.sha256(log.read(n)).hexdigest()

    def reached(self) -> dict:
        """How far each log goes now, up to the end of its last whole line."""
        system, base = place(self.path)
        out = {}
        for name, size, _ in listed(self.path, self.pattern):
            end = size
            with system.open_input_file(f"{base}/{name}") as log:
                while end > 0:
                    log.seek(max(0, end - HEAD_BYTES))
                    at = log.read(end - max(0, end - HEAD_BYTES)).rfind(b"\n")
                    if at >= 0:
                        end = max(0, end - HEAD_BYTES) + at + 1
                        break
                    end = max(0, end - HEAD_BYTES)
            n = min(end, HEAD_BYTES)
            out[name] = {"end": end, "n": n, "head": self._head(name, n)}
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, to in sorted(end.items()):
            was = start.get(name)
            same = was is not None and was["end"] <= to["end"] and self._head(name, was["n"]) == was["head"]
            first = was["end"] if same else 0
            out += [Range(name, first, a, min(a + self.width, to["end"]), to["end"], self.collected or _now()) for a in range(first, to["end"], self.width)]
        return out

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, base = place(self.path)
        rows, held = [], 0
        with io.BufferedReader(system.open_input_file(f"{base}/{part.name}"), 1 << 18) as log:
            at = part.first
            if at > part.start:  # a line that began before belongs to the range before
                log.seek(at - 1)
                at += len(log.readline()) - 1
            else:
                log.seek(at)
            while at < part.stop:
                line = log.readline()
                if not line:
                    break
                where, at = at, at + len(line)
                line = line.rstrip(b"\r\n")
                if not line.strip():
                    continue
                try:
                    told = json.loads(line)
                    told = told if isinstance(told, dict) else {}
                    own = told.get("metadata") if isinstance(told.get("metadata"), dict) else {}
                    when = own.get("occurred_at") or told.get("occurred_at")
                except ValueError:
                    when = None
                rows.append((part.name, where, line, None if when is None else str(when), part.collected))
                held += len(line)
                if held > 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


class LogReader(_Logs, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.reached())

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition else iter(())


class LogStream(_Logs, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.reached()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgraph_tree"

    def schema(self) -> str:
        return PAYLOAD_DDL

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


class Trajectories(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgraph_trajectories"

    def schema(self) -> str:
        return PAYLOAD_DDL

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session by name."""
    spark.dataSource.register(Tree)
    spark.dataSource.register(Trajectories)


#: What profiles call the sources, and what they say of them.
KINDS = {"document": ("Artifact", "text"), "agent_trajectory": ("Experience", "log")}


def envelopes(payloads: DataFrame, source_type: str, now: Column | None = None, runtime: str = "generic", most: int = MOST_BYTES) -> DataFrame:
    """Intake envelopes of payloads: ids, identity and provenance as the source's profile asks for them, the event's time,
    the fenced text, signs of injection, and a reason where the payload goes to quarantine instead.

    The time is when it happened, else when it was collected, else now. Ids follow from what they name, so the same
    payload gives the same envelope on any run.
    """
    category, medium = KINDS[source_type]
    told = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    when = rules.event_time(F.col("occurred_at"), F.col("collected_at"), now if now is not None else F.current_timestamp())
    external = F.element_at(F.split("source_path", "/"), -1)
    if source_type == "document":
        who = [F.lit("resource"), F.col("source_path"), F.lit("representation_hash"), told]
        where = who
    else:
        who = [F.lit("source_system"), F.lit(runtime), F.lit("external_id"), external, F.lit("representation_hash"), told]
        where = [*who, F.lit("occurred_at"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")]
    size = F.octet_length("content").cast("long")
    reason = F.when(size > most, "size_limit_exceeded")
    text = F.when(reason.isNull(), F.expr("try_validate_utf8(cast(content as string))"))
    code = lambda prefix, *parts: F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 12)))
    return payloads.select(
        code("SRC-", F.lit(source_type), F.col("source_path"), F.col("byte_offset").cast("string"), told).alias("source_id"),
        F.lit(source_type).alias("source_type"), F.lit(category).alias("category"), F.lit(medium).alias("medium"),
        F.col("source_path"), F.col("byte_offset"), when.alias("event_time"),
        F.create_map(*who).alias("identity"), F.create_map(*where).alias("provenance"),
        F.struct(code("REP-", told).alias("representation_id"), told.alias("representation_hash"), size.alias("byte_size")).alias("representation"),
        F.when(text.isNotNull(), X.fence(text)).alias("fenced_content"),
        F.when(text.isNotNull(), X.injection_indicators(text)).alias("injections"),
        F.coalesce(reason, F.when(text.isNull(), "not_text")).alias("reason"),
    )
