"""A staged table in versions: folders of Parquet and one manifest a revision.

A commit writes its new rows to a folder of its own and then puts the next manifest in place by a rename that fails if
that revision is there already. Until then nobody reads the folder; of two commits on one revision only one can win.
Readers take the last manifest and refuse it if a file it names is missing or of another size. Keys are added once:
the same key and hash again is no change, the same key with another hash is a conflict and nothing is written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import staging


class Conflict(ValueError):
    """A key with another hash, or a revision that isn't the expected one."""


class Damaged(ValueError):
    """A manifest or a file it names isn't as it was written."""


@dataclass(frozen=True)
class Committed:
    revision: int
    inserted: int
    repeated: int


class StagedTable:
    """A table at path with a key and a content hash; `status` and `scope`, where given, are counted in manifests."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, digest: str, counted: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.digest, self.counted = spark, path.rstrip("/"), schema, key, digest, counted
        jvm = spark.sparkContext._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(self.path)
        self._files = root.getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        self._rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._files.mkdirs(self._path(f"{self.path}/manifests"))

    # --- manifests ---

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def _load(self, revision: int) -> dict:
        jvm = self.spark.sparkContext._jvm
        stream = self._files.open(self._path(f"{self.path}/manifests/{revision:012d}.json"))
        try:
            content = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(content)
        except ValueError as e:
            raise Damaged(f"revision {revision} of {self.path} has no readable manifest") from e

    def revision(self) -> int:
        """The last revision; 0 before the first commit."""
        return max((int(n[:12]) for n in self._names("manifests") if not n.startswith(".") and n.endswith(".json")), default=0)

    def manifest(self, revision: int | None = None) -> dict:
        revision = self.revision() if revision is None else revision
        return self._load(revision) if revision else {"revision": 0, "folders": [], "rows": 0, "counts": {c: {} for c in self.counted}, "streams": {}}

    def _put(self, manifest: dict) -> None:
        own = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._files.create(own, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        try:
            self._context.rename(own, self._path(f"{self.path}/manifests/{manifest['revision']:012d}.json"), self.spark.sparkContext._gateway.new_array(self._rename, 0))
        except Exception as e:
            self._files.delete(own, False)
            raise Conflict(f"revision {manifest['revision']} of {self.path} is there already") from e

    def _sizes(self, folder: str) -> dict[str, int]:
        path = self._path(f"{self.path}/data/{folder}")
        found = self._files.listStatus(path) if self._files.exists(path) else []
        return {s.getPath().getName(): s.getLen() for s in found if s.getPath().getName().startswith("part-")}

    # --- reading ---

    def read(self, revision: int | None = None) -> DataFrame:
        """The rows of a revision, the last one if none is named; Damaged if a file isn't as its manifest says."""
        manifest = self.manifest(revision)
        for folder in manifest["folders"]:
            if self._sizes(folder["name"]) != folder["files"]:
                raise Damaged(f"folder {folder['name']} of {self.path} isn't as revision {manifest['revision']} has it")
        names = [f"{self.path}/data/{f['name']}" for f in manifest["folders"]]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def get(self, *keys) -> DataFrame:
        return self.read().where(F.col(self.key).isin(*keys))

    def listed(self, *order: str, **equal) -> DataFrame:
        """Rows whose columns have the stated values, in order."""
        rows = self.read()
        for column, value in equal.items():
            rows = rows.where(F.col(column) == value)
        return rows.orderBy(*(order or (self.key,)))

    def count(self, **equal) -> int:
        return self.listed(**equal).count() if equal else self.manifest()["rows"]

    # --- writing ---

    def _written(self, rows: DataFrame) -> tuple[dict, dict]:
        """A new folder and its counts."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        kept = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}")
        counts = {c: {r[0]: r[1] for r in kept.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(""))).count().collect()} for c in self.counted}
        return {"name": name, "files": self._sizes(name), "rows": kept.count()}, counts

    def commit(self, rows: DataFrame, expected: int | None = None, stream: tuple[str, int] | None = None) -> Committed:
        """Add the new keys of rows as the next revision.

        expected: the revision that the caller has seen. stream: (name, batch) of a stream; a batch at or before the
        last one committed changes nothing, so a batch that is sent twice counts once.
        """
        manifest = self.manifest()
        at = manifest["revision"]
        if expected is not None and expected != at:
            raise Conflict(f"{self.path} is at revision {at}, not {expected}")
        if stream and manifest["streams"].get(stream[0], -1) >= stream[1]:
            return Committed(at, 0, 0)
        names = self.spark.createDataFrame([], self.schema).columns
        incoming = rows.select(*names)
        marked = staging.upsert(self.read().select(self.key, self.digest), incoming, self.key, self.digest)
        per_key = marked.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(self.digest).alias("kinds"), F.max("outcome").alias("outcome"), F.max((F.col("outcome") == "conflict").cast("int")).alias("bad"))
        told = per_key.agg(
            F.sum(((F.col("bad") == 1) | (F.col("kinds") > 1)).cast("long")).alias("conflicts"), F.sum((F.col("outcome") == "insert").cast("long")).alias("new"),
            F.sum("n").alias("n"), F.min(F.when((F.col("bad") == 1) | (F.col("kinds") > 1), F.col(self.key).cast("string"))).alias("first")).first()
        if told["conflicts"]:
            raise Conflict(f"{told['conflicts']} keys of {self.path} have another hash, {told['first']} among them")
        new, n = told["new"] or 0, told["n"] or 0
        if not new and not stream:
            return Committed(at, 0, n)
        folders, counts, total = list(manifest["folders"]), {c: dict(v) for c, v in manifest["counts"].items()}, manifest["rows"]
        if new:
            folder, more = self._written(marked.where("outcome = 'insert'").select(*names).dropDuplicates([self.key]))
            folders, total = [*folders, folder], total + folder["rows"]
            for column, found in more.items():
                for value, k in found.items():
                    counts.setdefault(column, {})[value] = counts.get(column, {}).get(value, 0) + k
        streams = manifest["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._put({"revision": at + 1, "folders": folders, "rows": total, "counts": counts, "streams": streams})
        return Committed(at + 1, new, n - new)

    def writer(self, stream: str, tries: int = 5) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: commits each batch once, again if another commit came between."""

        def write(batch: DataFrame, number: int) -> None:
            for left in range(tries, 0, -1):
                try:
                    self.commit(batch, stream=(stream, number))
                    return
                except Conflict as e:
                    if left == 1 or "is there already" not in str(e):
                        raise

        return write

    def compact(self) -> int:
        """One folder in place of all; the revision that has it."""
        manifest = self.manifest()
        if len(manifest["folders"]) < 2:
            return manifest["revision"]
        folder, _ = self._written(self.read())
        self._put(manifest | {"revision": manifest["revision"] + 1, "folders": [folder]})
        return manifest["revision"] + 1

    def recover(self) -> dict[str, int]:
        """Take away what commits left that never came into effect: folders that no manifest names, manifests that never
        got their name or can't be read. Not while a commit runs."""
        named, damaged = set(), 0
        for name in self._names("manifests"):
            path = self._path(f"{self.path}/manifests/{name}")
            try:
                if name.startswith("."):
                    raise Damaged(name)
                named |= {f["name"] for f in self._load(int(name[:12]))["folders"]}
            except Damaged:
                self._files.delete(path, False)
                damaged += 1
        orphans = [n for n in self._names("data") if n not in named]
        for name in orphans:
            self._files.delete(self._path(f"{self.path}/data/{name}"), True)
        return {"manifests": damaged, "folders": len(orphans)}
