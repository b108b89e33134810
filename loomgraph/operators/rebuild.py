"""Artefacts of a corpus that are built again only where the corpus changed.

Files are dealt into buckets by path. An artefact's manifest says for each bucket what the files were like when it was
built and which folder holds it; a rebuild builds the buckets whose files differ into a new folder and then puts the
next manifest in place. An artefact that looks at all files at once has one bucket. Buckets are compared by count and
by two sums over hashes of path and content, so none is gathered.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.connectors import place

BUCKETS = 64
Builder = Callable[[DataFrame], DataFrame]


def bucket(count: int):
    return F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(count)).cast("int")


def fingerprints(files: DataFrame, count: int = BUCKETS) -> DataFrame:
    """bucket, print of files(path, digest): what changes if any file of the bucket is added, changed or taken away."""
    one = F.xxhash64("path", "digest")
    told = files.groupBy(bucket(count).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(F.crc32(F.concat_ws("\x1f", "path", "digest").cast("binary"))).alias("s"))
    return told.select("bucket", F.concat_ws(":", *[F.col(c).cast("string") for c in "nxs"]).alias("print"))


def manifest(path: str) -> dict:
    """What is in place: kind, buckets, prints and folders by bucket; empty before the first build."""
    system, base = place(path)
    if system.get_file_info(f"{base}/manifest.json").type == fs.FileType.NotFound:
        return {"count": 0, "prints": {}, "folders": {}, "schema": ""}
    with system.open_input_stream(f"{base}/manifest.json") as stream:
        return json.loads(stream.read())


def rebuild(files: DataFrame, build: Builder, path: str, count: int = BUCKETS) -> list[int]:
    """Bring the artefact at path up to date with files(path, digest, ...); the buckets that were built.

    build makes rows of the files of some buckets; it is called for those that differ, once for all of them, with their
    bucket, and hands the bucket on. Nothing is written where no bucket differs.
    """
    spark = files.sparkSession
    system, base = place(path)
    before = manifest(path)
    known = before["prints"] if before["count"] == count else {}
    now = {str(r["bucket"]): r["print"] for r in fingerprints(files, count).collect()}  # a row a bucket
    stale = sorted(int(b) for b, p in now.items() if known.get(b) != p)
    if not stale and set(now) == set(known):
        return []
    folders, schema = {b: f for b, f in before["folders"].items() if b in now and known}, before["schema"]
    if stale:
        name = f"data/{uuid.uuid4().hex}"
        rows = build(files.withColumn("bucket", bucket(count)).where(F.col("bucket").isin(stale)))
        schema = rows.drop("bucket").schema.json()
        rows.write.partitionBy("bucket").parquet(f"{path}/{name}")
        folders |= {str(b): f"{name}/bucket={b}" for b in stale}
    system.create_dir(base)
    own = f"{base}/.manifest-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as stream:
        stream.write(json.dumps({"count": count, "prints": now, "folders": folders, "schema": schema}, sort_keys=True).encode())
    system.move(own, f"{base}/manifest.json")
    return stale


def load(spark: SparkSession, path: str) -> DataFrame:
    """The artefact's rows. Buckets that built no rows have no folder."""
    from pyspark.sql.types import StructType

    told = manifest(path)
    if not told["schema"]:
        raise FileNotFoundError(f"no artefact at {path}")
    system, base = place(path)
    there = [f for f in told["folders"].values() if system.get_file_info(f"{base}/{f}").type == fs.FileType.Directory]
    schema = StructType.fromJson(json.loads(told["schema"]))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in there]) if there else spark.createDataFrame([], schema)


def rebuild_all(files: DataFrame, artefacts: dict[str, tuple[Builder, int]], path: str) -> dict[str, list[int]]:
    """Several artefacts of one corpus by name: (builder, number of buckets); which buckets of each were built."""
    return {name: rebuild(files, build, f"{path}/{name}", count) for name, (build, count) in artefacts.items()}
