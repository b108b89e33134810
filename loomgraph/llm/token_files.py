"""Token ids in binary files: frequency ranks in one to four bytes, lengths in control bytes of their own.

A file holds blocks; a block holds documents (or a part of a long one): their ids and counts, then a control byte for
every four tokens (two bits each: bytes of the rank less one), then the bytes of the ranks. The commonest tokens have
the lowest ranks, so most take a byte. Reading looks each control byte up in a table of 256 x 4 lengths, so that a
block is decoded in a few array operations.

Files are a data source of Spark ("loomgraph_tokens"): tasks write a range of documents each under a name of their
own, and the manifest, swapped in at commit, names what the attempts that counted have written, so a lost or repeated
task leaves nothing that is read. Readers get one file each and know from the manifest how many tokens lie before it.

Defined results: a null or empty text is the end token alone; documents are in order of doc_id, null first; equal ids
follow by number of tokens, then by hash; repeated rows are written as often as they come; an empty table is a folder
without files; further columns are ignored. Texts of any length are tokenised whole and may fill many blocks.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import forget, keep, shared_folder, small_batches
from .common import tidy
from .packing import token_bytes

END_ID = 1
FILE_BYTES = 64 << 20
BLOCK_IDS = 1 << 16
#: Fixed values of the format: a file's first bytes, a block's head, marks of a document's entry.
MAGIC = b"LGTOK001"
HEAD = struct.Struct("<IIQ")
NULL_ID, CONTINUES = 1, 2
#: Bytes of each of the four ranks of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2^32."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    full = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    full[: len(code)] = code
    control = full[0::4] | full[1::4] << 2 | full[2::4] << 4 | full[3::4] << 6
    if not code.any():
        return control.tobytes(), ranks.astype(np.uint8).tobytes()
    bytes_of = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), bytes_of[np.arange(4) <= code[:, None]].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks again."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    first = np.cumsum(length, dtype=np.int64) - length
    got = np.frombuffer(data, np.uint8)
    ranks = got[first].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(length > k)
        ranks[at] |= got[first[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str, name: str) -> bytes:
    system, base = _place(path)
    with system.open_input_stream(f"{base}/{name}") as stream:
        return stream.read()


def _write(path: str, name: str, content: bytes) -> None:
    """The file is there whole or not at all."""
    system, base = _place(path)
    system.create_dir(base)
    own = f"{base}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as stream:
        stream.write(content)
    system.move(own, f"{base}/{name}")


class _Block:
    """Documents of a block before they are written."""

    def __init__(self):
        self.ids, self.marks, self.counts, self.parts, self.n = [], [], [], [], 0

    def add(self, doc_id, ranks: np.ndarray, continues: bool) -> None:
        self.ids.append(doc_id or 0)
        self.marks.append((NULL_ID if doc_id is None else 0) | (CONTINUES if continues else 0))
        self.counts.append(len(ranks))
        self.parts.append(ranks)
        self.n += len(ranks)

    def written(self) -> bytes:
        control, data = encode(np.concatenate(self.parts))
        head = HEAD.pack(len(self.ids), self.n, len(data))
        return b"".join([head, np.array(self.ids, "<i8").tobytes(), np.array(self.marks, np.uint8).tobytes(), np.array(self.counts, "<u4").tobytes(), control, data])


def blocks(documents: Iterator[tuple], least: int = BLOCK_IDS) -> Iterator[bytes]:
    """Blocks of at most `least` ids from (doc_id, ranks)."""
    block = _Block()
    for doc_id, ranks in documents:
        at = 0
        while at < len(ranks) or at == 0:
            some = ranks[at : at + least - block.n]
            block.add(doc_id, some, at > 0)
            at += len(some) or 1
            if block.n == least:
                yield block.written()
                block = _Block()
    if block.ids:
        yield block.written()


def unblocked(stream) -> Iterator[tuple]:
    """(doc_id, continues, ranks) of each entry of a file's blocks."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(HEAD.size):
        docs, n, size = HEAD.unpack(head)
        ids, marks = np.frombuffer(stream.read(8 * docs), "<i8"), np.frombuffer(stream.read(docs), np.uint8)
        counts = np.frombuffer(stream.read(4 * docs), "<u4")
        control, data = stream.read(-(-n // 4)), stream.read(size)
        if len(data) != size:
            raise ValueError("a token file ends inside a block")
        ranks, at = decode(control, data, n), 0
        for doc_id, mark, count in zip(ids.tolist(), marks.tolist(), counts.tolist()):
            yield None if mark & NULL_ID else doc_id, bool(mark & CONTINUES), ranks[at : at + count]
            at += count


class Written(WriterCommitMessage):
    def __init__(self, part: int, name: str, docs: int, tokens: int, size: int):
        self.part, self.name, self.docs, self.tokens, self.size = part, name, docs, tokens, size


class Writer(DataSourceArrowWriter):
    """Writes rows (doc_id, ids: little-endian numbers of `width` bytes) as they come, a file a task."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        order = np.frombuffer(_read(self.path, "ranks"), "<u4")
        rank_of = np.empty(int(order.max(initial=0)) + 1, "<u4")
        rank_of[order] = np.arange(len(order), dtype="<u4")
        system, base = _place(self.path)
        docs = tokens = size = 0

        def documents() -> Iterator[tuple]:
            nonlocal docs, tokens
            for batch in iterator:
                held = batch.to_pydict()
                for doc_id, ids in zip(held["doc_id"], held["ids"]):
                    ranks = rank_of[np.frombuffer(ids, f"<u{self.width}")]
                    docs, tokens = docs + 1, tokens + len(ranks)
                    yield doc_id, ranks

        made, name, out = blocks(documents()), f"part-{uuid.uuid4().hex}.tokens", None
        for block in made:
            if out is None:
                out = system.open_output_stream(f"{base}/{name}")
                out.write(MAGIC)
            out.write(block)
            size += len(block)
        if out is not None:
            out.close()
        tidy()
        return Written(TaskContext.get().partitionId(), name, docs, tokens, size)

    def commit(self, messages: list) -> None:
        files = [vars(m) for m in sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.part)]
        _write(self.path, "manifest.json", json.dumps({"files": files}).encode())

    def abort(self, messages: list) -> None:
        system, base = _place(self.path)
        for m in messages:
            if m is not None and m.docs:
                system.delete_file(f"{base}/{m.name}")


class File(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        out, start = [], 0
        for f in json.loads(_read(self.path, "manifest.json"))["files"]:
            out.append(File(f["name"], start))
            start += f["tokens"]
        return out

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only partition of a folder without files
            return
        order = np.frombuffer(_read(self.path, "ranks"), "<u4")
        system, base = _place(self.path)
        start, rows, held, parts, who = partition.start, [], 0, [], None
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def done() -> None:
            nonlocal start, held
            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
            rows.append((who, start, len(ids), ids.tobytes()))
            start, held = start + len(ids), held + len(ids)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

        with system.open_input_stream(f"{base}/{partition.name}") as stream:
            for doc_id, continues, ranks in unblocked(stream):
                if parts and not continues:
                    done()
                    if held >= 4 * BLOCK_IDS:
                        yield batch()
                        rows, held = [], 0
                parts = [*parts, order[ranks]] if continues else [order[ranks]]
                who = doc_id
        if parts:
            done()
        if rows:
            yield batch()
        tidy()


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgraph_tokens"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("width", "4")))


def _tokenised(docs: DataFrame, path: str, width: int) -> DataFrame:
    """Documents (doc_id, ids) and, as a last row of each task, its counts of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            found = list(token_bytes(batch["text"].tolist(), path, END_ID))
            ids = np.frombuffer(b"".join(found), "<u4")
            counted = np.bincount(ids)
            if len(counted) > len(seen):
                seen = np.pad(seen, (0, len(counted) - len(seen)))
            seen[: len(counted)] += counted
            narrow, ends = ids.astype(f"<u{width}").tobytes(), np.cumsum([len(f) // 4 * width for f in found]).tolist()
            out = [narrow[a:b] for a, b in zip([0, *ends], ends)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": out, "counts": [None] * len(out)})
        known = np.flatnonzero(seen)
        yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "ids": [None], "counts": [[{"id": int(i), "n": int(seen[i])} for i in known]]})
        tidy()

    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(run, "doc_id long, ids binary, counts array<struct<id:int,n:long>>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Tokenise documents (doc_id, text), rank the ids by how often they come, and write the files of a new folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), END_ID + 1)
    width = 2 if size <= 1 << 16 else 4
    with small_batches(spark):
        rows = keep(_tokenised(docs, tokenizer, width))
    # A row per id of the vocabulary, at most `size`.
    counts = rows.where("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]
    _write(path, "ranks", np.array(ranked, "<u4").tobytes())
    told = rows.where("ids is not null").select("doc_id", "ids", "row", F.octet_length("ids").alias("size"))
    files = max(1, -(-(told.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.xxhash64("ids"), F.col("row")]
    placed = told.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    with small_batches(spark):
        placed.write.format("loomgraph_tokens").mode("append").option("width", str(width)).save(path)
    forget(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens before), n_tokens, ids (little-endian unsigned 32-bit numbers) of a written folder."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("loomgraph_tokens").load(path)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write documents to a folder of spark.checkpoint.dir and say what the files hold."""
    path = f"{shared_folder(docs.sparkSession)}/loomgraph/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
