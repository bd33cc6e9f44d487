"""Token ids in binary files of patched frame-of-reference blocks, and reading them back.

A file holds whole documents in order: the magic, the blocks, and a footer with
the documents' ids and lengths, the byte offset of every block and their counts. A block
holds ``BLOCK`` ids: their minimum, the bits of a packed value, the number of exceptions, the packed
differences from the minimum, and the exceptions' positions and differences.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.pretokens import PreTokens
from riskframe.llm.texts import Memo, ship
from riskframe.session import materialise, shared_folder

MAGIC = b"PFOR0001"

#: Ids of a block.
BLOCK = 4096

#: The packed width holds this share of a block's values; the others are exceptions.
PERCENTILE = 95

#: A file is closed after the document that brings it to this many ids.
FILE_IDS = 8_000_000

#: Pre-tokens that a worker remembers, at about 200 bytes each: encoding is most of the work.
REMEMBERED = 250_000

HEAD = struct.Struct("<IBH")
FOOT = struct.Struct("<QQQ")
NO_ID = -(1 << 63)


def pack(values: np.ndarray) -> bytes:
    """One block of at most ``BLOCK`` unsigned 32-bit values."""
    least = int(values.min())
    rest = (values - np.uint32(least)).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, len(rest) * PERCENTILE // 100))[k]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return HEAD.pack(least, width, len(odd)) + packed + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def unpack(data: bytes, at: int, n: int) -> np.ndarray:
    """The ``n`` values of the block that starts at ``at``."""
    least, width, n_odd = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
    # Eight bits at a time become bytes of the value.
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    odd = np.frombuffer(data, "<u2", n_odd, at)
    rest[odd] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(least)


def to_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A whole file: each document's id and tokens."""
    values = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    out, starts = [MAGIC], []
    at = len(MAGIC)
    for first in range(0, len(values), BLOCK):
        starts.append(at)
        out.append(pack(values[first : first + BLOCK]))
        at += len(out[-1])
    named = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    out += [named.tobytes(), np.array([len(x) for x in ids], "<u8").tobytes(), np.array(starts, "<u8").tobytes()]
    return b"".join([*out, FOOT.pack(len(doc_ids), len(values), len(starts))])


def footer(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of tokens and the blocks' offsets."""
    n_docs, _, n_blocks = FOOT.unpack_from(data, len(data) - FOOT.size)
    at = len(data) - FOOT.size - 8 * n_blocks
    starts = np.frombuffer(data, "<u8", n_blocks, at)
    sizes = np.frombuffer(data, "<u8", n_docs, at - 8 * n_docs)
    return np.frombuffer(data, "<i8", n_docs, at - 16 * n_docs), sizes, starts


def read_ids(data: bytes, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a file: only the blocks that hold them are unpacked."""
    total = FOOT.unpack_from(data, len(data) - FOOT.size)[1]
    starts = footer(data)[2]
    low, high = first // BLOCK, -(-(first + n) // BLOCK)
    parts = [unpack(data, int(starts[b]), min(BLOCK, total - b * BLOCK)) for b in range(low, high)]
    return np.concatenate(parts)[first - low * BLOCK :][:n] if parts else np.zeros(0, np.uint32)


@cache
def _encoder(path: str) -> tuple[PreTokens, Memo]:
    """One per worker process. A pre-token's ids are remembered as the bytes that a document's ids are joined from."""
    tokens = PreTokens(path)
    return tokens, Memo(lambda word: np.array(tokens.ids(word), "<u4").tobytes(), REMEMBERED)


def _encoded(text: str | None, path: str, end: int) -> np.ndarray:
    tokens, words = _encoder(path)
    split = tokens.split(text or "")
    if split is None:
        return np.array([*tokens.whole(text or ""), end], np.uint32)
    return np.frombuffer(b"".join([*[words[w] for w in split], struct.pack("<I", end)]), "<u4")


def write_tokens(documents: DataFrame, path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Writes every row's ids, each with ``end`` behind, in ascending doc_id order; returns the written manifest.

    Rows are range-partitioned by doc_id (a NULL id first, equal ids by text), and
    each task writes its files into ``folder`` (in the shared folder by default) under names of their own. The
    manifest names only files of tasks that succeeded, so a lost executor leaves at most files nobody reads.
    Its columns: ``part``, ``number`` (the order), ``file``, ``n_docs``, ``n_tokens``.
    NULL and empty texts have the end id alone.
    """
    ship(documents.sparkSession)
    folder = folder or f"{shared_folder(documents.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/part-{part:05}-{number:05}-{uuid.uuid4().hex}.pfor"
            write_file(name, to_file(doc_ids, ids))
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "file": name, "n_docs": len(doc_ids), "n_tokens": size}], schema=schema
            )

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                found = _encoded(texts[i].as_py(), path, end)
                doc_ids.append(doc_id)
                ids.append(found)
                size += len(found)
                if size >= FILE_IDS:
                    yield close()
                    doc_ids, ids, size, number = [], [], 0, number + 1
        if doc_ids:
            yield close()

    return materialise(rows.mapInArrow(work, "part int, number int, file string, n_docs bigint, n_tokens bigint"), "manifest")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, data: bytes) -> None:
    store, path = _place(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of every document in the files.

    The crc is over the ids as little-endian unsigned 32-bit integers. A task holds one file at a time.
    """
    spark = manifest.sparkSession
    ship(spark)
    # One row per partition of the writer; the files of one partition are few.
    parts = sorted((r.part, r.n) for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = [], 0
    for part, n in parts:
        bases.append((part, base))
        base += n
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.join(F.broadcast(spark.createDataFrame(bases, "part int, base bigint")), "part")
    files = files.select("file", (F.col("base") + F.col("inside")).alias("first"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _place(row["file"])
                with store.open_input_stream(path) as source:
                    data = source.read()
                doc_ids, sizes, starts = footer(data)
                if data[: len(MAGIC)] != MAGIC:
                    raise ValueError(f"{row['file']} isn't a token file")
                total = int(sizes.sum())
                blocks = [unpack(data, int(s), min(BLOCK, total - b * BLOCK)) for b, s in enumerate(starts)]
                values = np.concatenate(blocks).astype("<u4") if blocks else np.zeros(0, "<u4")
                ends = np.cumsum(sizes.astype(np.int64))
                crcs = [zlib.crc32(values[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [
                    pa.array([None if d == NO_ID else d for d in doc_ids.tolist()], pa.int64()),
                    pa.array(row["first"] + ends - sizes.astype(np.int64), pa.int64()),
                    pa.array(sizes.astype(np.int64), pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    # A number of its own, as otherwise the few small rows that name the files would be read in one task.
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
