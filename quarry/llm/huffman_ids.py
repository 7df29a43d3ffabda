"""Token-id files: canonical length-limited Huffman codes over global id counts.

A first pass encodes the texts, writes the ids and counts them; the counts give the code (package-merge, so no
code is longer than the limit).  Rows are dealt by ranges of (``doc_id``, checksum of the ids, place of the row), so that
neither one id nor equal rows fill a task; a range becomes files of documents in ascending ``doc_id``, cut into
independent blocks of whole or part documents.  A block starts at a byte
and carries a bit offset for every ``STRIDE`` ids; a decoder starts at any checkpoint, and
the reader here decodes all checkpoints of a block side by side with one table look-up per id.

File: magic, code table (symbols, lengths), directory of (doc key, ids), blocks, each
``n ids, n bytes, checkpoints, bytes``.  Files are named by range and number, so their names ascend with ``doc_id``.

Defined results: a null text is empty and consists of the end id alone; rows that share a ``doc_id`` follow
each other in the order of the CRC-32 of their ids; a null ``doc_id`` comes first; an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, by_bytes, running_sum, small_enough, write_once
from quarry.llm.token_ids import encoder

MAGIC = b"QHUF0002"
BLOCK = 1 << 19
STRIDE = 256
#: Stretches that a worker remembers, and bytes of text that it encodes at once: up to 488 MB of a worker, as measured.
KEEP = 1_000_000
SLAB = 4 << 20


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths under a limit, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # A level's list holds leaves (>= 0: position in order) and packages (-1); only how many leaves
    # are among its first m entries matters, which is all that the backward pass needs.
    leaves_before: list[np.ndarray] = []
    merged = weights
    flags = np.ones(n, bool)
    leaves_before.append(np.r_[0, np.cumsum(flags)])
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.r_[weights, pairs]
        rank = np.argsort(both, kind="stable")  # leaves before packages of equal weight
        merged, flags = both[rank], rank < n
        leaves_before.append(np.r_[0, np.cumsum(flags)])
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for level in reversed(leaves_before):
        leaves = int(level[take])
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols in code order, code of each symbol)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    longest = int(lengths.max()) if len(used) else 0
    span = np.left_shift(1, longest - lengths[order].astype(np.int64))
    first = np.r_[0, np.cumsum(span)[:-1]] if len(order) else np.zeros(0, np.int64)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = first >> (longest - lengths[order].astype(np.int64))
    return order, codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every possible window of the longest code: the symbol and the bits it takes."""
    order, _ = canonical(lengths)
    longest = int(lengths.max()) if len(order) else 1
    each = np.left_shift(1, longest - lengths[order].astype(np.int64))
    symbol, bits = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    total = int(each.sum()) if len(order) else 0
    symbol[:total], bits[:total] = np.repeat(order, each), np.repeat(lengths[order], each)
    return symbol, bits, longest


def aligned(lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The codes at the top of 64 bits."""
    return np.where(lengths > 0, codes.astype(np.uint64) << (64 - np.maximum(lengths, 1).astype(np.uint64)), 0).astype(np.uint64)


def encode_block(ids: np.ndarray, lengths: np.ndarray, high: np.ndarray) -> bytes:
    """One block; ``high`` are the ``aligned`` codes, of at most 32 bits."""
    size = lengths[ids]
    ends = np.cumsum(size, dtype=np.int64)
    total, at = int(ends[-1]), ends - size
    n_bytes, words = (total + 7) // 8, (total + 31) // 32
    # The bits of the codes that start in the same 32 never meet, so their sum is their union; what runs over goes to the next 32.
    starts = np.searchsorted(at, 32 * np.arange(words))
    joined = np.add.reduceat(high[ids] >> (at & 31).astype(np.uint64), starts[starts < len(ids)])
    out = np.zeros(words + 1, np.uint64)
    out[: len(joined)] = joined >> np.uint64(32)
    out[1 : len(joined) + 1] += joined & np.uint64(0xFFFFFFFF)
    marks = at[::STRIDE].astype("<u4").tobytes()
    return struct.pack("<II", len(ids), n_bytes) + marks + out.astype(">u4").tobytes()[:n_bytes]


def decode_block(data: memoryview, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, int]:
    """(ids, bytes read) of the block that ``data`` starts with."""
    n, n_bytes = struct.unpack_from("<II", data)
    lanes = -(-n // STRIDE)
    marks = np.frombuffer(data, "<u4", lanes, 8).astype(np.int64)
    body = np.zeros(n_bytes + 8, np.uint8)
    body[:n_bytes] = np.frombuffer(data, np.uint8, n_bytes, 8 + 4 * lanes)
    windows = np.ndarray(n_bytes + 4, ">u4", body.data, strides=(1,))  # the 32 bits from each byte on
    symbol, bits, longest = table
    out, mask = np.zeros((STRIDE, lanes), np.uint32), (1 << longest) - 1
    last = n - (lanes - 1) * STRIDE
    for k in range(STRIDE if lanes > 1 else last):
        if k == last and lanes > 1:
            marks = marks[:-1]
        w = (windows[marks >> 3] >> (32 - longest - (marks & 7))) & mask
        out[k, : len(marks)] = symbol[w]
        marks = marks + bits[w]
    return out.T.reshape(-1)[:n], 8 + 4 * lanes + n_bytes


def encode_file(documents: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One file of (doc key, ids); documents without a key come first."""
    used = np.flatnonzero(lengths).astype("<u4")
    nulls = sum(k is None for k, _ in documents)
    keys = np.array([0 if k is None else k for k, _ in documents], "<i8")
    sizes = np.array([len(x) for _, x in documents], "<i8")
    head = [MAGIC, struct.pack("<IIII", len(lengths), len(used), len(keys), nulls), used.tobytes(), lengths[used].tobytes(), keys.tobytes(), sizes.tobytes()]
    ids = np.concatenate([x for _, x in documents]) if documents else np.zeros(0, np.uint32)
    high = aligned(lengths, codes)
    return b"".join(head + [encode_block(ids[lo : lo + BLOCK], lengths, high) for lo in range(0, len(ids), BLOCK)])


def decode_file(data: bytes):
    """Yields (doc key, ids) from a file; holds the ids of one document and one block."""
    if data[:8] != MAGIC:
        raise ValueError("no token-id file")
    n_ids, n_used, n_docs, nulls = struct.unpack_from("<IIII", data, 8)
    at = 24
    used = np.frombuffer(data, "<u4", n_used, at)
    lengths = np.zeros(n_ids, np.uint8)
    lengths[used] = np.frombuffer(data, np.uint8, n_used, at + 4 * n_used)
    at += 5 * n_used
    keys, sizes = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    table, view = decode_table(lengths), memoryview(data)
    held: list[np.ndarray] = [np.zeros(0, np.uint32)]
    have = 0
    for i, (key, size) in enumerate(zip(keys.tolist(), sizes.tolist())):
        while have < size:
            ids, read = decode_block(view[at:], table)
            at += read
            held.append(ids)
            have += len(ids)
        ids = np.concatenate(held) if len(held) != 1 else held[0]
        yield None if i < nulls else key, ids[:size]
        held, have = [ids[size:]], have - size


def tokenize(documents: DataFrame, tokenizer: str, counts: str, end_id: int = 0) -> DataFrame:
    """``doc_id, crc, place, n, ids`` of every row, end id included; each task leaves a file of how often it met
    each id in the folder ``counts``.  ``ids``: two bytes per id where the vocabulary allows, else four.
    """

    def run(batches):
        from pyspark import TaskContext

        part, row, e = TaskContext.get().partitionId(), 0, encoder(tokenizer, KEEP)
        total = np.zeros(max(len(e.mark), end_id + 1), np.int64)
        for b in by_bytes(batches, "text", SLAB):
            for lo, hi, flat, edges in e.slabs(b.column("text"), end_id, SLAB):
                total += np.bincount(flat, minlength=len(total))
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((edges * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
                data, at = memoryview(flat).cast("B"), (edges * flat.itemsize).tolist()
                crc = pa.array([zlib.crc32(data[x:y]) for x, y in zip(at, at[1:])], pa.int64())
                place = pa.array((part << 40) + row + np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), crc, place, pa.array(np.diff(edges)), ids], ["doc_id", "crc", "place", "n", "ids"])
                row += hi - lo
        write_once(f"{counts}/part-{part:08d}", total.astype("<i8").tobytes())

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, crc long, place long, n long, ids binary")


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def count_ids(spark: SparkSession, counts: str) -> np.ndarray:
    """How often each id occurs, from the files of the tasks."""

    def add(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for data in b.column("content"):
                c = np.frombuffer(data.as_buffer(), "<i8")
                total = c + total if len(total) else c
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(counts)
    counted = files.select("content").mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per vocabulary entry
    out = np.zeros(1 + max((r["id"] for r in counted), default=0), np.int64)
    for r in counted:
        out[r["id"]] = r["n"]
    return out


def write_files(spark: SparkSession, documents: DataFrame, where: str, ws: Workspace, tokenizer: str, end_id: int = 0, limit: int = 16, file_ids: int = 1 << 22) -> None:
    """Write the token-id files of ``documents`` into the folder ``where``."""
    counted = ws.path("counts")
    tokens = ws.table(tokenize(documents, tokenizer, counted, end_id), "ids")
    total = tokens.agg(F.sum("n")).first()[0]
    if not total:
        return
    lengths = code_lengths(count_ids(spark, counted), limit)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)[1]))  # two numbers per vocabulary entry

    def write(batches):
        from pyspark import TaskContext

        lengths, codes = shared.value
        part, wrote, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for key, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                held.append((key, unpack_ids(ids, n)))
                size += n
                if size >= file_ids:  # the rows of a task are in a fixed order, so a repeated task writes the same files
                    write_once(f"{where}/ids-{part:08d}-{wrote:06d}.huf", encode_file(held, lengths, codes))
                    wrote, held, size = wrote + 1, [], 0
        if held:
            write_once(f"{where}/ids-{part:08d}-{wrote:06d}.huf", encode_file(held, lengths, codes))
            wrote += 1
        yield pa.RecordBatch.from_arrays([pa.array([wrote], pa.int32())], ["files"])

    parts = max(1, min(-(-total // file_ids), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    order = [F.col("doc_id").asc_nulls_first(), "crc", "place"]
    tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids").mapInArrow(write, "files int").agg(F.sum("files")).collect()
    ws.drop(tokens, counted)


def read_files(spark: SparkSession, where: str) -> DataFrame:
    """``file, at, doc_id, n_tokens, ids_crc32, inner`` of every document in the files; ``inner``: the ids before it in its file."""

    def read(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                part, number = (int(x) for x in name.rsplit("ids-", 1)[1].removesuffix(".huf").split("-"))
                rows, inner = [], 0
                for at, (key, ids) in enumerate(decode_file(data.as_buffer())):
                    rows.append((part << 24 | number, at, key, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), inner))
                    inner += len(ids)
                names = ["file", "at", "doc_id", "n_tokens", "ids_crc32", "inner"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.huf").load(where)
    return files.select("path", "content").mapInArrow(read, "file long, at long, doc_id long, n_tokens long, ids_crc32 long, inner long")


def round_trip(spark: SparkSession, documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from the written files."""
    ws = Workspace(spark, "huffman")
    where = ws.path("files")
    write_files(spark, documents, where, ws, tokenizer, end_id)
    path, fs = ws._path(where)
    if not fs.exists(path):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = ws.table(read_files(spark, where), "read")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("all", F.lit(0))  # one row per file
    base = ws.table(running_sum(ws, totals, "all", ["file"], "total", "base").select("file", "base"), "bases")
    base = F.broadcast(base) if small_enough(spark, base.count(), 16) else base
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
