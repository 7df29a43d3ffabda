"""Best-fit packing with certified bounds: as few sequences as can be shown to do.

Documents become token ids; only those longer than a sequence are cut.  Pieces are dealt at random into
partitions of bounded size; each partition packs by best-fit decreasing and computes a lower
bound from dual feasible functions: one that meets it is certified.  If all sequences together meet the bound of all
pieces, the packing is done.  Else partitions keep their full sequences and exchange what lies in those with a gap: these pieces
are dealt anew, into fewer partitions, and packed again, until the bound is met or the rounds are used up.

The ids themselves never travel: only (doc_id, piece, length) does.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed as often as
they come; an empty table gives no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.runtime import Workspace, by_bytes
from quarry.llm.token_ids import encoder


def cut_pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, remember: int = 2_000_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row.

    ``remember``: stretches of text whose ids a Python worker keeps, about 180 bytes each.
    """

    def run(batches):
        e = encoder(tokenizer, remember)
        for b in by_bytes(batches, "text"):
            for lo, hi, flat, edges in e.slabs(b.column("text"), end_id):
                size = np.diff(edges)
                count = -(-size // capacity)  # at least one: the end id
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                data, at = memoryview(flat.astype("<u4")).cast("B"), 4 * (edges[row] + start)
                crc = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                keys = b.column("doc_id").slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of sequences that these pieces can need, as far as the functions tell."""
    return lower_bound_of(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def lower_bound_of(count: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions, and the plain sum, from the count of each length."""
    if not count.any():
        return 0
    sizes = np.arange(capacity + 1)
    best = -(-int((count * sizes).sum()) // capacity)
    # f_e: sizes above C - e count as C, sizes below e as 0.
    number, mass = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * sizes)]
    e = np.arange(1, capacity // 2 + 1)
    large = number[capacity + 1] - number[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    best = max(best, int((large + -(-middle // capacity)).max()))
    # u_k: x -> floor((k + 1) x / C) / k, and x itself where (k + 1) x / C is whole.
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)  # in units of 1 / (k C)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset of each piece, fill of each bin); pieces of a length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for at, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + ((fitting & -fitting).bit_length() - 1)
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[at], offset[at] = b, fill[b]
        fill[b] += n
        if left := room - n:
            open_by_room[left].append(b)
            rooms |= 1 << left
    return bin_of, offset, np.array(fill, np.int64)


_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pack_part(turn: int, capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        b, offset, fill = best_fit_decreasing(lengths, capacity)
        base = ((turn + 1) << 56) | (int(key[0]) << 28)
        certified = len(fill) == lower_bound(lengths, capacity)
        return pdf[_NAMES].assign(sequence_id=base + b, offset=offset, certified=certified, full=fill[b] == capacity)

    return run


def pack(ws: Workspace, pieces: DataFrame, capacity: int, part_rows: int = 100_000, rounds: int = 4) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``certified`` tells whether its partition met the bound."""
    schema = f"{_COLUMNS}, sequence_id long, offset long, certified boolean, full boolean"
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    bound = lower_bound_of(np.array([counts.get(n, 0) for n in range(capacity + 1)], np.int64), capacity)
    # a piece that fills a sequence needs no partner
    whole = pieces.where(F.col("length") == capacity)
    done = [whole.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))]
    rest, used = pieces.where(F.col("length") < capacity), counts.get(capacity, 0)
    left = sum(counts.values()) - used
    for turn in range(rounds):
        if not left:
            break
        parts = max(1, -(-left // part_rows))
        dealt = rest.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)))
        packed = ws.table(dealt.groupBy("__part").applyInPandas(_pack_part(turn, capacity), schema), f"round{turn}")
        full, gaps = (packed.where(F.col("full") == yes).select("sequence_id").distinct().count() for yes in (True, False))
        keep = packed if turn == rounds - 1 or parts == 1 or used + full + gaps == bound else packed.where("full")
        done.append(keep.select(*_NAMES, "sequence_id", "offset", "certified"))
        if keep is packed:
            break
        rest, used = packed.where("not full").select(*_NAMES), used + full
        left = rest.count()
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(spark: SparkSession, documents: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, remember: int = 2_000_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified`` of every piece."""
    ws = Workspace(spark, "packing")
    pieces = ws.table(cut_pieces(documents, tokenizer, capacity, end_id, remember), "pieces")
    return pack(ws, pieces, capacity)
