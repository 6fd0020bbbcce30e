"""Sequence packing: shortest pack first over the length histogram (Krell et al., 2021).

Documents are tokenised, closed by an end id and cut into pieces of at most ``max_tokens``.  Only the
pieces' lengths, offsets and checksums are written down.  The histogram of lengths (``max_tokens`` rows at
most) goes to the driver, which places lengths longest first: each into the pack with the least in it that
still has room, all packs with one pattern and one free space at a time.  What comes out are patterns with
counts; a pattern's slot for a length takes a run of the ranks of that length's pieces.  A piece's rank is its
number within its task plus the pieces that earlier tasks have of that length, so no length is gathered
anywhere.  The slot table has a few rows a pattern, whatever the number of documents.

Rules: a null or empty text has the end id alone; a text of any length is cut into whole pieces; rows with one id,
or repeated rows, are packed each for itself; of packs with equal room the last one made is taken; an empty table
gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm._bpe import encoder
from barspark.llm._spark import cut, small_batches, text_rows

MAX_TOKENS = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(path: str, max_tokens: int, end_id: int):
    def run(batches):
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            rows = []
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for first in range(0, len(texts), 200):
                for doc, ids in zip(docs[first : first + 200], enc.ids(texts[first : first + 200]), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    for start in range(0, len(ids), max_tokens):
                        part = ids[start : start + max_tokens]
                        rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), task, int(seen[len(part)])))
                        seen[len(part)] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"])

    return run


def pack_histogram(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of every packing pattern; every length of the histogram is placed as often as it counts."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in range(max_tokens, 0, -1):
        left = histogram.get(length, 0)
        room = max_tokens
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                open_packs[max_tokens - length].append((left, (length,)))
                break
            count, pattern = open_packs[room].pop()
            placed = min(count, left)
            if count > placed:
                open_packs[room].append((count - placed, pattern))
            open_packs[room - length].append((placed, (*pattern, length)))
            left -= placed
    return [x for packs in open_packs.values() for x in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each pattern and slot: the length, the first rank it takes, the first sequence, and the offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _place(table: dict[str, np.ndarray]):
    """Sequence and offset of each piece from its length and rank; a length's slots follow each other by rank."""
    starts = np.searchsorted(table["length"], np.arange(table["length"].max(initial=0) + 2))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows, lo, hi = length == x, starts[x], starts[x + 1]
                at[rows] = lo + np.searchsorted(table["rank"][lo:hi], rank[rows], side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(table["offset"][at])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, each with its sequence and its offset there."""
    small_batches(docs.sparkSession)
    pieces = cut(text_rows(docs, key, text).mapInArrow(_pieces(path, max_tokens, end_id), PIECES))
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("c"))
    histogram = {r["length"]: r["c"] for r in per_task.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    table = slots(pack_histogram(histogram, max_tokens))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(table), PACKED)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
