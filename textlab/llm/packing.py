"""Best-fit packing planned on the histogram of lengths.

Best-fit decreasing runs over counts of lengths, not over documents: bins with equal room are one group with a count,
and a length that fits is put into as many of them at once as there are pieces. The plan, bounded by the capacity
and not by the corpus, says for every length which ranks go to which sequences and places; pieces take their
places by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import as_text
from textlab.llm.tokens import encoding, public_path
from textlab.sources.scratch import materialize

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, offset, repeats): pieces of ``length`` from ``first rank`` on lie
    ``repeats`` to a sequence, from ``offset`` on, in sequences from ``first sequence`` on, up to the next row's ranks.

    Best-fit decreasing: longest pieces first, each into the fullest open sequence that has room, else a new one.
    """
    room: dict[int, list[tuple[tuple, int]]] = {}         # room left -> groups of (contents, number of sequences)
    open_rooms: list[int] = []                            # sorted keys of `room`

    def put(contents: tuple, n: int) -> None:
        left = capacity - sum(size * t for size, t in contents)
        if left not in room:
            room[left] = []
            bisect.insort(open_rooms, left)
        room[left].append((contents, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(open_rooms, size)
            if k < len(open_rooms):
                left = open_rooms[k]
                contents, bins = room[left].pop()
                if not room[left]:
                    del room[left], open_rooms[k]
            else:
                left, contents, bins = capacity, (), n
            each = left // size
            full = min(bins, n // each)
            if full:
                put((*contents, (size, each)), full)
                n, bins = n - full * each, bins - full
            if n and bins and n < each:
                put((*contents, (size, n)), 1)
                n, bins = 0, bins - 1
            if bins and contents:
                put(contents, bins)
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for left in sorted(room):
        for contents, bins in room[left]:
            offset = 0
            for size, each in contents:
                rows.append((size, rank[size], sequence, offset, each))
                rank[size] += bins * each
                offset += size * each
            sequence += bins
    return sorted(rows)


def place(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with long columns ``sequence_id`` and ``offset``.

    ``pieces`` must come from a written table with columns ``task`` and ``nth``: of equal lengths within a task, nth
    counts from 0 (see :func:`cut_pieces`). Ranks need only the counts per (length, task) then, and no piece is sorted.
    """
    counts = materialize(pieces.groupBy(length, "task").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum("n")).collect()}     # at most `capacity` rows
    rows = np.array(plan(histogram, capacity) or [(0, 0, 0, 0, 1)], np.int64).T
    upto = Window.partitionBy(length).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(length).alias("_length"), F.col("task").alias("_task"),
                         F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, (pieces[length] == F.col("_length")) & (pieces["task"] == F.col("_task")))
    wide = np.int64(1) << np.int64(48)                     # ranks of one length stay below 2^48
    names = [c for c in pieces.columns if c not in ("task", "nth")]

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, sequence, offset, each = rows
        for batch in batches:
            own = batch.column(length).to_numpy()
            rank = batch.column("_base").to_numpy() + batch.column("nth").to_numpy()
            at = np.searchsorted(size * wide + first, own * wide + rank, side="right") - 1
            k = rank - first[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(sequence[at] + k // each[at]),
                                                    pa.array(offset[at] + k % each[at] * own)],
                names=[*names, "sequence_id", "offset"])

    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "nth", "_base").mapInArrow(take, schema)


def cut_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
               end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and its end id: doc_id, piece, start, length, ids_crc32, task, nth, and with
    ``with_ids`` also ``ids`` (binary, little-endian uint32).

    Only documents longer than ``capacity`` are cut; then the first piece holds the remainder, the others are full.
    """
    path = tokenizer or public_path(TOKENIZER)
    kind = docs.schema[doc_id].dataType
    id_type = kind.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), {}
        with encoding(path) as one:
            for batch in batches:
                at, cols, ids = [], [[] for _ in range(5)], []
                for k, body in enumerate(as_text(batch.column(1))):
                    data = one.encode(body) + end
                    n = len(data) // 4
                    start, size = 0, (n - 1) % capacity + 1
                    for piece in range((n - 1) // capacity + 1):
                        part = data[4 * start:4 * (start + size)]
                        nth = seen.get(size, 0)
                        seen[size] = nth + 1
                        at.append(k)
                        for col, v in zip(cols, (piece, start, size, zlib.crc32(part), nth)):
                            col.append(v)
                        if with_ids:
                            ids.append(part)
                        start, size = start + size, capacity
                arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [
                    pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 4))]
                arrays.insert(5, pa.array([task] * len(at), pa.int32()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.binary())] if with_ids else []),
                                                 names=names + ["ids"] * with_ids)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, schema + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID,
         capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids``).

    Null text is empty: its document is the end id alone. Ids may repeat or be null, every row is a document of its own;
    an empty table gives an empty result; other columns are not read.
    """
    pieces = materialize(cut_pieces(docs, doc_id, text, tokenizer, end_id, capacity, with_ids), "pack-pieces")
    return place(pieces, "length", capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of every sequence, put together from the pieces of ``pack(with_ids=True)``.

    A group holds at most ``capacity`` ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
            .select("sequence_id", "n_tokens", F.expr(
                "unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids")))
