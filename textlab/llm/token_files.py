"""Token ids in files of Simple-8b words, with escapes and per-block offsets.

A 64-bit word holds a selector in its top 4 bits and in the rest as many ids as fit at the selector's width. An id of
more than 60 bits is escaped: a word with selector 0, then the id itself (its top bits are never 0, so the two cannot
be confused). Blocks of 1,024 ids are coded alone; a file row keeps the blocks' word offsets, so any block can be read
by itself and a whole row is decoded selector by selector with array operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.llm.common import as_text
from textlab.llm.tokens import encoder, public_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1024
ROW_IDS = 1 << 19                # ids of a file row, about; a longer document has a row of its own
MAGIC = b"S8B1"
#: Selector -> ids in a word (and 60 // that many bits each); 0 is the escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SMALL = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, np.uint8)
    if int(ids.max()) < len(_SMALL):
        return _SMALL[ids]
    return np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)


def pack_words(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of every block) of ``ids`` (uint64). Blocks are walked side by side, a word of each at a time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    wide = _widths(ids)
    end = np.minimum((np.arange(n) // block + 1) * block, n)
    best = np.where(wide > 60, 0, len(COUNTS) - 1).astype(np.int8)
    high, span = wide.copy(), 1
    for selector in range(len(COUNTS) - 2, 0, -1):
        count = COUNTS[selector]
        while span < count:                                    # high[i]: widest of ids[i : i + span]
            if span >= n:
                break
            np.maximum(high[:n - span], wide[span:], out=high[:n - span])
            span += 1
        if span < count:
            break
        fits = (high <= 60 // count) & (np.arange(n) + count <= end)
        if not fits.any():
            break                                              # fewer bits for more ids fit nowhere either
        best[fits] = selector
    step = np.maximum(np.array(COUNTS, np.int64), 1)[best]
    at = np.arange(0, n, block)
    stop = np.minimum(at + block, n)
    owner, places, lanes = [], [], np.arange(len(at))
    while len(at):
        owner.append(lanes)
        places.append(at)
        at = at + step[at]
        more = at < stop
        at, stop, lanes = at[more], stop[more], lanes[more]
    if not places:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, places = np.concatenate(owner), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    owner, places = owner[order], places[order]
    picked = best[places]
    where = np.cumsum(np.where(picked == 0, 2, 1))
    words = np.zeros(int(where[-1]), np.uint64)
    where = where - np.where(picked == 0, 2, 1)
    for selector in range(len(COUNTS)):
        mine = np.flatnonzero(picked == selector)
        if not len(mine):
            continue
        if selector == 0:
            words[where[mine] + 1] = ids[places[mine]]
            continue
        count = COUNTS[selector]
        shift = np.arange(count, dtype=np.uint64) * np.uint64(60 // count)
        parts = ids[places[mine][:, None] + np.arange(count)] << shift
        words[where[mine]] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(selector << 60)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    return words, where[first]


def unpack_words(words: np.ndarray) -> np.ndarray:
    """The ids (uint64) in ``words``, which must begin at a block's first word and end at a block's end."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.r_[False, selector[:-1] == 0] if len(words) else np.zeros(0, bool)
    counts = np.array((*COUNTS, 0), np.int64)[selector]
    counts[raw] = 1
    where = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, len(COUNTS)):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            bits = 60 // COUNTS[s]
            shift = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(bits)
            out[where[mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shift) & np.uint64((1 << bits) - 1)
    out[where[raw]] = words[raw]
    return out


def to_bytes(ids: np.ndarray, block: int = BLOCK_IDS) -> bytes:
    """A file row: magic, ids per block, ids, blocks, words (uint32 each but ids: uint64), block offsets, words."""
    words, first = pack_words(ids, block)
    head = struct.pack("<4sIQII", MAGIC, block, len(ids), len(first), len(words))
    return head + first.astype("<u4").tobytes() + words.astype("<u8").tobytes()


_HEAD = struct.calcsize("<4sIQII")


def from_bytes(data: bytes, block_no: int | None = None) -> np.ndarray:
    """All ids of a file row, or those of one block, found by its offset."""
    magic, _, _, blocks, n_words = struct.unpack_from("<4sIQII", data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b row")
    words = np.frombuffer(data, "<u8", n_words, _HEAD + 4 * blocks)
    if block_no is None:
        return unpack_words(words)
    first = np.frombuffer(data, "<u4", blocks, _HEAD)
    return unpack_words(words[first[block_no]:first[block_no + 1] if block_no + 1 < blocks else n_words])


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
          end_id: int = END_ID) -> None:
    """Writes the ids of every whole text, ``end_id`` after each, in ascending ``doc_id`` order to files under ``path``.

    Parquet part files hold rows (shard, row, doc_ids, lengths, data); shards, and rows in a shard, are in order. Null
    text is empty. Null ids come first, equal ids stay side by side ordered by text; an empty table gives no rows.
    Texts are ordered by a range shuffle, so a shard is as large as its share of rows; only one file row is in memory.
    """
    source = tokenizer or public_path(TOKENIZER)
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, row = encoder(source).encode, TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            data = to_bytes(np.frombuffer(b"".join(held), "<u4").astype(np.uint64))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([row], pa.int32()), pa.array([ids]).cast(pa.list_(kind)),
                 pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                names=["shard", "row", "doc_ids", "lengths", "data"])

        for batch in batches:
            kind = batch.column(0).type
            for own, body in zip(batch.column(0).to_pylist(), as_text(batch.column(1))):
                ids.append(own)
                held.append(encode(body) + end)
                size += len(held[-1]) // 4
                if size >= ROW_IDS:
                    yield flush()
                    ids, held, size, row = [], [], 0, row + 1
        if held:
            yield flush()

    (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
     .repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, f"shard int, row int, doc_ids array<{id_type}>, lengths array<long>, data binary")
     .write.mode("errorifexists").parquet(path))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with
    ``with_ids`` also ``ids`` (array of long)."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = files.select("shard", "row", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    in_shard = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)      # one row per shard
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = sizes.withColumn("in", F.coalesce(F.sum("n").over(in_shard), F.lit(0))).join(shards, "shard").select(
        "shard", "row", (F.col("base") + F.col("in")).alias("base"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("doc_ids").slice(k, 1).flatten()
                size = batch.column("lengths").slice(k, 1).flatten().to_numpy()
                ids = from_bytes(batch.column("data")[k].as_py())
                end = np.cumsum(size)
                start, raw = end - size, ids.astype("<u4").tobytes()
                n = len(size)
                arrays = [pa.array([batch.column("shard")[k].as_py()] * n, pa.int32()),
                          pa.array([batch.column("row")[k].as_py()] * n, pa.int32()), own, pa.array(start), pa.array(size),
                          pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(start.tolist(), end.tolist())], pa.int64())]
                names = ["shard", "row", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"shard int, row int, doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = files.mapInArrow(run, schema)
    return (docs.join(base, ["shard", "row"]).withColumn("start", F.col("start") + F.col("base"))
            .select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids))
