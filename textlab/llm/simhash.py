"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are permuted into buckets by the pigeonhole principle: with ``d`` differing bits allowed
and the bits cut into ``d + 1`` parts, any pair within ``d`` bits agrees in one part, so every such pair
meets in a bucket. Inside a bucket the distinct fingerprints are sorted by Gray rank and an index is
laid over them: a node keeps the bits that all its fingerprints share (mask) and their values
(pattern). A pair of nodes whose shared bits already differ in more than ``d`` places is dropped with
all its members; only leaves that survive are compared. A bucket yields a star (fingerprint,
smallest linked fingerprint) and not its pairs; the stars of all buckets are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textlab.llm.common import as_bytes, connected_components, fresh
from textlab.sources.scratch import materialize

SEED = 42               # fixed value: the seed of XXH64
LEAF = 32               # fingerprints in a leaf of the index
FAN = 8                 # children of an upper node
GROUP_ROWS = 16_384     # rows that one index is laid over, on average
HOT_ROWS = 65_536       # buckets above this are cut again by the bits that they do not share
PAIR_CHUNK = 2_048      # leaf pairs compared at once: 2,048 x 32 x 32 distances


def simhash(data: bytes, shingle: int) -> int:
    """64-bit SimHash of whole ``data``: A-Z lower-cased, words at ASCII white space, ``shingle``-word shingles
    with repeats (fewer words: the whole sequence; none: 0); a bit is 1 if set in over half of the XXH64 values."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    end = end[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(start), 65_536):
        part = [digest(joined[a:b], SEED) for a, b in zip(start[k:k + 65_536], end[k:k + 65_536])]
        h = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(h, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with column ``out``: the SimHash of ``text`` as a signed long (null text: 0). Other columns stay."""

    @arrow_udf("long")
    def of_text(column: pa.Array) -> pa.Array:
        values = np.array([simhash(b, shingle) for b in as_bytes(column)], np.uint64)
        return pa.array(values.view(np.int64))

    return docs.withColumn(out, of_text(F.col(text)))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence (prefix XOR of its bits)."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of ``i`` and ``j`` in place; ``label`` holds each member's smallest known member."""
    while len(i):
        a, b = label[i], label[j]
        keep = a != b
        if not keep.any():
            return
        i, j, a, b = i[keep], j[keep], a[keep], b[keep]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _levels(seg: np.ndarray, pos: np.ndarray, code: np.ndarray) -> list[dict]:
    """Index levels from leaves to roots; a node is a run of rows (leaves) or of nodes, within one bucket."""
    levels, size = [], LEAF
    ones, zeros = code, ~code
    while True:
        slot = pos // size
        first = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (slot[1:] != slot[:-1])])
        all_one = np.bitwise_and.reduceat(ones, first)
        all_zero = np.bitwise_and.reduceat(zeros, first)
        levels.append({"first": np.r_[first, len(seg)], "mask": all_one | all_zero, "pattern": all_one})
        ones, zeros, seg, pos = all_one, all_zero, seg[first], slot[first]
        if (pos == 0).all() and len(np.unique(seg)) == len(seg):
            return levels
        size = FAN


def _pairs(a0: np.ndarray, an: np.ndarray, b0: np.ndarray, bn: np.ndarray, own: np.ndarray):
    """All (child of A, child of B) for node pairs given as child ranges; a node with itself gives i <= j once."""
    total = an * bn
    at = np.repeat(np.arange(len(an)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    i, j = a0[at] + k // bn[at], b0[at] + k % bn[at]
    keep = ~own[at] | (i <= j)
    return i[keep], j[keep]


def link(bucket: np.ndarray, code: np.ndarray, max_bits: int) -> np.ndarray:
    """For rows (bucket, distinct code): index of the smallest code reached in the bucket by links of ``max_bits``.

    Returned positions are into the input order.
    """
    order = np.lexsort((gray_rank(code), bucket))
    key, codes = bucket[order], code[order]
    n = len(codes)
    head = np.r_[True, key[1:] != key[:-1]]
    seg = np.cumsum(head) - 1
    pos = np.arange(n) - np.flatnonzero(head)[seg]
    label = np.arange(n)
    levels = _levels(seg, pos, codes)
    todo = [(len(levels) - 1, *(2 * (np.arange(len(levels[-1]["mask"])),)))]
    while todo:                                                     # depth first: few open node pairs at a time
        depth, a, b = todo.pop()
        if len(a) > PAIR_CHUNK:
            half = len(a) // 2
            todo += [(depth, a[half:], b[half:]), (depth, a[:half], b[:half])]
            continue
        lv = levels[depth]
        shared = lv["mask"][a] & lv["mask"][b]
        near = np.bitwise_count((lv["pattern"][a] ^ lv["pattern"][b]) & shared) <= max_bits
        a, b = a[near], b[near]
        if not len(a):
            continue
        f = lv["first"]
        if depth:
            todo.append((depth - 1, *_pairs(f[a], f[a + 1] - f[a], f[b], f[b + 1] - f[b], a == b)))
            continue
        lane = np.arange(LEAF)
        ia, ib = f[a][:, None] + lane, f[b][:, None] + lane
        ok_a, ok_b = ia < f[a + 1][:, None], ib < f[b + 1][:, None]
        ia, ib = np.where(ok_a, ia, 0), np.where(ok_b, ib, 0)
        apart = np.bitwise_count(codes[ia][:, :, None] ^ codes[ib][:, None, :])
        hit = (apart <= max_bits) & ok_a[:, :, None] & ok_b[:, None, :] & (ia[:, :, None] != ib[:, None, :])
        p, x, y = np.nonzero(hit)
        _unite(label, ia[p, x], ib[p, y])
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, label, codes)
    at = np.flatnonzero(codes == low[label])                         # one position per set: codes are distinct
    place = np.empty(n, np.int64)
    place[label[at]] = at
    out = np.empty(n, np.int64)
    out[order] = order[place[label]]
    return out


def _cut(parts: int):
    """Arrow function: rows (key, code, free) -> ``parts`` rows each, keyed also by one part of the free bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            code = batch.column("code").to_numpy().view(np.uint64)
            free = batch.column("free").to_numpy().view(np.uint64)
            rank, at = np.zeros(len(code), np.int64), []
            for bit in range(64):                                    # rank of every free bit of every row
                on = (free >> np.uint64(bit)) & np.uint64(1) == 1
                at.append(np.where(on, rank, -1))
                rank += on
            for part in range(parts):
                mask = np.zeros(len(code), np.uint64)
                for bit in range(64):
                    mine = (at[bit] >= 0) & (at[bit] * parts // np.maximum(rank, 1) == part)
                    mask |= np.where(mine, np.uint64(1 << bit), np.uint64(0))
                mixed = (key ^ np.uint64(part + 1)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29)) ^ (code & mask)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mixed, code, free & ~mask)],
                                                 names=["key", "code", "free"])

    return run


def _buckets(codes: DataFrame, max_bits: int, hot_rows: int) -> DataFrame:
    """(key, code): every two codes within ``max_bits`` share a key. Buckets above ``hot_rows`` are cut again.

    A key of 64 bits may stand for two buckets; that only brings more codes together, distances are
    computed on the codes themselves.
    """
    schema = "key long, code long, free long"
    rows = materialize(codes.select(F.lit(0).cast("long").alias("key"), "code", F.lit(-1).cast("long").alias("free"))
                       .mapInArrow(_cut(max_bits + 1), schema), "simhash-buckets")
    done = None
    for _ in range(6):                                               # 13, 10, 8, 6, 5, 4 bits: nothing is left to cut
        hot = rows.groupBy("key").count().filter(F.col("count") > hot_rows).select("key")
        hot = materialize(hot, "simhash-hot")
        if hot.isEmpty():
            break
        cool = rows.join(hot, "key", "left_anti").select("key", "code")
        done = cool if done is None else done.unionByName(cool)
        rows = materialize(rows.join(hot, "key").select("key", "code", "free").mapInArrow(_cut(max_bits + 1), schema),
                           "simhash-buckets")
    rows = rows.select("key", "code")
    return rows if done is None else done.unionByName(rows)


def _link_group(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        code = table.column("code").to_numpy().view(np.uint64)
        pair = np.unique(np.rec.fromarrays([key, code], names="key,code"))   # two cuts may meet in one key
        key, code = np.ascontiguousarray(pair["key"]), np.ascontiguousarray(pair["code"])
        root = code[link(key, code, max_bits)]
        far = root != code
        return pa.table({"u": pa.array(code[far].view(np.int64)), "v": pa.array(root[far].view(np.int64))})

    return run


def link_fingerprints(codes: DataFrame, max_bits: int = 4, group_rows: int = GROUP_ROWS,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) of all distinct fingerprints ``codes`` (code long) that have a neighbour within ``max_bits``."""
    rows = materialize(_buckets(codes, max_bits, hot_rows), "simhash-keyed")
    groups = max(1, rows.count() // group_rows)
    edges = (rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)))
             .groupBy("part").applyInArrow(_link_group(max_bits), "u long, v long"))
    return connected_components(edges, "simhash")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (signed long), ``component_id``.

    component_id is the smallest ``doc_id`` reached over links of at most ``max_bits`` differing bits;
    texts without words have fingerprint 0 and link like any other. Null text counts as empty, rows
    with equal ids stay separate rows, null ids are no minimum (a component of null ids only has a null
    component_id), an empty table gives an empty result, columns beside the two named are not read.
    """
    base = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle)
                       .select("doc_id", "fingerprint"), "simhash-prints")
    # min() over ids and distinct fingerprints are partial aggregates: a hot fingerprint shrinks before the shuffle
    first = materialize(base.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("first")),
                        "simhash-first")
    linked = materialize(link_fingerprints(first.select("code"), max_bits), "simhash-linked")
    rooted = (first.join(linked, first["code"] == linked["node"], "left")
              .select("code", F.coalesce("root", "code").alias("root"), "first"))
    low = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-low")
    rooted = materialize(rooted, "simhash-rooted")
    named = materialize(rooted.join(low, "root").select(F.col("code").alias("fingerprint"), "component_id"),
                        "simhash-named")
    return base.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
             max_bits: int = 4) -> DataFrame:
    """Rows of ``docs``, one of each near-duplicate group: the one with the smallest id (nulls last).

    Of rows with equal ids in a group one stays, chosen by a hash of its text; of rows equal in id and text one
    stays. All columns are kept; null or empty texts have fingerprint 0; an empty table stays empty. Fingerprints are
    written without texts; the rows to keep are found by 128 bits of hash over id and text, so that each text is read for
    its fingerprint once and shuffled once.
    """
    h1, h2 = fresh(docs, "_h1", "_h2")

    def hashes(of: DataFrame) -> DataFrame:
        key = (F.col(doc_id).isNull(), F.col(doc_id), F.coalesce(F.length(text), F.lit(-1)), F.col(text))
        return of.withColumns({h1: F.xxhash64(F.lit(1), *key), h2: F.xxhash64(F.lit(2), *key[::-1])})

    print_ = fresh(docs, "_print")[0]
    rows = materialize(hashes(fingerprints(docs.select(doc_id, text), shingle, text, print_)).select(
        F.col(print_).alias("code"), F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"),
                                              F.col(h1).alias("h1"), F.col(h2).alias("h2")).alias("r")), "keep-prints")
    groups = materialize(rows.groupBy("code").agg(F.min("r").alias("first")), "keep-first")
    linked = materialize(link_fingerprints(groups.select("code"), max_bits), "keep-linked")
    rooted = groups.join(linked, groups["code"] == linked["node"], "left").select("first", F.coalesce("root", "code").alias("root"))
    kept = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.h1").alias(h1), F.col("first.h2").alias(h2)), "keep-kept")
    # the keepers grow with the input; equal rows meet in the join's own partitions
    return hashes(docs).join(kept.hint("merge"), [h1, h2], "left_semi").dropDuplicates([h1, h2]).select(*docs.columns)
