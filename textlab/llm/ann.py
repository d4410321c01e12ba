"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt to shards of bounded size. A shard's forest has, for each tree, the sorted array of its vectors' long
hash strings (signs of random projections). A query descends every array to its longest common prefix, then all
trees ascend together, one prefix bit at a time, until the vectors under the prefixes are as many as the shard's own
calibration asks for. Those candidates are scored exactly, and the best of all shards are merged.

Equal vectors are one vector with its smallest ids, so a vector that very many rows share costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.sources.scratch import materialize

TREES = 32
BITS = 64
SHARD_ROWS = 8192           # vectors of a shard, on average
QUERY_ROWS = 2048           # queries that a shard answers together, at most
BLOCKS = 8                  # copies of a shard, each for a block of the queries, at most
SAMPLE = 64                 # queries of a block on which a shard calibrates its number of candidates
RECALL = 0.97               # wanted on that sample, against all vectors of the shard
SALT_ROWS = 100_000         # rows of one vector that are gathered together at most, about
SEED = 11


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int, salts: int) -> DataFrame:
    """(vec, ids): every vector once with its ``keep`` smallest ids, gathered through salted groups."""
    def smallest(ids: Column) -> Column:
        return F.slice(F.array_sort(F.array_distinct(ids)), 1, keep)

    part = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(smallest(F.collect_set("id")).alias("ids"))
    return part.groupBy("vec").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def hash_strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(rows, trees) 64-bit strings: signs of random projections, the first projection in the top bit."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
    signs = (x @ planes > 0).reshape(len(x), trees, bits)
    packed = np.packbits(signs, axis=2, bitorder="big").view(">u8")[:, :, 0] if bits == 64 else np.packbits(
        np.pad(signs, ((0, 0), (0, 0), (0, 64 - bits))), axis=2, bitorder="big").view(">u8")[:, :, 0]
    return packed.astype(np.uint64)


def _bit_length(x: np.ndarray) -> np.ndarray:
    smear = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        smear |= smear >> np.uint64(shift)
    return np.bitwise_count(smear)


class Forest:
    """Sorted hash arrays over the rows of ``x``; inner products become angles by one more component."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.x, self.trees, self.bits, self.seed = x, trees, bits, seed
        centred = x - x.mean(axis=0)                        # moves all products of a query by the same amount
        self.scale = np.sqrt((centred ** 2).sum(axis=1).max()) or 1.0
        unit = centred / self.scale
        last = np.sqrt(np.maximum(0.0, 1.0 - (unit ** 2).sum(axis=1)))
        self.codes = hash_strings(np.c_[unit, last], trees, bits, seed)
        self.order = np.argsort(self.codes, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.codes, self.order, axis=0).T)

    def query_codes(self, q: np.ndarray) -> np.ndarray:
        return hash_strings(np.c_[q, np.zeros(len(q))], self.trees, self.bits, self.seed)

    def descend(self, codes: np.ndarray) -> int:
        """The longest prefix that any query shares with any vector, over all trees."""
        best = 0
        for t in range(self.trees):
            s, c = self.sorted[t], codes[:, t]
            at = np.searchsorted(s, c)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(s) - 1)):
                best = max(best, 64 - int(_bit_length(s[k] ^ c).min()))
        return min(best, self.bits)

    def ranges(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) per query and tree: the run of the sorted array under the query's prefix of its ``depth`` bits."""
        free = np.where(depth >= 64, np.uint64(0), np.uint64(2 ** 64 - 1) >> np.minimum(depth, 63).astype(np.uint64))
        lo, hi = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(self.trees):
            c = codes[:, t]
            lo[:, t] = np.searchsorted(self.sorted[t], c & ~free)
            hi[:, t] = np.searchsorted(self.sorted[t], c | free, side="right")
        return lo, hi

    def ascend(self, codes: np.ndarray, enough: float, from_depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges at the first common depth, going up from ``from_depth``, that hold ``enough`` entries over all trees."""
        depth = np.full(len(codes), from_depth, np.int64)
        lo, hi = self.ranges(codes, depth)
        while True:
            short = np.flatnonzero(((hi - lo).sum(axis=1) < enough) & (depth > 0))
            if not len(short):
                return lo, hi
            depth[short] -= 1
            lo[short], hi[short] = self.ranges(codes[short], depth[short])

    def enough(self, q: np.ndarray, codes: np.ndarray, k: int, recall: float, from_depth: int) -> float:
        """Entries to gather so that the mean recall of the ``k`` best of ``q`` in this shard is at least ``recall``."""
        n = len(self.x)
        if n <= 4 * k:
            return float("inf")
        best = np.argpartition(-(q @ self.x.T), k - 1, axis=1)[:, :k]
        shared = 64 - _bit_length(self.codes[best] ^ codes[:, None, :]).astype(int).min(axis=2)   # longest, over trees
        counts = np.stack([np.subtract(*self.ranges(codes, np.full(len(q), d))[::-1]).sum(axis=1)
                           for d in range(from_depth + 1)], axis=1)
        for wanted in np.unique(np.r_[np.geomspace(k, n * self.trees, 60), n * self.trees]):
            depth = (counts >= wanted).cumsum(axis=1).max(axis=1) - 1       # counts fall as depth grows
            if (shared >= np.maximum(depth, 0)[:, None]).mean() >= recall:
                return float(wanted)
        return float("inf")


class Shard:
    """One shard's forest with its vectors' ids; answers queries in parts, of any number."""

    def __init__(self, parts: list[pa.RecordBatch], k: int, trees: int, bits: int, recall: float):
        table = pa.Table.from_batches(parts)
        x, ids = _matrix(table.column("vec").combine_chunks()), table.column("ids").to_pylist()
        rows = np.lexsort(x.T[::-1])                        # the result is the same in any order of arrival
        self.k, self.recall, self.wanted = k, recall, None
        self.ids = [ids[i] for i in rows]
        self.forest = Forest(x[rows], trees, bits)

    def answer(self, asked: pa.Table, sample: int) -> pa.RecordBatch:
        """The ``k`` best candidates of each query; the first call calibrates on its first ``sample`` queries."""
        forest, k = self.forest, self.k
        q = _matrix(asked.column("vec").combine_chunks())
        own = np.array([i[0] for i in asked.column("ids").to_pylist()], np.int64)
        codes = forest.query_codes(q)
        top = forest.descend(codes)
        if self.wanted is None:
            self.wanted = forest.enough(q[:sample], codes[:sample], min(k, len(forest.x)), self.recall, top)
        lo, hi = forest.ascend(codes, self.wanted, top)
        at, found_ids, found_scores = [], [], []
        for r in range(len(q)):
            mask = np.zeros(len(forest.x), bool)
            for t in range(forest.trees):
                mask[forest.order[lo[r, t]:hi[r, t], t]] = True
            found = np.flatnonzero(mask)
            if len(found) > k + 1:                          # all that may be among the k best, with ties; then exactly
                score = forest.x[found] @ q[r]
                least = np.partition(score, len(found) - k - 1)[len(found) - k - 1]
                found = found[score >= least - 1e-9 * max(1.0, abs(least))]
            exact = np.einsum("ij,j->i", forest.x[found], q[r])
            names = [self.ids[i] for i in found]
            value, ident = np.repeat(exact, [len(o) for o in names]), np.array([v for o in names for v in o], np.int64)
            value, ident = value[ident != own[r]], ident[ident != own[r]]
            best = np.lexsort((ident, -value))[:k]
            at.append(np.full(len(best), r))
            found_ids.append(ident[best])
            found_scores.append(value[best])
        at = np.concatenate(at)
        keys = asked.column("query_key").to_numpy()
        return pa.record_batch({"query_id": pa.array(own[at]), "query_key": pa.array(keys[at]),
                                "vec_id": pa.array(np.concatenate(found_ids)), "score": pa.array(np.concatenate(found_scores))})


def _matrix(vec: pa.Array) -> np.ndarray:
    return vec.flatten().to_numpy().reshape(len(vec), -1).astype(np.float64)


def _search_sorted(k: int, trees: int, bits: int, recall: float, sample: int):
    """Over rows sorted by (shard, block, dim, is_query): a shard is built from its vectors, then its queries stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, shard, waiting = None, [], None, []

        def ask(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal shard, vectors, waiting
            if vectors and sum(map(len, waiting)) >= least:
                shard = shard or Shard(vectors, k, trees, bits, recall)
                yield shard.answer(pa.Table.from_batches(waiting), sample)
                waiting = []

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "block", "dim")], axis=1).astype(np.int64)
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            mark = np.c_[keys, asks]
            cuts = np.r_[0, np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1, len(mark)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if tuple(keys[i]) != now:
                    yield from ask(1)                       # fewer than a sample: all that there are
                    now, vectors, shard, waiting = tuple(keys[i]), [], None, []
                if asks[i]:
                    for a in range(i, j, QUERY_ROWS):
                        waiting.append(batch.slice(a, min(j - a, QUERY_ROWS)))
                        yield from ask(1 if shard else sample)
                else:
                    vectors.append(batch.slice(i, j - i))
        yield from ask(1)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
           trees: int = TREES, bits: int = BITS, recall: float = RECALL, shard_rows: int = SHARD_ROWS,
           query_rows: int = QUERY_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """The ``k`` vectors of ``vectors`` with the largest inner product for every row of ``queries``, but its own id.

    Returns query_id, rank (from 1), vec_id, score (double, on the original vectors), nearest first, ties to smaller ids.
    Rows with a null id, or a vector that is not :func:`usable`, take no part; vectors of other lengths than the
    query's are no candidates; rows equal in id and vector count once; one id with several queries is asked once for each
    vector; an empty table gives an empty result; other columns are not read.
    """
    def clean(df: DataFrame) -> DataFrame:
        vec = F.transform(F.col(embedding), lambda x: x.cast("double"))
        return df.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec"))

    rows = clean(vectors)
    salts = max(64, rows.count() // SALT_ROWS)
    data = materialize(distinct_vectors(rows, k + 1, salts), "ann-vectors")
    asked = materialize(clean(queries).distinct(), "ann-queries")
    shards, blocks = max(1, data.count() // shard_rows), min(blocks, max(1, asked.count() // query_rows))
    # a stated query set against all vectors: a query visits every shard, a vector is copied once a block, ``blocks`` at most
    left = data.select(F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("query_key"), "vec", "ids",
                       F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("shard"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = asked.select(F.lit(True).alias("is_query"), F.xxhash64("vec").alias("query_key"), "vec", F.array("id").alias("ids"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                         F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    # sorted, a shard's vectors come first, then its queries in the order of a hash: the first of them are a fair sample
    found = (left.unionByName(right).withColumn("dim", F.size("vec")).repartition("shard", "block")
             .sortWithinPartitions("shard", "block", "dim", "is_query", F.xxhash64("ids", "query_key"), "ids")
             .mapInArrow(_search_sorted(k, trees, bits, recall, SAMPLE), "query_id long, query_key long, vec_id long, score double"))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
