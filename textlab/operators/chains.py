"""Packed training rows, and chains of splits of one large node inside a task, for both decision trees.

A packed row is ``(id, codes, vals)``: the numbers of its terms (their place in alphabetical order) and their values, 12 bytes a
cell. Ids must not repeat. A large node is split along its first branch (value zero, or up to the threshold): a task gets the
node's counts per (term, value, class) and the rows that have one of the terms likely to split next. A split takes those of
its rows off the counts; the other rows are not needed. When a term is best whose rows the task does not have, it gives the
counts and the terms to look for, and the next pass goes on from there, so the rows that stay are never counted again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlab.operators.node_cells import NodeCells
from textlab.sources.scratch import materialize

#: Non-zeros and rows of the largest node that one task finishes: 12 bytes each as they come, some 50 more while arrays are made.
LOCAL_CELLS = 5_000_000
#: Rows of one large node that a task gets in one pass.
PEEL_ROWS = 50_000
#: Packing numbers the terms by a table that goes to every task; with more terms rows are not packed.
MAX_TERMS = 200_000

#: What a chain goes on with from pass to pass.
STATE = {"path": "string", "split_value": "string", "depth": "int", "parent": "long", "classes": "array<string>", "cnt": "array<long>",
         "gcode": "array<int>", "gval": "array<double>", "m": "array<long>", "cand": "array<int>", "lim": "array<double>"}


def vocabulary(rows: DataFrame, nz: DataFrame) -> list[str] | None:
    """The sorted terms of ``nz``, or None if rows cannot be packed: an id repeats, or there are too many terms."""
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        return None
    terms = [r[0] for r in nz.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    return None if len(terms) > MAX_TERMS or None in terms else sorted(terms)


def numbers(spark, terms: list[str]) -> DataFrame:
    """(code, term) of the vocabulary, to be sent to every task."""
    return F.broadcast(spark.createDataFrame(list(enumerate(terms)), "code int, term string"))


def pack(nz: DataFrame, terms: list[str], value: str) -> DataFrame:
    """(id, codes, vals) from (id, term, ``value``), partitioned by id, so that joins with it move the other side alone."""
    spark = nz.sparkSession
    cells = nz.join(numbers(spark, terms), "term").select("id", F.struct("code", F.col(value).cast("double").alias("val")).alias("c"))
    return (cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id")
            .agg(F.collect_list("c").alias("c")).select("id", F.col("c.code").alias("codes"), F.col("c.val").alias("vals")))


def unpack(packed: DataFrame) -> DataFrame:
    """(id, code, val) of packed rows, where they lie."""
    return packed.select("id", F.inline(F.arrays_zip("codes", "vals")).alias("code", "val"))


def value_counts(assign: DataFrame, packed: DataFrame) -> DataFrame:
    """(node, code, val, label, c) from the non-zeros of the rows of ``assign`` (id, node, label)."""
    cells = assign.select("id", "node", "label").hint("shuffle_hash").join(packed, "id").select(
        "node", "label", F.inline(F.arrays_zip("codes", "vals")).alias("code", "val"))
    return cells.groupBy("node", "code", "val", "label").agg(F.count(F.lit(1)).alias("c"))


def gather(batches: Iterator[pa.RecordBatch], classes: list[str] | None = None) -> tuple[list[dict], dict, NodeCells | None]:
    """A group of packed rows: (the rows that have a path, ``id``, ``classes`` and class numbers ``y`` of the others, their cells).

    Batch by batch, so that the group is held once, as arrays. ``classes``: None for those that occur.
    """
    heads, ids, labels, lens, codes, vals = [], [], [], [], [], []
    for b in batches:
        t = pa.Table.from_batches([b])
        heads += t.filter(pc.is_valid(t["path"])).to_pylist()
        t = t.filter(pc.is_null(t["path"]))
        if len(t):
            ids += t["id"].to_pylist()
            labels += t["label"].to_pylist()
            lens.append(pc.fill_null(pc.list_value_length(t["codes"]), 0).to_numpy())
            codes.append(pc.list_flatten(t["codes"]).to_numpy())
            vals.append(pc.list_flatten(t["vals"]).to_numpy())
    if not ids:
        return heads, {"id": []}, None
    names = np.array(labels, dtype=object).astype(str)
    classes, y = np.unique(names, return_inverse=True) if classes is None else (np.array(classes), np.searchsorted(classes, names))
    row = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate(lens))
    codes, vals = np.concatenate(codes), np.concatenate(vals)
    return heads, {"id": ids, "classes": classes, "y": y}, NodeCells(y, len(classes), row, codes, vals)


def path_key(path: str) -> int:
    """The 64-bit key of a node by its path."""
    return int.from_bytes(hashlib.blake2b(path.encode(), digest_size=8).digest(), "little", signed=True)


class Counts:
    """The counts of one node: ``m`` per group and class, ``cnt`` per class; a group is a (term, value), sorted."""

    def __init__(self, gt: np.ndarray, gv: np.ndarray, m: np.ndarray, cnt: np.ndarray):
        there = m.any(axis=1)
        self.gt, self.gv, self.m, self.cnt = gt[there], gv[there], m[there], cnt
        self.first = np.flatnonzero(np.concatenate([[True], self.gt[1:] != self.gt[:-1]])) if len(self.gt) else np.zeros(0, np.int64)
        self.last = np.concatenate([self.first[1:], [len(self.gt)]]) - 1 if len(self.gt) else self.first
        self.terms = self.gt[self.first]
        self.term_at = np.repeat(np.arange(len(self.terms)), self.last - self.first + 1)

    def size(self) -> int:
        return int(self.m.sum() + self.cnt.sum())


#: A rule gives per term of the counts: its cost (inf: no split by it), the rows that leave, the first group of theirs.
Rule = Callable[[Counts, int], tuple[np.ndarray, np.ndarray, np.ndarray] | None]


def _counts(state: dict) -> tuple[np.ndarray, Counts]:
    """The classes and counts of a state; at a chain's start they come as they were counted, a line a (group, class)."""
    classes = np.array(state["classes"], dtype=object).astype(str)
    order = np.argsort(classes, kind="stable")
    cnt = np.array(state["cnt"], np.int64)[order]
    classes = classes[order]
    code, val = np.array(state["gcode"], np.int64), np.array(state["gval"], float)
    m = np.array(state["m"], np.int64)
    if state["glabel"] is None:
        return classes, Counts(code, val, m.reshape(len(code), len(classes)), cnt)
    y = np.searchsorted(classes, np.array(state["glabel"], dtype=object).astype(str)) if len(code) else np.zeros(0, np.int64)
    at = np.lexsort((val, code))
    code, val, m, y = code[at], val[at], m[at], y[at]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (val[1:] != val[:-1])]) if len(code) else np.zeros(0, bool)
    full = np.zeros((int(new.sum()), len(classes)), np.int64)
    np.add.at(full, (np.cumsum(new) - 1, y), m)
    return classes, Counts(code[new], val[new], full, cnt)


def _wanted(cost: np.ndarray, leaving: np.ndarray, budget: int) -> list[int]:
    """The terms to have rows of: the best and, in the order of their cost, those whose rows still fit."""
    out, left = [], budget
    for j in np.argsort(cost, kind="stable").tolist():
        if left <= 0 or not np.isfinite(cost[j]):
            break
        if leaving[j] <= left:
            out.append(j)
            left -= int(leaving[j])
        elif not out:
            break
    return out


def split_chain(batches: Iterator[pa.RecordBatch], rule: Rule, names: list[str], budget: int, local_cells: int, branch: Callable,
                exact: bool) -> list[dict]:
    """One pass over one large node: its splits (``node``), the rows that leave (``row``), where the others stay (``rest``) or,
    if the chain goes on, the counts and the terms to look for (``state``).

    ``branch(counts, path, j, g)`` gives (the split's threshold, the branch of all rows that leave or None if it is their value,
    the path of the rest, its split value). With ``exact`` rows are looked for that have a term's first value to leave or more.
    """
    heads, rows, cells = gather(batches)
    state = heads[0]
    classes, now = _counts(state)
    k, gkey = len(classes), state["gkey"]
    path, depth, sv, left = state["path"], state["depth"], state["split_value"], state["parent"]
    cand, lim = set(state["cand"] or []), state["lim"]
    here, out = None, []
    if cells is not None:
        here = np.ones(len(rows["id"]), bool)
        own_y = np.searchsorted(classes, rows["classes"])            # classes of the rows at hand among the node's
    while True:
        n = int(now.cnt.sum())
        if now.size() <= local_cells:
            break
        found = rule(now, depth)
        j = None if found is None else int(np.argmin(found[0]))
        if j is not None and not np.isfinite(found[0][j]):
            j = None
        majority = str(classes[int(np.argmax(now.cnt))])
        if j is None:
            out.append(dict(kind="node", gkey=gkey, path=path, split_value=sv, depth=depth, majority=majority, n=n, is_leaf=True,
                            **{"class": majority}))
            path = None
            break
        cost, leaving, first = found
        g, code = int(first[j]), int(now.terms[j])
        if here is None or code not in cand or (lim is not None and now.gv[g] < lim[code]):
            want = _wanted(cost, leaving, budget)
            if want:
                least = np.full(len(names), np.inf)                   # by term: the least value to look for
                least[now.terms[want]] = now.gv[first[want]]
                out.append(dict(kind="state", gkey=gkey, path=path, split_value=sv, depth=depth, parent=left, classes=classes.tolist(),
                                cnt=now.cnt.tolist(), gcode=now.gt.tolist(), gval=now.gv.tolist(), m=now.m.ravel().tolist(),
                                cand=now.terms[want].tolist(), lim=least.tolist() if exact else None))
                return out
            break                                                     # by jobs: the rows of this split are too many
        threshold, side, rest_path, rest_sv = branch(now, path, j, g)
        a, b = np.searchsorted(cells.gt, [code, code + 1]).tolist()
        a += int(np.searchsorted(cells.gv[a:b], now.gv[g], "left"))
        lo, hi = int(cells.post_ptr[a]), int(cells.post_ptr[b])
        gone = cells.post_row[lo:hi]
        value = np.repeat(cells.gv[a:b], np.diff(cells.post_ptr[a:b + 1]))
        stays = here[gone]
        gone, one = np.unique(gone[stays][::-1], return_index=True)
        value = value[stays][::-1][one]
        key = path_key(path)
        out.append(dict(kind="node", gkey=gkey, path=path, split_value=sv, depth=depth, feature=names[code], threshold=threshold,
                        majority=majority, n=n, is_leaf=False, parent=key))
        out += [dict(kind="row", gkey=gkey, id=rows["id"][i], parent=key, v=int(v) if side is None else side)
                for i, v in zip(gone.tolist(), value.tolist())]
        here[gone] = False
        m, cnt = now.m, now.cnt - np.bincount(own_y[rows["y"][gone]], minlength=k)
        at, c = cells.counts(gone)
        group, cls = at // cells.k, own_y[at % cells.k]
        np.subtract.at(m, (_place(now, cells, group), cls), c)
        now = Counts(now.gt, now.gv, m, cnt)
        path, sv, depth, left = rest_path, rest_sv, depth + 1, key
        if not cnt.sum():
            path = None
            break
    if path is not None and left is not None:
        out.append(dict(kind="rest", gkey=gkey, parent=left, v=0))
    return out


def _place(now: Counts, cells: NodeCells, group: np.ndarray) -> np.ndarray:
    """Where groups of the rows at hand are among the node's."""
    gt, gv = cells.gt[group], cells.gv[group]
    lo = np.searchsorted(now.gt, gt, "left")
    hi = np.searchsorted(now.gt, gt, "right")
    while (todo := lo < hi).any():                                   # the value's place within its term
        mid = (lo + hi) // 2
        less = todo & (now.gv[np.minimum(mid, len(now.gv) - 1)] < gv)
        lo, hi = np.where(less, mid + 1, lo), np.where(todo & ~less, mid, hi)
    return lo


def split_chains(own: DataFrame, packed: DataFrame, counts: DataFrame, heads: DataFrame, run: Callable, exact: bool,
                 name: str) -> DataFrame:
    """What :func:`split_chain` gives for every node of ``heads``, pass after pass until no chain goes on.

    ``own``: (node, id, label) of the nodes' rows; ``counts``: (node, code, val, label, c); ``heads``: (node, path, split_value, depth,
    classes, cnt). ``run`` is :func:`split_chain` with its rule. With ``exact`` a row must have a wanted term at its least value.
    """
    spark, kind = own.sparkSession, own.schema["id"].dataType.simpleString()
    fields = {"kind": "string", "gkey": "long", "id": kind, **STATE, "feature": "string", "threshold": "double", "class": "string",
              "majority": "string", "n": "long", "is_leaf": "boolean", "v": "long"}
    schema = ", ".join(f"`{c}` {t}" for c, t in fields.items())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = run(batches)
        for at in range(0, len(out), 50_000):
            part = out[at:at + 50_000]
            yield pa.RecordBatch.from_pydict({f.name: [r.get(f.name) for r in part] for f in arrow}, schema=arrow)

    listed = counts.groupBy("node").agg(F.collect_list(F.struct("code", "val", "label", "c")).alias("x"))
    state = heads.join(listed, "node", "left").select(
        F.col("node").alias("gkey"), "path", "split_value", "depth", F.lit(None).cast("long").alias("parent"), "classes", "cnt",
        *[F.coalesce(F.col(f"x.{c}"), F.array().cast(t)).alias(a) for c, a, t in
          (("code", "gcode", "array<int>"), ("val", "gval", "array<double>"), ("c", "m", "array<long>"), ("label", "glabel", "array<string>"))],
        F.lit(None).cast("array<int>").alias("cand"), F.lit(None).cast("array<double>").alias("lim"))
    columns = {"gkey": "long", **STATE, "glabel": "array<string>", "id": kind, "label": "string", "codes": "array<int>", "vals": "array<double>"}

    def lined_up(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])

    long, done = lined_up(state), []
    while True:
        part = materialize(long.groupBy("gkey").applyInArrow(task, schema), f"{name}-{len(done)}")
        done.append(part)
        state = part.filter("kind = 'state'")
        if state.isEmpty():
            break
        gone = done[0].filter("kind = 'row'").select("id")
        for p in done[1:]:
            gone = gone.unionByName(p.filter("kind = 'row'").select("id"))
        wanted = F.broadcast(state.select(F.col("gkey").alias("node"), "cand", "lim"))
        # hash tables of ids, which are few beside their cells: packed rows need no sort
        here = own.join(wanted.select("node"), "node", "left_semi").join(gone.hint("shuffle_hash"), "id", "left_anti")
        # what is wanted is looked at last, as it would travel with every row
        some = here.hint("shuffle_hash").join(packed, "id").join(wanted, "node").filter(F.arrays_overlap("codes", "cand"))
        if exact:
            some = some.filter(F.exists(F.zip_with("codes", "vals", lambda c, x: x >= F.get(F.col("lim"), c)), lambda yes: yes))
        long = lined_up(state).unionByName(lined_up(some.select(F.col("node").alias("gkey"), "id", "label", "codes", "vals")))
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out.filter("kind <> 'state'")
