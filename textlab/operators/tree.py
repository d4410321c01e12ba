"""Gain-ratio decision tree (A19, A20, L3, M2, M4-M7) grown level by level as DataFrame jobs.

The training matrix stays long and sparse: ``rows(id, label)`` and non-zeros ``nz(id, term, tf)``.
For every open node and every term with a non-zero at that node, the value branches are counted
from the non-zeros; the zero branch is the node's label counts minus the non-zero counts, so the
dense matrix never exists. Entropy, split information and gain ratio are column arithmetic;
the best term per node is a ranking window partitioned by node. Children are a join of the node's
rows with the chosen term. Each level is written as a Parquet table in the shared checkpoint folder,
so lineage stays one level deep, plan statistics stay fresh, and a lost executor recomputes at most
one level.

Node ids are paths: the root is ``""`` and a child appends ``/<value>`` with the value left-padded
to 6 digits, so sorting by node id is the pre-order walk with children in value order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab import schema as S
from textlab.operators import chains as CH
from textlab.operators.node_cells import NodeCells, codes
from textlab.sources.scratch import materialize, scratch_path

GAIN_EPS = 1e-12       # |gain| below this counts as zero (float noise, quirk Q11)
TIE_DECIMALS = 12      # gain ratios equal to 12 decimals tie; the alphabetically first term wins
VALUE_WIDTH = 6


def padded(value: Column) -> Column:
    """A branch value as it stands in node ids: at least ``VALUE_WIDTH`` digits, longer values whole."""
    v = value.cast("string")
    return F.when(F.length(v) >= VALUE_WIDTH, v).otherwise(F.lpad(v, VALUE_WIDTH, "0"))


def _log2(x: Column) -> Column:
    return F.log2(x)


def label_counts(assign: DataFrame) -> DataFrame:
    """``(node, label, c)``; with the tree job's row columns also the non-zeros of those rows and the
    node's parent key and branch value (constant per node)."""
    aggs = [F.count(F.lit(1)).alias("c")]
    if "row_nnz" in assign.columns:
        aggs += [F.sum("row_nnz").alias("nnz"), F.any_value("parent").alias("parent"), F.any_value("v").alias("v"),
                 F.min(F.struct("parent", "v")).alias("_lo"), F.max(F.struct("parent", "v")).alias("_hi")]
    return assign.groupBy("node", "label").agg(*aggs)


def node_summary(cnt: DataFrame) -> DataFrame:
    """Per node: rows ``n``, distinct labels, majority (tie: smallest label), entropy ``h``."""
    w = Window.partitionBy("node").orderBy(F.desc("c"), F.asc("label"))
    ranked = cnt.withColumn("_r", F.row_number().over(w))
    extra = [F.sum("nnz").alias("nnz"), F.any_value("parent").alias("parent"), F.any_value("v").alias("v"),
             (F.min("_lo") != F.max("_hi")).alias("collision")] if "nnz" in cnt.columns else []
    n = cnt.groupBy("node").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_labels"),
                                F.sum(-(F.col("c") * _log2(F.col("c")))).alias("_s"), *extra)
    maj = ranked.filter(F.col("_r") == 1).select("node", F.col("label").alias("majority"))
    # H(node) = log2(n) - sum(c log2 c)/n  (same quantity as -sum p log2 p)
    keep = ["nnz", "parent", "v", "collision"] if extra else []
    return n.join(maj, "node").select("node", "n", "n_labels", "majority", *keep,
                                      (_log2(F.col("n")) + F.col("_s") / F.col("n")).alias("h"))


def value_counts(assign: DataFrame, nz: DataFrame) -> DataFrame:
    """``(node, term, v, label, c)`` from the non-zeros of every node's rows."""
    # a hash table of the rows, which are few beside their non-zeros: these need no sort
    return (assign.hint("shuffle_hash").join(nz, "id").groupBy("node", "term", F.col("tf").cast("long").alias("v"), "label")
            .agg(F.count(F.lit(1)).alias("c")))


def gain_ratios(assign: DataFrame, nz: DataFrame, cnt: DataFrame, summ: DataFrame) -> DataFrame:
    """A19 for every (open node, term with a non-zero there): info gain, split info, gain ratio."""
    return ratios_of(materialize(value_counts(assign, nz), "tree-counts"), cnt, summ)      # the counts are read four times


def ratios_of(c: DataFrame, cnt: DataFrame, summ: DataFrame) -> DataFrame:
    """A19 from :func:`value_counts`; ``n_rows`` are the node's rows with the term."""
    nzsum = c.groupBy("node", "term", "label").agg(F.sum("c").alias("s"))
    pairs = c.select("node", "term").distinct()
    zero = (pairs.join(cnt, "node")
                 .join(nzsum, ["node", "term", "label"], "left")
                 .select("node", "term", F.lit(0).cast("long").alias("v"), "label",
                         (F.col("c") - F.coalesce(F.col("s"), F.lit(0))).alias("c"))
                 .filter(F.col("c") > 0))
    br = c.select("node", "term", "v", "label", "c").unionByName(zero)
    hb = br.groupBy("node", "term", "v").agg(F.sum("c").alias("nb"),
                                             F.sum(F.col("c") * _log2(F.col("c"))).alias("_s"))
    hb = hb.withColumn("hb", _log2(F.col("nb")) - F.col("_s") / F.col("nb"))
    g = hb.join(summ.select("node", "n", "h"), "node")
    p = F.col("nb") / F.col("n")
    agg = g.groupBy("node", "term").agg(F.first("h").alias("h"), F.sum(p * F.col("hb")).alias("we"),
                                        F.sum(-(p * _log2(p))).alias("si"), F.count(F.lit(1)).alias("n_values"),
                                        F.sum(F.when(F.col("v") != 0, F.col("nb")).otherwise(0)).alias("n_rows"))
    ig = F.col("h") - F.col("we")
    gr = F.when(F.col("si") > 0, ig / F.col("si")).otherwise(F.lit(0.0))
    return agg.select("node", "term", ig.alias("info_gain"), F.col("si").alias("split_info"),
                      gr.alias("gain_ratio"), "n_values", "n_rows")


def best_split(gr: DataFrame) -> DataFrame:
    """L3: per node the term with the largest gain ratio; ties go to the alphabetically first term."""
    w = Window.partitionBy("node").orderBy(F.desc(F.round("gain_ratio", TIE_DECIMALS)), F.asc("term"))
    return gr.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


NODE_SCHEMA = ("node_id string, parent_id string, split_value string, depth int, feature string, class string, "
               "majority string, n long, is_leaf boolean")


def _parent_path(path: Column) -> Column:
    return F.when(path != "", F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def _parent_of(path: str):
    return None if path == "" else path.rsplit("/", 1)[0]


def _finish_local(table, max_depth: int | None, eps: float = GAIN_EPS):
    """Grow the subtree of one small node inside one task from rows that are not packed, as where ids repeat.

    ``table`` (Arrow) holds the node's rows (``term`` null) and its non-zeros; the caller bounds it by its cell limit.
    """
    is_row = pc.is_null(table["term"])
    head = table.filter(is_row).select(["id", "label", "node", "depth", "split_value"]).to_pandas()
    node0, depth0, sv0 = head["node"].iloc[0], int(head["depth"].iloc[0]), head["split_value"].iloc[0]
    rows = head[["id", "label"]].drop_duplicates("id").sort_values("id")
    ids = rows["id"].to_numpy()
    classes, y = np.unique(rows["label"].to_numpy().astype(str), return_inverse=True)
    body = table.filter(pc.invert(is_row))
    terms, t_all = codes(body["term"])
    cells = NodeCells(y, len(classes), np.searchsorted(ids, body["id"].to_numpy()), t_all, body["tf"].to_numpy().astype(np.int64))
    return _subtree(node0, sv0, depth0, classes, y, cells, terms, max_depth, eps)


def _finish_packed(batches: Iterator[pa.RecordBatch], names: list[str], max_depth: int | None) -> pa.Table:
    """The subtree of one small node from its packed rows and one row with its path, depth and split value."""
    (head, *_), rows, cells = CH.gather(batches)
    return _subtree(head["path"], head["split_value"], head["depth"], rows["classes"], rows["y"], cells, names, max_depth)


def _ratios(m: np.ndarray, term_at: np.ndarray, n_terms: int, cnt: np.ndarray, xlogx) -> tuple[np.ndarray, np.ndarray]:
    """Per term (the gain ratio, -inf where it does not split; the rows that have it) from counts per (term, value) and class."""
    n, nb, sc = cnt.sum(), m.sum(axis=1), xlogx(m).sum(axis=1)
    nzsum = np.stack([np.bincount(term_at, weights=m[:, c], minlength=n_terms) for c in range(len(cnt))], axis=1).astype(np.int64)
    zc = cnt[None, :] - nzsum                                       # zero branch per (term, class)
    zn = zc.sum(axis=1)
    a = np.bincount(term_at, weights=xlogx(nb) - sc, minlength=n_terms) + xlogx(zn) - xlogx(zc).sum(axis=1)
    p = nb / n
    si = np.bincount(term_at, weights=-p * np.log2(p), minlength=n_terms)
    pz = zn / n
    si = si - np.where(pz > 0, pz * np.log2(np.where(pz > 0, pz, 1.0)), 0.0)
    n_br = np.bincount(term_at, minlength=n_terms) + (zn > 0)
    gain = np.log2(n) - xlogx(cnt).sum() / n - a / n
    gr = np.round(np.where(si > 0, gain / np.where(si > 0, si, 1.0), 0.0), TIE_DECIMALS)
    return np.where(n_br >= 2, gr, -np.inf), nzsum.sum(axis=1)


def _subtree(node0: str, sv0: str | None, depth0: int, classes: np.ndarray, y: np.ndarray, cells: NodeCells, terms,
             max_depth: int | None, eps: float = GAIN_EPS) -> pa.Table:
    """Grow the subtree of one small node inside one task, with the same rules as the level job.

    The matrix stays sparse (:class:`textlab.operators.node_cells.NodeCells`): a node has its counts per (term, value, class),
    the zero branch is its class counts minus those, and all gain ratios of the node are array arithmetic.
    """
    n_cls = len(classes)
    top = max([len(y), *np.diff(cells.post_ptr).tolist()])
    logs = np.arange(top + 1, dtype=float)                       # x log2 x of every count there can be
    logs[1:] *= np.log2(logs[1:])

    def xlogx(a):
        return logs[np.maximum(a, 0)]

    def best_term(idx, cnt, whole):
        groups, m = cells.present(idx, whole)
        if not len(groups):
            return None, None
        gt = cells.gt[groups]
        new = np.concatenate([[True], gt[1:] != gt[:-1]])
        bt, names = np.cumsum(new) - 1, gt[new]
        gr, _ = _ratios(m, bt, len(names), cnt, xlogx)
        j = int(np.argmax(gr))                                      # first max = alphabetically first term
        return (int(names[j]), float(gr[j])) if np.isfinite(gr[j]) else (None, None)

    out = []
    every = np.arange(len(y))
    stack = [(node0, sv0, depth0, every, cells.children([every], None)[0])]
    while stack:
        path, sv, depth, idx, whole = stack.pop()
        cnt = np.bincount(y[idx], minlength=n_cls)
        n = len(idx)
        majority = classes[sorted(range(n_cls), key=lambda k: (-cnt[k], classes[k]))[0]]
        j, g = (None, None)
        if (cnt > 0).sum() > 1 and (max_depth is None or depth < max_depth):
            j, g = best_term(idx, cnt, whole)
        if j is None or abs(g) < eps:
            out.append((path, _parent_of(path), sv, depth, None, majority, majority, n, True))
            continue
        out.append((path, _parent_of(path), sv, depth, terms[j], None, majority, n, False))
        vals = np.zeros(n, np.int64)
        at, group = cells.rows_of(idx, *np.searchsorted(cells.gt, [j, j + 1]).tolist())
        vals[at] = cells.gv[group]
        found = np.unique(vals)[::-1]
        parts = [idx[vals == v] for v in found]
        for v, part, own in zip(found, parts, cells.children(parts, whole)):
            stack.append((f"{path}/{str(int(v)).zfill(VALUE_WIDTH)}", str(int(v)), depth + 1, part, own))
    names = ["node_id", "parent_id", "split_value", "depth", "feature", "class", "majority", "n", "is_leaf"]
    frame = pd.DataFrame(out, columns=names)
    kinds = dict(depth=pa.int32(), n=pa.int64(), is_leaf=pa.bool_())
    return pa.Table.from_pandas(frame, schema=pa.schema([(c, kinds.get(c, pa.string())) for c in names]), preserve_index=False)


def _finished(own: DataFrame, heads: DataFrame, packed: DataFrame, terms: list[str], max_depth: int | None) -> DataFrame:
    """The subtrees of small nodes; ``own``: their rows, ``heads``: (node, path, split_value, depth), which travel once a node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _finish_packed(batches, terms, max_depth).to_batches()

    cells = own.select("node", "id", "label").hint("shuffle_hash").join(packed, "id", "left")
    one = heads.select("node", "path", "split_value", "depth")
    return cells.unionByName(one, allowMissingColumns=True).groupBy("node").applyInArrow(run, NODE_SCHEMA)


#: Bounds of ``textlab.operators.chains`` for rows that are not packed: some 50 bytes each as Arrow columns, as much again as arrays.
LOOSE_CELLS = 2_000_000
LOOSE_PEEL_ROWS = 20_000
PEELED = ("kind string, gkey long, id long, node_id string, parent_id string, split_value string, depth int, feature string, "
          "class string, majority string, n long, is_leaf boolean, parent long, v long")


def _peel(pdf, max_depth: int | None, eps: float = GAIN_EPS):
    """Several splits of one large node in a row, each time going on with its zero branch.

    ``pdf`` holds, by ``part``: ``count`` rows (term, v, label, c) of the whole node, its class counts (``class`` rows),
    the candidate terms (``cand``), and the non-zeros of all rows that have one of these (``cell``, labels on them; a row
    with no other use has its own term at least). For rows that are not packed. Counts of the zero branch are the node's minus those of the rows that
    leave, so splits are exact while the best term is a candidate. Out: the nodes split (or a leaf at the end), the
    rows that leave with their branch (``row``), and where the others stay (``rest``).
    """
    first = pdf[pdf["part"] == "class"].sort_values("label")
    classes, cnt = first["label"].to_numpy().astype(str), first["c"].to_numpy(float)
    path, depth, sv, gkey = first["path"].iloc[0], int(first["depth"].iloc[0]), first["split_value"].iloc[0], int(pdf["node"].iloc[0])
    k = len(classes)
    counts = pdf[pdf["part"] == "count"]
    terms, t = np.unique(counts["term"].to_numpy().astype(str), return_inverse=True)
    v, y = counts["v"].to_numpy(np.int64), np.searchsorted(classes, counts["label"].to_numpy().astype(str))
    span = int(v.max()) + 1
    groups, g = np.unique(t * span + v, return_inverse=True)
    m = np.zeros((len(groups), k))
    np.add.at(m, (g, y), counts["c"].to_numpy(float))
    gt = groups // span
    usable = np.zeros(len(terms), bool)
    usable[np.searchsorted(terms, pdf.loc[pdf["part"] == "cand", "term"].to_numpy().astype(str))] = True
    cells = pdf[pdf["part"] == "cell"]
    ct = np.searchsorted(terms, cells["term"].to_numpy().astype(str))
    cv, cid = cells["v"].to_numpy(np.int64), cells["id"].to_numpy(np.int64)
    cy, cg = np.searchsorted(classes, cells["label"].to_numpy().astype(str)), np.searchsorted(groups, ct * span + cv)
    here = np.ones(len(cid), bool)

    def xlogx(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1.0)), 0.0)

    out = []
    parent_id, key, left = _parent_of(path), gkey, None
    while True:
        n = cnt.sum()
        majority = classes[int(np.argmax(cnt))]
        j, gain = None, 0.0
        if (cnt > 0).sum() > 1 and (max_depth is None or depth < max_depth):
            nb, sc = m.sum(axis=1), xlogx(m).sum(axis=1)
            z = cnt[None, :] - np.stack([np.bincount(gt, weights=m[:, c], minlength=len(terms)) for c in range(k)], axis=1)
            zn = z.sum(axis=1)
            a = np.bincount(gt, weights=xlogx(nb) - sc, minlength=len(terms)) + xlogx(zn) - xlogx(z).sum(axis=1)
            p, pz = nb / n, zn / n
            si = np.bincount(gt, weights=-xlogx(p), minlength=len(terms)) - xlogx(pz)
            branches = np.bincount(gt, weights=nb > 0, minlength=len(terms)) + (zn > 0)
            ratio = np.where(si > 0, (np.log2(n) - xlogx(cnt).sum() / n - a / n) / np.where(si > 0, si, 1.0), 0.0)
            ratio = np.where(branches >= 2, np.round(ratio, TIE_DECIMALS), -np.inf)
            if np.isfinite(ratio).any():
                j, gain = int(np.argmax(ratio)), float(ratio.max())
        if j is not None and abs(gain) >= eps and not usable[j]:
            if left is not None or not (equal := usable & (ratio >= gain - 1e-9)).any():
                break                                          # goes on with other rows beside it
            j = int(np.flatnonzero(equal)[0])                  # the first split is a candidate, up to rounding
        if j is None or abs(gain) < eps:
            out.append(("node", gkey, None, path, parent_id, sv, depth, None, majority, majority, int(n), True, key, None))
            path = None
            break
        out.append(("node", gkey, None, path, parent_id, sv, depth, terms[j], None, majority, int(n), False, key, None))
        hit = here & (ct == j)
        for i, b in zip(cid[hit].tolist(), cv[hit].tolist()):
            out.append(("row", gkey, i, None, None, None, None, None, None, None, None, None, key, b))
        gone = here & np.isin(cid, cid[hit])
        np.subtract.at(m, (cg[gone], cy[gone]), 1)
        np.subtract.at(cnt, cy[hit], 1)
        here &= ~gone
        left, parent_id, depth, sv = key, path, depth + 1, "0"
        if cnt.sum() == 0:
            path = None
            break
        path = f"{path}/{'0' * VALUE_WIDTH}"
        key = CH.path_key(path)
    if path is not None and left is not None:
        out.append(("rest", gkey, None, None, None, None, None, None, None, None, None, None, left, 0))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in PEELED.split(", ")])
    for c in ("id", "depth", "n", "v"):
        frame[c] = frame[c].astype("Int64")
    frame["is_leaf"] = frame["is_leaf"].astype("boolean")
    return frame


def _chain_rule(now: CH.Counts, depth: int, max_depth: int | None):
    """:data:`textlab.operators.chains.Rule` of the gain ratio: all rows with the term leave the zero branch."""
    if (now.cnt > 0).sum() < 2 or (max_depth is not None and depth >= max_depth) or not len(now.terms):
        return None

    def xlogx(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1)), 0.0)

    ratio, rows = _ratios(now.m, now.term_at, len(now.terms), now.cnt, xlogx)
    best = ratio.max()
    return None if not np.isfinite(best) or abs(best) < GAIN_EPS else (-ratio, rows, now.first)


def _peel_pass(*given) -> tuple[DataFrame, DataFrame]:
    """(the splits and rows given by chains, the nodes that were split so) of large nodes: packed rows, or the others."""
    return _peel_packed(*given) if isinstance(given[2], list) else _peel_loose(*given)


def _peel_packed(assign, packed, terms, cnt, summ, counts, max_depth, peel_rows, local_cells, step) -> tuple[DataFrame, DataFrame]:
    def branch(now, path, j, g):
        return None, None, f"{path}/{'0' * VALUE_WIDTH}", "0"

    def run(batches):
        return CH.split_chain(batches, lambda now, depth: _chain_rule(now, depth, max_depth), terms, peel_rows, local_cells, branch, False)

    dist = summ.filter("mode = 'dist'").select("node", "path", "split_value", "depth")
    classes = cnt.groupBy("node").agg(F.collect_list(F.struct(F.coalesce("label", F.lit("None")).alias("label"), "c")).alias("l")).select(
        "node", F.col("l.label").alias("classes"), F.col("l.c").alias("cnt"))
    own = assign.join(dist.select("node"), "node", "left_semi").select("node", "id", "label")
    counts = counts.withColumn("label", F.coalesce("label", F.lit("None")))
    peeled = CH.split_chains(own, packed, counts, dist.join(classes, "node"), run, False, f"tree-peeled-{step}")
    peeled = peeled.withColumnRenamed("path", "node_id").withColumn("parent_id", _parent_path(F.col("node_id")))
    return peeled, peeled.select(F.col("gkey").alias("node")).distinct()


def _peel_loose(assign, nz, cnt, summ, counts, found, best, max_depth, peel_rows, step) -> tuple[DataFrame, DataFrame]:
    """(what :func:`_peel` gives, the nodes it was applied to) for large nodes whose best terms are in few rows."""
    w = Window.partitionBy("node").orderBy(F.desc(F.round("gain_ratio", TIE_DECIMALS)), F.asc("term"))   # a node's vocabulary
    cand = (found.withColumn("upto", F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .filter(F.col("upto") <= peel_rows).select("node", "term"))
    cand = materialize(cand.join(best.select("node"), "node", "left_semi"), f"tree-candidates-{step}")
    chains = cand.select("node").distinct()
    own = assign.join(chains, "node", "left_semi").select("node", "id", "label")
    some = own.join(nz, "id").join(cand, ["node", "term"], "left_semi").select("node", "id", "label").distinct()
    null = {"part": "string", "path": "string", "split_value": "string", "depth": "int", "term": "string", "v": "long", "label": "string",
            "c": "long", "id": "long"}

    def part(name: str, df: DataFrame) -> DataFrame:
        return df.select("node", *[F.lit(name).alias("part") if c == "part" else F.col(c).cast(t) if c in df.columns
                                   else F.lit(None).cast(t).alias(c) for c, t in null.items()])

    parts = [part("class", cnt.select("node", "label", "c").join(summ.select("node", "path", "depth", "split_value"), "node")
                  .join(chains, "node", "left_semi")),
             part("count", counts.join(chains, "node", "left_semi")), part("cand", cand),
             part("cell", some.join(nz, "id").withColumnRenamed("tf", "v"))]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)

    def run(pdf):
        return _peel(pdf, max_depth)

    return materialize(long.groupBy("node").applyInPandas(run, PEELED), f"tree-peeled-{step}"), chains


def build_tree(rows: DataFrame, nz: DataFrame, max_depth: int | None = None, checkpoint: bool = True,
               local_cells: int | None = None, copartition: bool = True, peel_rows: int | None = None) -> DataFrame:
    """M2: grow the multiway gain-ratio tree; returns the node table.

    ``rows``: ``(id, label)``; ``nz``: ``(id, term, tf)`` with ``tf > 0``.
    Node table: ``node_id, parent_id, split_value, depth, feature, class, majority, n, is_leaf``.
    Stops on a pure node, on ``max_depth``, or when the best gain ratio is zero (|.| < 1e-12).

    Rows carry a compact 64-bit node key (a hash of the parent key and the branch value) and their
    count of non-zeros; node paths live only in the per-level node table, so the row payload of
    every shuffle stays the same however deep the tree grows. A node whose sparse size (non-zeros
    plus rows) is at most ``local_cells`` is finished inside one task (``applyInArrow`` per node,
    a checked bound); larger nodes split by distributed jobs. ``local_cells=0`` keeps everything
    distributed.

    A large node whose best terms are in few rows is peeled: its counts and the rows (at most ``peel_rows``) that have
    its best terms go to one task, which splits the node again and again along its zero branch
    (:mod:`textlab.operators.chains`), so a chain of hundreds of levels takes a few passes. Other large nodes split once
    per pass.

    Rows are packed, one row an id, hash-partitioned by ``id`` and kept (memory, spilling to disk; rebuilt from lineage if
    an executor is lost), so every join with them shuffles only the rows' side. Where an id repeats they are not, and the
    smaller bounds hold (``local_cells``, ``peel_rows``: None for the bounds of this module).
    """
    from pyspark import StorageLevel
    spark, cached = rows.sparkSession, False
    terms = CH.vocabulary(rows, nz) if checkpoint else None
    if terms is None:
        packed, loose, row_nnz = None, nz, nz.groupBy("id").agg(F.count(F.lit(1)).alias("row_nnz"))
        local_cells = LOOSE_CELLS if local_cells is None else local_cells
        peel_rows = LOOSE_PEEL_ROWS if peel_rows is None else peel_rows
    else:
        packed = loose = CH.pack(nz, terms, "tf").persist(StorageLevel.MEMORY_AND_DISK)
        cached, row_nnz = True, packed.select("id", F.size("codes").alias("row_nnz"))
        nz = CH.unpack(packed).join(CH.numbers(spark, terms), "code").select("id", "term", F.col("val").cast("long").alias("tf"))
        local_cells = CH.LOCAL_CELLS if local_cells is None else local_cells
        peel_rows = CH.PEEL_ROWS if peel_rows is None else peel_rows
    assign = (rows.join(row_nnz, "id", "left")
                  .select("id", "label", F.coalesce("row_nnz", F.lit(0)).cast("long").alias("row_nnz"),
                          F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"),
                          F.lit(None).cast("long").alias("v")))
    folder = scratch_path(rows.sparkSession, "tree-nodes") if checkpoint else None

    def keep(part: DataFrame, name: str) -> None:
        """Adds nodes to the result: a folder of their own under the one that is read at the end, in one scan."""
        if folder is None:
            levels.append(part)
        else:
            part.write.parquet(f"{folder}/{name}")
            levels.append(f"{folder}/{name}")

    paths = None                       # (parent key -> parent path) of the nodes split at the previous level
    levels = []
    depth = 0
    while True:
        if checkpoint:
            assign = materialize(assign, f"tree-assign-{depth}")
        cnt = label_counts(assign)
        summ = node_summary(cnt)
        if paths is None:
            summ = summ.withColumns({"path": F.lit(""), "split_value": F.lit(None).cast("string"), "depth": F.lit(0)})
        else:
            summ = (summ.join(paths, "parent")
                        .withColumn("path", F.concat("ppath", F.lit("/"), padded(F.col("v"))))
                        .withColumn("split_value", F.col("v").cast("string"))
                        .withColumn("depth", F.col("pdepth") + 1).drop("ppath", "pdepth"))
        openable = F.col("n_labels") > 1
        if max_depth is not None:
            openable = openable & (F.col("depth") < max_depth)
        small = openable & ((F.col("nnz") + F.col("n")) <= F.lit(local_cells))
        summ = summ.withColumn("mode", F.when(small, "local").when(openable, "dist").otherwise("leaf"))
        if checkpoint:
            summ = materialize(summ, f"tree-summary-{depth}")
        stats = summ.groupBy("mode").agg(F.count(F.lit(1)), F.count_if("collision")).collect()   # <= 3 rows
        if any(r[2] for r in stats):
            raise RuntimeError("two tree nodes share a 64-bit key; grow the tree again with another key seed")
        modes = {r[0]: r[1] for r in stats}
        if modes.get("local"):
            local_nodes = summ.filter(F.col("mode") == "local").select("node", "path", "split_value", "depth")
            if packed is not None:
                small = F.broadcast(local_nodes) if modes["local"] <= 100_000 else local_nodes
                keep(_finished(assign.join(small.select("node"), "node"), local_nodes, packed, terms, max_depth), f"local-{depth}")
        if modes.get("local") and packed is None:
            ra = assign.join(F.broadcast(local_nodes) if modes["local"] <= 100_000 else local_nodes, "node")
            base = ra.select("node", "path", "depth", "id", "label", "split_value", F.lit(None).cast("string").alias("term"),
                             F.lit(None).cast("long").alias("tf"))
            # path, split value and label travel once per row, not once per non-zero
            nzs = ra.join(nz, "id").select("node", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("depth"), "id",
                                           F.lit(None).cast("string").alias("label"),
                                           F.lit(None).cast("string").alias("split_value"), "term",
                                           F.col("tf").cast("long"))
            long = base.unionByName(nzs).withColumnRenamed("node", "gkey").withColumnRenamed("path", "node")
            md = max_depth
            sub = long.groupBy("gkey").applyInArrow(lambda t: _finish_local(t, md), NODE_SCHEMA)
            keep(sub, f"local-{depth}")
        split_nodes = None
        if modes.get("dist") and copartition and not cached:
            n_parts = int(nz.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            nz = loose = nz.repartition(n_parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
            cached = True
        peeled = None
        none = summ.limit(0).select("node", F.lit(None).cast("string").alias("feature"))
        if modes.get("dist"):
            dist_nodes = summ.filter(F.col("mode") == "dist").select("node")
            open_rows, best, chains = assign.join(dist_nodes, "node", "left_semi"), none, None
            if packed is not None and peel_rows:
                counts = materialize(CH.value_counts(open_rows, packed), f"tree-counts-{depth}")
                peeled, chains = _peel_pass(assign, packed, terms, cnt, summ, counts, max_depth, peel_rows, local_cells, depth)
                dist_nodes = dist_nodes.join(chains, "node", "left_anti")
                counts = (counts.join(dist_nodes, "node", "left_semi").join(CH.numbers(spark, terms), "code")
                          .select("node", "term", F.col("val").cast("long").alias("v"), "label", "c"))
            else:
                counts = value_counts(open_rows, nz)
                if checkpoint:
                    counts = materialize(counts, f"tree-counts-{depth}")
            if peeled is None or not dist_nodes.isEmpty():
                found = ratios_of(counts, cnt, summ)
                if checkpoint:
                    found = materialize(found, f"tree-ratios-{depth}")
                best = best_split(found)
                best = best.filter(F.abs(F.round("gain_ratio", TIE_DECIMALS)) >= GAIN_EPS).select("node", F.col("term").alias("feature"))
            if checkpoint and peel_rows and packed is None:
                peeled, chains = _peel_pass(assign, nz, cnt, summ, counts, found, best, max_depth, peel_rows, depth)
                best = best.join(chains, "node", "left_anti")
            if peeled is not None:
                keep(peeled.filter("kind = 'node'").select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]), f"peeled-{depth}")
                summ = summ.join(chains.withColumn("_chain", F.lit(True)), "node", "left").withColumn(
                    "mode", F.when(F.col("_chain"), "chain").otherwise(F.col("mode"))).drop("_chain")
        else:
            best = none
        if modes.get("dist") or modes.get("leaf"):
            level = (summ.filter(~F.col("mode").isin("local", "chain")).join(best, "node", "left")
                         .select("node", F.col("path").alias("node_id"),
                                 _parent_path(F.col("path")).alias("parent_id"),
                                 "split_value", "depth", "feature",
                                 F.when(F.col("feature").isNull(), F.col("majority")).alias("class"),
                                 "majority", "n", F.col("feature").isNull().alias("is_leaf")))
            if checkpoint:
                level = materialize(level, f"tree-level-{depth}")
            keep(level.drop("node"), f"level-{depth}")
            n_split = level.filter(~F.col("is_leaf")).count()
            if n_split:
                split_nodes = level.filter(~F.col("is_leaf")).select("node", "feature", "node_id", "depth")
        moved, above = [], []
        if split_nodes is not None:
            moved.append(assign.join(split_nodes.select("node", "feature"), "node")
                         .join(nz.withColumnRenamed("term", "feature"), ["id", "feature"], "left")
                         .select("id", "label", "row_nnz", F.col("node").alias("parent"),
                                 F.coalesce("tf", F.lit(0)).cast("long").alias("v")))
            above.append(split_nodes.select(F.col("node").alias("parent"), F.col("node_id").alias("ppath"), F.col("depth").alias("pdepth")))
        if peeled is not None:
            gone = peeled.filter("kind = 'row'").select("id", F.col("parent").alias("_to"), F.col("v").alias("_v"))
            rest = peeled.filter("kind = 'rest'").select(F.col("gkey").alias("node"), F.col("parent").alias("_rest"))
            both = assign.drop("parent", "v").join(gone, "id", "left").join(rest, "node", "left")
            moved.append(both.filter("_to is not null or _rest is not null").select(
                "id", "label", "row_nnz", F.coalesce("_to", "_rest").alias("parent"), F.coalesce("_v", F.lit(0)).cast("long").alias("v")))
            above.append(peeled.filter("kind = 'node' and not is_leaf").select("parent", F.col("node_id").alias("ppath"), F.col("depth").alias("pdepth")))
        if not moved:
            break
        nxt, paths = moved[0], above[0]
        for x, y in zip(moved[1:], above[1:]):
            nxt, paths = nxt.unionByName(x), paths.unionByName(y)
        assign = nxt.withColumn("node", F.xxhash64("parent", "v"))
        depth += 1
    if checkpoint:
        if cached:                       # every level is a written table: the cached input can go
            loose.unpersist()
        return rows.sparkSession.read.parquet(*levels)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def predict_tree(nodes: DataFrame, rows: DataFrame, nz: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Route rows down a grown tree: ``rows(id)`` with non-zeros ``nz(id, term, tf)`` -> ``(id, predicted, node_id)``.

    One step per tree level, for the rows still moving: the row's value of the node's feature is its
    ``tf`` (0 when absent); a value with no branch stops the row at that node with the node's majority
    class (quirk Q13). Rows and edges use 64-bit keys of the node paths, so the row payload does not
    grow with depth; the state is written every step (lineage one step deep).
    """
    key = F.xxhash64("node_id")
    info = nodes.select(key.alias("node"), "node_id", "feature", "class", "majority", "is_leaf")
    edges = nodes.filter(F.col("parent_id").isNotNull()).select(
        F.xxhash64("parent_id").alias("node"), F.col("split_value").cast("long").alias("v"),
        key.alias("child"))
    state = rows.select("id", F.xxhash64(F.lit("")).alias("node"))
    done = []
    folder = scratch_path(rows.sparkSession, "tree-predicted") if checkpoint else None

    def keep(part: DataFrame, name: str) -> None:
        if folder is None:
            done.append(part)
        else:
            part.write.parquet(f"{folder}/{name}")
            done.append(f"{folder}/{name}")

    step = 0
    while True:
        if checkpoint:
            state = materialize(state, f"tree-route-{step}")
        if state.isEmpty():
            break
        cur = state.join(info, "node")
        keep(cur.filter("is_leaf").select("id", F.col("class").alias("predicted"), "node_id"), f"leaf-{step}")
        inner = cur.filter(~F.col("is_leaf"))
        moved = (inner.join(nz.withColumnRenamed("term", "feature"), ["id", "feature"], "left")
                      .select("id", "node", "node_id", "majority", F.coalesce("tf", F.lit(0)).cast("long").alias("v"))
                      .join(edges, ["node", "v"], "left"))
        if checkpoint:
            moved = materialize(moved, f"tree-moved-{step}")
        keep(moved.filter(F.col("child").isNull()).select("id", F.col("majority").alias("predicted"), "node_id"),
             f"stop-{step}")
        state = moved.filter(F.col("child").isNotNull()).select("id", F.col("child").alias("node"))
        step += 1
    if not done:
        return rows.select("id", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("string").alias("node_id")).limit(0)
    if checkpoint:
        return rows.sparkSession.read.parquet(*done)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def tree_rules_text(nodes: DataFrame) -> DataFrame:
    """M5: the tree as indented text lines; sort by ``(node_id, line_kind)`` to read it in order.

    Each child contributes its condition line (first child of a parent: ``JIKA``, others
    ``JIKA TIDAK, JIKA``) and each leaf its class line one level deeper.
    """
    parent = nodes.select(F.col("node_id").alias("parent_id"), F.col("feature").alias("pfeature"))
    kids = nodes.filter(F.col("parent_id").isNotNull()).join(parent, "parent_id")
    w = Window.partitionBy("parent_id").orderBy("node_id")
    kids = kids.withColumn("_k", F.row_number().over(w))
    kw = F.when(F.col("_k") == 1, F.lit(S.RULE_TEXT_IF)).otherwise(F.lit(S.TREE_TEXT_ELSE_IF))
    cond = kids.select("node_id", F.lit(0).alias("line_kind"),
                       F.concat(F.repeat(F.lit(S.TREE_INDENT), F.col("depth") - 1), kw, F.lit(" '"), F.col("pfeature"),
                                F.lit("' = '"), F.col("split_value"), F.lit("'")).alias("line"))
    leaves = nodes.filter("is_leaf").select(
        "node_id", F.lit(1).alias("line_kind"),
        F.concat(F.repeat(F.lit(S.TREE_INDENT), F.col("depth")), F.lit(S.TREE_TEXT_CLASS + " "), F.col("class")).alias("line"))
    return cond.unionByName(leaves)


def tree_edges(nodes: DataFrame) -> DataFrame:
    """M6: DOT-style edges parent -> child labelled ``= 'v'``; node labels are the feature or the class."""
    lab = F.when(F.col("is_leaf"), F.concat(F.lit("Sentimen = "), F.col("class"))).otherwise(F.col("feature"))
    n = nodes.select("node_id", "parent_id", "split_value", lab.alias("label"))
    p = nodes.select(F.col("node_id").alias("parent_id"), F.col("feature").alias("parent_label"))
    return (n.filter(F.col("parent_id").isNotNull()).join(p, "parent_id")
             .select("parent_id", F.col("node_id").alias("child_id"),
                     F.concat(F.lit("= '"), F.col("split_value"), F.lit("'")).alias("edge_label"),
                     "parent_label", F.col("label").alias("child_label")))


def tree_shape(nodes: DataFrame) -> DataFrame:
    """M7: depth and leaf count."""
    return nodes.agg(F.max("depth").alias("depth"), F.count_if(F.col("is_leaf")).alias("n_leaves"),
                     F.count(F.lit(1)).alias("n_nodes"))
