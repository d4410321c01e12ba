"""Binary decision tree over term counts or weights (M1) without a depth limit, grown level by level as DataFrame jobs.

The training matrix stays long and sparse: ``rows(id, label)`` and non-zeros ``nz(id, term, value)``, values above 0. Per
open node one histogram job counts the classes per (term, value); cumulating a term's values from the largest down gives
the right side of every threshold, and the node's class counts minus it the left side, so zeros are never written
out. A threshold lies half-way between neighbouring values. The best one has the least weighted impurity; ties go to
the alphabetically first term, then to the smaller threshold. Nodes split until they are pure, have too few rows,
have no threshold, or reach ``max_depth`` (None: no limit).

A node whose non-zeros and rows are at most ``local_cells`` is finished inside one task, many such nodes side by side;
larger ones are split by the jobs. Levels are written to the shared folder, so a lost executor costs one level.

Where no id repeats, rows are packed (:mod:`textlab.operators.chains`), and a large node is split in a task again and
again along its lower side, while the rows above the thresholds are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators import chains as CH
from textlab.operators.node_cells import NodeCells, codes
from textlab.sources.scratch import materialize, scratch_path

TIE_DECIMALS = 12
MAX_CLASSES = 256
#: A tree with at most so many nodes is sent to the tasks that predict with it; a larger one is joined, a level a step.
SHARED_NODES = 500_000

NODES = ("node_id string, parent_id string, depth int, feature string, threshold double, class string, majority string, "
         "n long, is_leaf boolean")


def _cost(left: list[Column], right: list[Column], criterion: str) -> Column:
    """Impurity of both sides weighted by their share of the rows, to ``TIE_DECIMALS`` places."""
    def side(counts: list[Column]) -> tuple[Column, Column]:
        n = sum(counts[1:], counts[0])
        if criterion == "entropy":
            terms = [F.when(c > 0, c * F.log2(c / n)).otherwise(0.0) for c in counts]
            return n, -sum(terms[1:], terms[0])
        squares = [c * c for c in counts]
        return n, n - sum(squares[1:], squares[0]) / n

    (a, x), (b, y) = side(left), side(right)
    return F.round((x + y) / (a + b), TIE_DECIMALS)


def thresholds(assign: DataFrame, nz: DataFrame, summary: DataFrame, classes: int, criterion: str = "gini",
               min_leaf: int = 1) -> DataFrame:
    """(node, term, threshold, cost) of every threshold of every node in ``summary`` (node, c0, c1, ...).

    ``assign``: (id, node, y) with y the class number; thresholds with fewer than ``min_leaf`` rows on a side are left out.
    """
    each = [F.count_if(F.col("y") == k).alias(f"r{k}") for k in range(classes)]
    # a hash table of the rows, which are few beside their non-zeros: these need no sort
    hist = assign.hint("shuffle_hash").join(nz, "id").groupBy("node", "term", "value").agg(*each)
    down = Window.partitionBy("node", "term").orderBy(F.desc("value"))       # the distinct values of one term in one node
    run = hist.select("node", "term", "value", F.lead("value").over(down).alias("below"),
                      *[F.sum(f"r{k}").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias(f"r{k}") for k in range(classes)])
    both = run.join(summary.select("node", *[f"c{k}" for k in range(classes)]), "node")
    right = [F.col(f"r{k}") for k in range(classes)]
    left = [F.col(f"c{k}") - F.col(f"r{k}") for k in range(classes)]
    enough = (sum(right[1:], right[0]) >= min_leaf) & (sum(left[1:], left[0]) >= min_leaf)
    return both.filter(enough).select("node", "term", ((F.col("value") + F.coalesce("below", F.lit(0.0))) / 2).alias("threshold"),
                                      _cost(left, right, criterion).alias("cost"))


def best_thresholds(found: DataFrame) -> DataFrame:
    """(node, feature, threshold): the least cost of each node; a partial aggregate, not a ranking."""
    return (found.groupBy("node").agg(F.min(F.struct("cost", "term", "threshold")).alias("b"))
            .select("node", F.col("b.term").alias("feature"), F.col("b.threshold").alias("threshold")))


def step(assign: DataFrame, best: DataFrame, nz: DataFrame) -> DataFrame:
    """(id, y, row_nnz, parent, side, node): the rows of ``assign`` one level down, by the ``best`` threshold of their node.

    Of the matrix only cells of the terms that split a node of this level are moved to the rows, not all of it a level.
    """
    split = best.withColumnRenamed("feature", "term")
    asked = nz.join(split.select("term"), "term", "left_semi")
    side = (F.coalesce("value", F.lit(0.0)) > F.col("threshold")).cast("int")
    return (assign.join(split, "node").join(asked, ["id", "term"], "left")
            .select("id", "y", "row_nnz", F.col("node").alias("parent"), side.alias("side"))
            .withColumn("node", F.xxhash64("parent", "side")))


def _grow_small(table: pa.Table, classes: list[str], criterion: str, max_depth: int | None, min_split: int,
                min_leaf: int) -> pa.Table:
    """The subtree of one small node whose rows are not packed: its rows have no term, the others are its non-zeros."""
    is_row = pc.is_null(table["term"])
    head = table.filter(is_row).select(["id", "y", "path", "depth"]).to_pandas().sort_values("id")
    ids, y = head["id"].to_numpy(), head["y"].to_numpy(np.int64)
    path0, depth0, k = head["path"].iloc[0], int(head["depth"].iloc[0]), len(classes)
    body = table.filter(pc.invert(is_row))
    terms, t = codes(body["term"])
    cells = NodeCells(y, k, np.searchsorted(ids, body["id"].to_numpy()), t, body["value"].to_numpy().astype(float))
    return _subtree(path0, depth0, y, cells, terms, classes, criterion, max_depth, min_split, min_leaf)


def _grow_packed(batches: Iterator[pa.RecordBatch], names: list[str], classes: list[str], *limits) -> pa.Table:
    """The subtree of one small node from its packed rows and one row with its path and depth."""
    (head, *_), rows, cells = CH.gather(batches, classes)
    return _subtree(head["path"], head["depth"], rows["y"], cells, names, classes, *limits)


def _costs(gt: np.ndarray, c: np.ndarray, counts: np.ndarray, criterion: str, min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per (term, value) that occurs, sorted, with its counts ``c``: (cost of the threshold below it, inf for none; rows above it)."""
    c = c.astype(float)
    upto = np.cumsum(c, axis=0)
    last = np.searchsorted(gt, gt, "right") - 1
    right = upto[last] - upto + c
    left = counts - right
    a, b = left.sum(axis=1), right.sum(axis=1)
    ok = (a >= max(1, min_leaf)) & (b >= min_leaf)
    a1, b1 = np.maximum(a, 1), np.maximum(b, 1)
    if criterion == "entropy":
        def bits(x, n):
            return -np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / n[:, None]), 0).sum(axis=1)
        cost = bits(left, a1) + bits(right, b1)
    else:
        cost = a - (left ** 2).sum(axis=1) / a1 + b - (right ** 2).sum(axis=1) / b1
    return np.where(ok, np.round(cost / counts.sum(), TIE_DECIMALS), np.inf), b


def _half_way(gt: np.ndarray, gv: np.ndarray, g: int) -> float:
    """The threshold between the value of group ``g`` and the one below it, 0 for a term's first."""
    return float((gv[g] + (gv[g - 1] if g > 0 and gt[g - 1] == gt[g] else 0.0)) / 2)


def _chain_rule(now: CH.Counts, depth: int, criterion: str, max_depth: int | None, min_split: int, min_leaf: int):
    """:data:`textlab.operators.chains.Rule` of the thresholds: the rows above one leave the lower side."""
    counts = now.cnt.astype(float)
    if (counts > 0).sum() < 2 or counts.sum() < min_split or (max_depth is not None and depth >= max_depth) or not len(now.terms):
        return None
    cost, above = _costs(now.gt, now.m, counts, criterion, min_leaf)
    least = np.minimum.reduceat(cost, now.first)
    equal = np.flatnonzero(cost == least[now.term_at])[::-1]
    first = np.zeros(len(now.terms), np.int64)
    first[now.term_at[equal]] = equal                               # of equal ones the smallest threshold
    return least, above[first], first


def _chains(assign: DataFrame, packed: DataFrame, terms: list[str], classes: list[str], large: DataFrame, budget: int, local_cells: int,
            turn: int, limits: tuple) -> DataFrame:
    """What :func:`textlab.operators.chains.split_chains` gives for the large nodes of a level."""
    def rule(now, depth):
        return _chain_rule(now, depth, *limits)

    def branch(now, path, j, g):
        return _half_way(now.gt, now.gv, g), 1, f"{path}0", None

    def run(batches):
        return CH.split_chain(batches, rule, terms, budget, local_cells, branch, True)

    own = assign.join(large.select("node"), "node", "left_semi").select("node", "id", _named(classes))
    counts = materialize(CH.value_counts(own, packed), f"threshold-counts-{turn}")
    heads = large.select("node", "path", F.lit(None).cast("string").alias("split_value"), F.length("path").alias("depth"),
                         F.array(*[F.lit(c) for c in classes]).alias("classes"),
                         F.array(*[F.col(f"c{c}") for c in range(len(classes))]).alias("cnt"))
    return CH.split_chains(own, packed, counts, heads, run, True, f"threshold-chains-{turn}")


def _named(classes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("y") + 1).alias("label")


def _subtree(path0: str, depth0: int, y: np.ndarray, cells: NodeCells, terms, classes: list[str], criterion: str, max_depth: int | None,
             min_split: int, min_leaf: int) -> pa.Table:
    """The subtree of one node, by the same rules as the level job."""
    k = len(classes)

    def best(rows: np.ndarray, counts: np.ndarray, whole: np.ndarray | None):
        groups, c = cells.present(rows, whole)
        if not len(groups):
            return None
        gt = cells.gt[groups]
        cost, _ = _costs(gt, c, counts, criterion, min_leaf)
        g = int(np.argmin(cost))
        return (int(gt[g]), _half_way(gt, cells.gv[groups], g)) if np.isfinite(cost[g]) else None

    every = np.arange(len(y))
    out, todo = [], [(path0, depth0, every, cells.children([every], None)[0])]
    while todo:
        path, depth, rows, whole = todo.pop()
        counts = np.bincount(y[rows], minlength=k).astype(float)
        majority, parent = classes[int(np.argmax(counts))], (path[:-1] if path else None)
        split = None
        if (counts > 0).sum() > 1 and len(rows) >= min_split and (max_depth is None or depth < max_depth):
            split = best(rows, counts, whole)
        if split is None:
            out.append((path, parent, depth, None, None, majority, majority, len(rows), True))
            continue
        term, limit = split
        out.append((path, parent, depth, terms[term], limit, None, majority, len(rows), False))
        a, b = np.searchsorted(cells.gt, [term, term + 1]).tolist()
        over = np.zeros(len(rows), bool)
        over[cells.rows_of(rows, a + int(np.searchsorted(cells.gv[a:b], limit, "right")), b)[0]] = True
        parts = [rows[~over], rows[over]]
        for side, part, own in zip("01", parts, cells.children(parts, whole)):
            todo.append((path + side, depth + 1, part, own))
    kinds = {"depth": pa.int32(), "threshold": pa.float64(), "n": pa.int64(), "is_leaf": pa.bool_()}
    names = [c.split()[0] for c in NODES.split(", ")]
    return pa.Table.from_pandas(pd.DataFrame(out, columns=names), preserve_index=False,
                                schema=pa.schema([(c, kinds.get(c, pa.string())) for c in names]))


def grow(rows: DataFrame, nz: DataFrame, criterion: str = "gini", max_depth: int | None = None, min_samples_split: int = 2,
         min_samples_leaf: int = 1, local_cells: int = 200_000, peel_rows: int = 0) -> DataFrame:
    """M1: the node table (``NODES``) of the tree; an id is its path, ``0`` for values up to the threshold and ``1`` above.

    ``rows``: (id, label); ``nz``: (id, term, value), value above 0. Rows carry a 64-bit node key, paths live in the
    node tables only. Rows without a non-zero count with zeros; a null label or an empty table gives no node.

    ``peel_rows``: where no id repeats, rows of a large node that a task gets in one pass to split it along its lower side,
    and ``textlab.operators.chains.LOCAL_CELLS`` replaces ``local_cells`` if that is less. 0: large nodes split once a level.
    """
    if criterion not in ("gini", "entropy"):
        raise ValueError(f"criterion {criterion}")
    spark = rows.sparkSession
    labels = [r[0] for r in rows.select("label").filter("label is not null").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    classes, folder, parts = sorted(labels), scratch_path(spark, "threshold-tree"), []
    if not classes:
        return spark.createDataFrame([], NODES)
    number = F.coalesce(*[F.when(F.col("label") == c, F.lit(k)) for k, c in enumerate(classes)])
    nz = nz.select("id", "term", F.col("value").cast("double").alias("value")).filter("value > 0")
    names = CH.vocabulary(rows.filter("label is not null"), nz) if peel_rows else None
    if names is None:
        packed, nnz = None, nz.groupBy("id").agg(F.count(F.lit(1)).alias("row_nnz"))
    else:
        packed, local_cells = CH.pack(nz, names, "value").persist(StorageLevel.MEMORY_AND_DISK), max(local_cells, CH.LOCAL_CELLS)
        nnz = packed.select("id", F.size("codes").cast("long").alias("row_nnz"))
    root = F.lit(0).cast("long")
    assign = (rows.filter("label is not null").join(nnz, "id", "left")
              .select("id", number.alias("y"), F.coalesce("row_nnz", F.lit(0)).alias("row_nnz"), root.alias("node"),
                      F.lit(None).cast("long").alias("parent"), F.lit(None).cast("int").alias("side")))
    # partitioned by id once: every level's joins shuffle the rows' side only
    if packed is None:
        nz = loose = nz.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").persist(StorageLevel.MEMORY_AND_DISK)
    else:
        loose, nz = packed, CH.unpack(packed).join(CH.numbers(spark, names), "code").select("id", "term", F.col("val").alias("value"))
    k, turn, paths = len(classes), 0, None
    each = [F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(k)]
    counts = [F.col(f"c{c}") for c in range(k)]
    most = F.greatest(*counts, F.lit(0))
    majority = F.coalesce(*[F.when(F.col(f"c{c}") == most, F.lit(name)) for c, name in enumerate(classes)])

    up = F.when(F.length("path") > 0, F.expr("substring(path, 1, length(path) - 1)"))
    limits = (criterion, max_depth, min_samples_split, min_samples_leaf)

    def finish(table: pa.Table) -> pa.Table:
        return _grow_small(table, classes, *limits)

    def finish_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grow_packed(batches, names, classes, *limits).to_batches()

    while True:
        assign = materialize(assign, f"threshold-rows-{turn}")
        one = assign.groupBy("node").agg(*each, F.count(F.lit(1)).alias("n"), F.sum("row_nnz").alias("nnz"),
                                         F.min(F.struct("parent", "side")).alias("lo"), F.max(F.struct("parent", "side")).alias("hi"))
        one = one.withColumns({"majority": majority, "collision": F.col("lo") != F.col("hi"),
                               "parent": F.col("lo.parent"), "side": F.col("lo.side")})
        if paths is None:
            one = one.withColumn("path", F.lit(""))
        else:
            one = one.join(paths, "parent").withColumn("path", F.concat("ppath", F.col("side").cast("string")))
        mixed = sum([(c > 0).cast("int") for c in counts[1:]], (counts[0] > 0).cast("int")) > 1
        may = mixed & (F.col("n") >= min_samples_split) & (F.lit(max_depth is None) | (F.length("path") < (max_depth or 0)))
        kind = F.when(~may, "leaf").when(F.col("nnz") + F.col("n") <= local_cells, "small").otherwise("large")
        summary = materialize(one.withColumn("kind", kind), f"threshold-nodes-{turn}")
        seen = {r["kind"]: r for r in summary.groupBy("kind").agg(F.count_if("collision").alias("bad")).collect()}   # 3 rows
        if any(r["bad"] for r in seen.values()):
            raise RuntimeError("two tree nodes share a 64-bit key")
        leaf = summary.filter("kind = 'leaf'").select("node", F.lit(None).cast("string").alias("feature"),
                                                      F.lit(None).cast("double").alias("threshold"))
        if "small" in seen and packed is not None:
            small = summary.filter("kind = 'small'")
            own = assign.join(small.select("node"), "node").select("node", "id", _named(classes))
            head = small.select("node", "path", F.length("path").alias("depth"))
            (own.hint("shuffle_hash").join(packed, "id", "left").unionByName(head, allowMissingColumns=True).groupBy("node")
             .applyInArrow(finish_packed, NODES).write.parquet(f"{folder}/small-{turn}"))
            parts.append(f"{folder}/small-{turn}")
        elif "small" in seen:
            own = assign.join(summary.filter("kind = 'small'").select("node", "path"), "node")
            base = own.select("node", "path", "id", "y", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("value"))
            cells = own.join(nz, "id").select("node", F.lit(None).cast("string").alias("path"), "id", F.lit(None).cast("int").alias("y"),
                                              "term", "value")
            (base.unionByName(cells).withColumn("depth", F.length("path")).groupBy("node")
             .applyInArrow(finish, NODES).write.parquet(f"{folder}/small-{turn}"))
            parts.append(f"{folder}/small-{turn}")
        best, chained, moved, above = leaf.limit(0), None, [], []
        by_level = summary.filter("kind <> 'small'")
        if "large" in seen:
            large = summary.filter("kind = 'large'")
            if packed is not None:
                chained = _chains(assign, packed, names, classes, large, peel_rows, local_cells, turn, limits)
                chains = chained.select(F.col("gkey").alias("node")).distinct()
                large, by_level = large.join(chains, "node", "left_anti"), by_level.join(chains, "node", "left_anti")
                chained.filter("kind = 'node'").withColumns({"node_id": F.col("path"), "parent_id": up}).select(
                    *[c.split()[0] for c in NODES.split(", ")]).write.parquet(f"{folder}/chains-{turn}")
                parts.append(f"{folder}/chains-{turn}")
            if chained is None or not large.isEmpty():
                best = materialize(best_thresholds(thresholds(assign.join(large.select("node"), "node", "left_semi"), nz, large, k,
                                                              criterion, min_samples_leaf)), f"threshold-best-{turn}")
        level = by_level.join(best, "node", "left").select(
            F.col("path").alias("node_id"), up.alias("parent_id"), F.length("path").alias("depth"), "feature", "threshold",
            F.when(F.col("feature").isNull(), F.col("majority")).alias("class"), "majority", "n", F.col("feature").isNull().alias("is_leaf"))
        level.write.parquet(f"{folder}/level-{turn}")
        parts.append(f"{folder}/level-{turn}")
        if not best.isEmpty():
            moved.append(step(assign, best, nz))
            above.append(summary.join(best.select("node"), "node", "left_semi").select(F.col("node").alias("parent"), F.col("path").alias("ppath")))
        if chained is not None:
            gone = chained.filter("kind = 'row'").select("id", F.col("parent").alias("_to"), F.col("v").cast("int").alias("_side"))
            rest = chained.filter("kind = 'rest'").select(F.col("gkey").alias("node"), F.col("parent").alias("_rest"))
            both = assign.drop("parent", "side").join(gone, "id", "left").join(rest, "node", "left").filter("_to is not null or _rest is not null")
            moved.append(both.select("id", "y", "row_nnz", F.coalesce("_to", "_rest").alias("parent"), F.coalesce("_side", F.lit(0)).alias("side"))
                         .withColumn("node", F.xxhash64("parent", "side")))
            above.append(chained.filter("kind = 'node' and not is_leaf").select("parent", F.col("path").alias("ppath")))
        if not moved:
            break
        assign, paths = moved[0], above[0]
        for x, y in zip(moved[1:], above[1:]):
            assign, paths = assign.unionByName(x), paths.unionByName(y)
        turn += 1
    loose.unpersist()
    return spark.read.schema(NODES).parquet(*parts)


def _routes(table: pd.DataFrame):
    """Per row of (id, cells): the class and id of the leaf it reaches; ``table`` is the whole tree, of checked size."""
    at = {p: k for k, p in enumerate(table["node_id"])}
    feature, limit, leaf = table["feature"].tolist(), table["threshold"].tolist(), table["is_leaf"].tolist()
    down = [(at.get(f"{p}0"), at.get(f"{p}1")) for p in table["node_id"]]
    names, found, root = table["class"].tolist(), table["node_id"].tolist(), at[""]

    def run(batches):
        for pdf in batches:
            out = []
            for cells in pdf["cells"]:
                own = {} if cells is None else {c["term"]: c["value"] for c in cells}
                k = root
                while not leaf[k]:
                    k = down[k][own.get(feature[k], 0.0) > limit[k]]
                out.append(k)
            yield pd.DataFrame({"id": pdf["id"], "predicted": [names[k] for k in out], "node_id": [found[k] for k in out]})

    return run


def predict(nodes: DataFrame, rows: DataFrame, nz: DataFrame) -> DataFrame:
    """(id, predicted, node_id) of ``rows(id)`` with non-zeros ``nz(id, term, value)``.

    A tree of at most ``SHARED_NODES`` nodes goes to the tasks, and a row walks it in one pass whatever the depth;
    a larger tree is joined to the rows level by level.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, predicted string, node_id string"
    if nodes.isEmpty():
        return rows.select("id", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("string").alias("node_id"))
    nz = nz.select("id", "term", F.col("value").cast("double").alias("value"))
    used = nodes.filter(~F.col("is_leaf")).select(F.col("feature").alias("term")).distinct()
    nz = nz.join(used, "term", "left_semi")
    if nodes.count() <= SHARED_NODES:
        cells = nz.groupBy("id").agg(F.collect_list(F.struct("term", "value")).alias("cells"))    # a row's own non-zeros
        table = nodes.select("node_id", "feature", "threshold", "is_leaf", "class").toPandas()
        return rows.select("id").join(cells, "id", "left").mapInPandas(_routes(table), schema)
    done, state = [], materialize(rows.select("id", F.lit("").alias("node_id")), "threshold-route")
    while not state.isEmpty():
        now = state.join(nodes, "node_id")
        done.append(materialize(now.filter("is_leaf").select("id", F.col("class").alias("predicted"), "node_id"), "threshold-done"))
        moved = now.filter(~F.col("is_leaf")).select("id", "node_id", F.col("feature").alias("term"), "threshold").join(nz, ["id", "term"], "left")
        over = (F.coalesce("value", F.lit(0.0)) > F.col("threshold")).cast("int").cast("string")
        state = materialize(moved.select("id", F.concat("node_id", over).alias("node_id")), "threshold-route")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``number``, the place in pre-order from 0 (left before right), without a window over all nodes.

    Nodes are sorted by path in ranges; a node's number is its place in its range plus the sizes of the ranges before.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = materialize(nodes.repartitionByRange(parts, "node_id").sortWithinPartitions("node_id")
                          .withColumn("range", F.spark_partition_id()), "threshold-sorted")
    sizes = sorted_.groupBy("range").count().collect()                        # a row a range
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        before[r["range"]], total = total, total + r["count"]
    first = spark.createDataFrame(list(before.items()) or [(0, 0)], "range int, first long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("node_id")) - 1
    return sorted_.withColumn("place", place).join(F.broadcast(first), "range").select(
        *nodes.columns, (F.col("first") + F.col("place")).alias("number"))


def rule_lines(nodes: DataFrame, indent: str = "|   ") -> DataFrame:
    """(line_no, line): the tree as text, a condition line for every node but the root and a class line for every leaf."""
    n = numbered(nodes)
    up = n.select(F.col("node_id").alias("parent_id"), F.col("feature").alias("f"), F.col("threshold").alias("t"))
    sign = F.when(F.col("node_id").endswith("1"), F.lit(">")).otherwise(F.lit("<="))
    cond = n.join(up, "parent_id").select("number", F.lit(0).alias("part"), F.concat(
        F.repeat(F.lit(indent), F.col("depth") - 1), F.lit("|--- "), "f", F.lit(" "), sign, F.lit(" "), F.format_string("%.2f", "t")).alias("line"))
    leaf = n.filter("is_leaf").select("number", F.lit(1).alias("part"), F.concat(
        F.repeat(F.lit(indent), F.col("depth")), F.lit("|--- class: "), "class").alias("line"))
    lines = cond.unionByName(leaf)
    # lines before a node's: one condition a node but the root, one class a leaf
    order = numbered(lines.select(F.concat(F.lpad(F.col("number").cast("string"), 18, "0"), F.col("part").cast("string")).alias("node_id"), "line"))
    return order.select((F.col("number") + 1).alias("line_no"), "line")


def dot_lines(nodes: DataFrame) -> DataFrame:
    """(line_no, line): the tree in DOT, nodes by pre-order number, edges after the nodes, the frame around them."""
    n = numbered(nodes)
    text = F.when(F.col("is_leaf"), F.concat(F.lit("class = "), "class")).otherwise(
        F.concat("feature", F.lit(" <= "), F.format_string("%.2f", "threshold")))
    node = n.select(F.col("number").alias("at"), F.lit(1).alias("part"),
                    F.concat(F.col("number").cast("string"), F.lit(' [label="'), text, F.lit("\\nsamples = "), F.col("n").cast("string"), F.lit('"] ;')).alias("line"))
    up = n.select(F.col("node_id").alias("parent_id"), F.col("number").alias("p"))
    edge = n.join(up, "parent_id").select(F.col("number").alias("at"), F.lit(2).alias("part"), F.concat(
        F.col("p").cast("string"), F.lit(" -> "), F.col("number").cast("string"), F.lit(" ;")).alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, 0, "digraph Tree {"), (0, 3, "}")], "at long, part int, line string")
    lines = frame.unionByName(node).unionByName(edge)
    order = numbered(lines.select(F.concat(F.col("part").cast("string"), F.lpad(F.col("at").cast("string"), 18, "0")).alias("node_id"), "line"))
    return order.select((F.col("number") + 1).alias("line_no"), "line")
