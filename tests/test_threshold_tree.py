"""The binary tree equals a plain recursive one, without a depth limit, and its text is in order."""

from __future__ import annotations

import math
import random

import pytest

from textlab.operators import threshold_tree as T

TERMS = ("apa", "bagus", "cinta", "duka", "enak")


def impurity(labels: list, criterion: str) -> float:
    shares = [labels.count(x) / len(labels) for x in sorted(set(labels))]
    return -sum(p * math.log2(p) for p in shares) if criterion == "entropy" else 1 - sum(p * p for p in shares)


def plain(rows, criterion="gini", max_depth=None, min_split=2, min_leaf=1, path="", out=None):
    """rows: (label, {term: value})."""
    out = [] if out is None else out
    labels = [r[0] for r in rows]
    majority = min(set(labels), key=lambda x: (-labels.count(x), x))
    best = None
    if len(set(labels)) > 1 and len(rows) >= min_split and (max_depth is None or len(path) < max_depth):
        for t in sorted({t for _, c in rows for t in c}):
            values = sorted({r[1].get(t, 0) for r in rows})
            for low, high in zip(values, values[1:]):
                a, b = [r[0] for r in rows if r[1].get(t, 0) <= low], [r[0] for r in rows if r[1].get(t, 0) > low]
                if min(len(a), len(b)) >= min_leaf:
                    cost = round((len(a) * impurity(a, criterion) + len(b) * impurity(b, criterion)) / len(rows), 12)
                    best = min(best or (9, "", 0), (cost, t, (low + high) / 2))
    if best is None:
        out.append((path, len(path), None, None, majority, len(rows)))
        return out
    _, t, x = best
    out.append((path, len(path), t, x, None, len(rows)))
    for side in (0, 1):
        plain([r for r in rows if (r[1].get(t, 0) > x) == bool(side)], criterion, max_depth, min_split, min_leaf, f"{path}{side}", out)
    return out


def tables(spark, rows):
    a = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "id long, label string")
    cells = [(k, t, float(v)) for k, r in enumerate(rows) for t, v in r[1].items() if v]
    return a, spark.createDataFrame(cells, "id long, term string, value double")


def found(nodes):
    return sorted((r.node_id, r.depth, r.feature, r.threshold, r["class"], r.n) for r in nodes.collect())


def fixture(n=70, seed=4):
    rnd = random.Random(seed)
    return [(rnd.choice("abc"), {t: rnd.choice([0, 0, 1, 1, 2, 5]) for t in TERMS if rnd.random() < 0.7}) for _ in range(n)]


@pytest.mark.parametrize("criterion,limits", [("gini", {}), ("entropy", {"min_split": 6, "min_leaf": 2})])
def test_small_nodes_equal_a_plain_tree(spark, criterion, limits):
    rows = fixture()
    a, nz = tables(spark, rows)
    got = T.grow(a, nz, criterion, min_samples_split=limits.get("min_split", 2), min_samples_leaf=limits.get("min_leaf", 1))
    want = sorted(plain(rows, criterion, **limits))
    assert found(got) == want


@pytest.mark.parametrize("criterion,cells", [("gini", 0), ("entropy", 60)])
def test_levels_equal_a_plain_tree(spark, criterion, cells):
    rows = fixture(40, 8)
    a, nz = tables(spark, rows)
    depth = 3 if cells == 0 else None
    got = T.grow(a, nz, criterion, max_depth=depth, local_cells=cells)
    assert found(got) == sorted(plain(rows, criterion, max_depth=depth))


def test_no_depth_limit_predictions_and_text(spark, monkeypatch):
    rows = [("ab"[k % 2], {"x": k + 1}) for k in range(44)]               # every split peels one row
    a, nz = tables(spark, rows)
    nodes = T.grow(a, nz)
    assert max(r.depth for r in nodes.collect()) > 30 and found(nodes) == sorted(plain(rows))
    got = {r.id: r.predicted for r in T.predict(nodes, a, nz).collect()}
    assert got == {k: r[0] for k, r in enumerate(rows)}
    small = T.grow(a, nz, max_depth=2)
    whole = sorted((r.id, r.predicted, r.node_id) for r in T.predict(small, a, nz).collect())
    monkeypatch.setattr(T, "SHARED_NODES", 0)
    assert sorted((r.id, r.predicted, r.node_id) for r in T.predict(small, a, nz).collect()) == whole
    order = [r.node_id for r in sorted(T.numbered(nodes).collect(), key=lambda r: r.number)]
    assert order == [p[0] for p in plain(rows)]


def test_text_and_dot(spark):
    a, nz = tables(spark, [("a", {"x": 1}), ("a", {"x": 1}), ("b", {"x": 4}), ("c", {"x": 4, "y": 2}), ("c", {"y": 1, "x": 3})])
    nodes = T.grow(a, nz)
    lines = [r.line for r in sorted(T.rule_lines(nodes).collect(), key=lambda r: r.line_no)]
    assert lines == ["|--- x <= 2.00", "|   |--- class: a", "|--- x > 2.00", "|   |--- y <= 0.50", "|   |   |--- class: b",
                     "|   |--- y > 0.50", "|   |   |--- class: c"]
    dot = [r.line for r in sorted(T.dot_lines(nodes).collect(), key=lambda r: r.line_no)]
    assert dot == ["digraph Tree {", '0 [label="x <= 2.00\\nsamples = 5"] ;', '1 [label="class = a\\nsamples = 2"] ;',
                   '2 [label="y <= 0.50\\nsamples = 3"] ;', '3 [label="class = b\\nsamples = 1"] ;', '4 [label="class = c\\nsamples = 2"] ;',
                   "0 -> 1 ;", "0 -> 2 ;", "2 -> 3 ;", "2 -> 4 ;", "}"]


def test_edges(spark):
    none = spark.createDataFrame([], "id long, term string, value double")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id long, label string")
    assert found(T.grow(rows, none, local_cells=0)) == [("", 0, None, None, "b", 3)]
    empty = T.grow(rows.limit(0), none)
    assert empty.count() == 0 and T.predict(empty, rows.select("id"), none).count() == 4
    assert T.rule_lines(T.grow(rows, none)).collect()[0].line == "|--- class: b"
    with pytest.raises(ValueError):
        T.grow(rows, none, criterion="other")


def test_a_level_moves_the_cells_of_its_own_terms_alone(spark):
    """the rows' way down a level, with a term a node; the other terms' cells stay where they are."""
    rnd = random.Random(11)
    rows = [(rnd.choice("ab"), {t: rnd.choice([1, 2, 5]) for t in TERMS if rnd.random() < 0.6}) for _ in range(40)]
    a, nz = tables(spark, rows)
    assign = a.selectExpr("id", "0 as y", "0L as row_nnz", "id % 2 as node", "cast(null as long) as parent", "cast(null as int) as side")
    best = spark.createDataFrame([(0, "cinta", 1.5), (1, "enak", 0.5)], "node long, feature string, threshold double")
    moved = T.step(assign, best, nz)
    assert "LeftSemi" in moved._jdf.queryExecution().optimizedPlan().toString()
    limit = {0: ("cinta", 1.5), 1: ("enak", 0.5)}
    assert {(r.id, r.parent): r.side for r in moved.collect()} == {
        (k, k % 2): int(r[1].get(limit[k % 2][0], 0) > limit[k % 2][1]) for k, r in enumerate(rows)}


def test_terms_are_counted_in_the_row_without_a_comparing_lambda(spark):
    """an interpreted comparison a pair of tokens took about a fifth of the time of the tree's terms."""
    from collections import Counter

    from textlab.operators.features import doc_terms
    texts = [(1, "dua dua satu tiga dua"), (1, "dua"), (2, None), (3, ""), (4, "a b"), (None, "satu satu"), (5, "é" * 3 + " zz " * 3000)]
    got = doc_terms(spark.createDataFrame(texts, "id long, t string"), "id", "t")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
    want = Counter((i, w, n) for i, t in texts for w, n in Counter(w for w in (t or "").split() if len(w) > 1).items())
    assert Counter((r.id, r.term, r.tf) for r in got.collect()) == want
