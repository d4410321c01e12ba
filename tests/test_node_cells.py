"""A node's counts: by its own cells, and the largest child's by subtraction; term counts are made once, where the texts are spread."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textlab.functions.text import clean_text
from textlab.operators import features as FE
from textlab.operators.node_cells import NodeCells


def _matrix(n, terms, k, seed):
    rng = np.random.default_rng(seed)
    dense = rng.integers(0, 4, (n, terms)) * (rng.random((n, terms)) < 0.5)
    row, term = np.nonzero(dense)
    return dense, rng.integers(0, k, n), row, term


def test_children_counts_equal_their_own_cells():
    dense, y, row, term = _matrix(600, 9, 3, 1)
    cells = NodeCells(y, 3, row, term, dense[row, term])
    every = np.arange(len(dense))
    whole, rows = cells.children([every], None)[0], every
    assert whole is not None
    while len(rows) >= 5:
        parts = [rows[: len(rows) // 5], rows[len(rows) // 5:]]
        for part, own in zip(parts, cells.children(parts, whole)):
            groups, m = cells.present(part, own)
            exp = {}
            for i in part:
                for t in np.flatnonzero(dense[i]):
                    exp[(t, dense[i, t], y[i])] = exp.get((t, dense[i, t], y[i]), 0) + 1
            got = {(cells.gt[g], cells.gv[g], c): m[j, c] for j, g in enumerate(groups) for c in range(3) if m[j, c]}
            assert got == exp
            last = own
        rows, whole = parts[1], last


def test_rows_of_are_the_nodes_own():
    dense, y, row, term = _matrix(60, 4, 2, 2)
    cells = NodeCells(y, 2, row, term, dense[row, term])
    rows = np.arange(0, 60, 3)
    a, b = np.searchsorted(cells.gt, [2, 3]).tolist()
    at, group = cells.rows_of(rows, a, b)
    assert {(int(rows[i]), int(cells.gv[g])) for i, g in zip(at, group)} == {(i, dense[i, 2]) for i in rows if dense[i, 2]}


def test_texts_are_cleaned_and_split_once(spark):
    d = spark.createDataFrame([(1, "B a, a #c1 c1"), (2, ""), (3, None), (4, "x"), (None, "bb  www.no bb")], "id long, text string")
    terms = FE.doc_terms(d.repartition(3, "id").select("id", clean_text("text").alias("t")), "id", "t")
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("lower(") == 1
    assert sorted(map(tuple, terms.collect()), key=str) == [(1, "c1", 2), (None, "bb", 2)]


def test_clean_text_in_one_pass_equals_its_steps(spark):
    from textlab.functions.text import MENTION_RE, SPACE, URL_RE, WORD
    texts = ["A  B\x1c\x85c", "É—ß_9 \t\n", "@a#b@c d#e", "https://x.y/@z #t", "\U0001f600a\U0001d400b", "áb ½²", "#", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    x = F.lower("t")
    for pattern, by in ((URL_RE, ""), (MENTION_RE, ""), ("#", ""), (rf"[^{WORD}{SPACE}]", " "), (rf"[{SPACE}]+", " ")):
        x = F.regexp_replace(x, pattern, by)
    assert all(r[0] == r[1] for r in d.select(clean_text("t"), F.trim(x)).collect())
