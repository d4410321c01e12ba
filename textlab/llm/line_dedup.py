"""Substring de-duplication by hashing sentences of lines.

Units are the sentences of every line, short ones put together with the next. Normalised units (A-Z and
other letters lower-cased, white space as one space) are digested to 128 bits and grouped over the whole corpus. The
occurrence that ranks first (by document, then place) is kept, later ones are marked; marked units that follow each
other are joined into spans, and spans of enough words are repeats. What is shorter than a unit at a line's end is
digested too: a span goes over it only where it repeats as well. Lines whose units all repeat are cut whatever their
length, if asked for; sentences inside other lines then only in spans of enough words. Offsets are those of the
original text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textlab.llm.common import as_text, fresh
from textlab.sources.scratch import materialize

MIN_UNIT_WORDS = 4
MIN_SPAN_WORDS = 30     # an option: MIN_UNIT_WORDS takes every repeated unit
DENSE_WORD = 2          # characters that count as a word in scripts without spaces
_BREAK = re.compile(r"(?<=[.!?])\s+|\n|(?<=[。！？｡])(?![。！？｡」』”’）])")
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def pieces(text: str, least: int = MIN_UNIT_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, 128-bit digest) of the units of ``text`` and of what is too short for one, in order.

    A sentence of fewer than ``least`` words is put together with the ones after it in its line until they have as many;
    what is still shorter at a line's end is a piece of its own, with fewer than ``least`` words. Chinese, Japanese, Thai
    and the like have a word in every DENSE_WORD characters.
    """
    out, at, dense = [], 0, _DENSE.search(text) is not None
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        words = text[at:end].lower().split()
        size = max(len(words), sum(len(_DENSE.findall(w)) for w in words) // DENSE_WORD) if dense else len(words)
        if size < least and m and "\n" not in m[0]:
            continue
        if words:
            out.append((at, end, size, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
        at = m.end() if m else end
    return out


def units(text: str, least: int = MIN_UNIT_WORDS) -> list[tuple[int, int, int, bytes]]:
    """The :func:`pieces` of ``text`` that have ``least`` words."""
    return [p for p in pieces(text, least) if p[2] >= least]


def unit_table(docs: DataFrame, doc_id: str, text: str, least: int = MIN_UNIT_WORDS, short: bool = False) -> DataFrame:
    """(doc_id, task, row, unit, start, end, words, d1, d2, line, in_line) of every unit, with ``short`` of every piece; (task,
    row) names a row of ``docs``, ``line`` is where the unit's line begins and ``in_line`` how many units that line has."""
    split = pieces if short else units
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            at, place, found, line, in_line = [], [], [], [], []
            for k, body in enumerate(as_text(batch.column(1))):
                own = split(body, least)
                at += [k] * len(own)
                place += range(len(own))
                found += own
                starts = [body.rfind("\n", 0, u[0]) + 1 for u in own]
                many = Counter(starts)
                line += starts
                in_line += [many[x] for x in starts]
            digest = np.frombuffer(b"".join(u[3] for u in found), "<i8").reshape(-1, 2)
            rows = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([task] * len(at), pa.int32()), pa.array(rows + row),
                 pa.array(place, pa.int32()), *[pa.array([u[c] for u in found], pa.int32()) for c in range(3)],
                 pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(line, pa.int32()), pa.array(in_line, pa.int32())],
                names=["doc_id", "task", "row", "unit", "start", "end", "words", "d1", "d2", "line", "in_line"])
            row += batch.num_rows

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, task int, row long, unit int, start int, end int, words int, d1 long, d2 long, line int, in_line int")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_unit: int = MIN_UNIT_WORDS,
                   min_span: int = MIN_SPAN_WORDS, compare_short: bool = False, lines: bool = False) -> DataFrame:
    """One row per span to remove: doc_id, task, row, start, end (code points, end exclusive), n_words, first_doc_id.

    With ``lines`` a line of which every unit repeats goes too where its span has fewer than ``min_span`` words.

    first_doc_id is the document that keeps the span's first unit. Documents rank by id (nulls last), rows with equal
    ids by their place in the input, units by their place in the text. With ``compare_short`` a span goes over text that is
    too short for a unit only if that repeats too, else the span ends before it; without, over all of it. Null and empty
    texts have no units; repeats inside one document count too; an empty table gives no spans; other columns are not read.
    """
    table = materialize(unit_table(docs, doc_id, text, min_unit, compare_short), "line-units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "task", "row", "unit")
    # count and minimum are partial aggregates, so a line that very many documents share shrinks before the shuffle
    groups = materialize(table.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank).alias("first"))
                         .filter("n > 1").select(F.col("d1").alias("g1"), F.col("d2").alias("g2"), "first"), "line-groups")
    later = (table.join(groups, (table["d1"] == groups["g1"]) & (table["d2"] == groups["g2"]))
             .filter(~rank.eqNullSafe(F.col("first")))
             .select("doc_id", "task", "row", "unit", "start", "end", "words", "line", "in_line", F.col("first.doc_id").alias("first_doc_id")))
    of_row = Window.partitionBy("task", "row").orderBy("unit")
    if lines:
        # all units of a line are later occurrences, or the span around has enough words: a document's own units
        in_run = later.withColumn("run", F.col("unit") - F.row_number().over(of_row))
        size = F.sum(F.when(F.col("words") >= min_unit, F.col("words"))).over(Window.partitionBy("task", "row", "run"))
        of_line = F.count("*").over(Window.partitionBy("task", "row", "line")) == F.col("in_line")
        later = in_run.withColumns({"_size": size, "_line": of_line}).filter("_line or _size >= " + str(min_span))
        min_span = min_unit
    runs = later.withColumn("run", F.col("unit") - F.row_number().over(of_row))
    whole = F.col("words") >= min_unit                      # a span begins and ends with a unit
    short = F.collect_list(F.when(~whole, F.struct("unit", "words")))
    found = (runs.groupBy("task", "row", "run")
             .agg(F.first("doc_id").alias("doc_id"), F.min(F.when(whole, F.col("start"))).alias("start"),
                  F.max(F.when(whole, F.col("end"))).alias("end"), F.sum(F.when(whole, F.col("words"))).alias("n_words"),
                  F.min_by("first_doc_id", F.when(whole, F.col("unit"))).alias("first_doc_id"), short.alias("short"),
                  F.min(F.when(whole, F.col("unit"))).alias("a"), F.max(F.when(whole, F.col("unit"))).alias("b"))
             .filter("start is not null"))
    between = F.aggregate(F.filter("short", lambda x: x["unit"].between(F.col("a"), F.col("b"))), F.lit(0).cast("long"),
                          lambda n, x: n + x["words"])
    return (found.withColumn("n_words", F.col("n_words") + between).filter(F.col("n_words") >= min_span)
            .select("doc_id", "task", "row", "start", "end", "n_words", "first_doc_id"))


def cut(text: str | None, spans: list[tuple[int, int]]) -> tuple[str | None, list[tuple[int, int]]]:
    """``text`` without ``spans``, and the original offsets of the parts that stay. A line left empty goes with its break."""
    if text is None:
        return None, []
    kept, at = [], 0
    for a, b in sorted(spans):
        if (a == 0 or text[a - 1] == "\n") and text[b:b + 1] == "\n":
            b += 1
        if a > at:
            kept.append((at, a))
        at = max(at, b)
    if at < len(text):
        kept.append((at, len(text)))
    return "".join(text[a:b] for a, b in kept), kept


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_unit: int = MIN_UNIT_WORDS,
                    min_span: int = MIN_UNIT_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, every repeated unit cut from ``text``, and ``kept_spans``: original offsets of what stays.

    Spans are joined to their document by id and a digest of its text; rows equal in both share one cut: the rows after
    the first lose all that repeats, and the first keeps it, so such rows are told apart by their rank.
    """
    key, nth, cuts, kept, made = fresh(docs, "_key", "_nth", "_cuts", "kept_spans", "_made")
    numbered = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(
        nth, F.row_number().over(Window.partitionBy(doc_id, key).orderBy(F.lit(1))))
    base = materialize(numbered, "line-rows")
    ids = base.select(F.struct(F.col(doc_id).alias("i"), F.col(key).alias("k"), F.col(nth).alias("n")).alias("id"),
                      F.col(text).alias("text"))
    spans = repeated_spans(ids, "id", "text", min_unit, min_span, compare_short=True)
    per_row = spans.groupBy(F.col("doc_id").alias(made)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))

    @arrow_udf("struct<text:string,kept:array<struct<start:int,end:int>>>")
    def apply(body: pa.Array, where: pa.Array) -> pa.Array:
        rows = [cut(t, [(s["start"], s["end"]) for s in c or []]) for t, c in zip(body.to_pylist(), where.to_pylist())]
        return pa.array([{"text": t, "kept": [{"start": a, "end": b} for a, b in k]} for t, k in rows],
                        pa.struct([("text", pa.string()), ("kept", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    mine = F.struct(F.col(doc_id).alias("i"), F.col(key).alias("k"), F.col(nth).alias("n"))
    out = base.join(per_row, mine.eqNullSafe(F.col(made)), "left").withColumn(made, apply(F.col(text), F.col(cuts)))
    return out.select(*[F.col(f"{made}.text").alias(c) if c == text else F.col(c) for c in docs.columns],
                      F.col(f"{made}.kept").alias(kept))
