"""Records of large quoted CSV files, a file over many tasks.

Spark reads a CSV file with line breaks inside quotes in one task, as it cannot tell at a split's start whether it is inside a
quoted field. Here a file is read as lines by its splits, and each line gives a map of the two states *outside* and *inside*
quotes: a line leaves the state as it is, swaps it, or sets it whatever it was. A task goes through its splits' lines in order
and puts records together for both states that a split may start in, until these agree on where a record begins; from there on
for the one. A window over the splits' totals (a row per split) then tells each split's first state, and so which rows hold.
Only records that lie over a split's end are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.sources.scratch import materialize

# a field from its first character: quoted (text after the closing quote goes on to the comma), plain, or empty
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_STAYS_OUTSIDE = rf'(?s)\A(?:{_FIELD},)*+{_FIELD}\z'
_GETS_OUTSIDE = rf'(?s)\A[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+\z'

#: Kinds of rows: a split's totals, a whole record, the lines that end an earlier split's record, a record's first lines.
SPLIT, WHOLE, TAIL, HEAD = range(4)
_ROWS = ("split long, kind int, pos long, needs int, first int, record binary, open boolean, "
         "file string, block long, out int, ins int, has0 boolean, has1 boolean")


def _scan(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``known`` and ``turns``: the state before a row is ``(known, or the first state of its keys, + turns) mod 2``.

    ``out`` and ``ins`` are the states (0 outside, 1 inside) after a row that begins outside and inside.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when((F.col("out") == 1) & (F.col("ins") == 0), 1).otherwise(0)
    df = df.withColumn("swaps", F.sum(swap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("out") == F.col("ins"), (F.col("out") + F.col("swaps")) % 2)
    return (df.withColumn("known", F.last(fixed, ignorenulls=True).over(before))
            .withColumn("turns", F.coalesce(F.sum(swap).over(before), F.lit(0)) % 2).drop("swaps"))


def _state(first: Column) -> Column:
    return (F.coalesce(F.col("known"), first) + F.col("turns")) % 2


class _Run:
    """The records of one split under one first state; ``lines`` are those of the record that is open."""

    def __init__(self, state: int):
        self.state, self.lines, self.pos, self.kind = state, [], -1, TAIL
        self.found = self.first = False           # whether a record began, and whether the open one was the first to

    def line(self, data: bytes, pos: int, out: int, ins: int, blank: bool) -> tuple | None:
        """(kind, pos, first, record) if the line ends a record."""
        if self.state:
            self.lines.append(data)
            if ins:
                return None
            kind = WHOLE if self.kind == HEAD else TAIL
            done = (kind, self.pos, self.first, b"\n".join(self.lines))
            self.state, self.lines = 0, []
            return done
        if blank:
            return None
        first, self.found = not self.found, True
        if not out:
            return WHOLE, pos, first, data
        self.state, self.lines, self.pos, self.kind, self.first = 1, [data], pos, HEAD, first
        return None


class _Split:
    """The records of one split, for both first states as long as these differ."""

    def __init__(self, number: int, file: str, block: int):
        self.number, self.file, self.block = number, file, block
        self.runs, self.needs, self.pos = [_Run(0), _Run(1)], [0, 1], 0
        self.has = [False, False]

    def line(self, data: bytes, code: int) -> Iterator[tuple]:
        runs, pos = self.runs, self.pos
        self.pos += 1
        for run, needs in zip(runs, self.needs):
            done = run.line(data, pos, code & 1, code >> 1 & 1, code > 3)
            if done:
                yield self._row(done, needs)
        if len(runs) == 2 and not runs[0].state and not runs[1].state:
            self.has = [run.found for run in runs]
            self.runs, self.needs = [_Run(0)], [None]

    def _row(self, done: tuple, needs: int | None, is_open: bool = False) -> tuple:
        kind, pos, first, record = done
        if needs is None:                                          # the first in the split for those states that had none before
            bits = sum(1 << s for s in (0, 1) if first and not self.has[s])
        else:
            bits = first << needs
        return self.number, kind, pos, needs, bits, record, is_open, None, None, None, None, None, None

    def end(self) -> Iterator[tuple]:
        for run, needs in zip(self.runs, self.needs):
            if run.lines:
                yield self._row((run.kind, run.pos, run.first, b"\n".join(run.lines)), needs, True)
        after = [run.state for run in self.runs] * (3 - len(self.runs))
        found = [run.found for run in self.runs] * (3 - len(self.runs))
        yield (self.number, SPLIT, None, None, None, None, None, self.file, self.block, *after[:2],
               *(a or b for a, b in zip(self.has, found)))


def _assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``_ROWS`` of lines (key, file, block, code, line) in the order of their splits."""
    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
                                        "boolean": pa.bool_()}[c.split()[1]]) for c in _ROWS.split(", ")])
    base, count, last, split = TaskContext.get().partitionId() << 32, 0, None, None

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        rows: list[tuple] = []
        keys, codes, lines = batch.column(0).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            if split is None or keys[a] != last:
                if split is not None:
                    rows.extend(split.end())
                split, last = _Split(base + count, batch.column(1)[a].as_py(), batch.column(2)[a].as_py()), keys[a]
                count += 1
            for k in range(a, b):
                rows.extend(split.line(lines[k], codes[k]))
        if rows:
            yield pack(rows)
    if split is not None:
        yield pack(list(split.end()))


def records(spark: SparkSession, files, encoding: str = "UTF-8", crlf: bool = False) -> DataFrame:
    """The records of CSV files but each file's first: (record, closed); ``closed`` is false for one whose quotes the file's end
    leaves open. Blank lines between records are no records. With ``crlf`` line ends are taken as ``\\n``, inside quotes too.

    The files are read once, and the records written once to the shared scratch folder. A record has to fit in a task, as it
    does for Spark's reader. What is broadcast has a row or two per split, which the driver lists to plan the scan.
    """
    text = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line"))
    if crlf:
        lines = lines.withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    code = (F.when(F.col("line").rlike(_STAYS_OUTSIDE), 0).otherwise(1) + F.when(F.col("line").rlike(_GETS_OUTSIDE), 0).otherwise(2)
            + F.when(F.col("line").rlike("\\A\ufeff?\r?\\z"), 4).otherwise(0))
    lines = lines.select(F.xxhash64("file", "block").alias("key"), "file", "block", code.alias("code"), F.col("line").cast("binary").alias("line"))
    rows = materialize(lines.mapInArrow(_assemble, _ROWS), "csv-records")
    few = materialize(rows.filter(F.col("kind") != WHOLE).repartition("split"), "csv-splits")        # a few rows a split
    splits = _scan(few.filter(F.col("kind") == SPLIT).select("split", "file", "block", "out", "ins", "has0", "has1"), ["file"], "block")
    splits = splits.withColumn("start", _state(F.lit(0))).withColumn("has", F.when(F.col("start") == 0, F.col("has0")).otherwise(F.col("has1")))
    head = F.min(F.when(F.col("has"), F.col("block"))).over(Window.partitionBy("file"))
    starts = splits.withColumn("header", F.coalesce(F.col("block") == head, F.lit(False))).select("split", "file", "block", "start", "header")

    def holding(found: DataFrame) -> DataFrame:
        found = found.drop("file", "block").join(F.broadcast(starts), "split")
        found = found.filter(F.col("needs").isNull() | (F.col("needs") == F.col("start")))
        return found.withColumn("header", F.col("header") & (F.col("first").bitwiseAND(F.col("start") + 1) != 0))

    whole = holding(rows.filter(F.col("kind") == WHOLE)).filter(~F.col("header")).select(F.col("record").cast("string").alias("record"), F.lit(True).alias("closed"))
    # a split that starts inside a record goes on with the last record that an earlier split of its file opened
    parts = holding(few.filter(F.col("kind").isin(TAIL, HEAD)))
    upto = Window.partitionBy("file").orderBy("block", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("kind") == HEAD, F.struct("block", "pos")), ignorenulls=True).over(upto)
    owners = parts.select("split", "kind", "file", "block", "pos").select("split", "kind", owner.alias("owner"))
    joined = (parts.join(F.broadcast(owners), ["split", "kind"]).groupBy("file", "owner")
              .agg(F.array_sort(F.collect_list(F.struct("block", "pos", F.col("record").cast("string").alias("record")))).alias("lines"),
                   F.min("open").alias("open"), F.max("header").alias("header"))
              .filter(~F.col("header"))
              .select(F.array_join(F.transform("lines", lambda x: x["record"]), "\n").alias("record"), (~F.col("open")).alias("closed")))
    return whole.unionByName(joined)
