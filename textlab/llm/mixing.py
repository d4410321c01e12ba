"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

A source's documents are shuffled by a hash of their ids and laid end to end; the stream is cut into blocks of
equal numbers of words. Slot i of the schedule goes to the source whose part of [0, 1) holds the golden-ratio
point frac(i / phi), so every prefix of the schedule is close to the wanted shares; the r-th slot of a source
takes its r-th block, beginning again after the last one. A source that its slots leave short of its target gets the
missing ones after the others, and its last slot is cut, so that it takes its target's words at any size. Ranks and positions come from counts per small key
range plus a rank within the range, so no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import NOT_SPACE, fresh, power_of_two, same
from textlab.sources.scratch import materialize

# fixed values of the mix
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_PASSES = 2

GOLDEN = 0.6180339887498949     # 1 / phi
SLOTS = 1 << 20                 # slots of the schedule while blocks of total / SLOTS words are within these two:
LEAST_BLOCK = 8                 # words; a small corpus has fewer slots
MOST_BLOCK = 32                 # words; a large corpus has more slots
CELLS = 4096                    # equal parts of [0, 1) by which points find their source
RANGE_ROWS = 1024               # rows or slots ranked together


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def source_plan(sized: DataFrame) -> DataFrame:
    """One row per source: source, idx (1.. by code point, null last), source_size, target, and the schedule's
    part [lo, hi), words per block, slots, number of blocks, and what reaches the target: whole passes over the source,
    words of one more pass, and slots.

    Sources whose target reaches twice their size are those with the least size per weight: in that order a source
    is full if all before it are and the rest, shared by weight, would exceed it.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = by_source.withColumn("idx", F.row_number().over(order))
    p = p.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]),
                                            (F.pmod(F.col("idx") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    p = p.withColumn("most", (F.col("source_size") * MOST_PASSES).cast("double"))
    p = p.withColumn("total", F.sum("source_size").over(every) * TOTAL_SHARE)
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "idx")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    p = p.withColumn("left", F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    p = p.withColumn("full", F.col("used") + F.col("most") / F.col("weight") * F.col("left") <= F.col("total"))
    p = p.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0)))
    p = p.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
    p = p.withColumn("target", F.when(F.col("full"), F.col("most"))
                     .otherwise((F.col("total") - F.col("spent")) * F.col("weight") / F.col("open")))
    by_idx = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.sum("target").over(every)
    p = p.withColumn("hi", F.when(wanted > 0, F.sum("target").over(by_idx) / wanted))
    p = p.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("idx")), F.lit(0.0)))
    p = p.withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.col("idx").desc())) == 1, F.lit(2.0))
                     .otherwise(F.col("hi")))
    p = p.withColumn("block", F.least(F.greatest(F.ceil(F.col("total") / SLOTS), F.lit(LEAST_BLOCK)),
                                        F.lit(MOST_BLOCK)).cast("long"))
    p = p.withColumn("slots", F.ceil(F.col("total") / F.col("block")).cast("long"))
    p = p.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    wanted, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    p = p.withColumn("passes", F.floor(wanted / size).cast("long"))
    p = p.withColumn("words_over", wanted - F.col("passes") * F.col("source_size"))
    p = p.withColumn("needed", F.col("passes") * F.col("blocks") + F.ceil(F.col("words_over") / F.col("block")))
    return p.select("source", "idx", "source_size", "target", "lo", "hi", "block", "slots", "blocks",
                    "passes", "words_over", "needed")


def schedule(plan: DataFrame) -> DataFrame:
    """The slots in order: slot (from 0), idx, rank (from 0 within the source), block_no (of the source's stream), pass_no,
    upto (word of the stream before which the slot ends).

    Ranks that a source does not need for its target take no block and are left out; missing ones follow at the end.
    """
    spark = plan.sparkSession
    head = plan.agg(F.max("slots").alias("n")).first()              # one number
    slots = spark.range(head["n"] or 0).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", (F.col("slot") + 1).cast("double") * GOLDEN)
    slots = slots.withColumn("u", F.col("u") - F.floor("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    parts = (plan.filter("hi > lo").select("idx", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS).cast("long"),
        F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("long"))).alias("at")))
    dealt = (slots.join(parts, (slots["cell"] == parts["at"]) & (slots["u"] >= parts["lo"]) & (slots["u"] < parts["hi"]))
             .select("slot", "idx", F.floor(F.col("slot") / RANGE_ROWS).alias("span")))
    dealt = materialize(dealt, "mix-slots")
    counts = materialize(dealt.groupBy("idx", "span").agg(F.count("*").alias("n")), "mix-counts")
    upto = Window.partitionBy("idx").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("idx", "span", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inner = Window.partitionBy("idx", "span").orderBy("slot")
    ranked = (dealt.withColumn("in", F.row_number().over(inner) - 1).join(base, ["idx", "span"])
              .select("slot", "idx", (F.col("base") + F.col("in")).alias("rank")))
    have = counts.groupBy("idx").agg(F.sum("n").alias("have"))
    short = (plan.select("idx", "needed").join(have, "idx", "left").withColumn("have", F.coalesce("have", F.lit(0)))
             .filter("needed > have").select("idx", "have", F.explode(F.expr("sequence(have, needed - 1)")).alias("rank")))
    short = short.crossJoin(F.broadcast(plan.agg(F.max("idx").alias("of")))).select(
        (F.lit(head["n"] or 0) + (F.col("rank") - F.col("have")) * F.col("of") + F.col("idx")).alias("slot"), "idx", "rank")
    every = ranked.unionByName(short).join(
        plan.select("idx", "source_size", "block", "blocks", "passes", "words_over", "needed"), "idx").filter("rank < needed")
    every = (every.withColumn("block_no", F.pmod("rank", "blocks"))
             .withColumn("pass_no", F.floor(F.col("rank") / F.col("blocks"))))
    end = F.when(F.col("pass_no") < F.col("passes"), F.col("source_size")).otherwise(F.col("words_over"))
    return every.select("slot", "idx", "rank", "block_no", "pass_no",
                        F.least((F.col("block_no") + 1) * F.col("block"), end).alias("upto"))


def _placed(rows: DataFrame, plan: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """Rows of sized documents with idx, block, and start: words of the source before them in shuffled order."""
    small = plan.select(F.col("source").alias("_plan_source"), "idx", "source_size", "target", "block")
    shift = 64 - (buckets.bit_length() - 1)
    top = F.shiftrightunsigned("mix_hash", shift) if buckets > 1 else F.lit(0).cast("long")
    r = (rows.filter("size > 0").join(small, same(F.col("source"), F.col("_plan_source")))
         .withColumn("bucket", top))
    sums = r.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("idx", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    inner = Window.partitionBy("idx", "bucket").orderBy("mix_hash", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (r.withColumn("in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(base, ["idx", "bucket"])
            .withColumn("start", F.col("base") + F.col("in"))
            .select("idx", "start", "size", "source_size", "target", "block", *keep))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """doc_id, source, size, mix_hash and tie of every row: rows that agree in all of them can stand for each other."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(body)).alias("mix_hash"),
                       F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.length(body), body).alias("tie"))


def _taken(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """(idx, start, taken): words that the schedule takes of the document at ``start``."""
    uses = slots.groupBy("idx", "block_no", "upto").agg(F.count("*").alias("uses"))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    cut = placed.select("idx", "start", "size", "block", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("block")), last)).alias("block_no"))
    words = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("upto"))
                       - F.greatest(F.col("start"), F.col("block_no") * F.col("block")))
    # the slots grow with the input, but as files they are so small that Spark would broadcast them
    return (cut.join(uses.hint("merge"), ["idx", "block_no"]).groupBy("idx", "start")
            .agg(F.sum(words * F.col("uses")).cast("long").alias("taken")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null text has no words and is taken 0 times; the null source is a source of its own, last in order; ids may repeat
    or be null, rows equal in id and text stay separate rows; an empty table gives an empty result; other columns are
    not read. A source's taken words are its target, rounded.
    """
    sized = materialize(_sized(docs, doc_id, text, source, seed), "mix-sized")
    plan = materialize(source_plan(sized), "mix-plan")
    buckets = power_of_two(sized.count() / RANGE_ROWS)
    placed = materialize(_placed(sized, plan, buckets, ["doc_id", "source"]), "mix-placed")
    taken = materialize(_taken(placed, materialize(schedule(plan), "mix-schedule")), "mix-taken")
    got = placed.join(taken, ["idx", "start"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    small = plan.select(F.col("source").alias("_plan_source"), "source_size", "target")
    none = sized.filter("size = 0").join(small, same(F.col("source"), F.col("_plan_source"))).select(
        "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return got.unionByName(none)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    n_chars: str = "n_chars", seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for every whole time that it is taken, and once
    cut to its first words for a rest (one document of a source at most). ``n_chars`` follows the cut text.

    Documents without words are not taken. Positions are computed as in :func:`mix`; ties and nulls as there. They come
    from rows without texts; then a text is shuffled once, to the number of times that it is taken. Rows equal in id, text
    and source share evenly what is taken of them; what is left over, and the cut, come from any one of them.
    """
    def origin(name: str) -> Column:
        return F.xxhash64(F.col(name).isNull(), F.col(name))

    k1, k2, k3, row = fresh(docs, "_hash", "_tie", "_origin", "_row")
    body = F.coalesce(F.col(text), F.lit(""))
    light = materialize(_sized(docs, doc_id, text, source, seed).withColumn("origin", origin("source")), "mix-sized")
    plan = materialize(source_plan(light), "mix-plan")
    buckets = power_of_two(light.count() / RANGE_ROWS)
    placed = materialize(_placed(light, plan, buckets, ["mix_hash", "tie", "origin"]), "mix-placed")
    taken = materialize(_taken(placed, materialize(schedule(plan), "mix-schedule")), "mix-taken")
    whole = F.sum(F.floor(F.col("taken") / F.col("size")))
    uses = (placed.join(taken.hint("merge"), ["idx", "start"])          # both sides grow with the input
            .groupBy(F.col("mix_hash").alias(k1), F.col("tie").alias(k2), F.col("origin").alias(k3))
            .agg(F.floor(whole / F.count("*")).cast("int").alias("each"), F.pmod(whole, F.count("*")).cast("int").alias("more"),
                 F.sum(F.pmod("taken", "size")).cast("int").alias("rest")))
    uses = materialize(uses, "mix-uses")
    last = materialize(uses.filter("more > 0 or rest > 0").drop("each"), "mix-last")    # one key of a source at most
    keyed = docs.select(F.struct(*docs.columns).alias(row), F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(body)).alias(k1),
                        F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.length(body), body).alias(k2), origin(source).alias(k3))
    even = (keyed.join(uses.filter("each > 0").select(k1, k2, k3, "each").hint("merge"), [k1, k2, k3])
            .withColumn("copy", F.explode(F.expr("sequence(1, each)"))).select(f"{row}.*"))
    odd = (keyed.join(last, [k1, k2, k3]).groupBy(k1, k2, k3, "more", "rest").agg(F.first(row).alias(row))
           .withColumn("copy", F.explode(F.expr("sequence(1, more + if(rest > 0, 1, 0))"))))
    cut = F.col("copy") > F.col("more")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"{row}.{text}"), F.lit(r"[\x20\x09-\x0D]*" + NOT_SPACE), F.lit(0)),
                                 F.lit(1), F.col("rest")), "")
    odd = odd.withColumn("body", F.when(cut, first).otherwise(F.col(f"{row}.{text}")))
    chars = F.when(cut, F.length("body")).otherwise(F.col(f"{row}.{n_chars}")) if n_chars in docs.columns else None
    return even.unionByName(odd.select(*[F.col("body").alias(c) if c == text
                                         else chars.cast(docs.schema[c].dataType).alias(c) if c == n_chars
                                         else F.col(row)[c].alias(c) for c in docs.columns]))
