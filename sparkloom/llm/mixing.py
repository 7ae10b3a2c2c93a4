"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often the mix takes it, from 0 to LIMIT times. The rates stay as near as possible, in
entropy, to the common rate SHARE while each source's words come to its target. The solution tilts rates exponentially
in the document's words, rate / (LIMIT - rate) = SHARE / (LIMIT - SHARE) * exp(b * size), with one dual variable b per
source; the b solve a convex problem by Newton steps, each a distributed sum of gradients and curvatures. Rates depend on
source and size alone, so all sums run over the exact histogram of (source, size), which Spark aggregates before it
shuffles. A source whose target is its LIMIT has the rate LIMIT, where b goes to infinity.

Rates are rounded into copies: within a source, sizes are taken from the largest to the smallest, and each gets
the whole number of copies that brings the words taken so far nearest to what the rates ask for. Which documents of one
size get the extra copy is decided by the hash of their id, so reruns agree.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, the last. A
source without words has target 0. An empty table gives an empty result. Repeated documents count each.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm._lineage import cut, row_hash, spare

#: A document and a source are taken at most so often.
LIMIT = 2.0
#: Words of the mix for each word there is.
SHARE = 1.5
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
STEPS = 100
#: Sources whose dual variables are broadcast in a Newton step; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Parts that the documents of one source and size are dealt into.
PARTS = 256


def word_count(text: Column) -> Column:
    """Runs of other characters than white space; splitting costs an eighth of the time of extracting all matches."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """``source, source_size, target``: shares by weight, those above ``limit`` times the size cut and dealt out again.

    Dealing out until none is above ends at min(limit * size, weight * t) with one level t for all; t is found on the
    sources in order of limit * size / weight. One row per source, in one task.
    """
    ranked = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("__w", weight).withColumn("__cap", limit * F.col("source_size"))
    level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), "source")
    before, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = out.withColumn("__left", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    out = out.withColumn("__t", F.col("__left") / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    # The first source, in this order, that stays below its cap sets the level.
    first = F.min(F.when(F.col("__t") * F.col("__w") <= F.col("__cap"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("__t").alias("t")))).over(whole)
    out = out.withColumn("__level", first.getField("t"))
    return out.select("source", F.col("source_size").cast("long").alias("source_size"), F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap"))).alias("target"))


def _tilted(limit: float, share: float) -> tuple[Column, Column]:
    """The rate's share of the limit, and the size in mean sizes, of cells with ``__b`` and ``__m``."""
    x = F.col("size") / F.col("__m")
    at = F.lit(math.log(share / (limit - share))) + F.col("__b") * x
    return 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-700.0)), F.lit(700.0)))), x


def _exact(value: Column) -> Column:
    """A sum in whole thousandths, which is the same in whatever order the parts meet."""
    return F.sum((value * 1000).cast("decimal(38,0)")).cast("double") / 1000


def solve(cells: DataFrame, goals: DataFrame, limit: float = LIMIT, share: float = SHARE, steps: int = STEPS) -> list[tuple]:
    """(source, b, mean size, target, size) of each source; b is None where no rate between 0 and the limit is asked for.

    cells: ``source, size, n``; goals: ``source, source_size, target``. Each Newton step is one aggregation of the cells.
    The words taken rise with b, so each step also narrows a bracket; a Newton step that leaves it is replaced by its
    middle. Raises where a source is not at its target after ``steps``. The driver holds a few numbers per source.
    """
    spark = cells.sparkSession
    mean = {s: max(float(m), 1.0) for s, m in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")) / F.sum("n")).collect()}
    state = {s: [0.0 if 0 < t < limit * z * (1 - 1e-12) else None, -math.inf, math.inf, t, z] for s, z, t in goals.collect()}
    live = {s for s, v in state.items() if v[0] is not None}
    for _ in range(steps):
        if not live:
            break
        dual = spark.createDataFrame([(s, state[s][0], mean[s]) for s in live], "__s string, __b double, __m double")
        dual = F.broadcast(dual) if len(live) <= BROADCAST_SOURCES else dual
        p, x = _tilted(limit, share)
        words = F.col("n") * F.col("size") * limit
        sums = cells.join(dual, F.col("source").eqNullSafe(F.col("__s"))).groupBy("source").agg(_exact(words * p), _exact(words * p * (1 - p) * x))
        for s, taken, slope in sums.collect():
            b, low, high, target, total = state[s]
            gap = taken - target
            if abs(gap) <= 1e-7 * total:
                live.discard(s)
                continue
            low, high = (low, b) if gap > 0 else (b, high)
            to = b - gap / slope if slope > 0 else math.nan
            if not low < to < high:
                to = (low + high) / 2 if math.isfinite(low + high) else (b - 1 - abs(b) if gap > 0 else b + 1 + abs(b))
            state[s][:3] = to, low, high
    if live:
        raise RuntimeError(f"{len(live)} sources have not reached their target after {steps} steps")
    return [(s, v[0], mean[s], v[3], v[4]) for s, v in state.items()]


def _round_cells(limit: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        """Copies of the cells of one source: at most one row per distinct size."""
        cells = cells.sort_values("size", ascending=False, kind="stable")
        asked = given = 0.0
        copies = []
        for size, n, rate in zip(cells["size"], cells["n"], cells["rate"], strict=True):
            asked += n * rate * size
            k = min(max(0, math.floor((asked - given) / size + 0.5)), int(limit) * n) if size else 0
            given += k * size
            copies.append(k)
        return cells.assign(copies=copies)[["source", "size", "n", "copies", "source_size", "target"]]

    return run


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, text_hash`` of each document.

    Shuffled are ids, sizes and sources, never texts. Documents of one source and size are dealt by the hash of their id
    into PARTS parts, so a hot source or a great many copies of one text do not meet in one task.
    """
    spark = docs.sparkSession
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), text_hash.alias("text_hash"))
    rows = docs.count()
    sized = cut(sized.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PARTS)).cast("int")), 2 * rows)
    parts = cut(sized.groupBy("source", "size", "__part").agg(F.count(F.lit(1)).alias("n")), rows)
    cells = cut(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), rows // 4)
    goals = cut(targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), limit=limit), 0)
    dual = solve(cells, goals, limit)
    table = spark.createDataFrame(dual, "__s string, __b double, __m double, target double, source_size long")
    table = F.broadcast(table) if len(dual) <= BROADCAST_SOURCES else table
    rate = F.when(F.col("__b").isNotNull(), limit * _tilted(limit, SHARE)[0]).when(F.col("target") > 0, F.lit(limit)).otherwise(0.0)
    rated = cells.join(table, F.col("source").eqNullSafe(F.col("__s"))).withColumn("rate", rate)
    done = rated.select("source", "size", "n", "rate", "source_size", "target").groupBy("source").applyInPandas(_round_cells(limit), "source string, size long, n long, copies long, source_size long, target double")
    # Deal a cell's copies over its parts: all documents get the floor, the first ones by part and hash one more.
    before = Window.partitionBy("source", "size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = parts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnRenamed("n", "__n").alias("p")
    done = done.withColumn("__base", F.floor(F.col("copies") / F.col("n"))).withColumn("__extra", F.col("copies") - F.col("__base") * F.col("n")).alias("d")
    same = F.col("p.source").eqNullSafe(F.col("d.source")) & (F.col("p.size") == F.col("d.size"))
    dealt = dealt.join(done, same).select("p.source", "p.size", "p.__part", "d.source_size", "d.target", "d.__base", (F.col("d.__extra") - F.col("p.__before")).alias("__more")).alias("c")
    order = Window.partitionBy("source", "size", "__part").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_hash")
    placed = sized.withColumn("__rank", F.row_number().over(order)).alias("s")
    same = F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.size") == F.col("c.size")) & (F.col("s.__part") == F.col("c.__part"))
    copies = F.col("c.__base") + (F.col("s.__rank") <= F.col("c.__more")).cast("long")
    return placed.join(dealt, same).select("s.doc_id", "s.source", "s.size", "c.source_size", "c.target", copies.alias("copies"), "s.text_hash")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes from every document."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", F.col("copies").cast("long").alias("copies"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: every document as often as its copies say, with the columns of the documents.

    Documents are shuffled once, by id and text hash, to meet their copies.
    """
    names = [spare(docs, c) for c in ("__id", "__text", "__copies", "__hash", "__row", "__at", "__copy")]
    an_id, text, number, hashed, row, at, copy = names
    copies = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col).select(F.col("doc_id").alias(an_id), F.col("text_hash").alias(text), F.col("copies").alias(number))
    copies = cut(copies, docs.count())
    keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col(an_id)) & (F.col(hashed) == F.col(text))
    if not copies.groupBy(an_id, text).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # Equal rows are numbered on both sides, so that each meets one decision.
        keyed = keyed.withColumn(row, F.row_number().over(Window.partitionBy(id_col, hashed).orderBy(row_hash(docs))))
        copies = copies.withColumn(at, F.row_number().over(Window.partitionBy(an_id, text).orderBy(number)))
        same &= F.col(row) == F.col(at)
    taken = keyed.join(copies.where(F.col(number) > 0), same)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col(number).cast("int"))).alias(copy)).drop(copy)
