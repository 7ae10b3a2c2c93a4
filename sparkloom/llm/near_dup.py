"""Near duplicates by MinHash and a multi-index Hamming join.

A document's set holds its distinct k-word shingles. Its signature has SYMBOLS minima of BITS bits each. Two signatures
may differ in at most ``radius(percent)`` symbols; split into ``chunks(radius)`` chunks, they then agree in two chunks up to one
symbol each: at 85 % the radius is 21, and 11 of 12 chunks with two differences or more would make 22. Every chunk is keyed once
for each choice of one symbol left out, so all pairs within the radius meet in buckets of two chunks. The distance of a pair at the
threshold is binomial (at 85 % with a mean of 0.15 * 64 = 9.6 and a deviation of 2.9); the radius is the least that leaves at most
one in 10,000 of such pairs beyond it.

Documents with equal sets are one from the start. A bucket links its members to one of them, its centre (the one with
most copies). Links are confirmed on full sets. Pairs that do not go through a centre are confirmed only if their ends are
still in different components: small buckets list them; in a bucket of over SMALL members they come from the exact
prefix join below, so no bucket is capped and none emits all its pairs. A member whose large buckets all belong to one
chunk meets each of its partners in a small bucket of another chunk, and needs no prefix join.

Prefix join: of a link's sets a and b, at least percent / (100 + percent) * (|a| + |b|) shingles are common. With shingles in
order of rarity, both have one of those among their first |a| - that + 1 and |b| - that + 1 shingles. Copies with edits of
their own begin with shingles that no other has, so they meet nobody, however many there are.

Defined results: a null or blank text has no shingle, n_shingles 0, and is linked with nothing. A row without an id is
linked with nothing and kept. To near_duplicates rows that share an id are one document with several texts; keep_one
judges each row. Ids are whole numbers.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm._lineage import cut, row_hash, spare
from sparkloom.llm._text import LOWER, WORDS, mix, segments, shingle_hashes, utf8, word_hashes
from sparkloom.lineage import components

SHINGLE = 5
#: Links have 100 * intersection >= percent * union; this is the percent of op10.
PERCENT = 85
#: The radius and the chunks are those of PERCENT.
SYMBOLS, BITS, RADIUS, CHUNKS = 64, 16, 21, 12
#: Pairs at the very threshold that may lie beyond the radius, and the least percent whose chunks still tell texts apart.
BEYOND, LEAST_PERCENT = 1e-4, 70
#: Members of a bucket whose pairs are listed.
SMALL = 12
#: Rows of one shingle that a task of the prefix join gets.
SLICE = 200
#: Ids that a broadcast may hold (8 bytes each, some 40 in a hash table); more are joined by a shuffle.
BROADCAST_IDS = 500_000

_R = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _R.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_TURN = _R.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    out: list[np.ndarray] = []
    for a, b in segments(offsets):
        words, rows = word_hashes(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], WORDS)
        hashes, at = shingle_hashes(words, rows, k)
        out += [np.unique(x) for x in np.split(hashes, np.searchsorted(at, np.arange(1, b - a)))]
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    best = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(best, ((hashes[i : i + 2048, None] ^ _TURN) * _MULTIPLY).min(axis=0), out=best)
    return (mix(best) >> np.uint64(64 - BITS)).astype(np.uint16)


def radius(percent: int) -> int:
    """The least distance that at most BEYOND of the pairs of exactly that similarity exceed."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be between {LEAST_PERCENT} and 100")
    miss, beyond = 1 - percent / 100, 1.0
    for r in range(SYMBOLS):
        beyond -= comb(SYMBOLS, r) * miss**r * (1 - miss) ** (SYMBOLS - r)
        if beyond <= BEYOND:
            return r
    return SYMBOLS


def chunks(within: int) -> int:
    """The least number of chunks of which two have at most one difference each, where ``within`` symbols differ."""
    return within // 2 + 2


def signature_keys(signatures: np.ndarray, within: int = RADIUS) -> np.ndarray:
    """Bucket keys, one row per signature: for each chunk, one key for each choice of a symbol that may differ."""
    count = chunks(within)
    edges = [SYMBOLS * i // count for i in range(count + 1)]
    out = []
    wide = signatures.astype(np.uint64)
    for chunk, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        for number, dropped in enumerate(combinations(range(a, b), 1)):
            key = np.full(len(wide), chunk << 16 | number, np.uint64)
            for s in range(a, b):
                if s not in dropped:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, s])
            # The chunk's number stands in the highest bits.
            out.append(key >> np.uint64(8) | np.uint64(chunk) << np.uint64(56))
    return np.stack(out, axis=1)


def _linked(inter: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * inter >= percent * (n + m - inter)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, set_a, set_b, n, signature``; two sums over the hashes name the set."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0)[first : first + 1000], batch.column(1)[first : first + 1000]
                sets = shingle_sets(texts)
                a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                b = np.array([mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids, pa.array(a), pa.array(b), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "set_a", "set_b", "n", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, set_a long, set_b long, n long, signature binary")


def _keyed(sets: DataFrame, within: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                if not part.num_rows:
                    continue
                sig = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = signature_keys(sig, within)
                copy = lambda k: pa.array(np.repeat(part.column(k).to_numpy(zero_copy_only=False), keys.shape[1]))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), copy(0), copy(1), copy(2)], ["key", "rep", "n", "copies"])

    return sets.select("rep", "n", "copies", "signature").mapInArrow(run, "key long, rep long, n long, copies long")


PAIR = "lo long, hi long, star boolean, low_centre boolean, high_centre boolean, sized boolean, chunks int"


def _bucket_pairs(batches, percent=PERCENT):
    """Streams buckets (rows by key, the centre first): pairs with the centre, and all pairs of small buckets.

    At most one bucket of SMALL members is held beside the batch; a larger one is known by its centre. ``chunks`` has the bit of
    the chunk of a large bucket.
    """

    def pairs(key, x, y, nx, ny, star, hot):
        keep = x != y
        if not hot:
            keep &= 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        key, x, y, nx, ny = key[keep], x[keep], y[keep], nx[keep], ny[keep]
        low, no = x < y, np.zeros(len(x), bool)
        sized = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
        chunks = (1 << (key >> 56 & 31)).astype(np.int32) if hot else np.zeros(len(x), np.int32)
        cols = [np.where(low, x, y), np.where(low, y, x), no | star, ~low if hot else no, low if hot else no, sized, chunks]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in PAIR.split(", ")])

    held = [np.zeros(0, np.int64)] * 3
    centre = None  # (key, rep, n) of a large bucket that goes on
    for batch in batches:
        fresh = [batch.column(k).to_numpy() for k in range(3)]
        if centre is not None:
            other = np.flatnonzero(fresh[0] != centre[0])
            go = int(other[0]) if len(other) else len(fresh[0])
            if go:
                yield pairs(fresh[0][:go], fresh[1][:go], np.full(go, centre[1]), fresh[2][:go], np.full(go, centre[2]), True, True)
            fresh = [c[go:] for c in fresh]
            if len(fresh[0]):
                centre = None
        key, rep, n = (np.concatenate([h, f]) for h, f in zip(held, fresh, strict=True))
        held = [np.zeros(0, np.int64)] * 3
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        if size[-1] <= SMALL:
            held = [c[starts[-1] :] for c in (key, rep, n)]
            key, rep, n = (c[: starts[-1]] for c in (key, rep, n))
            starts, size = starts[:-1], size[:-1]
        else:
            centre = (key[-1], rep[starts[-1]], n[starts[-1]])
        yield from _of_runs(pairs, key, rep, n, starts, size)
    key, rep, n = held
    if len(key):
        yield from _of_runs(pairs, key, rep, n, np.array([0]), np.array([len(key)]))


def _of_runs(pairs, key, rep, n, starts, size):
    of, count = np.repeat(starts, size), np.repeat(size, size)
    at = np.arange(len(rep))
    for hot in (False, True):
        rows = np.flatnonzero((at != of) & ((count > SMALL) == hot))
        if len(rows):
            yield pairs(key[rows], rep[rows], rep[of[rows]], n[rows], n[of[rows]], True, hot)
    for step in range(1, SMALL):
        rows = np.flatnonzero((at - of > step) & (count <= SMALL))
        if not len(rows):
            break
        other = rows - step
        yield pairs(key[rows], rep[rows], rep[other], n[rows], n[other], False, False)


def _close(batches, within):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (5, 6))
            yield batch.filter(pa.array((a != b).sum(axis=1) <= within)).select([0, 1, 2, 3, 4])


def _shingles_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, shingles`` of the documents that ``ids`` names."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                sets = shingle_sets(batch.column(1)[first : first + 1000])
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + 1000], pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "n", "shingles"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    return chosen.mapInArrow(run, "id long, n long, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``lo, hi`` that are links by their full sets."""
    a = sets.select(F.col("id").alias("lo"), F.col("n").alias("n_lo"), F.col("shingles").alias("s_lo"))
    b = sets.select(F.col("id").alias("hi"), F.col("n").alias("n_hi"), F.col("shingles").alias("s_hi"))
    inter = F.size(F.array_intersect("s_lo", "s_hi"))
    return pairs.select("lo", "hi").join(a, "lo").join(b, "hi").where(_linked(inter, F.col("n_lo"), F.col("n_hi"), percent)).select("lo", "hi")


def _prefix_pairs(members: DataFrame, sets: DataFrame, rows: int, percent: int) -> DataFrame:
    """Candidates ``lo, hi`` among members of large buckets, exactly. members: ``rep, component``."""
    known = members.join(sets.select(F.col("id").alias("rep"), "n", "shingles"), "rep")
    items = known.select("rep", "component", "n", F.explode("shingles").alias("e"))
    often = items.groupBy("e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    # A shingle that one member alone has is shared with none, but takes a place in the order, before all others.
    own = Window.partitionBy("rep", "component", "n")
    place = F.row_number().over(own.orderBy("f", "e")) + F.col("n") - F.count(F.lit(1)).over(own)
    ranked = items.join(often, "e").withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    ranked = cut(ranked.select("rep", "component", "n", "e", "at"), rows)
    # Pairs within a component are not sought, so the most common component of a shingle is taken on one side only.
    common = ranked.groupBy("e", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("e").agg(F.max_by("component", "k").alias("common"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("rows")).where("parts > 1")
    # The rows of a frequent shingle are dealt into slices of about SLICE rows, and the rarer side stands in each of them.
    slices = F.ceil(F.col("rows") / SLICE).cast("int")
    # They are few; where they fit, rows stay where they are, as those of a frequent one would all meet in one task.
    common = cut(common.select("e", "common", slices.alias("slices")), 2 * rows)
    common = F.broadcast(common) if common.count() <= BROADCAST_IDS else common
    ranked = cut(ranked.join(common, "e").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")), rows)
    a = ranked.where("component <> common").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("a")
    b = ranked.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    on = (F.col("a.e") == F.col("b.e")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.component") != F.col("b.component"))
    on &= (F.col("a.at") <= F.col("a.n") - need + 1) & (F.col("b.at") <= F.col("b.n") - need + 1)
    return a.join(b, on).select(F.least("a.rep", "b.rep").alias("lo"), F.greatest("a.rep", "b.rep").alias("hi")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row: all documents linked, directly or not, share the least id.

    Documents of ``percent`` similarity or more (LEAST_PERCENT to 100) are linked.
    """
    within = radius(percent)
    size = docs.count()
    prints = cut(_fingerprints(docs, id_col, text_col), 4 * size)  # rows of some 150 bytes
    full = prints.where("n > 0 AND doc_id IS NOT NULL")
    sets = cut(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")), 4 * size)
    # No task holds more of one key than others: a text is in one bucket per key, so the largest has 1 in SYMBOLS rows.
    keyed = _keyed(sets, within).repartition("key").sortWithinPartitions("key", F.desc("copies"), "rep").select("key", "rep", "n")
    raw = keyed.mapInArrow(lambda batches: _bucket_pairs(batches, percent), PAIR)
    most = [F.max(c).alias(c) for c in ("star", "low_centre", "high_centre", "sized")]
    pairs = cut(raw.groupBy("lo", "hi").agg(*most, F.bit_or("chunks").alias("chunks")), size)
    sig = sets.select("rep", "signature")
    near = pairs.where("sized").join(sig.select(F.col("rep").alias("lo"), F.col("signature").alias("sig_lo")), "lo").join(sig.select(F.col("rep").alias("hi"), F.col("signature").alias("sig_hi")), "hi")
    near = cut(near.select("lo", "hi", "star", "low_centre", "high_centre", "sig_lo", "sig_hi").mapInArrow(lambda batches: _close(batches, within), "lo long, hi long, star boolean, low_centre boolean, high_centre boolean"), size)
    hot = pairs.where("low_centre").select(F.col("lo").alias("centre"), F.col("hi").alias("rep"), "chunks").unionByName(pairs.where("high_centre").select(F.col("hi").alias("centre"), F.col("lo").alias("rep"), "chunks"))
    both = hot.unionByName(hot.select("centre", F.col("centre").alias("rep"), "chunks"))
    several = both.groupBy("rep").agg(F.bit_or("chunks").alias("m")).where(F.bit_count("m") > 1).select("rep")
    hot = hot.select("centre", "rep").join(several, "rep", "left_semi").distinct()
    hot = cut(hot.unionByName(hot.select("centre", F.col("centre").alias("rep"))).distinct(), size)
    wanted = near.select(F.explode(F.array("lo", "hi")).alias("id")).unionByName(hot.select(F.col("rep").alias("id"))).distinct()
    shingles = cut(_shingles_of(docs, wanted, id_col, text_col))
    links = cut(_confirm(near.where("star"), shingles, percent), size)
    first = components(links, size)
    name = lambda df, node, out: df.join(first.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))
    open_pairs = name(name(near.where("NOT star"), "lo", "c_lo"), "hi", "c_hi").where("c_lo <> c_hi").select("lo", "hi")
    members = cut(name(hot, "rep", "component"), size)
    split = members.groupBy("centre").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("centre")
    # Centres are few; where they fit, members stay where they are, as a large bucket's would all meet in one task.
    split = cut(split, size)
    members = cut(members.join(F.broadcast(split) if split.count() <= BROADCAST_IDS else split, "centre", "left_semi"), size)
    if not members.isEmpty():
        open_pairs = open_pairs.unionByName(_prefix_pairs(members.select("rep", "component").distinct(), shingles, size, percent)).distinct()
    more = cut(_confirm(open_pairs, shingles, percent), size)
    if not more.isEmpty():
        bridges = name(name(more, "lo", "c_lo"), "hi", "c_hi").select(F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"))
        second = components(bridges, size).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        lone = second.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(first.select("node"), "node", "left_anti")
        first = cut(first.join(second, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(lone), size)
    named = sets.select("set_a", "set_b", "rep").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("__component"))
    out = prints.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("set_a")).alias("set_a"), "set_b", "n").join(named, ["set_a", "set_b"], "left")
    component = F.coalesce("__component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents without those that are not kept: one row of each class stays, the one with the least id.

    Rows are judged each on their own, also where an id repeats: of several rows of a class with one id the least by text stays.
    Rows without an id or without a word stay. Rows to leave out are broadcast up to BROADCAST_IDS; more are joined by a
    shuffle of the documents. Where an id repeats, the documents are cut once, so that each row has a number.
    """
    whole = F.col(id_col).cast("long")
    gone, row = spare(docs, "__id"), spare(docs, "__row")
    if docs.where(whole.isNotNull()).groupBy(whole.alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        judged = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent).select("doc_id", "kept"))
        out, same = judged.where("NOT kept").select(F.col("doc_id").alias(gone)), whole == F.col(gone)
    else:
        docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        judged = near_duplicates(docs.where(whole.isNotNull()), id_col=row, text_col=text_col, percent=percent).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
        order = F.struct(whole, F.col(text_col), row_hash(docs, [c for c in docs.columns if c != row]), F.col(row).alias("row")).alias("order")
        ranked = cut(judged.join(docs.select(row, order), row))
        first = ranked.groupBy("component_id").agg(F.min("order")["row"].alias(row))
        out, same = cut(ranked.join(first, row, "left_anti").select(F.col(row).alias(gone))), F.col(row) == F.col(gone)
    out = F.broadcast(out) if out.count() <= BROADCAST_IDS else out
    return docs.join(out, same, "left_anti").drop(row)
