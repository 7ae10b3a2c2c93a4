"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are reduced to lower-case words joined by single spaces. An item of m characters may occur with k =
ERROR_SHARE * m edits. It is split into k + 1 pieces, of which an occurrence leaves at least one unharmed, so exact hits
of pieces, found for all items at once by one automaton, miss no occurrence. A hit is verified up a binary tree of
neighbouring pieces: a group of p pieces must occur nearby with at most p - 1 edits, which Myers' bit-parallel distance
decides; the root is the whole item.

An item of fewer than MIN_WORDS words is sought without edits and between word borders, as with edits it would be found in much
that has nothing to do with it.

Defined results: null and empty texts hold nothing; null items and items of fewer than LEAST_WORDS words are never sought,
as a word alone is vocabulary and no passage.
Repeated items are found each. A pair of document and item gives one row, its nearest occurrence (ties: the earliest).
Repeated documents are judged each on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ERROR_SHARE = 0.1
MIN_WORDS = 8
LEAST_WORDS = 2
#: Characters of items in one automaton (some 100 bytes each in memory), and automata that a worker keeps.
BLOCK_CHARS, HELD_BLOCKS = 2_000_000, 2
#: Blocks sought in one pass over the documents, which bounds what is broadcast; more items are sought in further passes.
PASS_BLOCKS = 32
#: Bytes of documents that are gone through together, and where a worker cannot keep all automata of a pass.
PART_BYTES, TOGETHER_BYTES = 1 << 20, 32 << 20

_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def budget(length: int) -> int:
    return int(ERROR_SHARE * length)


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to a substring of ``text`` and where that ends first; None over ``limit``."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    vp, vn, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        x = eq | vn
        d0 = ((eq & vp) + vp ^ vp) | x
        hn = vp & d0
        hp = vn | ~(vp | d0) & full
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1
        vn = hp & d0 & full
        vp = (hn << 1 | ~(d0 | hp)) & full
        if score < best:
            best, end = score, j
    return (best, end) if best <= limit else None


class Items:
    """A block of test items: pieces in one automaton, and each item's tree of groups.

    Items of fewer than ``min_words`` words occur without edits and between word borders only.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = 0) -> None:
        self.items = items
        self.cuts: list[list[int]] = []
        self.short = [text.count(" ") + 1 < min_words for _, text in items]
        self.allowed = [0 if s else budget(len(text)) for s, (_, text) in zip(self.short, items, strict=True)]
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            k = self.allowed[number]
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            self.cuts.append(cuts)
            for piece in range(k + 1):
                places.setdefault(text[cuts[piece] : cuts[piece + 1]], []).append((number, piece))
        self.machine = ahocorasick.Automaton()
        for word, where in places.items():
            self.machine.add_word(word, (len(word), where))
        if places:
            self.machine.make_automaton()

    def _climb(self, number: int, piece: int) -> Iterator[tuple[int, int]]:
        """The groups of pieces that hold a piece, from two or three up to all."""
        groups, a, b = [], 0, len(self.cuts[number]) - 1
        while b - a > 1:
            groups.append((a, b))
            mid = (a + b) // 2
            a, b = (a, mid) if piece < mid else (mid, b)
        return reversed(groups)

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, distance, start, end) of each item's nearest occurrence in a normalised text."""
        if not len(self.machine):
            return
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int, int, int]] = set()
        for last, (length, where) in self.machine.iter(text):
            for number, piece in where:
                cuts, item = self.cuts[number], self.items[number][1]
                origin = last + 1 - length - cuts[piece]
                known = best.get(number)
                if known and known[0] == 0:
                    continue
                if self.short[number] and (text[origin - 1 : origin].strip() or text[last + 1 : last + 2].strip()):
                    continue
                found = (0, last + 1)
                for a, b in self._climb(number, piece):
                    key = (number, a, b, origin)
                    if key in tried:
                        found = None
                        break
                    tried.add(key)
                    slack = b - a - 1
                    first = max(0, origin + cuts[a] - slack)
                    got = myers(item[cuts[a] : cuts[b]], text[first : max(0, origin + cuts[b] + slack)], slack)
                    if got is None:
                        found = None
                        break
                    found = (got[0], first + got[1])
                if found and (known is None or found < known):
                    best[number] = found
        for number, (distance, end) in sorted(best.items()):
            item = self.items[number][1]
            window = text[max(0, end - len(item) - self.allowed[number]) : end]
            back = myers(item[::-1], window[::-1], distance)
            yield number, distance, end - (back[1] if back else len(item)), end


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items that are sought, in blocks of bounded size; the driver holds one pass of them at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for i, text in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        text = normal(text)
        if text.count(" ") + 1 < LEAST_WORDS:
            continue
        if size + len(text) > BLOCK_CHARS and block:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    yield block


def passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Blocks as broadcasts, those of one pass over the documents together: at most PASS_BLOCKS * BLOCK_CHARS characters."""
    spark, waiting = items.sparkSession, []
    for block in blocks(items, id_col, text_col):
        waiting.append(spark.sparkContext.broadcast(block))
        if len(waiting) == PASS_BLOCKS:
            yield waiting
            waiting = []
    if waiting:
        yield waiting


class Held:
    """The automata of a pass, made when asked for; a worker keeps HELD_BLOCKS of them, the last ones used."""

    made: dict[tuple, Items] = {}

    def __init__(self, shared: list) -> None:
        self.shared = shared

    def __iter__(self) -> Iterator[Items]:
        for place in self.shared:
            block = place.value
            name = (len(block), hash(tuple(block)))
            items = Held.made.pop(name, None) or Items(block, MIN_WORDS)
            Held.made[name] = items
            while len(Held.made) > HELD_BLOCKS:
                del Held.made[next(iter(Held.made))]
            yield items


def _together(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[pa.RecordBatch]:
    """Batches in parts of PART_BYTES, or, where automata have to be made anew, many at once so that each is made seldom."""
    if len(held.shared) <= HELD_BLOCKS:
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for first in range(0, batch.num_rows, step):
                yield batch.slice(first, step)
        return
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= TOGETHER_BYTES:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, allowed, start, end, passage`` for each document that holds an item.

    Positions and the passage are those of the normalised text. Narrow: documents are not shuffled; items are broadcast at a
    bounded size, and a pass over the documents seeks PASS_BLOCKS blocks of them.
    """
    item_type = to_arrow_type(benchmark.schema[item_id_col].dataType)
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, distance int, allowed int, start int, end int, passage string"

    def one(shared: list) -> DataFrame:
        def run(batches):
            held = Held(shared)
            for batch in _together(batches, held):
                texts = [normal(t.as_py()) for t in batch.column(1)]
                rows = []
                for items in held:
                    for row, text in enumerate(texts):
                        for number, distance, start, end in items.find(text):
                            rows.append((row, items.items[number][0], distance, items.allowed[number], start, end, text[start:end]))
                if rows:
                    row, *cols = zip(*rows, strict=True)
                    kinds = [item_type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                    found = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *found], ["doc_id", "item_id", "distance", "allowed", "start", "end", "passage"])

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(one, passes(benchmark, item_id_col, item_text_col)))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage, with the passages."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns. Narrow, as ``leaks``; null texts stay."""
    place, schema = docs.columns.index(text_col), docs.schema
    for shared in passes(benchmark, item_id_col, item_text_col):

        def run(batches, shared=shared):
            held = Held(shared)
            for batch in _together(batches, held):
                texts = [normal(t.as_py()) for t in batch.column(place)]
                clean = [True] * len(texts)
                for items in held:
                    clean = [ok and next(items.find(text), None) is None for ok, text in zip(clean, texts, strict=True)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
