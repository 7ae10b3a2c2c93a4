"""Markdown into chunks: sections by heading and page, cut where too long, packed while short.

The packing is a fold over a document's sections, so it runs in Arrow batches, one document at a time, with no shuffle.
Neighbours and lookups are relational.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.identity import chunk_id, source_key
from sparkloom.functions.text import HEADING, page_marker

TARGET_TOKENS, MAX_TOKENS = 4000, 8000
PAGE_TAG = "sparkloom"
CHUNK_SCHEMA = "source string, `index` int, text string, heading_path array<string>, page_start int, page_end int"

#: Characters of chunks that a worker holds before it gives them back, and what a chunk counts beside its text.
BATCH_CHARS, ROW_CHARS = 1_000_000, 100

#: Counts tokens of a text. Any callable that can be pickled will do; one with ``starts`` (see ``PatternTokens``) is asked once per text.
TokenCounter = Callable[[str], int]


class PatternTokens:
    """The default counter: words, numbers and marks. A vocabulary's own counter moves the borders between chunks.

    ``starts`` gives the places where tokens begin. Tokens end at white space and a text cut where one begins has the same tokens
    as before, so counts of parts add up and a text is read once, however often it is cut and packed.
    """

    pattern = re.compile(r"[^\W\d_]{1,6}|\d{1,3}|[^\w\s]|_")

    def __call__(self, text: str) -> int:
        return len(self.pattern.findall(text))

    def starts(self, text: str) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text)]


pattern_tokens = PatternTokens()


@dataclass
class Section:
    text: str
    path: list[str]
    first: int | None = None
    last: int | None = None
    tokens: int = 0


def sections(markdown: str, tag: str = PAGE_TAG) -> Iterator[Section]:
    """Sections between headings and page markers; a heading opens its section, a marker is left out."""
    heading, marker = re.compile(HEADING), re.compile(page_marker(tag))
    stack: list[str] = []
    lines: list[str] = []
    path: list[str] = []
    page: int | None = None

    def close() -> Iterator[Section]:
        text = "\n".join(lines).strip()
        if text:
            yield Section(text, list(path), page, page)
        lines.clear()

    for line in markdown.splitlines():
        if at := marker.match(line):
            yield from close()
            page = int(at[1])
        elif at := heading.match(line):
            yield from close()
            stack[len(at[1]) - 1 :] = [at[2].strip()]
            path = list(stack)
            lines.append(line)
        else:
            lines.append(line)
    yield from close()


def _cut_point(text: str, most: int, count: TokenCounter) -> int:
    """Where to cut a text that is too long: at the last white space of the longest prefix that fits, if in its second half."""
    low, high = 1, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid - 1)
    gaps = [m.start() for m in re.finditer(r"\s+", text[: low + 1])]
    return gaps[-1] if gaps and gaps[-1] >= max(1, low // 2) else low


_GAP = re.compile(r"\s*")


def _cut_by_starts(text: str, most: int, starts: list[int]) -> Iterator[tuple[str, int]]:
    """What ``_cut_point`` leads to again and again, from the places of the tokens of the whole text."""
    at, token = 0, 0
    while len(starts) - token > most:
        low = starts[token + most] - at
        window = text[at : at + low + 1]
        head = window.rstrip() if window[-1:].isspace() else window.rsplit(None, 1)[0]
        gap = len(head) if len(head) < len(window) else 0
        cut = gap if gap >= max(1, low // 2) else low
        end = at + cut
        upto = bisect_left(starts, end)
        yield text[at:end].rstrip(), upto - token
        at, token = _GAP.match(text, end).end(), upto
    if at < len(text):
        yield text[at:], len(starts) - token


def split_long(text: str, most: int, count: TokenCounter) -> Iterator[tuple[str, int]]:
    """A section in parts of at most ``most`` tokens, with their tokens: by paragraphs, and those by white space."""
    total = count(text)
    if total <= most:
        yield text, total
        return
    known = getattr(count, "starts", None)
    held: list[str] = []
    size = 0
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        starts = known(paragraph) if known else []
        n = len(starts) if known else count(paragraph)
        both = size + n if known else count("\n\n".join([*held, paragraph])) if held else n
        if both <= most:
            held.append(paragraph)
            size = both
            continue
        if held:
            yield "\n\n".join(held), size
        held, size = [], 0
        if n <= most:
            held, size = [paragraph], n
        elif known:
            yield from _cut_by_starts(paragraph, most, starts)
        else:
            while n > most:
                at = _cut_point(paragraph, most, count)
                head = paragraph[:at].rstrip()
                yield head, count(head)
                paragraph = paragraph[at:].lstrip()
                n = count(paragraph)
            if paragraph:
                yield paragraph, n
    if held:
        yield "\n\n".join(held), size


def shared_path(a: list[str], b: list[str]) -> list[str]:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def pack(parts: list[Section], target: int, most: int, count: TokenCounter) -> list[Section]:
    """Neighbours joined while the first is under the target and both together fit."""
    adds = hasattr(count, "starts")
    out: list[Section] = []
    texts: list[list[str]] = []
    for part in parts:
        if out and out[-1].tokens < target:
            last = out[-1]
            both = last.tokens + part.tokens if adds else count("\n\n".join([*texts[-1], part.text]))
            if both <= most:
                first = part.first if last.first is None else last.first
                end = last.last if part.last is None else part.last
                texts[-1].append(part.text)
                out[-1] = Section("", shared_path(last.path, part.path), first, end, both)
                continue
        out.append(part)
        texts.append([part.text])
    for chunk, pieces in zip(out, texts, strict=True):
        chunk.text = "\n\n".join(pieces)
    return out


def chunk_markdown(markdown: str, *, count: TokenCounter = pattern_tokens, target: int = TARGET_TOKENS, most: int = MAX_TOKENS, tag: str = PAGE_TAG) -> list[Section]:
    """The chunks of one document, in order (C01); parts without a letter or digit go."""
    parts = [Section(text, s.path, s.first, s.last, n) for s in sections(markdown, tag) for text, n in split_long(s.text, most, count) if any(c.isalnum() for c in text)]
    return pack(parts, target, most, count)


def chunk_documents(docs: DataFrame, *, count: TokenCounter = pattern_tokens, target: int = TARGET_TOKENS, most: int = MAX_TOKENS, tag: str = PAGE_TAG) -> DataFrame:
    """``id, source, index, text, heading_path, page_start, page_end`` of ``source, markdown`` rows. Narrow."""

    types = pa.schema([("source", pa.string()), ("index", pa.int32()), ("text", pa.string()), ("heading_path", pa.list_(pa.string())), ("page_start", pa.int32()), ("page_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One document at a time is taken from Arrow, and chunks are given back before they are many.
        for batch in batches:
            rows, size = [], 0
            for source, markdown in zip(batch.column("source"), batch.column("markdown"), strict=True):
                name = source.as_py()
                for k, c in enumerate(chunk_markdown(markdown.as_py() or "", count=count, target=target, most=most, tag=tag)):
                    rows.append((name, k, c.text, c.path, c.first, c.last))
                    size += len(c.text) + ROW_CHARS
                if size >= BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    out = docs.select("source", "markdown").mapInArrow(run, CHUNK_SCHEMA)
    return out.select(chunk_id(source_key(F.col("source")), F.col("index")).alias("id"), "*")


def page_range_errors(chunks: DataFrame) -> DataFrame:
    """Chunks whose pages break the rules: both or neither, from 1, end not before start (§1.2)."""
    start, end = F.col("page_start"), F.col("page_end")
    return chunks.where((start.isNull() != end.isNull()) | (start < 1) | (end < start))


def neighborhood(chunks: DataFrame) -> DataFrame:
    """Each chunk with the ids of the chunks before and after it in its source."""
    line = Window.partitionBy("source").orderBy("index")
    return chunks.withColumns({"previous_id": F.lag("id").over(line), "next_id": F.lead("id").over(line)})


def neighbors(chunks: DataFrame, source: str, item: str) -> DataFrame:
    """The chunk, its predecessor and its successor with their place (-1, 0, 1), by index; an unknown chunk raises."""
    own = chunks.where((F.col("source") == source) & (F.col("id") == item)).select("index").first()
    if own is None:
        raise ValueError(f"unknown chunk {item!r} in {source!r}")
    return chunks.where((F.col("source") == source) & F.col("index").between(own[0] - 1, own[0] + 1)).withColumn("place", F.col("index") - own[0])


def in_requested_order(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The chunks that ``source, ids`` rows ask for, in the order asked; unknown ids are left out."""
    asked = requests.select(F.col("source").alias("__s"), F.posexplode("ids").alias("place", "__id"))
    return chunks.join(asked, (F.col("source") == F.col("__s")) & (F.col("id") == F.col("__id"))).drop("__s", "__id").orderBy("source", "place")
