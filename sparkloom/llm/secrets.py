"""Secret scans through a trigram index.

Each rule's regular expression gives a Boolean query over trigrams that every match must contain, with letters folded
to lower case. Texts are taken in segments of a few megabytes. A segment's inverted index maps the trigrams that any
query asks for to the texts that hold them; a query intersects and unites postings, and only the texts that it leaves
are verified with the expression. A rule whose expression has no mandatory trigram scans every text.

Defined results: a null text is an empty one and has no span. Equal texts have equal results; rows are never dropped.
Spans count code points, ends exclusive; per kind they are the leftmost ones that do not overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm._text import LOWER, segments, utf8

#: Bytes of text in one index segment.
SEGMENT_BYTES = 2 << 20
#: Most strings that an exact set may hold while a query is derived; beyond, the set is turned into its trigrams.
EXACT_LIMIT = 64


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans; ``keep`` judges a match; ``needs`` may replace the expression that the index sees."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None
    base: bool = False


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


# The base rules, in the order in which kinds are listed. A run of 24 or more digits is what is left of
# all runs after the short ones are dropped.
BASE = [
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", None, True),
    Rule("hex", r"[0-9a-f]{24,}", None, True),
]
# Rules that the scan adds: public formats of credentials.
ADDED = [
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?ai:bearer)\x20[A-Za-z0-9._~+/-]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,10}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
    Rule("stripe_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
]
RULES = [*BASE, *ADDED]

# A query is True (all texts), ("tri", bytes), ("and", [queries]) or ("or", [queries]).
Query = bool | tuple


def _all(parts: Iterable[Query]) -> Query:
    parts = [p for p in dict.fromkeys(x if not isinstance(x, tuple) else (x[0], x[1] if isinstance(x[1], bytes) else tuple(x[1])) for x in parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> Query:
    """What texts hold that contain one of the strings."""
    return _any(_all(("tri", s[i : i + 3]) for i in range(len(s) - 2)) for s in sorted(strings))


def _fold(code: int) -> bytes:
    return chr(code).encode().translate(bytes(LOWER))


#: ASCII letters that case-insensitive matching beyond ASCII takes other characters for.
_WIDE = {"k": "\u212a", "s": "\u017f", "i": "\u0130\u0131"}


def _literal(code: int, wide: bool) -> set[bytes] | None:
    """The folded strings that a literal matches; None where they cannot be told. ``wide``: any case, beyond ASCII."""
    if not wide:
        return {_fold(code)}
    if code > 127:
        return {_fold(code)} if chr(code).upper() == chr(code).lower() else None
    return {_fold(code), *(c.encode() for c in _WIDE.get(chr(code).lower(), ""))}


def _class_strings(items: list, wide: bool) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, value in items:
        codes = [value] if op is C.LITERAL else range(value[0], value[1] + 1) if op is C.RANGE and value[1] - value[0] <= EXACT_LIMIT else None
        if codes is None:
            return None
        for code in codes:
            strings = _literal(code, wide)
            if strings is None:
                return None
            out |= strings
    return out if len(out) <= 8 else None


def _flags(flags: int, add: int, drop: int) -> int:
    """Flags inside a group; a group's own kind of text, ASCII or not, replaces the outer one."""
    kinds = re.ASCII | re.UNICODE | re.LOCALE
    return (flags & ~kinds if add & kinds else flags) & ~drop | add


def _join(query: list[Query], left: set[bytes] | None, right: set[bytes] | None) -> set[bytes] | None:
    """The exact strings so far continued by the next ones; what cannot be kept goes into the query."""
    if left is None or right is None or len(left) * len(right) > EXACT_LIMIT:
        for side in (left, right):
            if side:
                query.append(_of_strings(side))
        return None
    return {a + b for a in left for b in right}


def _walk(items: Iterable, flags: int) -> tuple[set[bytes] | None, Query]:
    """Of a sequence: the strings that it matches exactly, or None, and a query that every match satisfies."""
    wide = bool(flags & re.IGNORECASE) and not flags & re.ASCII
    query: list[Query] = []
    run: set[bytes] | None = {b""}
    exact = True
    for op, value in items:
        piece: set[bytes] | None = None
        need: Query = True
        if op is C.LITERAL:
            piece = _literal(value, wide)
        elif op is C.IN:
            piece = _class_strings(value, wide)
        elif op is C.SUBPATTERN:
            piece, need = _walk(value[-1], _flags(flags, value[1], value[2]))
        elif op is C.BRANCH:
            sides = [_walk(x, flags) for x in value[1]]
            if all(s is not None for s, _ in sides) and sum(len(s) for s, _ in sides) <= EXACT_LIMIT:
                piece = set().union(*(s for s, _ in sides))
            else:
                need = _any(q if s is None else _all([q, _of_strings(s)]) for s, q in sides)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = value
            inner, deep = _walk(body, flags)
            if inner is not None and most <= 2 and len(inner) <= 4:
                piece = set()
                for n in range(least, most + 1):
                    grown: set[bytes] | None = {b""}
                    for _ in range(n):
                        grown = {a + b for a in grown for b in inner}
                    piece |= grown
            elif least and (inner is None or len(inner) <= 4):
                need = deep if inner is None else _all([deep, _of_strings(inner)])
        elif op is C.AT:
            piece = {b""}
        if need is not True:
            query.append(need)
        if piece is None:
            exact = False
            if run:
                query.append(_of_strings(run))
            run = {b""}
            continue
        joined = _join(query, run, piece)
        if joined is None:
            exact = False
            run = {b""} if len(piece) > 8 else set(piece)
        else:
            run = joined
    if exact:
        return run, _all(query)
    query.append(_of_strings(run))
    return None, _all(query)


def trigram_query(pattern: str) -> Query:
    """The Boolean query of trigrams that each match of ``pattern`` satisfies; True if it has no mandatory trigram."""
    parsed = _parser.parse(pattern)
    strings, query = _walk(parsed, parsed.state.flags)
    return _all([query, _of_strings(strings)]) if strings is not None else query


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1]))


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


class SegmentIndex:
    """Postings of a segment: for each trigram of ``wanted`` the texts (by number) that hold it, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> None:
        self.rows = len(offsets) - 1
        self.posting: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        low = LOWER[data].astype(np.int32)
        code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[row + 1]
        at, row = at[inside], row[inside]
        pair = np.unique(code[at].astype(np.int64) << 32 | row)
        if not len(pair):
            return
        grams = pair >> 32
        cuts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        for a, b in zip(cuts, [*cuts[1:], len(pair)], strict=True):
            self.posting[int(grams[a])] = pair[a:b] & 0xFFFFFFFF

    def find(self, query: Query) -> np.ndarray:
        """The texts that satisfy the query."""
        if query is True:
            return np.arange(self.rows)
        if query[0] == "tri":
            return self.posting.get(_code(query[1]), np.zeros(0, np.int64))
        found = [self.find(q) for q in query[1]]
        if query[0] == "and":
            found.sort(key=len)
            out = found[0]
            for other in found[1:]:
                out = np.intersect1d(out, other, assume_unique=True)
            return out
        return np.unique(np.concatenate(found))


class Scanner:
    """Rules with their queries; finds all spans in batches of text."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, q in self.rules:
            for gram in trigrams(q):
                self.wanted[_code(gram)] = True

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text: (start, number of the rule, end), in order."""
        data, offsets = utf8(column)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for a, b in segments(offsets, SEGMENT_BYTES):
            index = SegmentIndex(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.wanted)
            texts.clear()
            for k, (rule, pattern, query) in enumerate(self.rules):
                for row in index.find(query):
                    row = int(row) + a
                    text = texts.get(row)
                    if text is None:
                        text = texts[row] = column[row].as_py() or ""
                    for m in pattern.finditer(text):
                        if rule.keep is None or rule.keep(m):
                            found[row].append((m.start(), k, m.end()))
        for row in found:
            row.sort()
        return found




def joined(rules: list[Rule], spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def scan(docs: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` for each row. Narrow: the index lives in the task that made it."""
    rules = RULES if rules is None else rules
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(rules)
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in row] for row in scanner.spans(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["doc_id", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scan with RULES as counts of the base kinds, a checksum of the base spans, and all spans as text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(RULES)
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in batches:
            rows = scanner.spans(batch.column(1))
            counts = [pa.array([sum(x[1] == k for x in row) for row in rows], pa.int64()) for k in range(len(BASE))]
            sha = [hashlib.sha256(joined(RULES, (x for x in row if x[1] < len(BASE))).encode()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([joined(RULES, row) for row in rows], pa.string())], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op1_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets in all documents."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
