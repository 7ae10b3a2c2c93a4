"""Token counts by a compiled finite-state transducer.

Two machines are compiled from a byte-level BPE file. The outer one reads characters and cuts words off where the tokenizer's
split pattern does: whether a word begins at a character depends on at most four characters before it and one behind it, so
all cuts of a text are found at once from tables of character classes.

The inner one reads the bytes of words. BPE of a word's prefix is BPE of a shorter prefix plus one token, the only one ending
there that the merges leave beside the token before. What comes next depends on the places from which a token may still
reach beyond the present byte: a state is the list of those, each with its node in the trie of the vocabulary, the last token
before it, and the tokens since. Words that agree in this are in the same state, whatever came before. Each transition carries
the number of tokens that its byte adds to (or takes from) the count. States and transitions are compiled when first
reached and kept in a hash table that whole arrays are looked up in.

Texts are cut into chunks of CHUNK bytes. A chunk's map takes the state before it to the state behind it and the tokens between.
All chunks of a step are read side by side, byte by byte. A chunk in which a word begins has one state behind it, whatever came
before, so only its head waits for its neighbour's state. Chunks inside a long word get the part of their map that a guess asks
for (the state that the chunk before leads to from the start); neighbours whose maps fit together are composed by a prefix scan
of their counts, and a chunk that does not fit is read once more from the true state.

Defined results: null texts count as empty, with 0 tokens; the special string inside a text is one token, as the
library's default has it. Ids may be null or repeat; each row is counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from sparkloom.llm._text import segments, utf8

#: Bytes of a chunk, and of the texts that one step reads side by side.
CHUNK, STEP = 64, 1 << 19
#: Transitions that a worker keeps, checked before each step; at the limit it compiles anew, which costs time and changes no count.
KEPT = 1_000_000
TOKEN_LIMIT = 1024
#: Characters before a place that its cut may depend on, with room.
CONTEXT = 8

# The split pattern of the byte-level tokenizer is
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# Its suffixes behind an apostrophe:
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, BLANK, NOTHING = range(5)

START, IDLE = 0, 1
_SPREAD = 0x9E3779B97F4A7C15


def byte_symbols() -> list[str]:
    """The printable characters that stand for bytes 0 to 255 in the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def character_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    number = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[number[m.start() : m.end()]] = kind
    return kinds


class Edges:
    """Transitions (state, byte) -> (state, tokens), in a table that arrays are looked up in."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}  # state << 8 | byte -> state << 8 | tokens + 128
        self._room(16)

    def _room(self, bits: int) -> None:
        self.bits, self.keys, self.values = bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for key, value in self.known.items():
            self._put(key, value)

    def _put(self, key: int, value: int) -> None:
        at = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[at] >= 0:
            at = (at + 1) & ((1 << self.bits) - 1)
        self.keys[at], self.values[at] = key, value

    def add(self, key: int, value: int) -> None:
        self.known[key] = value
        if 3 * len(self.known) > 1 << self.bits:
            self._room(self.bits + 2)
        else:
            self._put(key, value)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys, and which are unknown."""
        at = ((keys.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[at]
        out = self.values[at]
        miss = np.flatnonzero(held != keys)
        missing = []
        while len(miss):
            free = held[miss] < 0
            missing.append(miss[free])
            miss = miss[~free]
            at[miss] = (at[miss] + 1) & ((1 << self.bits) - 1)
            held[miss] = self.keys[at[miss]]
            found = held[miss] == keys[miss]
            out[miss[found]] = self.values[at[miss[found]]]
            miss = miss[~found]
        return out, np.concatenate(missing) if missing else miss


class Transducer:
    """Counts the tokens of texts; made once in each worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in enumerate(byte_symbols())}
        word = lambda s: bytes(of[c] for c in s)
        self.ids = {word(s): i for s, i in spec["model"]["vocab"].items() if all(c in of for c in s)}
        self.text = {i: s for s, i in self.ids.items()}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = word(a), word(b)
            self.rank[self.ids[a], self.ids[b]] = (r, self.ids[a + b])
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.cut_special = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        self.kinds = character_classes()
        # The trie: node << 8 | byte -> node, the token that ends at a node, and the nodes that go on.
        self.child: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for data, token in self.ids.items():
            node = 0
            for byte in data:
                self.goes_on[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
                node = self.child[key]
            self.token[node] = token
        self._clear()

    # --- compilation ---

    def _clear(self) -> None:
        self.beside: dict[tuple[int, int], bool] = {}
        self.edges = Edges()
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._state(((0, -1, 0),))
        self._state(("idle",))
        for byte in range(256):
            self.edges.add(IDLE << 8 | byte, IDLE << 8 | 128)

    def _state(self, places: tuple) -> int:
        n = self.number.get(places)
        if n is None:
            n = self.number[places] = len(self.states)
            self.states.append(places)
        return n

    def _merged(self, data: bytes) -> list[int]:
        """BPE by its definition, for the short strings that compilation asks about."""
        parts = [self.ids[bytes((b,))] for b in data]
        while True:
            ranks = [(self.rank[p][0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not ranks:
                return parts
            k = min(ranks)[1]
            parts[k : k + 2] = [self.rank[parts[k], parts[k + 1]][1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps two tokens apart that stand side by side; with -1 on the left, whether it makes the right one."""
        known = self.beside.get((left, right))
        if known is None:
            known = self.beside[left, right] = self._merged((self.text[left] if left >= 0 else b"") + self.text[right]) == ([left, right] if left >= 0 else [right])
        return known

    def _compile(self, key: int) -> int:
        """The transition of a state and a byte: the longest token that ends with it and fits to what stands before."""
        byte = key & 255
        went = [(self.child[node << 8 | byte], last, since) for node, last, since in self.states[key >> 8] if node << 8 | byte in self.child]
        for node, last, since in went:
            token = self.token[node]
            if token >= 0 and self.fits(last, token):
                adds = 1 - since
                places = tuple((n, t, s + adds) for n, t, s in went if self.goes_on[n])
                value = self._state((*places, (0, token, 0))) << 8 | adds + 128
                self.edges.add(key, value)
                return value
        raise ValueError("the vocabulary lacks a byte")

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition in each lane: states, tokens."""
        keys = state << 8 | byte
        value, missing = self.edges.look(keys)
        if len(missing):
            fresh, of = np.unique(keys[missing], return_inverse=True)
            value[missing] = np.array([self._compile(int(k)) for k in fresh], np.int64)[of]
        return value >> 8, (value & 255) - 128

    # --- chunk maps ---

    def _read(self, state: int, data: bytes) -> tuple[int, list[int]]:
        """Reads one chunk from one state."""
        adds = []
        for byte in data:
            key = state << 8 | byte
            value = self.edges.known.get(key)
            if value is None:
                value = self._compile(key)
            state = value >> 8
            adds.append((value & 255) - 128)
        return state, adds

    def run(self, data: np.ndarray, begins: np.ndarray, state: int = START) -> tuple[np.ndarray, int]:
        """The tokens that each byte adds, and the state behind them. ``begins``: whether a word begins at a byte."""
        size = len(data)
        lanes = -(-size // CHUNK)
        byte, new = np.zeros(lanes * CHUNK, np.int64), np.zeros(lanes * CHUNK, bool)
        byte[:size], new[:size] = data, begins
        new[size:] = True
        byte, new = (np.ascontiguousarray(x.reshape(lanes, CHUNK).T) for x in (byte, new))
        adds = np.zeros((CHUNK, lanes), np.int64)
        has = new.any(axis=0)
        head = np.where(has, new.argmax(axis=0), CHUNK)
        # All chunks from their first word on; what stands before it idles.
        now = np.full(lanes, IDLE, np.int64)
        for k in range(CHUNK):
            now, adds[k] = self._step(np.where(new[k], START, now), byte[k])
        before = np.r_[state, now[:-1]]
        self._long_words(np.flatnonzero(~has), has, byte, adds, now, before)
        # The heads, whose states before are known by now.
        order = np.argsort(-head, kind="stable")
        order = order[has[order] & (head[order] > 0)]
        now_head, left = before[order], head[order]
        for k in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -k, "left"))
            order, left, now_head = order[:live], left[:live], now_head[:live]
            now_head, adds[k, order] = self._step(now_head, byte[k, order])
        # Bytes put in behind the last one begin words, so they change no state of a text that goes on.
        behind = int(now[-1]) if size % CHUNK == 0 or not lanes else self._behind(byte[:, -1], new[:, -1], size % CHUNK, int(before[-1]))
        return adds.T.reshape(-1)[:size], behind

    def _behind(self, byte: np.ndarray, new: np.ndarray, n: int, state: int) -> int:
        first = np.flatnonzero(new[:n])
        at = int(first[-1]) if len(first) else 0
        return self._read(START if len(first) else state, byte[at:n].astype(np.uint8).tobytes())[0]

    def _long_words(self, inside: np.ndarray, has: np.ndarray, byte: np.ndarray, adds: np.ndarray, now: np.ndarray, before: np.ndarray) -> None:
        """Fills in the chunks that lie inside a word, run by run of neighbours."""
        if not len(inside):
            return
        guess = before[inside].copy()
        unsure = np.flatnonzero((inside > 0) & ~has[np.maximum(inside - 1, 0)])
        if len(unsure):
            lane = inside[unsure] - 1
            g = np.full(len(lane), START, np.int64)
            for k in range(CHUNK):
                g, _ = self._step(g, byte[k, lane])
            guess[unsure] = g
        out = guess
        for k in range(CHUNK):
            out, adds[k, inside] = self._step(out, byte[k, inside])
        # Maps compose where a chunk's guess is what its neighbour leads to; a scan finds how far each run of such chunks goes.
        apart = np.r_[True, (inside[1:] != inside[:-1] + 1) | (guess[1:] != out[:-1])]
        last = np.r_[np.flatnonzero(apart)[1:], len(inside)]
        end = last[np.cumsum(apart) - 1]
        k = 0
        while k < len(inside):
            lane = int(inside[k])
            true = int(now[lane - 1]) if k and inside[k - 1] == lane - 1 else int(before[lane])
            if true == guess[k]:
                stop = int(end[k])
                now[inside[k:stop]] = out[k:stop]
                k = stop
            else:
                now[lane], adds[:, lane] = self._read(true, byte[:, lane].astype(np.uint8).tobytes())
                k += 1
            if lane + 1 < len(before):
                behind = int(inside[k - 1])
                if behind + 1 < len(before):
                    before[behind + 1] = now[behind]

    # --- words and texts ---

    def begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a word begins at each byte of texts that are laid side by side."""
        out = np.zeros(len(data), bool)
        if not len(data):
            return out
        place = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(code) + 1, bool)
        first[np.searchsorted(place, offsets)] = True
        first[-1] = True
        kind = self.kinds[code]
        left = np.where(first[:-1], NOTHING, np.r_[np.uint8(NOTHING), kind[:-1]])
        right = np.where(first[1:], NOTHING, np.r_[kind[1:], np.uint8(NOTHING)])
        space = np.r_[False, code[:-1] == 32] & ~first[:-1]
        new = (kind != left) & ~((kind != BLANK) & space)
        new |= (kind == BLANK) & (left == BLANK) & (right < BLANK)
        tick = np.flatnonzero((code == 39) & new)
        padded, edge = np.r_[code, np.zeros(3, np.uint32)], np.r_[first, True, True]
        for suffix in SUFFIXES:
            hit = tick
            for k, c in enumerate(suffix, 1):
                hit = hit[(padded[hit + k] == ord(c)) & ~edge[hit + k]]
            new[hit + 1] = False
            after = hit + 1 + len(suffix)
            new[after[after < len(new)]] = True
        out[place] = new
        return out

    def _pieces(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A long text in pieces, each with its word beginnings."""
        place = np.flatnonzero((data & 0xC0) != 0x80)
        for a in range(0, len(place), STEP):
            b = min(len(place), a + STEP)
            low, high = max(0, a - CONTEXT), min(len(place), b + CONTEXT)
            edges = [int(place[k]) if k < len(place) else len(data) for k in (low, a, b, high)]
            begins = self.begins(data[edges[0] : edges[3]], np.array([0, edges[3] - edges[0]]))
            yield data[edges[1] : edges[2]], begins[edges[1] - edges[0] : edges[2] - edges[0]]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of texts without special strings."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in segments(offsets, STEP):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if len(self.edges.known) > KEPT:
                self._clear()
            if len(part) <= 2 * STEP:
                adds, _ = self.run(part, self.begins(part, at)) if len(part) else (part, 0)
                out[a:b] = np.diff(np.r_[0, np.cumsum(adds)][at])
                continue
            state = START
            for piece, begins in self._pieces(part):
                if len(self.edges.known) > KEPT:
                    places = self.states[state]
                    self._clear()
                    state = self._state(places)
                adds, state = self.run(piece, begins, state)
                out[a] += int(adds.sum())
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; data are the UTF-8 bytes of all."""
        found = [m.span() for m in self.cut_special.finditer(data.tobytes())] if self.cut_special else []
        row = lambda at: np.searchsorted(offsets, at, "right") - 1
        found = np.array([(x, y) for x, y in found if row(x) == row(y - 1)], np.int64).reshape(-1, 2)
        if not len(found):
            return self._plain(data, offsets)
        cuts = np.unique(np.concatenate([offsets, found.reshape(-1)]))
        n = self._plain(data, cuts)
        n[np.searchsorted(cuts, found[:, 0])] = 1
        total = np.r_[0, np.cumsum(n)]
        return np.diff(total[np.searchsorted(cuts, offsets)])

    def count(self, text: str | None) -> int:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return int(self.counts(data, np.array([0, len(data)]))[0])


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row. Narrow: no shuffle. ``vocabulary`` is the file's path."""

    def run(batches):
        machine = transducer(vocabulary)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = machine.counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text in the 50k byte-level vocabulary."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
