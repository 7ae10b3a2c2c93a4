"""The corpus operators against brute force, exact round trips and held-out accuracy, on odd inputs as well."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import decontaminate, license_scan, mixing, near_dup, quality, secrets, shard_map, tiff, token_count, url_filter
from sparkloom.llm._text import LOWER, SPACE, WORDS, shingle_hashes, word_hashes
from sparkloom.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, slot long, `__rank` int"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))


def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named as operators name theirs."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n", "en", "a", 4), (4, LONG, "en", "b", 1), (5, "same text here for all of you", "en", "a", 2), (6, "same text here for all of you", "en", None, 2), (7, "one", "en", "b", 3), (7, "one", "en", "b", 3), (8, "MIT license token=abcdef123 <|endoftext|>", "en", "a", 3)]
    return spark.createDataFrame([(*r, 0.5, 9, 9, 9) for r in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared ------------------------------------------------------------------------------------------------------------


def test_words_and_shingles():
    texts = ["a b  c\td", "", " x", "a b c d e f", "é é", LONG * 3]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words, rows = word_hashes(data, offsets, WORDS)
    assert np.bincount(rows, minlength=6).tolist() == [len(t.split()) for t in texts]
    by_word = defaultdict(set)
    for h, w in zip(words, [w for t in texts for w in t.split()], strict=True):
        by_word[w].add(int(h))
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    _, at = shingle_hashes(words, rows, 5)
    assert np.bincount(at, minlength=6).tolist()[:5] == [1, 0, 1, 2, 1]
    assert SPACE.sum() == 6


# --- op1 -----------------------------------------------------------------------------------------------------------------


def plain_base(text):
    key = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")) + ")"
    key = key.replace("|[Aa][Pp][Ii])", "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
    rules = [(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) > 5), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) > 19), ("[0-9a-f]+", lambda m: len(m[0]) > 23)]
    return sorted((m.start(), k, m.end()) for k, (p, keep) in enumerate(rules) for m in re.finditer(p, text) if keep(m))


def test_secret_spans_match_brute_force():
    random.seed(2)
    bits = ["password", "Token", "SECRET", "apikey", "api_key", " ", "=", ":", '"', "'", "abcdef", "AKIA", "ABCDEFGH1234", "0123456789ab", "ſecret", "é", "\n", "ghp_", "-----BEGIN RSA PRIVATE KEY-----", "bearer ", "eyJ", "."]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    got = secrets.Scanner(secrets.RULES).spans(pa.array(texts))
    assert [[s for s in row if s[1] < 3] for row in got] == [plain_base(t) for t in texts]
    everything = [sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t) if r.keep is None or r.keep(m)) for t in texts]
    assert got == everything


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") is True
    assert secrets.trigrams(secrets.trigram_query("AKIA[A-Z0-9]{16,}")) == {b"aki", b"kia"}
    assert secrets.trigram_query("(abc|x)") is True


def test_secrets_on_odd_rows(spark):
    got = {r.doc_id: r for r in secrets.digest(odd(spark)).collect()}
    assert got[1].base_sha256 == got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert (got[8].n_assign, got[8].spans) == (1, "assign:12:27")
    assert secrets.digest(odd(spark)).count() == 9 and secrets.digest(none(spark)).count() == 0
    assert [s.kind for s in secrets.scan(odd(spark)).where("doc_id = 8").first().spans] == ["assign"]


@pytest.mark.parametrize("pattern", ["(?i:abcK)", "(?i)tokens?-[ks]i", "(?i:(?a:kiss)me)", "(?ai:kiss)me", "(?i:straße)x", "(?i:[hk]is)s"])
def test_trigram_queries_miss_no_case(pattern):
    texts = ["".join(t) for t in product("ab", "b", "cC", ["K", "k", "\u212a"])] + ["TOKEN\u017f-\u212aI", "token-s\u0131", "TOKENS-\u017f\u0130", "\u212ai\u017f\u017fme", "KISSme", "kissme", "STRASSEX", "straßex", "STRAẞEX", "his\u017f", "\u212aISs"]
    query = secrets.trigram_query(pattern)
    found = re.compile(pattern)
    for text in texts:
        grams = {text.encode().translate(bytes(LOWER))[i : i + 3] for i in range(len(text.encode()))}
        holds = lambda q: q is True or (q[1] in grams if q[0] == "tri" else (all if q[0] == "and" else any)(holds(x) for x in q[1]))  # noqa: B023, E731
        assert not found.search(text) or holds(query), (pattern, text, query)


# --- op2 -----------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 100).cast("int")).alias("text"))
    out, slots = shard_map.assign(rows)
    got = out.toPandas()
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - loads.min() < 100 and len(loads) == 16
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    again = slots.rebalanced(*shard_map.slot_loads(shard_map.records(rows, "doc_id", "text", 4096), 4096)[:1], shards=17)
    assert again.version == slots.version + 1 and again.moved < 4096 / 8
    load = again.loads(shard_map.slot_loads(shard_map.records(rows, "doc_id", "text", 4096), 4096)[0])
    assert max(load) - min(load) < 2000


def test_slot_map_versions(spark, tmp_path):
    first = shard_map.SlotMap.spread([5, 1, 9, 2], 2)
    first.save(spark, str(tmp_path))
    second = first.rebalanced([50, 1, 9, 2], 3)
    second.save(spark, str(tmp_path))
    held = shard_map.SlotMap.load(spark, str(tmp_path))
    assert (held.owner, held.shards, held.moved, held.history) == (second.owner, 3, second.moved, [(1, first.owner)])
    assert shard_map.SlotMap.load(spark, str(tmp_path), 1).owner == first.owner
    # The last shard may own nothing.
    shard_map.SlotMap(5, [0, 1, 0, 1], 3).save(spark, str(tmp_path))
    assert shard_map.SlotMap.load(spark, str(tmp_path)).shards == 5
    assert max(second.rebalanced([5, 1, 9, 2], 2).owner) == 1


def test_stored_map_is_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    _, first = shard_map.assign(docs, map_path=path)
    _, same = shard_map.assign(docs, map_path=path)
    assert same.version == first.version and same.owner == first.owner
    more, grown = shard_map.assign(docs, map_path=path, shards=17)
    assert grown.version == first.version + 1 and 0 < grown.moved < 4096 / 8 and more.select("map_version").distinct().collect()[0][0] == grown.version
    assert [v for v, _ in shard_map.SlotMap.load(spark, path).history] == list(range(1, grown.version))
    assert shard_map.SlotMap.load(spark, path, 1).shards == 16


def test_shards_match_a_plain_version(spark):
    random.seed(8)
    rows = [(i, "é" * random.randint(0, 300) if i % 7 else None) for i in range(700)] + [(5, "twice"), (5, "twice"), (None, "no id")]
    out, slot_map = shard_map.assign(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in out.select("doc_id", "size", "text_crc32", "shard", "slot", "vslot").collect()), key=lambda r: (r[3], r[4]))
    assert Counter(r[:3] for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    # Places count on by virtual slot, then id; equal ids and texts share a virtual slot.
    place = {}
    for shard in range(16):
        mine = [r for r in got if r[3] == shard]
        assert [r[4] for r in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda r: (r[5], r[0] is not None, r[0] or 0, r[2]))
        assert all(slot_map.owner[r[5]] == shard for r in mine)
        for r in mine:
            assert place.setdefault((r[0], r[2]), r[5]) == r[5]
    # The first map, dealt by hand: slots by falling bytes, each to the emptiest shard; then the fullest gives to the emptiest.
    slot_bytes = [0] * 4096
    for r in got:
        slot_bytes[r[5]] += r[1]
    load, owner = [0] * 16, {}
    for slot in sorted(range(4096), key=lambda k: -slot_bytes[k]):
        owner[slot] = load.index(min(load))
        load[owner[slot]] += slot_bytes[slot]
    assert max(slot_map.loads(slot_bytes)) <= max(load) and sum(slot_map.loads(slot_bytes)) == sum(r[1] for r in got)


def test_names_that_operators_use_inside(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of a few words", "a", i, 2 * i, 3 * i, {"k": i}, i) for i in range(20)], "doc_id long, text string, source string, `__hash` long, `__vslot` long, `__shard` long, m map<string,int>, `__row` long")
    shards = shard_map.attach(docs)
    assert shards.columns == [*docs.columns, "shard"] and {(r["doc_id"], r["__vslot"], r["__shard"]) for r in shards.collect()} == {(i, 2 * i, 3 * i) for i in range(20)}
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and all(r["__hash"] == r["doc_id"] == r["m"]["k"] for r in taken.collect())
    twice = docs.unionByName(docs)
    kept = near_dup.keep_one(twice)
    assert kept.columns == docs.columns and all(r["__row"] == r["doc_id"] for r in kept.collect())
    assert mixing.take(twice).columns == docs.columns


def test_shards_on_odd_rows(spark):
    out, _ = shard_map.assign(odd(spark))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 9 and (got[1]["size"], got[1].text_crc32) == (1, 0)
    assert got[8].text_crc32 == zlib.crc32(b"MIT license token=abcdef123 <|endoftext|>")
    assert shard_map.assign(none(spark))[0].count() == 0
    assert shard_map.attach(odd(spark)).columns.count("shard") == 1 and shard_map.attach(odd(spark)).count() == 9


# --- op3 -----------------------------------------------------------------------------------------------------------------


def tiff_file(pages, order="<", big=False):
    """A file of directories (tags, blocks), made by hand; the blocks' places and sizes are added to the tags."""
    out, link = bytearray(b"II" if order == "<" else b"MM"), 8 if big else 4
    out += struct.pack(f"{order}HHHQ", 43, 8, 0, 0) if big else struct.pack(f"{order}HI", 42, 0)
    word, unit, room = ("Q", 16, 8) if big else ("I", 4, 4)
    for tags, blocks in pages:
        places = []
        for b in blocks:
            places.append(len(out))
            out += b
        entries = bytearray()
        fields = {**tags, 273: places, 279: [len(b) for b in blocks]}
        for tag, values in sorted(fields.items()):
            raw = struct.pack(f"{order}{len(values)}{word}", *values)
            if len(raw) > room:
                raw, at = struct.pack(f"{order}{word}", len(out)), raw
                out += at
            entries += struct.pack(f"{order}HH{word}", tag, unit, len(values)) + raw.ljust(room, b"\0")
        struct.pack_into(f"{order}{word}", out, link, len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(fields)) + entries
        link = len(out)
        out += struct.pack(f"{order}{word}", 0)
    return bytes(out)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages_of_other_depths(order, big):
    wide = np.arange(12, dtype=np.uint16).reshape(2, 3, 2) * 5003
    pages = [
        ({256: [10], 257: [2], 258: [1]}, [bytes([0b10110011, 0b01000000, 0b00000001, 0b10000000])]),
        ({256: [3], 257: [2], 258: [4], 278: [1]}, [bytes([0x1F, 0xA0]), bytes([0x23, 0x40])]),
        ({256: [9], 257: [9], 258: [8], 259: [7]}, [b"jpeg"]),
        ({256: [3], 257: [2], 258: [16, 16], 277: [2], 259: [tiff.DEFLATE], 317: [2]}, [zlib.compress(np.diff(wide, axis=1, prepend=np.zeros_like(wide[:, :1])).astype(f"{order}u2").tobytes())]),
        ({256: [2], 257: [2], 258: [8, 8, 8], 277: [3], 278: [1], 284: [2]}, [bytes([10 * k, 10 * k + 1]) for k in range(6)]),
    ]
    got = list(tiff.page_rows(tiff_file(pages, order, big)))
    assert [r[0] for r in got] == [0, 1, 2, 3, 4] and [r[8] for r in got] == [None, None, "compression 7 is not supported", None, None]
    assert [r[9] for r in got] == [1, 4, None, 16, 8]
    assert list(got[0][7]) == [1, 0, 1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0]
    assert list(got[1][7]) == [1, 15, 10, 2, 3, 4] and got[3][7] == wide.astype("<u2").tobytes()
    assert list(got[4][7]) == [0, 20, 40, 1, 21, 41, 10, 30, 50, 11, 31, 51]


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 4, (70, 50, 3), dtype=np.uint8) * 60, rng.integers(0, 255, (5, 900, 1), dtype=np.uint8), np.zeros((1, 1, 1), np.uint8)]
    blob = tiff.write_pages(images, compression=compression, predictor=predictor, tile=tile, order=order, rows_per_strip=16)
    assert all((a == p.pixels).all() for a, p in zip(images, tiff.read_pages(blob), strict=True))


def test_tiff_pages_and_damage(spark):
    blob = tiff.store(tiff.payload(b"x" * 576 * 100))
    loop = bytearray(tiff.write_pages([np.zeros((2, 2, 1), np.uint8)]))
    loop[-4:] = loop[4:8]
    rows = [(1, bytearray(blob)), (2, None), (3, bytearray(b"no")), (4, bytearray(blob[:-300])), (5, bytearray(bytes(loop)))]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "page int, media binary").withColumn("id", F.col("page"))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    assert [(p.page, p.page_height) for p in by[1]] == [(0, 64), (1, 36)] and len(by[5]) == 1
    assert 2 not in by and 3 not in by and by[4][-1].error
    assert tiff.tiff_pages(spark.createDataFrame([], "media binary")).count() == 0


def test_tiff_damage_gives_error_rows():
    page = lambda tags, blocks: list(tiff.page_rows(tiff_file([({256: [8], 257: [200], 258: [8], **tags}, blocks), ({256: [2], 257: [1], 258: [8]}, [b"ok"])])))
    sides, full = {256: [1 << 31], 257: [1 << 31]}, [bytes(16 * 8)] * 12 + [bytes(8 * 8)]
    assert [r[8] for r in page({278: [16]}, full)] == [None, None]
    for tags, blocks in (({278: [16]}, full[:1]), ({278: [0]}, full), ({}, []), ({257: []}, full), (sides, full), ({259: [tiff.DEFLATE], **sides}, full), ({322: [0], 323: [16], 324: [8], 325: [8]}, full), ({277: [0]}, full), ({259: [tiff.LZW]}, full), ({278: [16]}, [b"x", *full[1:]])):
        rows = page(tags, blocks)
        assert rows[0][8] and rows[0][7] is None and rows[1][8] is None and rows[1][7] == b"ok", (tags, rows[0][8])
    mirrored = page({256: [2], 257: [1], 266: [2]}, [bytes([0b10000000, 0b11000000])])
    assert list(mirrored[0][7]) == [1, 3]


def test_tiff_fuzz():
    rng = random.Random(9)
    grid = np.frombuffer(rng.randbytes(40 * 30 * 3), np.uint8).reshape(40, 30, 3) & 15
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for tile in (None, (16, 16)):
            blob = tiff.write_pages([grid, grid[:7]], compression=compression, predictor=2, tile=tile, rows_per_strip=9)
            assert all(r[8] is None for r in tiff.page_rows(blob))
            for _ in range(150):
                bad = bytearray(blob)
                for _ in range(rng.randint(1, 6)):
                    bad[rng.randrange(4, len(bad)) if rng.random() < 0.5 else -rng.randint(1, 350)] = rng.choice([0, 1, 255, rng.randrange(256)])
                for r in tiff.page_rows(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])])):
                    assert (r[7] is None) == (r[8] is not None)
                    assert r[7] is None or len(r[7]) == r[1] * r[2] * r[3] * (2 if r[9] == 16 else 1)


def test_tiff_forms_of_texts():
    rng = random.Random(10)
    texts = ["".join(rng.choice("abc \n") for _ in range(rng.randint(1, 90_000))).encode() for _ in range(60)]
    seen = set()
    for text in texts:
        data = tiff.payload(text)
        blob = tiff.store(data)
        pages = list(tiff.read_pages(blob))
        assert b"".join(p.pixels.tobytes() for p in pages) == data and blob == tiff.store(data)
        seen |= {(p.compression, p.predictor, p.tiled) for p in pages}
        flat = [list(data[k : k + 576 * 64]) for k in range(0, len(data), 576 * 64)]
        mean = sum(data) / len(data)
        sd = (sum(b * b for b in data) / len(data) - mean * mean) ** 0.5
        rising = sum(b > a for page in flat for a, b in zip(page, page[1:], strict=False)) / sum(len(page) - 1 for page in flat)
        hist = Counter(b // 32 for b in data)
        assert tiff.features(pages) == f"pages={len(flat)};rows={len(data) // 576};mean={mean:.4f};sd={sd:.4f};rising={rising:.4f};hist=" + ",".join(str(hist[k]) for k in range(8))
    assert {c for c, _, _ in seen} == {tiff.LZW, tiff.PACKBITS, tiff.DEFLATE} and {p for _, p, _ in seen} == {1, 2} and {t for _, _, t in seen} == {True, False}


def test_tiff_digests(spark):
    got = {r.doc_id: r for r in tiff.text_media(odd(spark)).collect()}
    for i, text in ((1, b""), (2, b""), (8, b"MIT license token=abcdef123 <|endoftext|>"), (4, LONG.encode())):
        payload = text + b"\xff" * (max(576, -(-len(text) // 576) * 576) - len(text))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[5].feature == got[6].feature and tiff.text_media(none(spark)).count() == 0


# --- op4 -----------------------------------------------------------------------------------------------------------------

URLS = ["http://A.Org/x?y", "https://b.example.org/es/1", "https://example.org/en/12", "http://x.com/fr/", "http://com/de/1#z", "http://x.net/a", "nothing", None, "http://org", "http://xorg/", "ftp://a.com?x/fr/", "http://É.org/"]


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_model(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id int, url string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for i, url in enumerate(URLS):
        host, path = plain_url(url)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.filter_urls(pages.where("false")).count() == 0
    alone = url_filter.filter_urls(pages.where("page_id IN (5, 6)"))
    assert {(r.verdict, r.score) for r in alone.collect()} == {("allow", 0.0)}


def test_url_model_is_smoothed_and_tells_kinds_apart(spark):
    words = ["cats", "dogs", "birds"]
    rows = [(i, f"http://h{i}.org/{words[i % 3]}/{i}", "g") for i in range(60)] + [(100 + i, f"http://h{i}.example.org/es/zzqq{i}", "b") for i in range(60)] + [(300, "http://new.net/zzqq1", ""), (301, "http://new.net/dogs/7", "")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id int, url string, x string")).collect()}
    assert got[301].score > got[300].score and got[300].verdict == "block"
    judged = spark.createDataFrame([([0, 1, 2, 3], 1), ([0, 1, 7], 0)], "gram array<int>, accepted int")
    assert url_filter.model_table(judged).where("isnan(diff) OR diff IS NULL").count() == 0


# --- op5 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def machine():
    return token_count.Transducer(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(machine, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(1)
    bits = ["a", " ", "  ", "\n", "'s", "'ll", "é", "ñ", "1", "23", "!", "…", "the", "ing", "\t", chr(0xA0), "<|endoftext|>", chr(0x1F600), "AB", chr(0x3000), "re", "'", "'v", "漢字"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += [LONG, "x" * 5000, "ab" * 3000 + " ", " " * 3000, "é" * 700, "=-" * 900, "".join(random.choice("abcdefgh") for _ in range(9000)), "'s" * 300]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for chunk, step in ((64, 1 << 19), (7, 1 << 19), (3, 50), (64, 700)):
        monkeypatch.setattr(token_count, "CHUNK", chunk)
        monkeypatch.setattr(token_count, "STEP", step)
        assert machine.counts(data, offsets).tolist() == expected


def test_word_beginnings_equal_the_pattern(machine):
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    random.seed(2)
    for _ in range(3000):
        text = "".join(random.choice("a'strevld1 \n\t!" + chr(0xA0) + "é") for _ in range(random.randint(1, 14)))
        data = text.encode()
        got = machine.begins(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert np.flatnonzero(got).tolist() == [len(text[: m.start()].encode()) for m in pattern.finditer(text)], text


def test_chunk_maps_compose(machine):
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(900)).encode()
    data, begins = np.frombuffer(text, np.uint8), np.zeros(900, bool)
    whole, end = machine.run(data, begins)
    for cut in (1, 63, 64, 65, 500, 899):
        left, middle = machine.run(data[:cut], begins[:cut])
        right, last = machine.run(data[cut:], begins[cut:], middle)
        assert last == end and np.r_[left, right].tolist() == whole.tolist()


def test_kept_states_do_not_matter(machine, monkeypatch):
    texts = [" ".join(f"word{i}{j}" for j in range(30)) for i in range(30)] + ["abcdefg" * 2000]
    expected = [machine.count(t) for t in texts]
    monkeypatch.setattr(token_count, "KEPT", 20)
    monkeypatch.setattr(token_count, "STEP", 1000)
    machine._clear()
    assert [machine.count(t) for t in texts] == expected


def test_token_counts_on_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_count.token_counts(odd(spark), path).collect()}
    assert (got[1].n_tokens, got[2].n_tokens, got[4].over_limit, got[1].n_bytes) == (0, 0, True, 0)
    assert token_count.token_counts(none(spark), path).count() == 0


# --- op6 -----------------------------------------------------------------------------------------------------------------


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row), row.index(min(row))


def test_myers_distance():
    random.seed(3)
    for _ in range(200):
        p, t = ("".join(random.choice("abc ") for _ in range(random.randint(1, n))) for n in (40, 60))
        assert decontaminate.myers(p, t, 99) == plain_distance(p, t)


def test_every_occurrence_within_the_budget_is_found():
    random.seed(4)
    items = [(i, "".join(random.choice("abcde ") for _ in range(60))) for i in range(4)]
    found = decontaminate.Items(items)
    for _ in range(150):
        copy = list(random.choice(items)[1])
        for _ in range(random.randint(0, 9)):
            k, how = random.randrange(len(copy)), random.random()
            copy[k : k + 1] = [] if how < 0.33 else [random.choice("abcde ")] if how < 0.66 else [copy[k], "e"]
        text = "".join(random.choice("abcde ") for _ in range(30)) + "".join(copy) + "abcde"
        expected = {n: d for n, (_, p) in enumerate(items) if (d := plain_distance(p, text)[0]) <= 6}
        assert {n: d for n, d, _, _ in found.find(text)} == expected


def test_leaks_on_odd_rows(spark):
    items = spark.createDataFrame([(1, "Same text, here: for ALL of you, my friend!"), (2, None), (3, "one"), (1, "Same text, here: for ALL of you, my friend!")], "item_id int, text string")
    docs = odd(spark).unionByName(spark.createDataFrame([(20, "xx same text here for all of yu my friend yy", None, None, 1, 0.1, 1, 1, 1)], SCHEMA))
    got = decontaminate.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.distance, r.passage) for r in got} == {(20, 1, 1, "same text here for all of yu my friend")} and len(got) == 2
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns and decontaminate.drop_leaks(docs, items).count() == 9
    assert decontaminate.leaks(none(spark), items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def test_short_items_are_found_between_word_borders(spark):
    items = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "two words"), (3, " .. ")], "item_id int, text string")
    texts = ["who wrote faust", "So: WHO wrote, Faust (1808)", "who wrote fausts", "awho wrote faust; who wrote faust", "who wrot faust", "two wordsmiths", "in two words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.leaks(docs, items).collect()}
    where = {0: (0, 15), 1: (3, 18), 3: (17, 32)}
    assert got == {(d, 1, 0, 0, a, b, "who wrote faust") for d, (a, b) in where.items()} | {(6, 2, 0, 0, 3, 12, "two words")}
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {2, 4, 5, 7, 8}


def test_blocks_of_items(spark, monkeypatch):
    # Nine blocks in three passes; a worker keeps the automata of two.
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    monkeypatch.setattr(decontaminate, "PASS_BLOCKS", 4)
    items = spark.createDataFrame([(i, f"item number {i} has these words and some {i * 7} more of them") for i in range(9)], "item_id int, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), "text")
    assert len(list(decontaminate.passes(items, "item_id", "text"))) == 3
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).where("distance = 0").collect()} >= {(i, i) for i in range(9)}
    assert decontaminate.drop_leaks(docs, items).count() == 0


# --- op7 -----------------------------------------------------------------------------------------------------------------


def test_quality_tells_kinds_apart_and_holds_out(spark):
    random.seed(5)
    good = [" ".join(random.choice(["the", "of", "and", "house", "river", "tree"]) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(random.choice(["BUY!!", "now###", "cheap$$$", "the"]) for _ in range(40)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    w = quality.fit(docs, labels)
    got = quality.score_ids(docs, w).withColumn("h", quality.held_out(F.col("doc_id"))).toPandas()
    assert list(got["h"]) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    held = got[got["h"]]
    assert ((held["score"] >= quality.THRESHOLD) == (held["doc_id"] < 300)).mean() > 0.97
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, flipped) == w).all()


def test_training_matches_a_plain_version():
    """Follow the regularised leader, one weight at a time."""
    rng = random.Random(11)
    rows = [(sorted(rng.sample(range(30), rng.randint(0, 9))), rng.randint(0, 1)) for _ in range(60)]
    z, n, bias = defaultdict(float), defaultdict(float), quality.DIMENSIONS
    weight = lambda i: 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - (quality.L1 if z[i] > 0 else -quality.L1)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)
    ones = sum(y for _, y in rows) / len(rows)
    for _ in range(quality.EPOCHS):
        for numbers, y in rows:
            x = {i: 1 / max(1, len(numbers)) ** 0.5 for i in numbers} | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i] * (0.5 / ones if y else 0.5 / (1 - ones))
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.train([np.array(f, np.int32) for f, _ in rows], np.array([y for _, y in rows], float))
    assert got[[*range(30), bias]] == pytest.approx([weight(i) for i in [*range(30), bias]], abs=1e-5) and np.count_nonzero(got) <= 31


def test_scores_match_a_plain_version():
    w = np.random.default_rng(12).normal(size=quality.DIMENSIONS + 1).astype(np.float32)
    texts = ["One two, one two", "", "a", "x x x x", "Ünïcode wörds!! and 12 more", LONG[:3000]]
    for text, got in zip(texts, quality.scores(pa.array(texts), w), strict=True):
        data = text.encode()
        _, numbers = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        dot = float(w[-1]) + sum(float(w[k]) for k in numbers) / max(1, len(numbers)) ** 0.5
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(dot + np.log(0.3 / 0.7), -30, 30))))


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1), (8, 0), (7, 1), (7, 0), (None, 1), (4, None)], "doc_id long, quality int")
    w = quality.fit(odd(spark), labels)
    got = quality.score(odd(spark), w)
    assert got.count() == 9 and got.columns.count("score") == 1 and got.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    empty = quality.fit(none(spark), labels)
    assert {r.score for r in quality.score_ids(odd(spark), empty).collect()} == {0.5}
    assert quality.score_ids(none(spark), w).count() == 0


# --- op8 -----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


def test_mixture_reaches_its_targets(spark):
    random.seed(6)
    rows = [(i, " ".join(["w"] * random.choice([0, 1, 3, 10, 40, 200])), random.choice(["a", "b", "c", "ä", None, "d"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (mixing.mix(docs).toPandas().sort_values("doc_id") for _ in range(2))
    assert (first["copies"].to_numpy() == second["copies"].to_numpy()).all() and first["copies"].between(0, 2).all()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = plain_targets(sizes)
    for source, part in first.groupby("source", dropna=False):
        key = source if isinstance(source, str) else None
        assert part["target"].iloc[0] == pytest.approx(expected[key]) and part["source_size"].iloc[0] == sizes[key]
        assert abs((part["copies"] * part["size"]).sum() - expected[key]) <= 2
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == first.loc[first["size"] >= 0, "copies"].sum()


def test_mixture_on_odd_rows(spark):
    got = mixing.mix(odd(spark))
    assert got.count() == 9 and got.where("doc_id = 1").first()["size"] == 0
    taken = mixing.take(odd(spark))
    assert taken.count() == got.agg(F.sum("copies")).first()[0] and taken.columns == odd(spark).columns
    assert mixing.mix(none(spark)).count() == 0 and mixing.take(none(spark)).count() == 0


# --- op9 -----------------------------------------------------------------------------------------------------------------


def test_licence_places_match_brute_force(spark):
    random.seed(7)
    bits = ["MIT", "mit", "license", "License.", "apache", "general", "public", "x", "é", "-", "released", "under", "the", "\n"]
    texts = [" ".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(400)] + [None, "", "mit license mit license", "mit licenseé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in license_scan.labelled(docs).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for label, phrase in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licence_texts_with_gaps(spark):
    grant = "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this fine software and associated documentation files"
    docs = spark.createDataFrame([(1, "some words " + grant), (2, "Released under the MIT License."), (3, "free of charge to any person")], "doc_id int, text string")
    got = {r.doc_id: r.labels for r in license_scan.labelled(docs).collect()}
    assert got == {1: "mit-grant", 2: "mit,mit-notice", 3: ""}


def test_licences_in_a_long_text(spark):
    text = "the quick fox of this software " * 25_000 + "released under the mit license " + "general public license " * 20_000
    r = license_scan.labelled(spark.createDataFrame([(1, text), (None, "mit license"), (None, "mit license")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [x.labels for x in r] == ["mit", "mit", "gpl,mit,mit-notice"]
    assert (r[2].n_words, r[2].n_base, r[2].first_word, r[2].last_word) == (150_005 + 60_000, 20_001, 150_003, 150_005 + 60_000 - 3)


def test_licences_on_odd_rows(spark):
    got = license_scan.labelled(odd(spark))
    assert got.count() == 9 and got.where("doc_id = 7").count() == 2 and license_scan.labelled(none(spark)).count() == 0


# --- op10 ----------------------------------------------------------------------------------------------------------------


def plain_classes(rows, percent=85):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(words, n):
    out = list(words)
    for _ in range(n):
        out[random.randrange(len(out))] = f"e{random.random()}"
    return " ".join(out)


def test_near_duplicates_match_brute_force(spark):
    random.seed(8)
    base = [f"w{random.randrange(900)}" for _ in range(150)]
    texts = [" ".join(base)] * 20 + [edited(base, random.choice([1, 1, 2, 2, 3, 4, 6, 9])) for _ in range(120)]
    far = edited(base, 9).split()
    texts += [edited(far, 1) for _ in range(20)]
    for _ in range(30):
        one = [f"v{random.randrange(5000)}" for _ in range(random.randint(3, 80))]
        texts += [" ".join(one), edited(one, 1), " ".join(one).upper()]
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"q{random.random()}" for _ in range(random.randint(5, 60))) for _ in range(40)]
    texts += [None, "", " ", "one two", "One  two", LONG, LONG + " tail"]
    random.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_pairs_within_the_radius_share_a_key():
    rng = np.random.default_rng(9)
    one = rng.integers(0, 1 << 16, near_dup.SYMBOLS, dtype=np.uint16)
    for _ in range(300):
        other = one.copy()
        other[rng.choice(near_dup.SYMBOLS, near_dup.RADIUS, replace=False)] += 1
        keys = near_dup.signature_keys(np.stack([one, other]))
        assert len({int(k) >> 56 for k in np.intersect1d(keys[0], keys[1])}) >= 2


def test_buckets_are_streamed_alike():
    rng = np.random.default_rng(10)
    key = np.sort(np.concatenate([np.repeat(5 << 56, 400), rng.integers(0, 60, 400)]))
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(800)), pa.array(np.full(800, 10))], ["key", "rep", "n"])

    def run(sizes):
        out, at = set(), 0
        for size in sizes:
            parts = [rows.slice(i, size) for i in range(0, 800, size)]
            for b in near_dup._bucket_pairs(parts):
                out |= set(zip(*(c.to_pylist() for c in b.columns), strict=True))
        return out

    assert run([800]) == run([7]) == run([1])


def test_near_duplicates_on_odd_rows(spark):
    rows = odd(spark).unionByName(spark.createDataFrame([(None, "one", "en", "b", 3, 0.1, 1, 1, 1)], SCHEMA))
    got = near_dup.near_duplicates(rows).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = near_dup.keep_one(rows)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7, 8] and kept.columns == rows.columns
    assert near_dup.near_duplicates(none(spark)).count() == 0 and near_dup.keep_one(none(spark)).count() == 0


def test_near_duplicates_at_a_lower_percent(spark):
    assert [near_dup.radius(p) for p in (85, 80)] == [near_dup.RADIUS, 26] and near_dup.chunks(near_dup.RADIUS) == near_dup.CHUNKS
    rng = np.random.default_rng(11)
    for _ in range(100):
        one = rng.integers(0, 1 << 16, near_dup.SYMBOLS, dtype=np.uint16)
        other = one.copy()
        other[rng.choice(near_dup.SYMBOLS, 26, replace=False)] += 1
        keys = near_dup.signature_keys(np.stack([one, other]), 26)
        assert len({int(k) >> 56 for k in np.intersect1d(keys[0], keys[1])}) >= 2
    words = [f"w{k}" for k in range(104)]
    texts = [" ".join(words), " ".join([*words[:92], *(f"x{k}" for k in range(12))]), " ".join([*words[:90], *(f"y{k}" for k in range(14))])]
    many = [f"v{k}" for k in range(200)]  # a large bucket whose members reach the threshold only in part
    texts += [" ".join([*many[: 200 - k], *(f"z{i}-{k}" for i in range(k))]) for k in range(2, 30)] + [" ".join(many)] * 20
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 88 of 112 and 86 of 114 shingles: 78.6 % and 75.4 %; copies with 11 words changed have 89 of 111: 80.2 %.
    docs = docs.unionByName(spark.createDataFrame([(1000, " ".join([*words[:93], *(f"u{k}" for k in range(11))]))], docs.schema))
    rows.append((1000, docs.where("doc_id = 1000").first().text))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, percent=80).collect()}
    assert got == {i: find(i) for i in sets} and got[1000] == 0
    assert {r.doc_id for r in near_dup.near_duplicates(docs).where("kept").collect()} >= {0, 1000}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == {i for i in sets if find(i) == i}
    with pytest.raises(ValueError):
        near_dup.radius(50)


def test_rows_that_share_an_id_are_judged_each(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows = [(3, y), (5, x), (5, y), (9, x), (7, z), (7, z), (7, None), (7, ""), (None, x), (11, z + " end")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(3, y), (5, x), (7, z), (7, None), (7, ""), (None, x)]) and kept.columns == ["doc_id", "text"]


# --- pipeline and queries ------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")
def test_pipeline_stages_do_what_they_say(spark):
    d = str(DATA)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.good_quality(spark, docs, d)
    w = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score_ids(docs, w).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3} and good.columns == columns
    single = corpus_pipeline.one_of_each(spark, good, d)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    # The stage links at the job's 0.8, not at the 0.85 of op10's contract.
    classes = plain_classes(rows, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (n, c) in classes.items() if n == 0 or c == i} and single.columns == columns
    clean = corpus_pipeline.no_leaks(spark, single, d)
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    expected = {r.doc_id for r in single.collect() if not any(i in decontaminate.normal(r.text) for i in items)}
    got = {r.doc_id for r in clean.collect()}
    assert got <= expected and len(expected - got) <= 2 and clean.columns == columns
    mixed = corpus_pipeline.mixture(spark, clean, d)
    words = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.005 * words(clean) and mixed.columns == columns
    sharded = corpus_pipeline.shards(spark, mixed, d)
    assert sharded.count() == mixed.count() and sharded.select("shard").distinct().count() == 16
    assert corpus_pipeline.run(spark, d).count() == mixed.count()


def test_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(5, 1), (8, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd(spark), none(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            docs = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), str(tmp_path))
        assert docs.count() >= 0


@pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op6", "op10"))])
def test_queries_return_every_row(spark, name):
    table = "pages" if name.startswith("op4") else "documents"
    assert QUERIES[name](spark, str(DATA)).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
