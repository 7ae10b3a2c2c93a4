"""Text, identity and vector functions against plain Python."""

import hashlib
import json
import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import identity, text, vectors
from sparkloom.operators.resolution import plain_name, plain_type

WORDS = ["", "Companies", "boxes", "classes", "bus", "buzzes", "ties", "Straße", "ﬁles", "Ångström's", "ŉa", "API-keys", "  x  y ", "ſS", "10 Things!", "Été"]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_normal_forms(spark):
    def names(value):
        def single(w):
            if len(w) > 4 and w.endswith("ies"):
                return w[:-3] + "y"
            if len(w) > 4 and re.search("(ches|shes|sses|xes|zes)$", w):
                return w[:-2]
            return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w

        return " ".join(map(single, re.sub("[^a-z0-9]+", " ", value.casefold()).split()))

    rows = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for r in rows.select("w", text.normal_name(F.col("w")).alias("n"), text.normal_type(F.col("w")).alias("t"), text.normal_text(F.col("w")).alias("x")).collect():
        folded = re.sub("[^a-z0-9]+", " ", r.w.casefold()).split()
        assert (r.n, r.t, r.x) == (names(r.w), "_".join(folded), " ".join(folded))
        assert (plain_name(r.w), plain_type(r.w)) == (r.n, r.t)


def test_source_key_and_hashes(spark):
    for source in ["documents/A b.md", "documents/..hidden", "a/b.tar.gz", "  x\\y\\Zürich report.PDF ", "documents/---.md"]:
        path = source.replace("\\", "/").strip()
        slug = re.sub("[^A-Za-z0-9]+", "-", PurePosixPath(path).stem).strip("-").lower() or "source"
        assert one(spark, identity.source_key(F.col("s")), s=source) == f"{slug}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"
    assert one(spark, identity.content_hash(F.col("s"), "tag-v2"), s="ä") == hashlib.sha256("tag-v2\0ä".encode()).hexdigest()


def test_references_and_stamps(spark):
    place = lambda s, a, b: spark.range(1).select(text.source_reference(F.lit(s), F.lit(a).cast("int"), F.lit(b).cast("int")).alias("x")).first()["x"]
    assert place("d/m.pdf", 4, 6) == "d/m.pdf (pp. 4-6)"
    assert place("d/m.pdf", 4, 4) == "d/m.pdf (p. 4)"
    assert place("d/m.PPTX", 1, 2) == "d/m.PPTX (slides 1-2)"
    assert place("d/m.md", None, None) == "d/m.md"
    assert spark.range(1).select(text.timestamp_label(F.lit(360_061_999)).alias("x")).first()["x"] == "100:01:01"


def test_json_and_content(spark):
    rows = spark.createDataFrame([('{"b": [1, {"z": 1, "a": "ü"}], "a": null}',)], "j string")
    assert rows.select(text.canonical_json_text("j").alias("x")).first()["x"] == json.dumps({"a": None, "b": [1, {"a": "ü", "z": 1}]}, sort_keys=True)
    rows = spark.createDataFrame([("...",), ("a",), ("½",), ("",)], "t string")
    assert [r.x for r in rows.select(text.has_content_exact("t").alias("x")).collect()] == [False, True, True, False]


def test_split_message():
    assert text.split_message("a" * 10, 4) == ["aaaa", "aaaa", "aa"]
    assert text.split_message("one two three", 8) == ["one two", "three"]
    assert text.split_message("line\nnext words", 8) == ["line", "next", "words"]
    assert text.split_message("  ") == []
    random.seed(1)
    for _ in range(200):
        t = "".join(random.choice("ab \n") for _ in range(60))
        assert all(0 < len(p) <= 7 for p in text.split_message(t, 7))


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, 0.0, 0.0]


def test_common_prefix(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["a"], ["a", "b"]), ([], ["a"]), (["x"], ["y"])], "a array<string>, b array<string>")
    assert [r.p for r in rows.select(text.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()] == [["a"], ["a"], [], []]


@pytest.mark.parametrize(("value", "expected"), [("a\r\nb\rc ", "a\nb\nc"), ("　x ", "x")])
def test_normal_lines(spark, value, expected):
    assert one(spark, text.normal_lines(F.col("s")), s=value) == expected
