"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Words are runs of letters and digits, and runs of other marks, in their own case. A document's features are its
distinct words and pairs of neighbouring words, hashed into DIMENSIONS; each counts 1/sqrt(their number). The score is
the logistic function of a sparse dot product, moved so that 0.3, where documents are told apart, is even odds.

Defined results: null and empty texts have no feature and get the score of the bias alone. Without any labelled row all
scores are 0.5. Labels are joined on the id; an id with several labels takes the highest, one without a label
teaches nothing. Repeated documents are scored each on its own and teach once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._text import mix, segments, utf8, word_hashes

BITS = 18
DIMENSIONS = 1 << BITS
#: Labelled rows that the fit takes at most, by the hash of their id. The score covers every row.
FIT_ROWS = 12_000
THRESHOLD = 0.3
EPOCHS, ALPHA, BETA, L1, L2 = 8, 1.0, 1.0, 0.1, 0.1

_KINDS = np.full(256, 2, np.uint8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_PAIR = np.uint64(0xA24BAED4963EE407)
#: The pair of any word with itself: words repeat, whichever they are.
_TWICE = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the distinct features of each row, by row."""
    words, rows = word_hashes(data, offsets, _KINDS)
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    twice = words[pairs] == words[pairs + 1]
    both = np.where(twice, _TWICE, mix(words[pairs] * _PAIR + words[pairs + 1]))
    number = np.concatenate([words, both]) >> np.uint64(64 - BITS)
    key = np.unique(np.concatenate([rows, rows[pairs]]) << BITS | number.astype(np.int64))
    return key >> BITS, key & (DIMENSIONS - 1)


def batch_features(column: pa.Array) -> list[np.ndarray]:
    data, offsets = utf8(column)
    out: list[np.ndarray] = []
    for a, b in segments(offsets):
        rows, numbers = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out += np.split(numbers.astype(np.int32), np.searchsorted(rows, np.arange(1, b - a)))
    return out


def train(examples: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights of DIMENSIONS features and, last, the bias, after EPOCHS passes in the given order.

    The rarer class weighs as much as the other. The result depends on the order, not on how rows were spread.
    """
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zz) <= L1] = 0
        return w

    ones = labels.mean() if len(labels) else 0.5
    share = np.where(labels == 1, 0.5 / max(ones, 1e-9), 0.5 / max(1 - ones, 1e-9)) if 0 < ones < 1 else np.ones(len(labels))
    for _ in range(EPOCHS):
        for numbers, y, importance in zip(examples, labels, share, strict=True):
            at = np.append(numbers, DIMENSIONS)
            x = np.full(len(at), 1 / np.sqrt(max(1, len(numbers))))
            x[-1] = 1
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = importance * (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(DIMENSIONS + 1)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents that are not held out.

    The sample is at most FIT_ROWS ids, so it may be broadcast; its features are trained on in one task.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")

    def extract(batches):
        for batch in batches:
            found = batch_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "y", "x"])

    def learn(batches):
        held = {}
        for batch in batches:
            for i, y, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held[i] = min(held.get(i, (y, x)), (y, x))
        order = sorted(held, key=lambda i: (zlib.crc32(str(i).encode()), i))
        w = train([np.frombuffer(held[i][1], np.int32) for i in order], np.array([held[i][0] for i in order], float))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = chosen.select("__id", "__y", "__text").select("__id", "__text", "__y").mapInArrow(extract, f"id {kind}, y int, x binary")
    found = seen.repartition(1).mapInArrow(learn, "w binary").first()
    return np.frombuffer(found["w"], np.float32) if found else np.zeros(DIMENSIONS + 1, np.float32)


def scores(column: pa.Array, w: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    data, offsets = utf8(column)
    out = np.full(len(column), float(w[-1]))
    for a, b in segments(offsets):
        rows, numbers = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        count = np.bincount(rows, minlength=b - a)
        out[a:b] += np.bincount(rows, weights=w[numbers], minlength=b - a) / np.sqrt(np.maximum(1, count))
    moved = out + np.log(threshold / (1 - threshold)) if w.any() else out
    return 1 / (1 + np.exp(-np.clip(moved, -30, 30)))


def score(docs: DataFrame, w: np.ndarray, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with their score in ``score_col`` (replacing one of that name). Narrow; the weights are 1 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    keep = [c for c in docs.columns if c != score_col]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != score_col] + [f"`{score_col}` double"])
    place = keep.index(text_col)

    def run(batches):
        for batch in batches:
            s = scores(batch.column(place), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*keep, score_col])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, fields)


def score_ids(docs: DataFrame, w: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ids and scores: texts do not travel back."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), shared.value))], ["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_ids(docs, w).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
