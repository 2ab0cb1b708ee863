"""A quality classifier with supervised subword embeddings.

Every word and every character 3- to 5-gram within a word (its ends marked) has a hashed, learned vector; so has a word that
repeats the one before it. A document is the mean of its vectors, and a softmax over two classes reads it. Both are trained
together by stochastic gradient descent, in numpy, on a bounded sample of labelled documents.

As mean and softmax are linear up to the last step, scoring needs one number per bucket: its vector times the difference of
the output rows. Texts are hashed as arrays of characters (code points), many at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, small_batches

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
_BLANK = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def bucketed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of some texts."""
    lines = [b" ".join((t or "").encode().translate(_BLANK).split()).decode() for t in texts]
    data = np.frombuffer((" ".join(" " + x for x in lines) + " ").encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) + 2 for x in lines], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(data)]
    space = data == 32
    wide = data.astype(np.uint64)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            inner = np.zeros(m, bool)
            h = np.full(m, n, np.uint64)
            for i in range(n):
                h = h * _P + wide[i : i + m]
                if 0 < i < n - 1:
                    inner |= space[i : i + m]
            at = np.flatnonzero(~inner)
            buckets.append(_bucket(h[at], n))
            owners.append(owner[at])
        begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if len(begin):
            end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
            place = _places(begin, len(data))
            weighted = np.where(space, np.uint64(0), (wide + np.uint64(1)) * _power(int((end - begin).max()) + 2)[np.where(space, 0, place)])
            h = np.add.reduceat(weighted, begin)
            buckets.append(_bucket(h, 99))
            owners.append(owner[begin])
            same = np.flatnonzero((h[1:] == h[:-1]) & (owner[begin][1:] == owner[begin][:-1])) + 1
            buckets.append(np.full(len(same), int(_bucket(np.array([7], np.uint64), 7)[0])))
            owners.append(owner[begin][same])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.empty(0, np.int64), np.empty(0, np.int64))


def _places(begin: np.ndarray, n: int) -> np.ndarray:
    """For every byte its distance from the last word start."""
    at = np.zeros(n, np.int64)
    at[begin] = begin
    return np.arange(n) - np.maximum.accumulate(at)


def _power(n: int) -> np.ndarray:
    out = np.full(n, _P | np.uint64(1), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Model:
    """Vectors (float32, ``BUCKETS`` x ``size``), output rows and bias, trained on texts with labels 0 and 1."""

    def __init__(self, texts: list[str], labels: list[int], size: int = 12, epochs: int = 6, rate: float = 0.4, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        vectors = r.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
        out, bias = np.zeros((2, size), np.float32), np.zeros(2, np.float32)
        rows = []
        for text in texts:
            found, count = np.unique(bucketed([text])[0], return_counts=True)
            rows.append((found, (count / max(1, count.sum())).astype(np.float32)))
        y, total, step = np.array(labels, np.int64), max(1, epochs * len(texts)), 0
        for _ in range(epochs):
            for i in r.permutation(len(texts)):
                lr = rate * (1 - step / total)
                step += 1
                found, share = rows[i]
                mean = share @ vectors[found]
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = p @ out
                out -= lr * np.outer(p, mean)
                bias -= lr * p
                # A feature's share is small, so vectors take a step as if each stood alone.
                vectors[found] -= lr * np.outer(np.minimum(share * 20, 1), back)
        self.weights = (vectors @ (out[1] - out[0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, texts: list[str | None]) -> np.ndarray:
        bucket, owner = bucketed(texts)
        n = np.bincount(owner, minlength=len(texts))
        z = np.bincount(owner, self.weights[bucket], len(texts)) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, cells: int = 1500, most_chars: int = 16_000_000) -> Model:
    """Trains on at most ``cells`` documents of each label, drawn by hash from the labelled ones that are not held out.

    Of each label, texts are taken whole, the shortest first, until they reach ``most_chars`` characters (the first is
    always taken if it is shorter than that). Of rows with one id one text counts, the least. Without labelled rows the
    model is the zero model: 0.5 for all. Null texts and labels are not used.
    """
    known = labels.filter(~held_out(F.col(id_col))).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    drawn = dict(labelled_sample(known, "k", "y", cells))
    if not drawn:
        return Model([], [])
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(sorted(drawn.items()), f"_k {kind}, _y int")
    held = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("_k")).groupBy("_k", "_y").agg(F.min(F.col(text_col).cast("string")).alias("t"))
    size = F.sum(F.length("t").cast("long")).over(Window.partitionBy("_y").orderBy(F.length("t"), F.col("_k").cast("string")))
    rows = held.withColumn("size", size).filter(F.col("size") <= most_chars).select("_k", "t", "_y").collect()
    rows = sorted(rows, key=lambda r: (str(r._k), r.t))
    return Model([r.t for r in rows], [r._y for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """One row per input row: the id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``).

    Null and empty texts have no features and get the bias alone. Repeated rows are scored each by itself; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # half a megabyte
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = object.__new__(Model)
        scorer.weights, scorer.bias = shared.value
        for part in parts:
            made, texts, held = [np.empty(0)], [], 0
            for text in part.column(1).to_pylist():
                texts.append(text)
                held += len(text or "")
                if held >= 400_000:
                    made.append(scorer.score(texts))
                    texts, held = [], 0
            if texts:
                made.append(scorer.score(texts))
            s = np.concatenate(made)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns, from :func:`fit` and :func:`score`."""
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
