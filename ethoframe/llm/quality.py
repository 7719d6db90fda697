"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words, their shapes (runs of letters by case, digits, marks) and whether a word repeats the one before; they
hash into FEATURES columns, weighed by tf-idf. A truncated singular value decomposition of the labelled sample gives DIMENSIONS latent
axes. Every document is projected and compared by exact cosine, in blocks, with every labelled vector; its NEIGHBOURS nearest vote
with their label, weighted by similarity.

The labelled sample is bounded: SAMPLE rows at most, those with the smallest hash of doc_id, none with crc32(doc_id) mod 5 = 0. The model that is broadcast
has SAMPLE * DIMENSIONS + FEATURES * DIMENSIONS numbers whatever the input. All documents are scored, each on its whole text.

Nulls and edges: null and empty texts, and texts without any known direction, score the share of label 1 in the sample (0.5 without labels);
labelled rows whose quality is null or whose document is missing are not used; repeated label rows count once each at most SAMPLE; ties among neighbours at the
same similarity are broken by position in the sample, which is ordered by hash and id. Columns of docs pass through; input columns
named score or predicted are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoframe.llm import tokens

SHAPES, FEATURES = 256, 1024
DIMENSIONS, NEIGHBOURS, SAMPLE = 48, 15, 4096
THRESHOLD = 0.3
BLOCK = 1024
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
REPEAT, LENGTH = 0, 1


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5


def _shape(word: str) -> str:
    cased = _LETTERS.sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "x", word)
    return _DIGITS.sub("0", cased)


def term_counts(texts: pa.Array) -> np.ndarray:
    """Texts by features: counts over the square root of the text's words."""
    codes, vocabulary, starts = tokens.words(texts)
    n = len(starts) - 1
    if not len(codes):
        return np.zeros((n, FEATURES), np.float32)
    shape = np.fromiter((2 + zlib.crc32(_shape(w).encode()) % (SHAPES - 2) for w in vocabulary), np.int64, len(vocabulary))
    word = np.fromiter((SHAPES + zlib.crc32(w.lower().encode()) % (FEATURES - SHAPES) for w in vocabulary), np.int64, len(vocabulary))
    doc = tokens.doc_of(starts)
    again = np.flatnonzero((codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]))
    cells = np.concatenate([doc * FEATURES + shape[codes], doc * FEATURES + word[codes], doc[again] * FEATURES + REPEAT])
    counts = np.bincount(cells, minlength=n * FEATURES).reshape(n, FEATURES)
    return np.sqrt(counts / np.maximum(1, np.diff(starts))[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Latent axes and labelled vectors from the bounded sample; its term counts (sample * FEATURES numbers) go to the driver."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("at"))
    picked = rows.orderBy("at", "labelled", "quality").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled")).select("at", "doc_id", "quality", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                x = term_counts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("doc_id"), part.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], ["at", "doc_id", "quality", "x"])

    # rows may repeat a doc_id, so they are cut before they reach the driver
    got = known.mapInArrow(counts, "at long, doc_id long, quality int, x binary").orderBy("at", "doc_id", "quality", "x").limit(sample).collect()
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, FEATURES), np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    weighed = _unit(x * idf)
    values, axes = np.linalg.eigh(weighed.T.astype(np.float64) @ weighed)
    axes = axes[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    return Model(idf, axes, _unit(weighed @ axes), np.array([r["quality"] for r in got], np.float32))


def vote(model: Model, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of term counts: exact cosines with all labelled vectors, the nearest ones' labels weighted by similarity."""
    score = np.full(len(x), model.prior)
    if not len(model.labels):
        return score
    for at in range(0, len(x), BLOCK):
        latent = _unit(_unit(x[at : at + BLOCK] * model.idf) @ model.axes)
        cosine = latent @ model.vectors.T
        k = min(neighbours, cosine.shape[1])
        least = np.partition(cosine, -k, axis=1)[:, -k, None]
        nearer, tied = cosine > least, cosine == least
        chosen = nearer | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - nearer.sum(axis=1, keepdims=True)))  # ties by position
        weight = np.where(chosen, np.maximum(cosine, 0), 0).astype(np.float64)
        total = weight.sum(axis=1)
        good = (total > 1e-9) & (np.abs(latent).sum(axis=1) > 0)
        score[at : at + BLOCK][good] = ((weight @ model.labels.astype(np.float64))[good] / total[good]).clip(0, 1)
    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (double) and predicted (int); needs a column text."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                score = vote(shared.value, term_counts(part.column("text")))
                more = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(scored, schema)
