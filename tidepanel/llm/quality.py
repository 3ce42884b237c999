"""Text quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are the shapes of its character runs and marks of its
structure (how often words and lines repeat, how long they are). TF-IDF
vectors, with frequencies over all documents, are projected on the leading
singular directions of a bounded sample of labelled documents. The labelled
vectors are broadcast; every document is compared with all of them, block by
block, and its nearest ones vote with the power of their cosine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepanel.llm import shared

ORDERS = (1, 2, 3, 4)
SHAPES = 1024
MARKS = 8  # structural marks of a text
LEVELS = 16  # levels of a mark
BUCKETS = SHAPES + MARKS * LEVELS
# Weight of a mark beside a shape that occurs once.
MARK_COUNT = 30.0
# Most labelled documents that vote (about), and so the size of the broadcast.
SAMPLE_ROWS = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
POWER = 8


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray  # buckets x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of length 1
    labels: np.ndarray
    prior: float


# One code per kind of character; punctuation keeps its own.
_ASCII = np.arange(128, dtype=np.uint32)
_ASCII[[*range(97, 123)]] = 97
_ASCII[[*range(65, 91)]] = 65
_ASCII[[*range(48, 58)]] = 48


def shapes(text: str) -> np.ndarray:
    """Kinds of the characters: lower case, upper case, digit, or the sign itself."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    upper = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    wide = np.full(len(c), 97, dtype=np.uint32)
    if len(upper) == len(c):
        wide[c != upper] = 65
    return np.where(c < 128, _ASCII[np.minimum(c, 127)], wide)


def level(share: float) -> int:
    """A share from 0 to 1 as one of the levels, finer near 0."""
    return min(LEVELS - 1, int(LEVELS * max(0.0, min(1.0, share)) ** 0.5))


def marks(text: str) -> list[int]:
    """One level per structural mark; an empty text has none."""
    words = text.split()
    if not words:
        return []
    lines = [line for line in text.split("\n") if line.strip()]
    counts = Counter(words)
    line_counts = Counter(lines)
    n = len(words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    return [
        level(len(counts) / n),
        level(max(counts.values()) / n),
        level(again / n),
        level(1 - pairs / max(1, n - 1)),
        level(1 - len(line_counts) / len(lines)),
        min(LEVELS - 1, int(np.log2(n))),
        min(LEVELS - 1, len(text) // n),
        level(sum(w.isupper() for w in words) / n),
    ]


def counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of shapes, and marks, for blocks of whole texts."""
    for first, shape_counts in shared.dense_counts(texts, ORDERS, SHAPES, shapes):
        mark_counts = np.zeros((len(shape_counts), MARKS * LEVELS))
        for i in range(len(shape_counts)):
            for m, at in enumerate(marks(texts[first + i])):
                mark_counts[i, m * LEVELS + at] = MARK_COUNT
        yield first, np.concatenate([shape_counts, mark_counts], axis=1)


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel | None:
    """Learn from ``labels`` (doc_id, quality) of rows that are not held out; None without any.

    Document frequencies cover all of ``docs``; basis and voters come from a
    sample of about ``sample_rows`` labelled documents at most.
    """
    frequencies, documents = shared.document_frequencies(docs, counted, BUCKETS)
    weights = shared.idf(frequencies, documents)
    sample = shared.learnt_rows(docs, labels, "quality", sample_rows, even=False)

    def start():
        def step(batch):
            rows = [shared.tfidf(c, weights) for _, c in counted(shared.texts_of(batch))]
            packed = [row.astype(np.float32).tobytes() for row in np.concatenate(rows)]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())]
            return pa.record_batch(columns, ["doc_id", "label", "vector"])

        return step

    schema = shared.fields(sample, ["doc_id", "label"], ("vector", T.BinaryType()))
    rows = shared.map_batches(sample, start, schema).toPandas().sort_values(["doc_id", "label"], kind="stable")
    if rows.empty:
        return None
    matrix = np.frombuffer(b"".join(rows["vector"]), np.float32).reshape(len(rows), BUCKETS)
    _, directions = np.linalg.eigh(matrix.T @ matrix)
    basis = np.ascontiguousarray(directions[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    known = rows["label"].to_numpy(np.float32)
    return QualityModel(weights, basis, unit(matrix @ basis), known, float(known.mean()))


def votes(model: QualityModel, vectors: np.ndarray) -> np.ndarray:
    """Share of label 1 among the nearest voters of each row, weighted by similarity.

    Rows without any term have no neighbours and get the mean label.
    """
    k = min(NEIGHBOURS, len(model.labels))
    cosine = vectors @ model.vectors.T
    nearest = np.argpartition(cosine, -k, axis=1)[:, -k:]
    weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0).astype(float) ** POWER
    total = weight.sum(axis=1)
    score = np.full(len(vectors), model.prior)
    some = total > 0
    score[some] = (weight * model.labels[nearest])[some].sum(axis=1) / total[some]
    return np.clip(score, 0.0, 1.0)


def predict(df: DataFrame, model: QualityModel | None, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of column ``text``.

    Null and empty texts get the mean label of the voters; without a model (no
    label to learn) every score is 0.5. Texts are read whole, repeated rows each
    get their row, and other columns are ignored.
    """
    schema = shared.fields(df, kept, ("score", T.DoubleType()), ("predicted", T.IntegerType()))

    def start():
        def step(batch):
            texts = shared.texts_of(batch)
            score = np.full(len(texts), 0.5)
            if model is not None:
                for first, counts in counted(texts):
                    rows = unit(shared.tfidf(counts, model.idf) @ model.basis)
                    score[first : first + len(rows)] = votes(model, rows)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            return pa.record_batch(columns, schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)
