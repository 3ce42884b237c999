"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are learnt by follow-the-regularised-leader with elastic-net
penalties (most stay exactly 0), one example at a time, on a bounded sample;
document frequencies count every document. A temperature, fitted on examples
kept back, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared

ORDERS = (1, 2, 3)
BUCKETS = 8192
# Most labelled documents the weights are learnt from (about; even over languages).
SAMPLE_ROWS = 4000
EPOCHS = 3
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def codes(text: str) -> np.ndarray:
    """Lower-case characters as numbers; ASCII characters that are no letters become blanks."""
    c = np.frombuffer(shared.lowered(text).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    c[(c < 128) & ((c < 97) | (c > 122))] = 32
    return c


def counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    return shared.dense_counts(texts, ORDERS, BUCKETS, codes)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    buckets: int,
    classes: int,
    epochs: int = EPOCHS,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.1,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after ``epochs`` passes of FTRL-proximal over sparse examples.

    An example is (places, values, class). A weight whose accumulated gradient
    stays within ``l1`` is 0; ``l2`` shrinks the others. Biases are not penalised.
    """
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    penalty = np.full((buckets + 1, 1), l1)
    penalty[buckets] = 0

    def weights(at):
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - penalty[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            places, values, label = examples[k]
            at = np.append(places, buckets)
            x = np.append(values, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    full = weights(np.arange(buckets + 1))
    return full[:buckets].astype(np.float32), full[buckets].astype(np.float32)


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest, from 0.25 to 20."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 121))
    rows = np.arange(len(labels))
    loss = [-np.log(softmax(scores / t)[rows, labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Learn from ``train`` (doc_id, text, lang); ``docs`` gives the document frequencies.

    Rows without text or language teach nothing. None if no row is left.
    """
    frequencies, documents = shared.document_frequencies(docs, counted, BUCKETS)
    weights = shared.idf(frequencies, documents)
    usable = train.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sample = shared.bounded_sample(usable, sample_rows, "lang")

    def start():
        def step(batch):
            places, values = [], []
            for _, counts in counted(shared.texts_of(batch)):
                for row in shared.tfidf(counts, weights):
                    at = np.flatnonzero(row).astype(np.int32)
                    places.append(at.tobytes())
                    values.append(row[at].tobytes())
            return pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang": batch.column("lang"),
                    "places": pa.array(places, pa.binary()),
                    "values": pa.array(values, pa.binary()),
                }
            )

        return step

    binary = T.BinaryType()
    schema = shared.fields(usable, ["doc_id", "lang"], ("places", binary), ("values", binary))
    rows = shared.map_batches(sample, start, schema).toPandas()
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    if rows.empty:
        return None
    languages = tuple(sorted(rows["lang"].unique()))
    code = {v: i for i, v in enumerate(languages)}
    examples = [
        (np.frombuffer(p, np.int32), np.frombuffer(v, np.float32).astype(float), code[lang])
        for p, v, lang in zip(rows["places"], rows["values"], rows["lang"])
    ]
    kept_back = examples[::5] if len(examples) >= 50 else examples
    learnt = [e for i, e in enumerate(examples) if i % 5] if len(examples) >= 50 else examples
    w, bias = ftrl(learnt, BUCKETS, len(languages))
    scores = np.array([v @ w[p] + bias for p, v, _ in kept_back])
    temperature = best_temperature(scores, np.array([c for _, _, c in kept_back]))
    return LanguageModel(languages, weights, w, bias, temperature)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def probabilities(model: LanguageModel, texts: list[str]) -> Iterator[np.ndarray]:
    """Calibrated probabilities of the languages, for blocks of rows in order."""
    for _, counts in counted(texts):
        scores = shared.tfidf(counts, model.idf) @ model.weights + model.bias
        yield softmax(scores / model.temperature)


def label(model: LanguageModel | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text; ``und`` and 0 without a letter or a model."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return lang, score
    p = np.concatenate(list(probabilities(model, texts))) if texts else np.zeros((0, 1))
    best = p.argmax(axis=1)
    for i, text in enumerate(texts):
        if has_letter(text):
            lang[i], score[i] = model.languages[best[i]], p[i, best[i]]
    return lang, score


def predict(df: DataFrame, model: LanguageModel | None, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept`` with ``lang_pred`` and ``score`` (0 to 1) of column ``text``.

    A null or empty text, or one without any letter, is ``und`` with score 0.
    Texts are used whole, repeated rows each get their row, and other columns
    are ignored. Ties go to the language that sorts first.
    """
    schema = shared.fields(df, kept, ("lang_pred", T.StringType()), ("score", T.DoubleType()))

    def start():
        def step(batch):
            lang, score = label(model, shared.texts_of(batch))
            columns = [batch.column(c) for c in kept]
            return pa.record_batch([*columns, pa.array(lang, pa.string()), pa.array(score)], schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)


def keep(docs: DataFrame, model: LanguageModel | None, least: float = 0.5) -> DataFrame:
    """The documents, all columns, in a known language with probability ``least`` or more.

    Without a model (no labelled row) nothing can be judged, and every row stays.
    """
    schema = docs.schema

    def start():
        def step(batch):
            lang, score = label(model, shared.texts_of(batch))
            good = [model is None or (l != UNKNOWN and s >= least) for l, s in zip(lang, score)]
            return batch.filter(pa.array(good, pa.bool_()))

        return step

    return shared.map_batches(docs, start, schema)


def trainable(docs: DataFrame) -> DataFrame:
    """The rows whose language may be learnt."""
    return docs.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & ~shared.held_out())
