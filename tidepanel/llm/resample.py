"""Importance resampling towards a target distribution, by hashed word features.

A document's weight is the mean log ratio of its features' frequencies in the
target and in the corpus, looked up in an array of one gain per bucket. Adding
Gumbel noise from the id's hash and drawing the highest scores draws without
replacement in proportion to the weights. The cutoff is found without sorting
all scores: a quantile sketch gives a bracket, exact counts outside it validate
or widen it, and only the scores inside are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared
from tidepanel.operators.ordered import ordered_index
from tidepanel.storage import materialise

BUCKETS = 10_000
# Bytes of a text whose words are held at a time.
BLOCK_BYTES = 1 << 20
# First relative error of the quantile sketch, and the share of the rows the bracket begins with at least.
SKETCH_ACCURACY = 1000
BRACKET = 0.002

# A-Z become a-z, letters a-z, digits and all bytes beyond ASCII stay, every other byte parts words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, crc32 of each feature) for one block of a UTF-8 text after another.

    Features are the words and the pairs of neighbouring words; a pair across
    two blocks belongs to the later one.
    """
    data = text.translate(_WORD_BYTES)
    at, last = 0, None
    while at < len(data):
        end = len(data)
        if end - at > BLOCK_BYTES:
            end = data.find(b" ", at + BLOCK_BYTES)
            end = len(data) if end < 0 else end
        words = data[at:end].split()
        at = end
        if not words:
            continue
        single = list(map(crc32, words))
        # A pair's checksum goes on from its first word's, over a blank and the second word.
        firsts = single[:-1] if last is None else [last, *single[:-1]]
        seconds = words[1:] if last is None else words
        pairs = map(crc32, seconds, map(crc32, repeat(b" "), firsts))
        last = single[-1]
        yield len(words), np.fromiter(chain(single, pairs), np.int64, len(single) + len(firsts))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The UTF-8 texts of a batch, one at a time."""
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))


def bucket_counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket (``text``; null: none)."""

    def count():
        seen = np.zeros(buckets, np.int64)

        def add(batch):
            for text in _texts(batch):
                for _, hashes in features(text):
                    seen[:] += np.bincount(hashes % buckets, minlength=buckets)

        return add, lambda: seen

    return _summed(df.select("text"), buckets, count)


def _summed(df: DataFrame, size: int, count) -> np.ndarray:
    """As ``shared.summed``, in whole numbers."""

    def run(batches):
        add, get = count()
        for batch in batches:
            add(batch)
        vector = get()
        place = np.flatnonzero(vector)
        yield pa.record_batch({"i": pa.array(place, pa.int32()), "n": pa.array(vector[place], pa.int64())})

    out = np.zeros(size, np.int64)
    for row in df.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # one per bucket
        out[row.i] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio of smoothed frequencies in target and corpus, in thousandths, floored."""
    size, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratios = [
        (float(t) + 1) * (all_corpus + size) / ((float(s) + 1) * (all_target + size)) for s, t in zip(corpus, target)
    ]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(df: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains over each text's features."""
    table = df.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            words, sizes, weights = [], [], []
            for text in _texts(batch):
                n_words = n_features = total = 0
                for n, hashes in features(text):
                    n_words += n
                    n_features += len(hashes)
                    total += int(gain[hashes % len(gain)].sum())
                words.append(n_words)
                sizes.append(n_features)
                weights.append(total // n_features if n_features else 0)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (words, sizes, weights))]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "n_features", "weight"])

    numbers = [(n, T.LongType()) for n in ("n_words", "n_features", "weight")]
    return df.select("doc_id", "text").mapInArrow(run, shared.fields(df, ["doc_id"], *numbers))


def gumbel(key: str, seed: int) -> Column:
    """Noise of a row by the hash of its id (null id: an empty one), in thousandths, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def cutoff(scores: DataFrame, wanted: int, rows: int) -> int | None:
    """The ``wanted``-th highest of the ``rows`` values of column ``score``, by quantile-sketch bracketing.

    A sketch gives two scores between which the cutoff should lie. The rows above
    and from the bracket on are counted exactly; where the cutoff is not between
    them, that side is widened until it is. Only the distinct scores inside the
    bracket are then sorted and counted down. None if nothing is wanted.
    """
    if wanted <= 0:
        return None
    spread, share = BRACKET, wanted / rows
    while True:
        # Quantiles from the lowest score on; 0 and 1 are the sketch's exact ends.
        at = [max(0.0, 1 - share - spread), min(1.0, 1 - share + spread)]
        low, high = scores.select(F.percentile_approx("score", at, SKETCH_ACCURACY)).first()[0]
        if at[0] == 0.0 or at[1] == 1.0:
            least, most = scores.agg(F.min("score"), F.max("score")).first()
            low, high = (least if at[0] == 0.0 else low), (most if at[1] == 1.0 else high)
        above, from_low = scores.agg(
            F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)
        ).first()
        if above < wanted <= from_low:
            break
        spread *= 4
    inside = scores.filter(F.col("score").between(low, high)).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Scores are whole thousandths, so the bracket holds a bounded number of them, however many rows.
    running = F.sum("n").over(Window.orderBy(F.desc("score"))) + above
    return inside.withColumn("_down", running).filter(F.col("_down") >= wanted).agg(F.max("score")).first()[0]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every document, with its place among the drawn.

    ``docs`` has doc_id and text, ``target`` text; other columns are not looked
    at. Of the N documents with ``least_words`` words, floor(percent * N / 100)
    with the highest scores are drawn; ties go to the smaller doc_id (null ids
    first), then to one of the equal rows, and repeated rows count each. A null
    or empty text has no features and weight 0. An empty table gives none.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    score = (F.col("weight") + gumbel("doc_id", seed)).alias("score")
    scored = weighted(docs, gain).select("doc_id", "n_words", "n_features", "weight", score)
    # Written once: the sketch, the counts and the order are passes over these few numbers a row.
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    rows = eligible.count()
    wanted = percent * rows // 100
    edge = cutoff(eligible.select("score"), wanted, rows)
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    if edge is None:
        ranked = unranked
    else:
        # Rows at the cutoff score itself may be more than are wanted; the order decides among them.
        reaches = (F.col("n_words") >= least_words) & (F.col("score") >= edge)
        near = scored.filter(reaches).withColumn("_down", -F.col("score"))
        placed = ordered_index(near, ["_down", "doc_id", "_row"], "rank")
        ranked = unranked.filter(~reaches).unionByName(
            placed.drop("_down").withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
        )
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")
