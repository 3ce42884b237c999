"""Token counts by a unigram model, with dynamic programming shared along a trie.

The best segmentation of a pre-token is found from left to right: the score of
a prefix depends on the prefix only. Distinct pre-tokens are therefore walked
as a trie, in sorted order, and the score and count of each shared prefix are
computed once; the count at the end of a pre-token is stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepanel.llm import shared

# Marks the start of a pre-token, as the vocabulary file does.
MARK = "▁"
# Pre-tokens a task remembers before it starts again.
REMEMBERED = 400_000


def read_vocabulary(model_path: str) -> tuple[dict[str, float], float]:
    """Log-probability of each piece, and of a single byte of anything else.

    The file orders its pieces by how early they were merged but holds no
    probabilities; a piece at place r gets the Zipf probability 1 / (r + 2.7),
    normalised. Bytes are as rare as the last piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    names = [
        model.id_to_piece(i)
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(names))))
    scores: dict[str, float] = {}
    for r, name in enumerate(names):
        scores.setdefault(name, -math.log(r + 2.7) - total)
    return scores, -math.log(len(names) + 2.7) - total


def trie_counts(tokens: Iterable[str], scores: Mapping[str, float], byte_score: float, longest: int) -> dict[str, int]:
    """Number of pieces in the best segmentation of each distinct token.

    A character that no piece covers costs one piece per UTF-8 byte. The higher
    score wins, then the smaller count.
    """
    out: dict[str, int] = {}
    best, count = [0.0], [0]  # along the trie path of the token before
    last = ""
    for token in sorted(set(tokens)):
        shared_length, most = 0, min(len(last), len(token))
        while shared_length < most and last[shared_length] == token[shared_length]:
            shared_length += 1
        del best[shared_length + 1 :], count[shared_length + 1 :]
        for end in range(shared_length + 1, len(token) + 1):
            size = len(token[end - 1].encode("utf-8", "surrogatepass"))
            top, n = best[end - 1] + size * byte_score, count[end - 1] + size
            for begin in range(max(0, end - longest), end):
                score = scores.get(token[begin:end])
                if score is not None:
                    new, m = best[begin] + score, count[begin] + 1
                    if new > top or (new == top and m < n):
                        top, n = new, m
            best.append(top)
            count.append(n)
        out[token] = count[-1]
        last = token
    return out


def token_counts(df: DataFrame, model_path: str, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept``, ``n_pretokens`` and ``n_tokens`` of column ``text``.

    Pre-tokens are the runs without white space, each with the mark of a word
    start. Null and empty texts have none; texts are counted whole, repeated
    rows each. The vocabulary is read on the driver and sent to the tasks.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    schema = shared.fields(df, kept, ("n_pretokens", T.LongType()), ("n_tokens", T.LongType()))

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scores, byte_score = vocabulary.value
        longest = max(map(len, scores), default=1)
        known: dict[str, int] = {}

        def step(batch):
            split = [text.split() for text in shared.texts_of(batch)]
            if len(known) > REMEMBERED:
                known.clear()
            new = {MARK + t for tokens in split for t in set(tokens) if t not in known}
            known.update((t[1:], n) for t, n in trie_counts(new, scores, byte_score, longest).items())
            totals = [sum(map(known.__getitem__, tokens)) for tokens in split]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(list(map(len, split)), pa.int64()), pa.array(totals, pa.int64())]
            return pa.record_batch(columns, schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)
