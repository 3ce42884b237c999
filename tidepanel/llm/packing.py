"""Packing of examples into training sequences by vector bin packing.

Each example makes several demands at once: its tokens, one segment, and its
loss-bearing tokens; a sequence has a limit on each. The dot-product heuristic
fills one sequence at a time with the example that fits and whose demands,
weighted by how scarce each resource is, agree best with what is left.
Every task packs the rows of its own partition in windows, so nothing is
shuffled and memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepanel.llm import shared, words

# Examples a task packs together.
WINDOW = 4096
# A sequence whose scarcest resource is used less than this waits for the next window.
FULL_ENOUGH = 0.98
# Sequence ids of a task begin at its partition number shifted by this many bits.
PARTITION_BITS = 36

END_OF_TEXT = 2


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. ``length`` also cuts documents into pieces.

    A segment has a token at least, so that by default tokens decide and short texts
    leave no padding; a lower limit of segments, as instruction data may need, closes
    a sequence of many short ones earlier.
    """

    length: int = 4096
    segments: int = 4096
    loss_tokens: int = 4096

    def vector(self) -> np.ndarray:
        return np.array([self.length, self.segments, self.loss_tokens], dtype=float)


def place(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Indices of the examples of each sequence, by the dot-product heuristic.

    ``demands`` has a row per example, none above ``limits``. Ties go to the
    earlier example, so the same rows give the same sequences.
    """
    if not len(demands):
        return []
    share = demands / limits
    weights = share.mean(axis=0)
    # Larger examples first, so that an equal score prefers them and scans stay in order.
    left = np.lexsort((np.arange(len(share)), -share.max(axis=1)))
    share = share[left]
    bins: list[list[int]] = []
    alive = np.ones(len(left), dtype=bool)
    while alive.any():
        if alive.mean() < 0.5:
            left, share = left[alive], share[alive]
            alive = np.ones(len(left), dtype=bool)
        room, chosen = np.ones(share.shape[1]), []
        # What fits goes on with its demands side by side, a row per resource; it only gets fewer.
        fits = np.flatnonzero(alive)
        demand = np.ascontiguousarray(share[fits].T)
        while True:
            able = (demand <= room[:, None] + 1e-12).all(axis=0)
            if not able.all():
                fits, demand = fits[able], demand[:, able]
            if not len(fits):
                break
            best = int(np.argmax((weights * room) @ demand))
            chosen.append(int(left[fits[best]]))
            room = room - demand[:, best]
            alive[fits[best]] = False
            fits, demand = np.delete(fits, best), np.delete(demand, best, axis=1)
        bins.append(chosen)
    return bins


@dataclass
class Window:
    """The rows a task has yet to pack."""

    limits: Limits
    next_id: int
    rows: list[pa.RecordBatch] = field(default_factory=list)
    held: int = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, WINDOW):
            part = batch.slice(at, WINDOW)
            self.rows.append(part)
            self.held += part.num_rows
            if self.held >= WINDOW:
                yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows = pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
        tokens = rows.column("length").to_numpy(zero_copy_only=False).astype(float)
        loss = rows.column("loss_tokens").to_numpy(zero_copy_only=False).astype(float)
        demands = np.column_stack([tokens, np.ones(len(tokens)), loss])
        limits = self.limits.vector()
        order, ids, offsets, waiting = [], [], [], []
        for chosen in place(demands, limits):
            if not last and (demands[chosen].sum(axis=0) / limits).max() < FULL_ENOUGH:
                waiting += chosen
                continue
            ends = np.cumsum(tokens[chosen]).astype(np.int64)
            order += chosen
            ids += [self.next_id] * len(chosen)
            offsets += [0, *ends[:-1].tolist()]
            self.next_id += 1
        if len(waiting) > WINDOW // 2:  # examples that never fill a sequence must not pile up
            self.rows, self.held = [], 0
            yield from self.final(rows, demands, waiting)
        else:
            self.rows = [rows.take(pa.array(waiting, pa.int64()))] if waiting else []
            self.held = len(waiting)
        yield self.packed(rows, order, ids, offsets)

    def final(self, rows, demands, waiting) -> Iterator[pa.RecordBatch]:
        part = rows.take(pa.array(waiting, pa.int64()))
        self.rows, self.held = [part], len(waiting)
        yield from self.pack(last=True)
        self.rows, self.held = [], 0

    def packed(self, rows, order, ids, offsets) -> pa.RecordBatch:
        out = rows.take(pa.array(order, pa.int64()))
        columns = [*out.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())]
        return pa.record_batch(columns, [*rows.schema.names, "sequence_id", "offset"])


def pack_batches(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Add ``sequence_id`` and ``offset`` to rows with ``length`` and ``loss_tokens``."""
    window = Window(limits, TaskContext.get().partitionId() << PARTITION_BITS)
    for batch in batches:
        yield from window.add(batch)
    yield from window.pack(last=True)


def pack(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack rows that have ``length`` and ``loss_tokens`` (whole numbers) into sequences.

    All columns stay; ``sequence_id`` and ``offset`` (tokens before the row in
    its sequence) are added, in place of columns of those names. A row must fit
    a sequence alone. Rows are packed per partition, so partitions should hold
    many sequences' worth of rows. An empty table gives no rows.
    """
    df = df.drop("sequence_id", "offset")
    schema = T.StructType([*df.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return df.mapInArrow(lambda batches: pack_batches(batches, limits), schema)


def cut_batches(
    batches: Iterator[pa.RecordBatch], kept: Sequence[str], tokenizer_json: str, length: int
) -> Iterator[pa.RecordBatch]:
    """The documents of each batch as pieces of at most ``length`` ids."""
    ids_of = words.encoder(tokenizer_json)
    end = np.array([END_OF_TEXT], dtype="<u4").tobytes()
    for batch in batches:
        row, starts, lengths, ids, totals = [], [], [], [], []
        for i, text in enumerate(shared.texts_of(batch)):
            document = ids_of(text) + end
            total = len(document) // 4
            for at in range(0, total, length):
                piece = document[4 * at : 4 * (at + length)]
                row.append(i)
                starts.append(at)
                lengths.append(len(piece) // 4)
                ids.append(piece)
                totals.append(total)
        columns = [batch.column(c).take(pa.array(row, pa.int64())) for c in kept]
        long = pa.int64()
        columns += [pa.array(starts, long), pa.array(lengths, long), pa.array(lengths, long)]
        columns += [pa.array(ids, pa.binary()), pa.array(totals, long)]
        yield pa.record_batch(columns, [*kept, "start", "length", "loss_tokens", "ids", "doc_tokens"])


def pack_documents(
    df: DataFrame, tokenizer_path: str, limits: Limits = Limits(), kept: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Tokenise column ``text``, cut documents into pieces and pack the pieces.

    A document is its ids and the end-of-text id, so a null or empty text is one
    id; every id bears loss. Documents longer than a sequence give full pieces
    and a rest. Returns ``kept``, ``start`` (ids before the piece), ``length``,
    ``loss_tokens``, ``ids`` (binary, little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset``; repeated rows are packed
    each, and of other columns only ``kept`` are looked at. An empty table gives no
    rows. Pieces are packed in the task that cuts them.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = df.sparkSession.sparkContext.broadcast(file.read())
    long = T.LongType()
    schema = shared.fields(
        df,
        kept,
        *[(n, long) for n in ("start", "length", "loss_tokens")],
        ("ids", T.BinaryType()),
        *[(n, long) for n in ("doc_tokens", "sequence_id", "offset")],
    )

    length = min(limits.length, limits.loss_tokens)

    def run(batches):
        return pack_batches(cut_batches(batches, kept, tokenizer_json.value, length), limits)

    return df.select(*kept, "text").mapInArrow(run, schema)
