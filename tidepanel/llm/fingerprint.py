"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j the walk writes the character it
stands on and, by a random bit shared for (j, character), moves on or stays. An
edit makes two walks part, and they soon meet again, so the edit distance of
texts becomes the Hamming distance of what the walks write. A fingerprint keeps
the written characters, as 4 bits each, at fixed sampled steps: equally many
from each doubling of the length. Bands of samples drawn at random propose pairs,
and the likeness of whole fingerprints verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import neardup, shared
from tidepanel.llm.components import components
from tidepanel.storage import materialise

PERIOD = 4096  # steps after which the walk's random bits repeat
SAMPLES = 64  # samples of a doubling
DOUBLINGS = 44
PIECE = 1 << 18  # characters walked at a time
BAND = 10  # samples of a band
MISS = 1e-3  # chance that two fingerprints exactly at the threshold share no band
PAD = 16  # what a sampled step beyond the end of a walk holds
ROWS_PER_PART = 20_000

_RANDOM = np.random.Generator(np.random.PCG64(1968))


def _moves() -> list[list[int]]:
    """Steps until the walk leaves a character of each class that it reaches at each step."""
    bits = _RANDOM.integers(0, 2, size=(256, PERIOD)).astype(bool)
    out = np.zeros((256, PERIOD), dtype=np.int64)
    after = np.argmax(bits, axis=1) + 1  # from the start of the next period
    for j in range(PERIOD - 1, -1, -1):
        after = np.where(bits[:, j], 1, after + 1)
        out[:, j] = after
    return out.tolist()


MOVES = _moves()


def _sampled_steps() -> tuple[np.ndarray, np.ndarray]:
    """The sampled steps in order, and the weight of each: how many steps it stands for."""
    steps, weights = [0], [1.0]
    for d in range(DOUBLINGS):
        low, high = 1 << d, 1 << (d + 1)
        if high - low <= SAMPLES:
            chosen = range(low, high)
        else:
            chosen = sorted({low + int(x * (high - low)) for x in _RANDOM.random(SAMPLES)})
        steps += chosen
        weights += [(high - low) / len(chosen)] * len(chosen)
    return np.array(steps, dtype=np.int64), np.array(weights)


STEPS, WEIGHTS = _sampled_steps()
DIGITS = np.frombuffer(b"0123456789abcdefx", dtype=np.uint8)


def classes_of(text: str) -> np.ndarray:
    """One of 256 classes for each character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint8)


def walk(text: str, step: int, samples: np.ndarray, stops: tuple[int, ...] = ()) -> tuple[int, list[int]]:
    """Walk a text from ``step`` on; fill ``samples``; return the end step and the steps at ``stops``.

    ``stops`` are places in the text, in order.
    """
    at_stops = []
    for at in range(0, len(text), PIECE):
        classes = classes_of(text[at : at + PIECE])
        arrivals = []
        for c in classes.tobytes():
            arrivals.append(step)
            step += MOVES[c][step & (PERIOD - 1)]
        reached = np.array(arrivals, dtype=np.int64)
        low, high = np.searchsorted(STEPS, [reached[0], step])
        on = np.searchsorted(reached, STEPS[low:high], side="right") - 1
        samples[low:high] = classes[on] & 15
        at_stops += [arrivals[s - at] for s in stops if at <= s < at + len(arrivals)]
    return step, at_stops


def written(samples: np.ndarray, end: int) -> str:
    """The samples up to the doubling that holds the last step, as hexadecimal digits and x."""
    if end == 0:
        return ""
    size = int(np.searchsorted(STEPS, 1 << max(0, (end - 1).bit_length())))
    return DIGITS[samples[:size]].tobytes().decode()


@dataclass
class Walked:
    """A text's walk: its samples, its end, and the step at which its last third begins."""

    samples: np.ndarray
    end: int
    head_end: int

    @classmethod
    def of(cls, text: str) -> Walked:
        samples = np.full(len(STEPS), PAD, dtype=np.uint8)
        head = len(text) - len(text) // 3
        end, stops = walk(text, 0, samples, (head,))
        return cls(samples, end, stops[0] if stops else end)

    def edited(self, tail: str) -> tuple[np.ndarray, int]:
        """Samples and end of the walk whose text has ``tail`` in the place of its last third."""
        samples = self.samples.copy()
        samples[np.searchsorted(STEPS, self.head_end) :] = PAD
        end, _ = walk(tail, self.head_end, samples)
        return samples, end

    @property
    def fingerprint(self) -> str:
        return written(self.samples, self.end)


def likeness(a: str, b: str) -> float:
    """Share of the steps, as the samples tell it, at which two walks write the same; 1 for two empty texts."""
    size = max(len(a), len(b))
    x = np.frombuffer(a.ljust(size, "x").encode(), dtype=np.uint8)
    y = np.frombuffer(b.ljust(size, "x").encode(), dtype=np.uint8)
    counted = WEIGHTS[:size] * ~((x == DIGITS[PAD]) & (y == DIGITS[PAD]))
    total = counted.sum()
    return float((counted * (x == y)).sum() / total) if total else 1.0


def fingerprints(df: DataFrame, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept``, ``n_chars`` and ``fingerprint`` of column ``text``; null counts as empty.

    Equal texts have equal fingerprints; that of an empty text is empty.
    """
    schema = shared.fields(df, kept, ("n_chars", T.LongType()), ("fingerprint", T.StringType()))

    def start():
        def step(batch):
            texts = shared.texts_of(batch)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(list(map(len, texts)), pa.int64())]
            columns += [pa.array([Walked.of(t).fingerprint for t in texts], pa.string())]
            return pa.record_batch(columns, schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)


def compared(text: str, walked: Walked, after: str, next_fingerprint: str) -> dict[str, object]:
    """A text beside its edited form, which ends with the start of the text ``after``."""
    third = len(text) // 3
    tail = after[:third]
    samples, end = walked.edited(tail)
    own, edited = walked.fingerprint, written(samples, end)
    content = text[: len(text) - third] + tail
    return {
        "edited_sha256": hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(),
        "edited_fingerprint": edited,
        "near_edited": likeness(own, edited),
        "near_next": likeness(own, next_fingerprint),
    }


RESULTS = ("edited_sha256", "edited_fingerprint", "near_edited", "near_next")
OUT = T.StructType(
    [
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def compare_with_next(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprint of every text, and of the text that ends like the next one begins.

    The next row is the one after it in descending order of ``key``, the first
    one after the last; rows that repeat a key follow their place in the input,
    null keys come last. In the edited text the last third of the characters
    (rounded down) is replaced by as many of the next text's first, or all of
    them. Null counts as empty; a single row follows itself; an empty table
    gives no rows. Returns ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Texts are shuffled once, into ranges of the key. Each range walks its texts
    in order; only its first and last texts are written, for the neighbour's
    sake.
    """
    rows = df.select(key, F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_PART))
    order = [F.desc_nulls_last(key), F.asc("_row")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(key, "text")
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("n_chars", T.LongType()),
            T.StructField("fingerprint", T.StringType()),
            *OUT.fields,
            T.StructField("_part", T.IntegerType()),
            T.StructField("_first", T.StringType()),
            T.StructField("_last", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = schema.names
        before = None  # the row that waits for the next text

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, pa.schema([pa.field(n, types[n]) for n in names]))

        types = None
        for batch in batches:
            if types is None:
                strings = dict.fromkeys(("fingerprint", *RESULTS[:2], "_first", "_last"), pa.string())
                doubles = dict.fromkeys(RESULTS[2:], pa.float64())
                types = {key: batch.schema.field(0).type, "n_chars": pa.int64(), "_part": pa.int32()} | strings | doubles
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                walked = Walked.of(text)
                row = {key: k, "n_chars": len(text), "fingerprint": walked.fingerprint, "_part": part}
                if before is None:
                    row["_first"] = text
                else:
                    last_row, last_text, last_walk = before
                    done.append(last_row | compared(last_text, last_walk, text, row["fingerprint"]))
                before = row, text, walked
            if done:
                yield out(done)
        if before:
            yield out([before[0] | {"_last": before[1]}])

    # Digits of 4 bits each: half of their bytes go when they are written densely.
    walked = materialise(ranged.mapInArrow(run, schema), "walks", compression="zstd")
    columns = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    complete = walked.filter("_last IS NULL").select(*columns)
    # One first and one last text for each range; the ranges follow one another.
    ranges = sorted(r[0] for r in walked.filter("_last IS NOT NULL").select("_part").collect())
    if not ranges:
        return complete
    follows = df.sparkSession.createDataFrame(
        list(zip(ranges, ranges[1:] + ranges[:1])), "_part int, _next int"
    )
    firsts = walked.filter("_first IS NOT NULL").select(
        F.col("_part").alias("_next"), F.col("_first").alias("_after"), F.col("fingerprint").alias("_after_print")
    )
    lasts = walked.filter("_last IS NOT NULL").select(key, "n_chars", "fingerprint", "_part", F.col("_last").alias("_text"))
    ends = lasts.join(follows, "_part").join(firsts, "_next")
    kept = [key, "n_chars", "fingerprint"]
    end_schema = T.StructType([schema[c] for c in kept] + OUT.fields)

    def finish():
        def step(batch):
            columns = [batch.column(c).to_pylist() for c in ("_text", "_after", "_after_print")]
            found = [compared(t, Walked.of(t), after, print_) for t, after, print_ in zip(*columns)]
            arrays = [pa.array([f[n] for f in found]) for n in RESULTS]
            return pa.record_batch([*[batch.column(c) for c in kept], *arrays], end_schema.names)

        return step

    finished = shared.map_batches(ends.select(*kept, "_text", "_after", "_after_print"), finish, end_schema)
    return complete.unionByName(finished)


@dataclass(frozen=True)
class Bands:
    """Bands that two fingerprints of likeness ``least`` or more both have, but for a chance of MISS.

    The steps that a walk has reached are cut into classes that grow by
    1 / ``least``, so two such walks are of one class or of neighbouring ones.
    A class has its own bands: each takes ``BAND`` steps drawn at random, with
    replacement and in proportion to the steps they stand for, from those up to
    the end of the class. What lies beyond a walk's end counts as a value of its
    own. So a drawn step agrees with at least the chance ``least``, a band with
    ``least ** BAND``, and all ``number`` bands fail with MISS at most. A walk
    takes the bands of its class and of the next longer one.
    """

    least: float

    @property
    def number(self) -> int:
        return ceil(log(MISS) / log(1 - self.least**BAND))

    def keys(self, fingerprint: str) -> np.ndarray:
        """One number per band of a fingerprint that is not empty; equal bands have equal numbers."""
        digits = digits_of(fingerprint)
        size = int(np.searchsorted(digits == PAD, True))  # the walk ends before its first x
        own = int(log(REACHED[size]) / log(1 / (self.least - 1e-9)))
        found = []
        for longer in (own, own + 1):
            drawn = drawn_samples(longer, self.least, self.number)
            values = np.where(drawn < size, digits[np.minimum(drawn, size - 1)], PAD).astype(np.uint64)
            found.append(mixed(longer, values))
        return np.concatenate(found).view(np.int64)


REACHED = np.concatenate([[0.0], np.cumsum(WEIGHTS)])  # how many steps the first samples stand for
PLACES = np.zeros(128, dtype=np.uint8)  # of a digit
PLACES[DIGITS] = np.arange(len(DIGITS))


def digits_of(fingerprint: str) -> np.ndarray:
    return PLACES[np.frombuffer(fingerprint.encode(), dtype=np.uint8)]


@lru_cache(maxsize=None)
def drawn_samples(longer: int, least: float, number: int) -> np.ndarray:
    """For each band of a class, the samples it takes; the same in every task."""
    reach = (1 / (least - 1e-9)) ** (longer + 1)
    places = np.random.Generator(np.random.PCG64([1969, longer])).random((number, BAND)) * reach
    return np.searchsorted(REACHED, places, side="right") - 1


def mixed(longer: int, values: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each row of ``values``, which tells rows and classes apart."""
    rows = np.arange(len(values), dtype=np.uint64)
    h = (rows + np.uint64(longer << 20)) * np.uint64(0x9E3779B97F4A7C15)
    for column in values.T:
        h = (h ^ (h >> np.uint64(29))) + column + np.uint64(1)
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def unlikeness(prints: list[str]) -> Callable[[int], np.ndarray]:
    """For a fingerprint, how unlike each later one is."""
    size = max(map(len, prints))
    digits = np.stack([digits_of(p.ljust(size, "x")) for p in prints])
    weights = WEIGHTS[:size]

    def apart_from(i: int) -> np.ndarray:
        later = digits[i + 1 :]
        counted = (later != PAD) | (digits[i] != PAD)
        return ((later != digits[i]) @ weights) / (counted @ weights)

    return apart_from


def near_texts(prints: DataFrame, least: float) -> DataFrame:
    """(doc_id, component): groups of rows whose fingerprints are alike to ``least`` or more.

    ``prints`` has doc_id and fingerprint. Two fingerprints that share a band
    are compared whole; equal ones are one class whose members are never paired.
    A pair exactly at ``least`` shares no band with chance ``MISS``, a more alike
    one more rarely, whatever the length of the texts; a pair that is found by
    other members of its group is not lost. Bands with the same members are
    looked at once, large ones block by block, and only a spanning forest leaves
    a block. Rows with a null id or an empty fingerprint are in no group; a row
    alone in its group is its own component; an empty table gives none. Other
    columns are ignored.
    """
    usable = prints.select("doc_id", "fingerprint").filter("doc_id IS NOT NULL AND fingerprint <> ''")
    same = materialise(usable.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "prints", compression="zstd")
    schema = T.StructType([same.schema["rep"], T.StructField("keys", T.ArrayType(T.LongType()))])
    bands = Bands(least)

    def start():
        def step(batch):
            keys = [bands.keys(f) for f in batch.column("fingerprint").to_pylist()]
            return pa.record_batch([batch.column("rep"), pa.array(keys, pa.list_(pa.int64()))], ["rep", "keys"])

        return step

    keyed = shared.map_batches(same, start, schema).select("rep", F.explode("keys").alias("key"))
    # Most bands are met once: what goes on is what several fingerprints hold.
    several = keyed.groupBy("key").count().filter("count > 1").select("key")
    keyed = materialise(keyed.join(several, "key", "left_semi"), "bands")
    held = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("rep").alias("low"),
        F.max("rep").alias("high"),
        F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(2), "rep")).alias("y"),
    )
    held = held.groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key"))
    members = keyed.join(held.select("key", "n"), "key")
    cells = neardup.in_cells(members, "key", "rep", F.ceil(F.col("n") / neardup.KEY_BLOCK)).drop("n")
    cells = cells.join(same, "rep")
    order = ["key", "low", "high"]

    def run(batches):
        linked = neardup.Links()
        for cell in neardup.cells_of(batches, "key"):
            own = cell.column("own").to_numpy()
            ids = cell.column("rep").to_pylist()
            apart_from = unlikeness(cell.column("fingerprint").to_pylist())
            edges = neardup.forest(linked, ids, own, apart_from, 1 - least + 1e-9)
            if edges:
                yield neardup.edge_batch(edges)

    links = cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")
    # A repeated id with several fingerprints ties its classes together.
    ties = usable.join(same, "fingerprint").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    found = components(links.union(ties))
    return usable.select("doc_id").distinct().join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component")
    )


def with_groups(prints: DataFrame, least: float) -> DataFrame:
    """Add ``group_id``: the smallest doc_id of the row's group of ``near_texts``; its own without one.

    ``prints`` is read several times, so it should be a written table; equal rows keep
    their number.
    """
    mate, group = shared.free_names(prints, "_mate", "group_id")
    groups = near_texts(prints, least).filter("component <> doc_id")
    groups = groups.select(F.col("doc_id").alias(mate), F.col("component").alias(group))
    joined = prints.join(groups, F.col("doc_id") == F.col(mate), "left").drop(mate)
    return joined.withColumn(group, F.coalesce(group, "doc_id"))
