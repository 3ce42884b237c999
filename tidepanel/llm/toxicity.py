"""Toxicity of texts that hide their words: noisy-channel deobfuscation, then a score.

Leetspeak, spaced-out letters and repeated letters turn a word into a lattice
of readings. A Viterbi search under a character language model, whose counts
cover every document, picks the likeliest reading. The restored text is scored
by terms (words and their beginnings) learnt from all labelled documents.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import shared
from tidepanel.storage import materialise

# Share of a word, the mean over the labels, from which on runs are parted into it. So a million words at most
# are known, whatever the table's size.
LEAST_SHARE = 1e-6
# Evidence a term needs: the log-likelihood ratio of its toxic and clean documents.
LEAST_EVIDENCE = 10.0
# Share of a term's documents that are toxic, at least. Words of a language in which toxic documents are
# merely more frequent stay out.
LEAST_PRECISION = 0.5
# Orders of word pairs that tell copies of a text, pairs put in order at a time, and the share of common
# pairs from which two texts are copies.
SKETCH, SKETCH_PAIRS = 128, 1024
NEAR_COPY = 0.8
# Texts whose sketches begin alike that are compared with each other; of more, the first of each block meet again,
# where so many places agree.
WITNESS_BLOCK, AGREED = 512, 4
# Rows of ids that are sent to every executor, about 100 MB at most, so that no text is shuffled; more are joined
# as Spark's sizes tell.
BROADCAST_ROWS = 2_000_000
ORDERS, SHIFTS = np.random.default_rng(11).integers(1 << 62, size=(2, SKETCH), dtype=np.uint64) | np.uint64(1)
# Documents that a task counts the terms of at a time; distinct terms it holds before it gives their counts on.
TERM_ROWS = 64
HELD_TERMS = 200_000
# Distinct pieces of text that a task remembers, and the longest of them.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64

# Letters that a character may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
# What each reading costs in the channel (natural logarithms).
COST_SAME, COST_LEET, COST_DROP_SIGN, COST_DROP_DIGIT = 0.0, -1.5, -1.0, -4.0
COST_DROP_DOUBLE, COST_DROP_REPEAT = -2.0, -0.3
# An edge inside a run is no letter, so that it gets nothing for being read.
COST_JOINT = -math.log(28)

# Symbols of the language model: a to z, any other letter, and the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHER, EDGE = 26, 27
SYMBOLS = 28

WORD = re.compile(r"\S+")
LETTER_RUN = re.compile(r"[^\W\d_]+")
# A word with a sign or digit next to a letter, or a letter three times in a row.
HIDDEN = re.compile(r"(?:[^\W\d_][0-9@$!|+€£¡*._\-]+(?=[^\W\d_])|(?<!\S)[0-9@$!|+€£¡]+(?=[^\W\d_])|[^\W\d_][0-9@$|+€£¡]+)|([^\W\d_])\1\1")
# Signs that stand for no letter.
JOINT = re.compile(r"[^\w@$!|+€£¡]+")
# Four or more single characters, with up to four blanks, signs or format characters between neighbours;
# blanks, signs or the ends of the text are around them.
ONE = r"(?:[^\W_]|[@$!|+€£¡])"
SPACED = re.compile(rf"(?<![^\W_]){ONE}(?:(?:[^\w@$!|+€£¡]|_){{1,4}}{ONE}){{3,}}(?![^\W_])")
CHARACTER = re.compile(ONE)
# What every such run holds and few other texts do: two single characters between others.
TWO_SINGLE = re.compile(r"[\W_]\S[\W_]{1,4}\S[\W_]")
# Signs after a word that hide nothing.
AFTER = ".,;:?!*#&%-_)]}\"'"


@dataclass(frozen=True)
class CharacterModel:
    """log P(symbol | two symbols before), smoothed with the shorter contexts."""

    logs: list[float]  # (a * SYMBOLS + b) * SYMBOLS + c
    words: dict[str, float] = field(default_factory=dict)  # log P(word) of the commonest words

    def of(self, a: int, b: int, c: int) -> float:
        return self.logs[(a * SYMBOLS + b) * SYMBOLS + c]


def symbol(character: str) -> int:
    if character == " ":
        return EDGE
    place = LETTERS.find(character)
    return place if place >= 0 else OTHER


def symbols_of(text: str) -> np.ndarray:
    """Symbols of the words of a text; everything that is no letter is an edge."""
    c = np.frombuffer(shared.lowered(text).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    ascii_letter = (c >= 97) & (c <= 122)
    # From the Latin-1 letters on, a character counts as a letter unless it is punctuation or a symbol there.
    other = (c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c <= 0x2BFF)) & ~((c >= 0x3000) & (c <= 0x303F))
    return np.where(ascii_letter, c - 97, np.where(other, OTHER, EDGE))


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each triple of symbols occurs in all documents, counted per task and added up."""
    size = SYMBOLS**3

    def count():
        seen = np.zeros(size)

        def add(batch):
            nonlocal seen
            for text in shared.texts_of(batch):
                for at in range(0, len(text), shared.BLOCK_CHARS):
                    # Each piece begins two symbols early; a text begins and ends with edges.
                    part = symbols_of(text[max(0, at - 2) : at + shared.BLOCK_CHARS])
                    if at == 0:
                        part = np.concatenate([[EDGE, EDGE], part])
                    if at + shared.BLOCK_CHARS >= len(text):
                        part = np.concatenate([part, [EDGE]])
                    # Words of a running text have one edge between them: (edge, edge, x) counts as a start too.
                    a, b, c = part[:-2], part[1:-1], part[2:]
                    a = np.where(b == EDGE, EDGE, a)
                    seen += np.bincount((a * SYMBOLS + b) * SYMBOLS + c, minlength=size)

        return add, lambda: seen

    return shared.summed(docs.select("text"), size, count)


def character_model(counts: np.ndarray) -> CharacterModel:
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return CharacterModel(np.log(p3).ravel().tolist())


def readings(word: str, i: int) -> list[tuple[str, float]]:
    """The letters that place ``i`` may stand for, with their costs; '' drops the character, ' ' is a word's edge."""
    ch = word[i]
    if ch == " ":
        # Between the characters of a spaced-out run.
        return [("", COST_SAME), (" ", COST_JOINT)]
    if ch.isalpha():
        out = [(ch, COST_SAME)]
        step = 2 if i > 1 and word[i - 1] == " " else 1
        if i and word[i - step] == ch:
            # A letter three times or more is drawn out; twice may be its spelling, or in a run two words.
            if word[max(0, i - 2 * step) : i + step + 1 : step].count(ch) >= 3:
                out.append(("", COST_DROP_REPEAT))
            elif step == 1:
                out.append(("", COST_DROP_DOUBLE))
        return out
    out = [(letter, COST_LEET) for letter in LEET.get(ch, "")]
    out.append(("", COST_DROP_DIGIT if ch.isalnum() else COST_DROP_SIGN))
    if not ch.isalnum():
        out.append((" ", COST_JOINT))
    return out


def restore(word: str, model: CharacterModel) -> str:
    """The likeliest letters behind a word or run, by Viterbi search over its lattice; blanks part its words.

    States are the last two symbols; the end of the word is an edge. Scores are
    per letter read, so that dropping characters does not win by being short.
    A state's text is a chain of (text before, letter), so that runs of any
    length are read whole.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    for i in range(len(word)):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in states.items():
            for letter, cost in readings(word, i):
                if letter:
                    c = symbol(letter)
                    # A uniform letter costs log 28; above that a reading is better than none.
                    state, new = (b, c), score + cost + model.of(a, b, c) + math.log(SYMBOLS)
                    if state not in step or new > step[state][0]:
                        step[state] = new, (text, letter)
                else:
                    state, new = (a, b), score + cost
                    if state not in step or new > step[state][0]:
                        step[state] = new, text
        states = step
    _, text = max(((score + model.of(a, b, EDGE), text) for (a, b), (score, text) in states.items()), key=lambda s: s[0])
    letters = []
    while text is not None:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


def parted(letters: str, words: dict[str, float]) -> str:
    """The likeliest words behind letters without edges, with blanks between them; unknown ones cost by their length."""
    unknown = min(words.values(), default=0.0) - 1.0
    longest = max(map(len, words), default=1)
    best, since = [0.0], [0]
    for end in range(1, len(letters) + 1):
        top = (-math.inf, 0)
        for start in range(max(0, end - longest), end):
            word = letters[start:end]
            score = words.get(word)
            top = max(top, (best[start] + (unknown - len(word) * math.log(SYMBOLS) if score is None else score), start))
        best.append(top[0])
        since.append(top[1])
    parts, end = [], len(letters)
    while end:
        parts.append(letters[since[end] : end])
        end = since[end]
    return " ".join(reversed(parts))


def restore_run(run: str, model: CharacterModel) -> str:
    """The words behind a spaced-out run, its characters with blanks between them."""
    if not model.words:
        return restore(run, model)
    return parted(restore(run, model).replace(" ", ""), model.words)


def tallied(df: DataFrame, schema: str, start: Callable[[], tuple[Callable, Callable, Callable]]) -> DataFrame:
    """Counts over the rows of each task. ``start`` gives a task (add batch, entries held, rows of the counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, held, take = start()
        for batch in batches:
            for at in range(0, batch.num_rows, TERM_ROWS):
                add(batch.slice(at, TERM_ROWS))
                if held() >= HELD_TERMS:
                    yield take()
                    add, held, take = start()
        yield take()

    return df.mapInArrow(run, schema)


def common_words(learnt: DataFrame) -> dict[str, float]:
    """log P(word) of the plain words that the labelled documents hold more than once, the labels even.

    All labelled documents are counted. A word's probability is the mean of its
    shares of the words under each label, at least ``LEAST_SHARE``.
    """

    def start():
        counts = defaultdict(Counter)

        def add(batch):
            for label, text in zip(batch.column("label").to_pylist(), shared.texts_of(batch)):
                counts[label].update(LETTER_RUN.findall(shared.lowered(text)))

        def take():
            columns = [pa.array([k for k, c in counts.items() for _ in c], pa.int32())]
            columns += [pa.array([w for c in counts.values() for w in c], pa.string())]
            columns += [pa.array([n for c in counts.values() for n in c.values()], pa.int64())]
            return pa.record_batch(columns, ["label", "word", "n"])

        return add, lambda: sum(map(len, counts.values())), take

    found = tallied(learnt.select("label", "text"), "label int, word string, n long", start)
    found = materialise(found.groupBy("label", "word").agg(F.sum("n").alias("n")), "words")
    totals = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for label, total in totals.items():
        share = share + F.when(F.col("label") == label, F.col("n") / float(total * len(totals))).otherwise(0.0)
    common = found.groupBy("word").agg(F.sum("n").alias("n"), F.sum(share).alias("share"))
    rows = common.filter(f"n > 1 AND share >= {LEAST_SHARE}").collect()
    return {r["word"]: math.log(r["share"]) for r in rows}


def token_words(token: str, decode: Callable[[str], str]) -> set[str]:
    """The words of a piece without blanks, in every likely reading if it is obfuscated."""
    words = set(LETTER_RUN.findall(token))
    if HIDDEN.search(token):
        # A joint may hide a letter's place or part two words.
        for part in {token, *JOINT.split(token)}:
            if HIDDEN.search(part):
                words.update(LETTER_RUN.findall(decode(part)))
    return words


def spaced(run: str) -> str:
    """The characters of a spaced-out run with one blank between them."""
    return " ".join(CHARACTER.findall(run))


def run_words(lower: str, decode: Callable[[str], str]) -> set[str]:
    """The words behind the spaced-out runs of a text, parted and as one word."""
    words = set()
    if not TWO_SINGLE.search(lower):
        return words
    for run in set(SPACED.findall(lower)):
        read = decode(spaced(run))
        words.update(LETTER_RUN.findall(read))
        words.add(read.replace(" ", ""))
    return words


class Remembered(dict):
    """What ``read`` makes of a piece of text; short pieces are remembered."""

    def __init__(self, read: Callable[[str], object]):
        self.read = read

    def __missing__(self, piece: str):
        found = self.read(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found


def plain_words(lower: str) -> tuple[set[str], set[str]]:
    """The words that are whole pieces of a text, but for signs after them, and the other pieces."""
    tokens = set(lower.split())
    words, others = set(filter(str.isalpha, tokens)), set()
    for token in filterfalse(str.isalpha, tokens):
        word = token.rstrip(AFTER)
        if word.isalpha():
            words.add(word)
        elif word:
            others.add(token)
    letters = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    same = letters[1:] == letters[:-1]
    if (same[1:] & same[:-1]).any():
        # Some word is drawn out.
        others.update(filter(HIDDEN.search, tokens))
    return words, others


def restored_words(text: str, decode: Callable[[str], str]) -> set[str]:
    """The distinct words of a text, with obfuscated ones in every likely reading."""
    lower = shared.lowered(text)
    words, others = plain_words(lower)
    for token in others:
        words |= token_words(token, decode)
    return words | run_words(lower, decode)


def terms_of(words: set[str]) -> set[str]:
    """Words of at least three letters, and their beginnings of four to six."""
    out = set()
    for w in words:
        if len(w) >= 3:
            out.add(w)
            for n in (4, 5, 6):
                if len(w) > n:
                    out.add(w[:n] + "+")
    return out


def text_hash(text: str) -> int:
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def sketch(text: str) -> np.ndarray:
    """Least hashes of the pairs of neighbouring words under ``SKETCH`` orders; none without a word."""
    words = text.lower().split()
    pairs = set(zip(words, words[1:])) or {(w, "") for w in words}
    own = np.array([zlib.crc32(" ".join(p).encode("utf-8", "surrogatepass")) for p in pairs], dtype=np.uint64)
    parts = [own[at : at + SKETCH_PAIRS, None] for at in range(0, len(own), SKETCH_PAIRS)]
    least = [((part * ORDERS + SHIFTS) >> np.uint64(32)).min(axis=0) for part in parts]
    return np.min(least, axis=0).astype(np.uint32) if least else np.zeros(0, np.uint32)


def witnesses_of(texts: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(label, text hash, witness) of distinct (label, text hash, sketch).

    A text is the same witness as an earlier one whose sketch begins like its own
    and agrees with it in ``NEAR_COPY`` of its places.
    """
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for label, text, own in sorted(texts):
        own = np.frombuffer(own, np.uint32)
        groups.setdefault((label, int(own[0]) if len(own) else -1), []).append((text, own))
    out = []
    for (label, _), members in groups.items():
        leaders, known = [], np.zeros((len(members), len(members[0][1])), np.uint32)
        for text, own in members:
            # Texts without a word are copies of each other.
            near = np.flatnonzero((known[: len(leaders)] == own).sum(axis=1) >= NEAR_COPY * len(own))
            if not len(near):
                known[len(leaders)] = own
                leaders.append(text)
            out.append((label, text, leaders[near[0]] if len(near) else text))
    return out


def decoder(model: CharacterModel) -> Callable[[str], str]:
    return Remembered(lambda word: restore_run(word, model) if " " in word else restore(word, model)).__getitem__


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharacterModel
    terms: dict[str, float]  # log-odds of toxic documents
    slope: float
    bias: float


def term_value(word: str, terms: dict[str, float]) -> float:
    """The strongest term of a word, at least three letters long; 0 without one."""
    return max((terms[t] for t in (word, word[:4] + "+", word[:5] + "+", word[:6] + "+") if t in terms), default=0.0)


def strength(values: dict[str, float]) -> float:
    """The strongest term of a text and a fifth of the others, one term per word (word -> value)."""
    if not values:
        return 0.0
    top = max(values.values())
    return top + 0.2 * (sum(values.values()) - top)


def measurer(characters: CharacterModel, terms: dict[str, float]) -> Callable[[str], float]:
    """A function from a text to its strength."""
    decode = decoder(characters)
    # Terms have three letters at least.
    heads = {t[:3] for t in terms}

    def measure(text: str) -> float:
        words = [w for w in restored_words(text, decode) if w[:3] in heads]
        return strength({w: v for w in words if (v := term_value(w, terms))})

    return measure


def logistic(strengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and bias of a lightly penalised logistic curve, by Newton's method."""
    x = np.column_stack([strengths, np.ones(len(strengths))])
    w = np.array([0.5, 0.0])
    penalty = np.diag([0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + penalty @ w
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def joinable(ids: DataFrame, rows: int) -> DataFrame:
    """A table of ids to join texts with: broadcast while it is small."""
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def learnt_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(label, text, hash, sketch) of every row of ``docs`` whose id is in ``ids`` (doc_id, label)."""
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(ids, "doc_id")
    schema = shared.fields(rows, ("label", "text"), ("hash", T.LongType()), ("sketch", T.BinaryType()))

    def start():
        def step(batch):
            texts = shared.texts_of(batch)
            columns = [batch.column("label"), batch.column("text"), pa.array(map(text_hash, texts), pa.int64())]
            return pa.record_batch([*columns, pa.array([sketch(t).tobytes() for t in texts], pa.binary())], schema.names)

        return step

    return shared.map_batches(rows.select("label", "text"), start, schema)


def first_of_copies(texts: DataFrame, agreed: int) -> DataFrame:
    """(label, hash, witness, blocks, sketch) of those (label, hash, sketch) whose first places ``agreed`` others share.

    A witness is found in blocks of about ``WITNESS_BLOCK`` texts, ``blocks`` for the
    group; only witnesses keep their sketch.
    """
    keyed = texts.select("label", "hash", "sketch", F.substring("sketch", 1, 4 * agreed).alias("key"))
    groups = keyed.groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written, so that a join of a large group can be split.
    groups = materialise(groups.select("label", "key", F.ceil(F.col("n") / WITNESS_BLOCK).alias("blocks")), "groups")
    dealt = keyed.join(groups, ["label", "key"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "hash"), "blocks"))

    def run(batches):
        held, last = [], None

        def found():
            dealt = witnesses_of([(label, text, own) for label, text, own, _ in held])
            sketches = {text: own for _, text, own, _ in held}
            rows = [(label, text, w, held[0][3], sketches[text] if w == text else None) for label, text, w in dealt]
            return pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in rows], pa.schema(out))

        out = pa.schema([("label", pa.int32()), ("hash", pa.int64()), ("witness", pa.int64()), ("blocks", pa.int64()), ("sketch", pa.binary())])
        for batch in batches:
            for *now, text, own, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                if held and now != last:
                    yield found()
                    held = []
                last = now
                held.append((now[0], text, own, blocks))
        if held:
            yield found()

    order = ["label", "key", "block"]
    dealt = dealt.select(*order, "hash", "sketch", "blocks").repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "label int, hash long, witness long, blocks long, sketch binary")


def witnesses(learnt: DataFrame) -> DataFrame:
    """(label, hash, witness, copies) of the distinct texts under each label; copies of a text are one witness.

    Texts are compared where their sketches begin alike. Where more than a block
    do, each block finds its witnesses, and those meet once more.
    """
    texts = learnt.groupBy("label", "hash").agg(F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts, "texts")
    found = materialise(first_of_copies(texts, 1), "witnesses")
    heads = found.filter("blocks > 1 AND hash = witness").select("label", "hash", "sketch")
    again = first_of_copies(heads, AGREED).select("label", F.col("hash").alias("witness"), F.col("witness").alias("head"))
    found = found.select("label", "hash", "witness").join(again, ["label", "witness"], "left")
    found = found.select("label", "hash", F.coalesce("head", "witness").alias("witness"))
    named = texts.select("label", "hash", "copies").join(found, ["label", "hash"], "left")
    return named.select("label", "hash", F.coalesce("witness", "hash").alias("witness"), "copies")


def term_counts(learnt: DataFrame, named: DataFrame, characters: CharacterModel) -> DataFrame:
    """(term, toxic, clean): how many witnesses under each label hold a term.

    Rows that are a witness alone are counted per task; the terms of others go
    on with their witness, so that each counts once.
    """
    several = named.groupBy("label", "witness").agg(F.sum("copies").alias("rows")).filter("rows > 1").drop("rows")
    copied = materialise(named.select("label", "hash", "witness").join(several, ["label", "witness"]), "copied")
    copied = joinable(copied, copied.count())

    def start():
        decode = decoder(characters)
        alone, of_witness, read = defaultdict(Counter), defaultdict(set), set()

        def add(batch):
            columns = [batch.column(c).to_pylist() for c in ("label", "hash", "witness")]
            for label, own, witness, text in zip(*columns, shared.texts_of(batch)):
                if witness is None:
                    alone[label].update(terms_of(restored_words(text, decode)))
                elif (label, own) not in read:
                    read.add((label, own))
                    of_witness[label, witness] |= terms_of(restored_words(text, decode))

        def take():
            labels = [k for k, c in alone.items() for _ in c] + [k for (k, _), c in of_witness.items() for _ in c]
            those = [w for (_, w), c in of_witness.items() for _ in c]
            terms = [t for c in (*alone.values(), *of_witness.values()) for t in c]
            n = [n for c in alone.values() for n in c.values()]
            columns = [pa.array(labels, pa.int32()), pa.array([*repeat(None, len(n)), *those], pa.int64())]
            columns += [pa.array(terms, pa.string()), pa.array(n + [1] * len(those), pa.int64())]
            return pa.record_batch(columns, ["label", "witness", "term", "n"])

        def held():
            return sum(map(len, alone.values())) + sum(map(len, of_witness.values()))

        return add, held, take

    rows = learnt.select("label", "hash", "text").join(copied, ["label", "hash"], "left")
    found = tallied(rows, "label int, witness long, term string, n long", start)
    found = found.groupBy("label", "witness", "term").agg(F.sum("n").alias("n"))
    n = F.when(F.col("witness").isNull(), F.col("n")).otherwise(1)
    toxic, clean = (F.sum(F.when(F.col("label") == k, n).otherwise(0)).alias(name) for k, name in ((1, "toxic"), (0, "clean")))
    return found.groupBy("term").agg(toxic, clean)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Learn from ``labels`` (doc_id, toxic) of rows that are not held out; None without both labels.

    Language-model counts cover all of ``docs``; words, terms and the curve
    cover every labelled row, counted where the texts lie.
    """
    ids = shared.learnable(labels, "toxic")
    totals = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    learnt = materialise(learnt_texts(docs, joinable(ids, sum(totals.values()))), "learnt")
    named = materialise(witnesses(learnt), "named")
    numbers = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.countDistinct("witness").alias("n")).collect()}
    toxic, clean = numbers.get(1, 0), numbers.get(0, 0)
    if not toxic or not clean:
        return None
    characters = replace(character_model(character_counts(docs)), words=common_words(learnt))
    counted = term_counts(learnt, named, characters)
    # The rows of a label, dealt to its witnesses.
    weight_toxic, weight_clean = totals[1] / toxic, totals[0] / clean
    precision = F.col("toxic") * weight_toxic / (F.col("toxic") * weight_toxic + F.col("clean") * weight_clean)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    share = toxic / (toxic + clean)
    both = F.col("toxic") + F.col("clean")
    evidence = F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))
    ).otherwise(0.0)
    rows = (
        # Of few documents a term may be toxic by chance.
        counted.filter(F.col("toxic") > 0)
        .filter(evidence >= LEAST_EVIDENCE)
        .filter(precision >= LEAST_PRECISION)
        .withColumn("odds", odds - 1.0 / F.sqrt("toxic"))
        .filter(F.col("odds") > 0)
        .collect()  # the model's own terms
    )
    terms = {r["term"]: float(r["odds"]) for r in rows}

    def measure():
        strength_of = measurer(characters, terms)

        def step(batch):
            values = [strength_of(t) for t in shared.texts_of(batch)]
            return pa.record_batch([batch.column("label"), pa.array(values, pa.float64())], ["label", "strength"])

        return step

    schema = shared.fields(learnt, ["label"], ("strength", T.DoubleType()))
    # Rounded and counted, so that the curve is fitted on a short table.
    curve = (
        shared.map_batches(learnt.select("label", "text"), measure, schema)
        .groupBy("label", F.round("strength", 1).alias("strength"))
        .count()
        .orderBy("label", "strength")
        .toPandas()
    )
    # The curve counts rows, copies too.
    weight = curve["label"].map({k: totals[k] / n for k, n in curve.groupby("label")["count"].sum().items()}).to_numpy(float)
    weight *= curve["count"].to_numpy(float)
    slope, bias = logistic(curve["strength"].to_numpy(float), curve["label"].to_numpy(float), weight)
    return ToxicityModel(characters, terms, slope, bias)


def scores(model: ToxicityModel | None, texts: list[str], strength_of: Callable[[str], float]) -> np.ndarray:
    """Probability of toxicity; 0 without a model, and without any learnt term the curve's foot."""
    if model is None:
        return np.zeros(len(texts))
    values = np.array([strength_of(t) for t in texts], dtype=float)
    return 1 / (1 + np.exp(-np.clip(model.slope * values + model.bias, -30, 30)))


def task_measurer(model: ToxicityModel | None) -> Callable[[str], float]:
    return measurer(model.characters, model.terms) if model else len


def predict(
    df: DataFrame, model: ToxicityModel | None, kept: tuple[str, ...] = ("doc_id",), least: float = 0.7
) -> DataFrame:
    """Columns ``kept`` with ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on) of column ``text``.

    Null and empty texts hold no term and get the score of such texts. Texts
    are read whole; repeated rows each get their row; other columns are ignored.
    """
    schema = shared.fields(df, kept, ("score", T.DoubleType()), ("predicted", T.IntegerType()))

    def start():
        strength_of = task_measurer(model)

        def step(batch):
            score = scores(model, shared.texts_of(batch), strength_of)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(score), pa.array((score >= least).astype(np.int32))]
            return pa.record_batch(columns, schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)


def keep(docs: DataFrame, model: ToxicityModel | None, least: float = 0.7) -> DataFrame:
    """The documents, all columns, whose score is below ``least``; every row without a model."""

    def start():
        strength_of = task_measurer(model)

        def step(batch):
            score = scores(model, shared.texts_of(batch), strength_of)
            return batch.filter(pa.array(score < least, pa.bool_()))

        return step

    return shared.map_batches(docs, start, docs.schema)


def restore_texts(df: DataFrame, model: CharacterModel, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``kept`` and ``restored``: the text with its obfuscated words read as the model reads them.

    A word without letters behind it stays as it is; null stays null.
    """
    schema = shared.fields(df, kept, ("restored", T.StringType()))

    def start():
        decode = decoder(model)

        def word(match: re.Match) -> str:
            lower = shared.lowered(match[0])
            if not HIDDEN.search(lower):
                return match[0]
            return decode(lower).strip() or match[0]

        def step(batch):
            texts = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    text = SPACED.sub(lambda m: decode(spaced(shared.lowered(m[0]))).strip() or m[0], text)
                    text = WORD.sub(word, text)
                texts.append(text)
            return pa.record_batch([*[batch.column(c) for c in kept], pa.array(texts, pa.string())], schema.names)

        return step

    return shared.map_batches(df.select(*kept, "text"), start, schema)
