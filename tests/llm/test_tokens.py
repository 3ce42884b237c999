"""Operators 4, 7 and 9 against their libraries and brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidepanel.llm import bpe, counts, packing, words

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

HARD = [
    "",
    "   ",
    "don't I'LL ''s x's 'S're",
    "<|endoftext|> a<|startoftext|>b",
    "Σας ΣΑΣ İstanbul ǅ é́ x\x0by\x1cz 12３ ²½ 中文字 हिन्दी ñ'S",
    "L'eau naïve… a$$, (x) ſ ß ẞ \U0001f600 _x_ A.B,C d'Artagnan're  \n\n  two  spaces ",
    "a" * 3000,
    "word's non breaking　spaces\u0085x",
]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


def test_word_ids_equal_the_library(odd_rows):
    encode = words.encoder(open(WORD_FILE, encoding="utf-8").read())
    library = Tokenizer.from_file(WORD_FILE)
    for text in HARD + [t for _, t, _ in odd_rows if t]:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 3)
    encode = words.encoder(open(WORD_FILE, encoding="utf-8").read())
    library = Tokenizer.from_file(WORD_FILE)
    for text in HARD:
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 7, 100])
def test_safe_pieces_keep_the_ids(encoding, size):
    texts = HARD + ["it's 3x4 we've\n\n  \tend. 'tis", "x1y2 z²٣", "don't'll ve're"]
    for text in texts:
        assert "".join(bpe.safe_pieces(text, size)) == text
        assert bpe.encode_text(encoding, text, size) == encoding.encode_ordinary(text)


def test_bytes_round_trip(spark, odd, empty, encoding, odd_rows):
    rows = bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()
    got = collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows)
    want = collections.Counter(
        (d, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for d, t, _ in odd_rows
    )
    assert got == want
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_trie_counts_equal_brute_force():
    scores, byte_score = counts.read_vocabulary(PIECES)
    longest = max(map(len, scores))
    pick = random.Random(3)
    letters = "abcdefinorst▁é漢\U0001f600"
    tokens = {"▁" + "".join(pick.choices(letters, k=pick.randrange(0, 14))) for _ in range(500)} | {""}

    def brute(token):
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            size = len(token[end - 1].encode())
            options = [(best[end - 1][0] + size * byte_score, best[end - 1][1] - size)]
            options += [
                (best[b][0] + scores[token[b:end]], best[b][1] - 1) for b in range(end) if token[b:end] in scores
            ]
            best.append(max(options))
        return -best[-1][1]

    found = counts.trie_counts(tokens, scores, byte_score, longest)
    assert found == {t: brute(t) for t in tokens}


def test_token_counts_of_odd_rows(odd, empty, odd_rows):
    rows = counts.token_counts(odd, PIECES).collect()
    assert collections.Counter((r.doc_id, r.n_pretokens) for r in rows) == collections.Counter(
        (d, len((t or "").split())) for d, t, _ in odd_rows
    )
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].n_tokens == by_id[4].n_tokens == by_id[5].n_tokens == 0
    assert by_id[1].n_tokens == by_id[2].n_tokens >= 80
    assert counts.token_counts(empty, PIECES).count() == 0


def test_places_respect_every_limit():
    pick = np.random.default_rng(5)
    demands = np.column_stack([pick.integers(1, 900, 3000), np.ones(3000), pick.integers(0, 300, 3000)]).astype(float)
    limits = packing.Limits(length=1000, segments=4, loss_tokens=320).vector()
    bins = packing.place(demands, limits)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all((demands[b].sum(axis=0) <= limits).all() for b in bins)
    # No worse than a quarter above the bound that each limit alone sets.
    assert len(bins) <= 1.25 * (demands.sum(axis=0) / limits).max()


def test_places_of_equal_and_of_no_examples():
    limits = packing.Limits(length=10).vector()
    assert packing.place(np.zeros((0, 3)), limits) == []
    equal = np.tile([5.0, 1.0, 5.0], (7, 1))
    assert sorted(map(len, packing.place(equal, limits))) == [1, 2, 2, 2]


def test_packed_documents(spark, odd, empty, odd_rows):
    library = Tokenizer.from_file(WORD_FILE)
    limits = packing.Limits(length=512, segments=6, loss_tokens=512)
    rows = packing.pack_documents(odd, WORD_FILE, limits).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        assert sum(p.length for p in pieces) <= 512 and len(pieces) <= 6
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()))
    want = collections.defaultdict(list)
    for doc_id, text, _ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.END_OF_TEXT]
        want[doc_id] += [(at, len(ids), ids[at : at + 512]) for at in range(0, len(ids), 512)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack_documents(empty, WORD_FILE).count() == 0


def test_packing_in_windows_loses_nothing(spark, monkeypatch):
    pick = np.random.default_rng(9)
    rows = [(i, int(n), int(n) // 2) for i, n in enumerate(pick.integers(1, 4096, 9000))]
    df = spark.createDataFrame(rows, "example long, length long, loss_tokens long").coalesce(1)
    packed = packing.pack(df).toPandas()
    assert sorted(packed["example"]) == list(range(9000))
    used = packed.groupby("sequence_id")["length"].sum()
    assert used.max() <= 4096
    assert used.sum() / (4096 * len(used)) > 0.97


def padding(rows, limit=4096):
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= limit
    return 1 - sum(used.values()) / (limit * len(used))


def test_short_texts_leave_little_padding(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "'a' AS text").coalesce(1)
    rows = packing.pack_documents(df, WORD_FILE).collect()
    assert len(rows) == 20_000 and padding(rows) < 0.05


def best_fit(lengths, limit):
    """A plain best-fit decreasing packing: the number of sequences."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(limit - n)
    return len(room)


def test_no_more_sequences_than_best_fit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    rows = packing.pack_documents(docs, WORD_FILE).collect()
    assert len({r.sequence_id for r in rows}) <= 1.02 * best_fit([r.length for r in rows], 4096) + 1


def test_instruction_data_with_loss_on_the_answers(spark, sf_dir):
    """All three limits bind apart: tokens, turns, and the tokens of the answers only."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        "conv_id",
        "turn",
        "length(text) AS length",
        "if(role = 'assistant', length(text), 0) AS loss_tokens",
        "'clash' AS offset",
        "'clash' AS sequence_id",
    ).where("length <= 2000 AND length > 0")
    limits = packing.Limits(length=2000, segments=8, loss_tokens=1000)
    df = turns.where("loss_tokens <= 1000").coalesce(1)
    rows = packing.pack(df, limits).collect()
    assert collections.Counter((r.conv_id, r.turn) for r in rows) == collections.Counter(
        (r.conv_id, r.turn) for r in df.collect()
    )
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    sums = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in sequences.values()]
    assert all(t <= 2000 and n <= 8 and loss <= 1000 for t, n, loss in sums)
    total = np.sum(sums, axis=0) / limits.vector()
    assert len(sequences) <= 1.25 * total.max() + 1
