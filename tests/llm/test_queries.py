"""The registered queries at the smallest size: against SQL, or against a plain version over all rows."""

from __future__ import annotations

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import oracle
from tidepanel.llm import bpe, counts, fingerprint, queries

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert oracle.difference(spark, oracle.connect(sf_dir), name, sf_dir) is None


@pytest.mark.parametrize("name", ["op1_quality", "op3_language", "op5_toxicity"])
def test_scores_every_document(spark, sf_dir, texts, name):
    rows = run(spark, sf_dir, name)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1


def test_packing(spark, sf_dir, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = {}, {}
    for r in run(spark, sf_dir, "op4_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == sorted(texts)
    for doc_id, rows in pieces.items():
        ids = np.array(library.encode(texts[doc_id], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in used.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(length for rows in used.values() for _, length in rows)
    assert len(used) <= total / 4096 + 3


def test_bytes(spark, sf_dir, texts):
    encoding = tiktoken.Encoding(
        "own",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        special_tokens={},
    )
    rows = run(spark, sf_dir, "op7_bytes")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_near_duplicates(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op8_near_duplicates")
    want = brute.near_duplicates(list(texts.items()), 3, 85)
    assert {r.doc_id: r.component_id for r in rows} == want


def test_token_counts(spark, sf_dir, texts):
    scores, byte_score = counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    longest = max(map(len, scores))
    for r in run(spark, sf_dir, "op9_token_counts"):
        words = [counts.MARK + w for w in texts[r.doc_id].split()]
        # Each word by itself, so that nothing is shared.
        each = {w: counts.trie_counts([w], scores, byte_score, longest)[w] for w in set(words)}
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(each[w] for w in words))


def test_fingerprints(spark, sf_dir, texts):
    rows = run(spark, sf_dir, "op10_fingerprints")
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(texts)
    order = sorted(texts.items(), reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        content = text[: len(text) - third] + after[:third]
        assert got[doc_id].edited_sha256 == hashlib.sha256(content.encode()).hexdigest()
        assert got[doc_id].fingerprint == fingerprint.Walked.of(text).fingerprint
        assert got[doc_id].near_edited > got[doc_id].near_next or len(text) < 60 or text == after
