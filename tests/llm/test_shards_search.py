"""Operators 2 and 6 against brute force on odd rows; test_queries holds them against SQL."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from tidepanel.llm import search, sharding


def test_byte_shards_of_odd_rows(odd, empty, odd_rows):
    rows = sharding.byte_shards(odd, 4).collect()
    want = sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in odd_rows
    )
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows} <= set(range(4))
    assert sharding.byte_shards(empty, 4).count() == 0


def test_byte_shards_are_even_and_keep_small_groups_together(many):
    rows = sharding.byte_shards(many, 5).collect()
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(5)]
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 4 * largest


def test_one_text_that_holds_most_rows_is_spread(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    rows = sharding.byte_shards(df, 8).collect()
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 40


def brute(queries, vectors, k):
    out = []
    for qid, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), vid) for vid, v in vectors if vid != qid)
        out += [(qid, rank, vid, -s) for rank, (s, vid) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["signed", "positive", "sparse", "ties", "large"])
def test_search_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 150)
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    monkeypatch.setattr(search, "STEP_ROWS", 16)
    monkeypatch.setattr(search, "SEED_ROWS", 3 if kind in ("signed", "ties") else 40)
    pick = np.random.default_rng(4)
    if kind == "ties":
        data = pick.integers(-1, 2, (400, 4))
    elif kind == "positive":
        data = pick.integers(0, 90, (400, 12))
    elif kind == "sparse":
        data = pick.integers(1, 90, (400, 30)) * (pick.random((400, 30)) < 0.1)
    elif kind == "large":
        data = pick.integers(-(2**27), 2**27, (200, 8))
    else:
        data = pick.integers(-200, 200, (400, 16))
    vectors = [(i, [int(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    got = search.top_k(df.filter("vec_id % 20 = 0"), df, 5).collect()
    assert sorted(tuple(r) for r in got) == brute([v for v in vectors if v[0] % 20 == 0], vectors, 5)


def test_max_score_touches_less_than_a_dense_search(monkeypatch):
    """With a threshold from the start, most terms of most vectors are never read."""
    pick = np.random.default_rng(8)
    centres = pick.normal(size=(12, 32)) * 60
    vectors = np.floor(centres[pick.integers(0, 12, 3000)] + pick.normal(size=(3000, 32)) * 20)
    columns, ids = np.ascontiguousarray(vectors.T), np.arange(3000)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = np.asarray(self)[key]
            if isinstance(key, tuple) and isinstance(key[0], slice):
                return out.view(Counted)
            read.append(out.size)
            return out

    dense = 0
    for i in range(40):
        scores = columns.T @ vectors[i]
        want = sorted(((-s, j) for j, s in enumerate(scores) if j != i))[:5]
        top = search.max_score(
            vectors[i], i, ids, columns.view(Counted), vectors.min(axis=0), vectors.max(axis=0), 5, int(-want[-1][0]) - 50
        )
        assert list(zip([-s for s in top.scores], top.ids)) == want
        dense += vectors.size
    assert sum(read) < 0.8 * dense


def test_search_of_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]),
        (1, None),
        (2, [1.0, None]),
        (3, [1.0, float("nan")]),
        (4, [float("inf"), 1.0]),
        (5, [0.5, -0.001]),
        (5, [0.5, -0.001]),
        (6, []),
        (None, [1.0, 1.0]),
        (50, [3.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter(search.usable("embedding"))
    vectors = df.select("vec_id", search.quantised("embedding").alias("vector"))
    assert {r.vec_id for r in vectors.collect()} == {0, 5, 6, None, 50}
    got = search.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5).collect()
    # floor(256 * -0.001) is -1; a missing component is 0.
    whole = [(0, [256, 512]), (5, [128, -1]), (5, [128, -1]), (6, []), (50, [768])]
    assert sorted(tuple(r) for r in got) == brute([whole[0], whole[4]], whole, 5)
    none = vectors.filter("false")
    assert search.top_k(none, none, 5).count() == 0
    assert search.top_k(vectors.filter("vec_id = 0"), none, 5).count() == 0
    assert math.floor(256 * -0.001) == -1
