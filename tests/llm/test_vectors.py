"""Operators 11 to 13 against plain versions; test_queries holds 11 and 13 against SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import codes, neighbours, queries, resample


# --- 11: importance resampling ------------------------------------------------


def plain_features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(f.encode()) for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def plain_resample(rows, targets, percent=25, least=20):
    def buckets(texts):
        return Counter(h % 10000 for t in texts for h in plain_features(t)[1])

    corpus, target = buckets(t for _, t in rows), buckets(targets)
    s_all, t_all = sum(corpus.values()), sum(target.values())

    def gain(b):
        return math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((corpus[b] + 1) * (t_all + 10000))))

    out = []
    for i, (doc_id, text) in enumerate(rows):
        words, found = plain_features(text)
        weight = sum(gain(h % 10000) for h in found) // len(found) if found else 0
        key = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words)])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(order[: percent * len(order) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


TARGETS = ["The quiet river, under stone!", "green light WINDOW window", None, ""]


def drawn(docs, spark, **settings):
    target = spark.createDataFrame([(t,) for t in TARGETS], "text string")
    return sorted((tuple(r) for r in resample.resample(docs, target, **settings).collect()), key=repr)


def test_resampling_of_odd_rows(spark, odd, odd_rows):
    assert drawn(odd, spark) == plain_resample([r[:2] for r in odd_rows], TARGETS)


@pytest.mark.parametrize("percent", [0, 1, 25, 99, 100])
def test_resampling_of_many_rows(spark, many, percent):
    rows = [tuple(r) for r in many.collect()]
    assert drawn(many, spark, percent=percent) == plain_resample(rows, TARGETS, percent)


def test_resampling_of_one_id_that_holds_most_rows(spark):
    """All its scores are equal, so the cutoff cuts through them."""
    rows = [(7 if i % 3 else i, "one same text of more than a few words " * 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert drawn(df, spark) == plain_resample(rows, TARGETS)


def test_resampling_of_empty_tables(spark, empty, many):
    assert drawn(empty, spark) == []
    none = resample.resample(many, empty).collect()
    assert len(none) == many.count() and sum(r["rank"] is not None for r in none) > 0


def test_features_across_blocks(monkeypatch):
    text = "Über den Fluß, 12 times: a-b  c" * 50
    whole = sorted(plain_features(text)[1])
    for size in (1, 3, 17, 1 << 20):
        monkeypatch.setattr(resample, "BLOCK_BYTES", size)
        parts = list(resample.features(text.encode()))
        assert sorted(int(h) for _, hashes in parts for h in hashes) == whole
        assert sum(n for n, _ in parts) == len(plain_features(text)[0])


@pytest.mark.parametrize("spread", [1e-9, 0.002, 0.9])
def test_cutoff_widens_a_wrong_bracket(spark, monkeypatch, spread):
    """With a bracket that begins too narrow, exact counts widen it; the cutoff stays exact."""
    monkeypatch.setattr(resample, "BRACKET", spread)
    monkeypatch.setattr(resample, "SKETCH_ACCURACY", 2)
    values = [(i * 7919) % 3001 for i in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "score long")
    for wanted in (1, 10, 1000, 3999, 4000):
        assert resample.cutoff(df, wanted, len(values)) == sorted(values, reverse=True)[wanted - 1]
    assert resample.cutoff(df, 0, len(values)) is None


# --- 12: approximate neighbours -----------------------------------------------


def plain_neighbours(rows, k):
    """Exact answers of the queries, an id divisible by 5 each; equal rows count once."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(math.isfinite(x) for x in v) and any(v)})
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([[*v, *([0] * (width - len(v)))] for _, v in rows]).reshape(len(rows), width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, (query, _) in enumerate(rows):
        if query % 5 == 0 and query not in out:
            scored = sorted((-round(float(s), 12), vid) for s, (vid, _) in zip(x @ x[i], rows) if vid != query)
            out[query] = [(vid, -s) for s, vid in scored[:k]]
    return out


def found(df, k, **settings):
    out = {}
    for r in neighbours.nearest(df.filter("vec_id % 5 = 0"), df, k, **settings).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r["rank"] == len(out[r.query_id])
    return out


def hits(got, want):
    return sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def clustered(n, seed=4, width=16):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(20, width))
    return [(i, (centres[i % 20] + 0.4 * pick.normal(size=width)).tolist()) for i in range(n)]


def test_neighbours_reach_their_recall(spark):
    rows = clustered(3000)
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(4)
    got, want = found(df, 5, calibration_queries=200), plain_neighbours(rows, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert hits(got, want) >= 0.93


def test_neighbours_visit_less_than_all_leaves(spark, monkeypatch):
    seen = []
    calibrated = neighbours.calibrated
    monkeypatch.setattr(neighbours, "calibrated", lambda tree, *rest: seen.append((calibrated(tree, *rest), len(tree.leaves))) or seen[-1][0])
    rows = clustered(3000)
    found(spark.createDataFrame(rows, "vec_id long, vector array<double>"), 5)
    (visits, leaves), = seen
    assert leaves > 40 and visits <= leaves / 3


def test_neighbours_are_exact_when_all_are_reached(spark):
    rows = clustered(300) + [(1000 + i, [1.0] * 16) for i in range(120)]  # a group of copies, too
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    assert found(df, 5, recall=1.0, calibration_queries=1000) == plain_neighbours(rows, 5)


def test_neighbours_of_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0], "a"),
        (0, [1.0, 2.0], "b"),
        (1, None, "x"),
        (2, [1.0, None], "x"),
        (3, [1.0, float("nan")], "x"),
        (4, [float("inf"), 1.0], "x"),
        (5, [3.0], "x"),
        (6, [], "x"),
        (7, [0.0, 0.0], "x"),
        (None, [1.0, 1.0], "x"),
        (10, [1e-200, 1e-200], "x"),
        (15, [1e200, 1e200], "x"),
        (9, [1.0, 2.0], "x"),
        (11, [-1.0, 0.5], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, score string").withColumn("leaf", df_lit("y"))
    plain = [(i, v) for i, v, _ in rows if v is None or None not in v]
    got = found(df, 20)
    want = plain_neighbours([(i, [x * (1e200 if i == 10 else 1e-200 if i == 15 else 1) for x in v] if v else v) for i, v in plain], 20)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}
    none = df.filter("false")
    assert neighbours.nearest(none, none, 5).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), none, 5).count() == 0
    assert neighbours.nearest(none, df, 5).count() == 0
    assert found(df.filter("vec_id = 5"), 5) == {}


def df_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_cells_are_bounded(spark, monkeypatch):
    """Leaves and their visitors are cut; no pair is lost or found twice."""
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 16)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 7)
    monkeypatch.setattr(neighbours, "STEP", 5)
    rows = clustered(400)
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    assert found(df, 5, recall=1.0, calibration_queries=1000) == plain_neighbours(rows, 5)


def test_tree_visits_every_leaf_once_nearest_centres_first():
    x = neighbours.units(np.random.default_rng(1).normal(size=(500, 8)))
    tree = neighbours.fit_tree(x, 30)
    assert len(tree.leaves) == 30
    order = list(tree.visits(x[0]))
    assert sorted(order) == sorted(tree.leaves)
    assert set(tree.leaf_of(x)) <= set(tree.leaves)
    same = neighbours.fit_tree(np.ones((40, 3)), 10)
    assert same.leaves == [0]


def test_neighbours_query(spark, sf_dir):
    rows = queries.op12_neighbours(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in table])
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {}
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        want[ids[i]] = ids[np.lexsort((ids, -near))[:5]]
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


# --- 13: vector codes ---------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale=1024):
    """(vec_id, label, code, error) and codebooks by comparing every part with every entry."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max(len(v) for _, v, _ in rows) // parts))
    points = []
    for _, v, _ in rows:
        whole = [math.floor(scale * x) for x in v] + [0] * (parts * width - len(v))
        points.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted((i for i, r in enumerate(rows) if r[0] is not None), key=lambda i: (rows[i][0], rows[i][1]))
    books = [[list(points[i][p]) for i in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for point in points:
                members.setdefault(nearest(point[p], books[p])[1], []).append(point[p])
            for k, held in members.items():
                books[p][k] = [sum(c) // len(held) for c in zip(*held)]
    out = []
    for (vec_id, _, label), point in zip(rows, points):
        found = [nearest(point[p], books[p]) for p in range(parts)]
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=repr), books


def compared(df, rows, **settings):
    coded, books = codes.product_codes(df, scale=1024, **settings)
    got = coded.collect()
    want, want_books = plain_codes(rows, **settings)
    assert books.tolist() == want_books
    assert sorted((tuple(r)[:4] for r in got), key=repr) == want
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in got)


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "large", "few"])
def test_codes_equal_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(codes, "TREE_ROWS", 64)
    pick = np.random.default_rng(5)
    n = 5 if kind == "few" else 300
    x = pick.normal(size=(n, 8))
    if kind == "clustered":
        x = x[pick.integers(0, 4, n)] + 1e-3 * x
    elif kind == "ties":
        x = pick.integers(-1, 2, (n, 8)) / 1024
    elif kind == "large":
        x = x * 2.0**15
    rows = [(i, v.tolist(), None if i % 3 == 0 else i % 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int").repartition(3)
    compared(df, rows, parts=4, entries=16, rounds=3)


def test_codes_of_odd_rows(spark):
    rows = [
        (3, [0.5, -0.001, 2.0], "a"),
        (3, [0.5, -0.001, 2.0], "a"),
        (1, [0.25], None),
        (None, [0.125, 1.0], None),
        (2, [], "b"),
        (4, None, "b"),
        (5, [1.0, None], "b"),
        (6, [float("nan")], "b"),
        (7, [float("-inf"), 0.0], "b"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, vector array<float>, label string, code string, error string")
    compared(df, [(i, np.float32(v).tolist() if v and None not in v else v, c) for i, v, c in rows], parts=2, entries=3, rounds=2)
    coded, books = codes.product_codes(df.filter("false"))
    assert coded.collect() == [] and books.shape[1] == 0
    assert codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_trees_spare_comparisons():
    """In tight groups, whole subtrees are assigned; only the points of ambiguous leaves are compared."""
    pick = np.random.default_rng(2)
    centres = pick.integers(-1000, 1000, (8, 16))
    points = centres[pick.integers(0, 8, 1000)] + pick.integers(-3, 4, (1000, 16))
    tree = codes.CoverTree.of(points)
    nearest, compared_points = tree.assign(points, centres)
    assert len(compared_points) == 0
    assert (nearest == codes.distances(points[tree.order], centres).argmin(axis=1)).all()
    assert sorted(tree.order.tolist()) == list(range(1000))
    count, sums = tree.totals(points, nearest, 8)
    assert count.sum() == 1000 and (sums.sum(axis=0) == points.sum(axis=0)).all()
    for node in range(len(tree.start)):
        members = points[tree.order[tree.start[node] : tree.end[node]]]
        far = np.sqrt(((members - points[tree.centre[node]]) ** 2).sum(axis=1))
        assert far.max() <= tree.radius[node] + 1e-9
