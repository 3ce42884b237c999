"""Operators 8 and 10 and the connected components, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import components, fingerprint, neardup, shingles

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

SHAPES = [neardup.Shape(3, 85), neardup.Shape(5, 80)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    pick = random.Random(seed)
    nodes = list(range(-5, 60))
    edges = [(pick.choice(nodes), pick.choice(nodes)) for _ in range(40)]
    edges += [(100 + i, 101 + i) for i in range(40)] + [(500, i) for i in range(200, 260)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    near = {(ids.index(a), ids.index(b)) for a, b in edges if a != b}
    want = ids
    label = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[ids[i]], label[ids[j]])
            for k in (i, j):
                if label[ids[k]] != low:
                    label[ids[k]], changed = low, True
    assert got == {d: label[d] for d in want}


def test_components_without_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_shingle_sets_are_as_large_as_exact_ones(monkeypatch, block, odd_rows):
    monkeypatch.setattr(shingles, "BLOCK_BYTES", block)
    texts = ["", "A b\tc\nd  e", "a b", "x", " \x0b\x0c ", "É é É", "a b c a b c a b c", "Ab aB AB ab"]
    texts += [t for _, t, _ in odd_rows if t and len(t) < 5000]
    for width in (3, 5):
        sets = [shingles.shingle_set(w, width) for w in shingles.words_of(texts)]
        exact = [s for _, s in brute.shingle_sets(enumerate(texts), width)]
        assert [len(s) for s in sets] == [len(s) for s in exact]
        for i, a in enumerate(exact):
            for j, b in enumerate(exact):
                assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)


@pytest.mark.parametrize("shape", SHAPES)
def test_every_pair_within_the_distance_shares_a_key(spark, shape):
    pick = np.random.default_rng(6)
    rows = []
    for i in range(300):
        base = pick.integers(0, 2**16, shape.positions).astype(np.uint16)
        other = base.copy()
        at = pick.choice(shape.positions, shape.distance, replace=False)
        other[at] ^= 1
        rows += [(2 * i, base.tobytes()), (2 * i + 1, other.tobytes())]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "rep long, signature binary")
    keys = collections.defaultdict(set)
    for r in df.select("rep", neardup.chunk_keys(shape)).collect():
        keys[r.rep].add(r.key)
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(300))
    assert all(len(k) == shape.positions for k in keys.values())
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in neardup.candidate_forest(df, shape).collect()}
    assert {(2 * i, 2 * i + 1) for i in range(300)} <= found


def test_keys_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(neardup, "KEYED_ROWS", 50)
    shape = SHAPES[0]
    rows = [(i, bytearray(random.Random(i).randbytes(2 * shape.positions))) for i in range(1000)]
    classes = spark.createDataFrame(rows, "rep long, signature binary").coalesce(1)
    keys = neardup.keyed_classes(classes, shape)
    made = [r["count"] for r in keys.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 1000 * shape.positions and max(made) <= 2 * 50 * shape.positions
    want = classes.select("rep", neardup.chunk_keys(shape))
    assert not keys.exceptAll(want).count() and not want.exceptAll(keys).count()


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_equal_brute_force(spark, many, monkeypatch, shape, block):
    monkeypatch.setattr(neardup, "KEY_BLOCK", block)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", block)
    rows = [(r.doc_id, r.text) for r in many.collect()]
    got = neardup.near_duplicates(many, shape).collect()
    want = brute.near_duplicates(rows, shape.width, shape.percent)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {d: len(s) for d, s in brute.shingle_sets(rows, shape.width)}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(set(want.values())) < len(rows) - 100


def test_near_duplicates_of_odd_rows(odd, empty, odd_rows):
    shape = SHAPES[0]
    rows = neardup.near_duplicates(odd, shape).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _, _ in odd_rows)
    want = brute.near_duplicates([(d, t) for d, t, _ in odd_rows], shape.width, shape.percent)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id]
    assert neardup.near_duplicates(empty, shape).count() == 0


def test_an_id_with_two_texts_ties_their_groups(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (2, b), (5, a), (5, b), (9, "other words here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, SHAPES[0]).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 9: 9}


def test_keep_first_keeps_one_of_each_group(odd, odd_rows, empty):
    kept = neardup.keep_first(odd, SHAPES[0])
    assert sorted(kept.columns) == sorted(odd.columns)
    ids = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    want = brute.near_duplicates([(d, t) for d, t, _ in odd_rows], 3, 85)
    assert set(ids) == {d for d, c in want.items() if d == c} | {None}
    assert ids[8] == 1 and ids[None] == 2 and ids[3] == ids[4] == ids[5] == 1
    assert neardup.keep_first(empty, SHAPES[0]).count() == 0


def plain_walk(text):
    """The whole of what a walk writes, step by step."""
    classes = fingerprint.classes_of(text).tolist()
    out, i = [], 0
    while i < len(classes):
        stay = fingerprint.MOVES[classes[i]][len(out) % fingerprint.PERIOD]
        out += [classes[i] & 15] * stay
        i += 1
    return out


@pytest.mark.parametrize("piece", [5, 1 << 18])
def test_fingerprints_sample_the_walk(monkeypatch, piece):
    monkeypatch.setattr(fingerprint, "PIECE", piece)
    for text in ("", "a", "ab", "hello world " * 20, "é漢\U0001f600" * 50):
        steps = plain_walk(text)
        want = ""
        size = len(steps)
        if size:
            limit = 1 << max(0, (size - 1).bit_length())
            want = "".join("%x" % steps[s] if s < size else "x" for s in fingerprint.STEPS if s < limit)
        assert fingerprint.Walked.of(text).fingerprint == want


def test_edited_walks_equal_walks_of_edited_texts():
    pick = random.Random(8)
    for n in (0, 1, 2, 3, 5, 50, 700):
        text = "".join(pick.choices("abcdé ", k=n))
        after = "".join(pick.choices("xyz ", k=pick.randrange(0, 300)))
        content = text[: n - n // 3] + after[: n // 3]
        row = fingerprint.compared(text, fingerprint.Walked.of(text), after, fingerprint.Walked.of(after).fingerprint)
        assert row["edited_fingerprint"] == fingerprint.Walked.of(content).fingerprint
        assert row["edited_sha256"] == hashlib.sha256(content.encode()).hexdigest()


def test_likeness_follows_the_edit_distance():
    pick = random.Random(4)
    text = "".join(pick.choices("abcdefghij ", k=4000))

    def edited(k):
        out = list(text)
        for _ in range(k):
            out[pick.randrange(len(out))] = "q"
        return "".join(out)

    own = fingerprint.Walked.of(text).fingerprint
    alike = [np.mean([fingerprint.likeness(own, fingerprint.Walked.of(edited(k)).fingerprint) for _ in range(8)]) for k in (0, 10, 200, 4000)]
    assert alike[0] == 1 and alike[0] > alike[1] > alike[2] > alike[3]
    assert alike[1] > 0.75 and alike[3] < 0.3
    assert fingerprint.likeness("", "") == 1 and fingerprint.likeness(own, "") == 0


def check_next(rows, got):
    """``rows`` in their order; ``got`` by id."""
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        content = text[: len(text) - third] + after[:third]
        own, next_print = fingerprint.Walked.of(text).fingerprint, fingerprint.Walked.of(after).fingerprint
        r = got[doc_id]
        assert (r.n_chars, r.fingerprint) == (len(text), own)
        assert r.edited_sha256 == hashlib.sha256(content.encode()).hexdigest()
        assert r.edited_fingerprint == fingerprint.Walked.of(content).fingerprint
        assert r.near_edited == pytest.approx(fingerprint.likeness(own, r.edited_fingerprint))
        assert r.near_next == pytest.approx(fingerprint.likeness(own, next_print))


def test_compare_with_next_equals_brute_force(spark, many, odd_rows):
    rows = [(r.doc_id, r.text) for r in many.collect()]
    rows += [(-1, None), (-2, ""), (-3, "é" * 500), (5000, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.compare_with_next(df).collect()}
    assert len(got) == len(rows)
    check_next(sorted(((d, t or "") for d, t in rows), reverse=True), got)


def test_compare_with_next_of_odd_rows(spark, odd, empty, odd_rows):
    rows = fingerprint.compare_with_next(odd).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _, _ in odd_rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[3].fingerprint == by_id[4].fingerprint == ""
    assert fingerprint.compare_with_next(empty).count() == 0
    one = spark.createDataFrame([(3, "abcdef")], "doc_id long, text string")
    check_next([(3, "abcdef")], {3: fingerprint.compare_with_next(one).first()})


def test_near_texts_groups_small_edits(spark, odd, empty):
    pick = random.Random(2)
    rows = []
    for g in range(20):
        base = "".join(pick.choices("abcdefghij ", k=1500))
        rows.append((10 * g, base))
        rows.append((10 * g + 1, base[:700] + "Z" + base[701:]))
        rows.append((10 * g + 2, base))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = fingerprint.fingerprints(df)
    got = {r.doc_id: r.component for r in fingerprint.near_texts(prints, 0.8).collect()}
    exact = {r.doc_id: r.fingerprint for r in prints.collect()}
    ids = sorted(exact)
    want = brute.groups(ids, lambda i, j: fingerprint.likeness(exact[ids[i]], exact[ids[j]]) >= 0.8)
    assert got == want and len(set(want.values())) == 20
    assert fingerprint.near_texts(fingerprint.fingerprints(empty), 0.8).count() == 0
    assert {r.doc_id for r in fingerprint.near_texts(fingerprint.fingerprints(odd), 0.8).collect()} >= {1, 2, 8}


def test_bands_meet_as_often_as_stated():
    """Pairs of likeness 0.9 or more share a band at every length, with any kind of edit."""
    pick = random.Random(6)
    bands = fingerprint.Bands(0.9)
    assert (1 - 0.9**fingerprint.BAND) ** bands.number <= fingerprint.MISS
    alike = missed = 0
    for n in (3, 6, 12, 40, 200, 1500, 6000):
        for _ in range(120):
            text = pick.choices("abcdefghij ", k=n)
            other = list(text)
            for _ in range(pick.choice((1, 1, 2, 6))):
                at = pick.randrange(len(other))
                other[at : at + pick.randrange(2)] = pick.choice(("", "q", "b"))
                other = other or ["a"]
            a, b = (fingerprint.Walked.of("".join(t)).fingerprint for t in (text, other))
            if a != b and fingerprint.likeness(a, b) >= 0.9:
                alike += 1
                missed += not set(bands.keys(a)) & set(bands.keys(b))
    assert alike > 250 and missed <= 1


def test_groups_of_many_lengths_and_edit_rates_equal_brute_force(spark):
    pick = random.Random(12)
    rows = []
    for n in (4, 8, 30, 300, 2500):
        for _ in range(8):
            base = pick.choices("abcdefghij ", k=n)
            for rate in (0, 0.002, 0.01, 0.05):
                text = [pick.choice("qrs") if pick.random() < rate else c for c in base]
                rows.append((len(rows), "".join(text)))
    prints = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    exact = {r.doc_id: r.fingerprint for r in prints.collect()}
    got = {r.doc_id: r.group_id for r in fingerprint.with_groups(prints, 0.9).collect()}
    want = brute.groups(sorted(exact), lambda i, j: fingerprint.likeness(exact[i], exact[j]) >= 0.9)
    together = {(a, b) for a in want for b in want if a < b and want[a] == want[b]}
    found = {(a, b) for a in got for b in got if a < b and got[a] == got[b]}
    assert found <= together and len(found) >= 0.99 * len(together) > 60


def test_groups_of_odd_rows(spark, odd, empty, odd_rows):
    prints = fingerprint.fingerprints(odd).withColumn("_mate", F.lit("x")).withColumn("key", F.lit("y"))
    rows = fingerprint.with_groups(prints, 0.9).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _, _ in odd_rows)
    group = {r.doc_id: r.group_id for r in rows}
    assert group[1] == group[2] == 1 and group[7] in (6, 7)
    assert group[None] is None and (group[3], group[4]) == (3, 4)
    assert {r["_mate"] for r in rows} == {"x"}
    assert fingerprint.with_groups(fingerprint.fingerprints(empty), 0.9).count() == 0
