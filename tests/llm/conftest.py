from __future__ import annotations

import pytest

WORDS = "the of and river stone light under morning paper window seven green carry north quiet".split()


def prose(seed: int, n: int) -> str:
    """Words in an order that the seed decides."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


# Names that operators use for their own columns.
EXTRA = ("score", "label", "size", "shard", "rep", "key", "component", "h1", "length", "ids", "_row", "_place", "_kept", "offset", "sequence_id", "predicted", "lang_pred", "held_out")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): nulls, empty, blank, very long and repeated texts, ties, a null id."""
    long = prose(5, 60_000)
    rows = [
        (1, prose(1, 80), "en"),
        (2, prose(1, 80), None),
        (3, None, "en"),
        (4, "", None),
        (5, " \t\n ", "en"),
        (6, long, "en"),
        (7, long + " tail", "xx"),
        (8, prose(2, 200), "en"),
        (8, prose(2, 200), "en"),
        (9, "12345 !!! 678", None),
        (10, "one", "en"),
        (11, "one two", "en"),
        (12, "é" * 400_000, "fr"),
        (13, "Ünïcödé 漢字 \U0001f600 " * 40, "fr"),
        (None, prose(3, 40), "en"),
        (None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame(
        [(*r, *("x" for _ in EXTRA)) for r in odd_rows], f"doc_id long, text string, lang string, {extra}"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def many(spark):
    """(doc_id, text): copies, near copies and short texts among others."""
    rows = [(i, prose(i, 30 + i % 50)) for i in range(1, 200)]
    rows += [(1000 + i, prose(7, 60)) for i in range(60)]
    for i in range(80):
        words = prose(11, 120).split()
        words[(i * 7) % 120] = f"changed{i % 40}"
        if i % 3 == 0:
            words[(i * 11) % 120] = "again"
        rows.append((2000 + i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
