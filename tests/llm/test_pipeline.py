"""Every stage of the pipeline on its own input, against plain versions, and on odd and empty tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from tidepanel import storage
from tidepanel.llm import language, shared, toxicity

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return shared.table(spark, sf_dir, "documents")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_are_in_order():
    assert list(STAGES) == ["language ID", "toxicity", "near duplicates", "packing"]


def test_stages_pass_few_texts_at_a_time_to_python(spark, tmp_path, monkeypatch):
    """The JVM and Python each hold a batch of whole texts; in one task, more rows than a batch may have."""
    spark.range(5000).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        yield from (pa.record_batch({"n": pa.array([b.num_rows])}) for b in batches)

    monkeypatch.setattr(
        corpus_pipeline, "STAGES", [("sizes", lambda _, docs, __: docs.mapInArrow(sizes, "n long")), ("rows", lambda _, docs, __: docs)]
    )
    before = spark.conf.get(storage.BATCH_ROWS)
    found = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(found) == 5000 and max(found) <= 1024
    assert spark.conf.get(storage.BATCH_ROWS) == before


def largest_batches(spark, docs):
    """Rows and bytes of the largest batch that a query passes to Python, all in one task."""

    def sizes(batches):
        yield from (pa.record_batch({"n": pa.array([b.num_rows]), "size": pa.array([b.nbytes])}) for b in batches)

    rows = docs.coalesce(1).mapInArrow(sizes, "n long, size long").collect()
    return max(r.n for r in rows), max(r.size for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_written_by_its_caller_passes_few_texts_at_a_time(spark, tmp_path, name):
    """The caller starts the stage's last query after the stage has returned; long texts count by their bytes."""
    spark.range(6).selectExpr("id AS doc_id", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string")
    short = spark.range(5000).selectExpr("id", "'a text' AS text")
    long = spark.range(600).selectExpr("id", "repeat('x', 50000) AS text")
    before = {k: spark.conf.get(k) for k in (storage.BATCH_ROWS, storage.BATCH_BYTES)}
    try:
        spark.conf.set(storage.BATCH_ROWS, "10000")
        spark.conf.set(storage.BATCH_BYTES, "64m")
        STAGES[name](spark, docs, str(tmp_path))
        assert largest_batches(spark, short)[0] <= 1024
        assert largest_batches(spark, long)[1] <= 16 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_last_stage_of_a_run_passes_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(5000).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        yield from (pa.record_batch({"n": pa.array([b.num_rows])}) for b in batches)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda _, docs, __: docs.mapInArrow(sizes, "n long"))])
    found = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(found) == 5000 and max(found) <= 1024


def test_sizes_in_other_units_and_smaller_settings_hold(spark):
    before = {k: spark.conf.get(k) for k in (storage.BATCH_ROWS, storage.BATCH_BYTES)}
    try:
        spark.conf.set(storage.BATCH_ROWS, "0")
        spark.conf.set(storage.BATCH_BYTES, "1m")
        with storage.small_batches(spark):
            assert int(spark.conf.get(storage.BATCH_ROWS)) == 1024
            assert int(spark.conf.get(storage.BATCH_BYTES)) == 1 << 20
        assert (spark.conf.get(storage.BATCH_ROWS), spark.conf.get(storage.BATCH_BYTES)) == ("0", "1m")
        spark.conf.set(storage.BATCH_ROWS, "10")
        with storage.small_batches(spark):
            assert spark.conf.get(storage.BATCH_ROWS) == "10"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_language_stage_keeps_documents_in_known_languages(spark, docs, sf_dir):
    kept = STAGES["language ID"](spark, docs, sf_dir)
    model = language.fit(docs, language.trainable(docs))
    rows = language.predict(docs, model).collect()
    assert kept.schema == docs.schema
    assert ids(kept) == {r.doc_id for r in rows if r.score >= 0.5 and r.lang_pred != "und"}
    assert len(ids(kept)) >= 0.98 * len(rows)


def test_toxicity_stage_drops_what_scores_as_toxic(spark, docs, sf_dir):
    kept = STAGES["toxicity"](spark, docs, sf_dir)
    labels = shared.table(spark, sf_dir, "labels")
    rows = toxicity.predict(docs, toxicity.fit(docs, labels)).collect()
    assert kept.schema == docs.schema
    assert ids(kept) == {r.doc_id for r in rows if not r.predicted}
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert not clean - ids(kept)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, sf_dir):
    kept = STAGES["near duplicates"](spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute.near_duplicates(rows, 5, 80)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, c in want.items() if d == c)


def test_packing_stage_packs_every_document(spark, docs, sf_dir):
    packed = STAGES["packing"](spark, docs, sf_dir)
    assert ids(packed) == ids(docs)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_run_on_odd_tables(spark, odd, empty, tmp_path, kind):
    rows = {"odd": odd, "empty": empty}[kind]
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 0), (8, 0), (None, 1), (10, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = ids(out)
    if kind == "empty":
        assert got == set()
    else:
        # 2 repeats 1, and 7 all but repeats 6; 3, 4, 5 and 9 have no letters.
        assert not got & {2, 3, 4, 5, 7, 9}
        assert {1, 6, 8} <= got
