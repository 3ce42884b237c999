"""Operators 1, 3 and 5: counts against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import language, quality, shared, toxicity

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return shared.table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return shared.table(spark, SMALL, "labels")


@pytest.mark.parametrize("block", [64, 1 << 18])
def test_dense_counts_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(shared, "BLOCK_CHARS", block)
    monkeypatch.setattr(shared, "BLOCK_ROWS", 3)
    texts = ["", "abc", "x" * 500, "", "hello world " * 30, "q", "", "ab" * 100, "zz"]
    buckets = 37
    seen = {}
    for first, counts in shared.dense_counts(texts, (1, 2, 3), buckets, language.codes):
        for i, row in enumerate(counts):
            assert first + i not in seen
            seen[first + i] = row
    assert sorted(seen) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = np.zeros(buckets)
        for order in (1, 2, 3):
            np.add.at(want, shared.ngram_ids(language.codes(text), order, buckets), 1)
        assert (seen[i] == want).all(), i


@pytest.mark.parametrize("even", [True, False])
@pytest.mark.parametrize("rate", [0.5, 1.9])  # in 2^-20
def test_samples_of_very_many_rows_are_not_empty(spark, even, rate):
    rows = spark.range(1 << 26).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    sample = shared.bounded_sample(rows, 1000, "lang", even, counts={"en": int(1000 * (1 << 20) / rate)})
    assert 0.7 < sample.count() / (64 * rate) < 1.4


def test_ftrl_learns_sparse_weights():
    # Places 0 and 1 tell the classes; 2 to 9 are noise.
    pick = np.random.default_rng(1)
    examples = []
    for _ in range(400):
        label = int(pick.integers(2))
        noise = pick.choice(np.arange(2, 10), 2, replace=False)
        examples.append((np.array([label, *noise], dtype=np.int32), np.array([1.0, 0.1, 0.1]), label))
    weights, bias = language.ftrl(examples, 10, 2, l1=1.0)
    assert all((v @ weights[p] + bias).argmax() == label for p, v, label in examples)
    assert (weights[2:] == 0).mean() > 0.8


def test_temperature_makes_probabilities_honest():
    pick = np.random.default_rng(2)
    truth = pick.normal(size=(4000, 3))
    labels = np.array([pick.choice(3, p=language.softmax(t)) for t in truth])
    assert 2.5 < language.best_temperature(truth * 3, labels) < 3.5


def test_languages_of_held_out_documents(docs):
    model = language.fit(docs, language.trainable(docs))
    assert model.languages == ("de", "en", "es", "fr") and (model.weights == 0).mean() > 0.3
    rows = language.predict(docs.select("doc_id", "lang", "text"), model, ("doc_id", "lang"))
    held = rows.filter(shared.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_rows(odd, empty, odd_rows):
    model = language.fit(odd, odd)
    rows = language.predict(odd, model).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _, _ in odd_rows)
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.lang_pred, r.score))
    for d in (3, 4, 5, 9):
        assert by_id[d] == {("und", 0.0)}
    assert by_id[1] == by_id[2] and next(iter(by_id[1]))[0] == "en"
    kept = language.keep(odd, model)
    assert kept.columns == odd.columns
    assert not {3, 4, 5, 9} & {r.doc_id for r in kept.select("doc_id").collect()}
    assert language.fit(empty, empty) is None
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_quality_of_held_out_documents(docs, labels):
    model = quality.fit(docs, labels)
    rows = quality.predict(docs, model).join(labels, "doc_id").filter(shared.held_out()).collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_votes_equal_brute_force():
    pick = np.random.default_rng(3)
    known = quality.unit(pick.normal(size=(60, 5)).astype(np.float32))
    model = quality.QualityModel(np.ones(1), np.ones(1), known, pick.integers(0, 2, 60).astype(np.float32), 0.4)
    rows = np.vstack([quality.unit(pick.normal(size=(20, 5)).astype(np.float32)), np.zeros((1, 5), np.float32)])
    got = quality.votes(model, rows)
    for row, score in zip(rows[:-1], got):
        near = sorted(range(60), key=lambda i: -float(known[i] @ row))[: quality.NEIGHBOURS]
        weight = [max(0.0, float(known[i] @ row)) ** quality.POWER for i in near]
        want = sum(w * model.labels[i] for w, i in zip(weight, near)) / sum(weight)
        assert abs(score - want) < 1e-5
    assert got[-1] == 0.4


def test_quality_of_odd_rows(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(1, 1), (8, 0), (6, 1), (None, 1), (10, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    rows = quality.predict(odd, model).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _, _ in odd_rows)
    assert all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[1] == score[2] and score[3] == score[4]
    assert quality.fit(odd, labels.filter("false")) is None
    assert quality.fit(empty, labels) is None
    assert {r.score for r in quality.predict(odd, None).collect()} == {0.5}
    assert quality.predict(empty, model).count() == 0


def test_toxicity_of_held_out_documents(docs, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.predict(docs, model).join(labels, "doc_id").filter(shared.held_out()).collect()
    assert not [r for r in rows if r.predicted and not r.toxic]
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.6


CLEAN = "the weather in the river town was quiet and the light under the stone bridge stayed green "


def story(seed: int) -> str:
    """Twenty of two hundred made-up words, and some that every text has."""
    pick = random.Random(seed)
    names = ["".join(pair) + "ando" for pair in itertools.product("bdfglmnprt", ("ale", "ino", "oru", "ete", "umi") * 4)]
    return CLEAN + " ".join(pick.sample(sorted(set(names)), 20)) + " "


@pytest.fixture(scope="module")
def insult_model(spark):
    rows = [(i, story(i)) for i in range(120)]
    rows += [(200 + i, story(200 + i) + ("what a rotten scoundrel" if i % 2 else "you scoundrel rotten")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 200).cast("int").alias("toxic"))
    return toxicity.fit(docs, labels)


@pytest.mark.parametrize(
    "hidden",
    ["scoundrel", "sc0undr3l", "$coundrel", "scooooundrel", "s c o u n d r e l", "s.c.o.u.n.d.r.e.l", "SC0UNDREL!", "sc*oun*drel"],
)
def test_hidden_words_are_restored(spark, insult_model, hidden):
    df = spark.createDataFrame([(1, CLEAN + hidden + " and more"), (2, CLEAN)], "doc_id long, text string")
    rows = {r.doc_id: r for r in toxicity.predict(df, insult_model).collect()}
    assert rows[1].predicted == 1 and rows[2].predicted == 0
    restored = {r.doc_id: r.restored for r in toxicity.restore_texts(df, insult_model.characters).collect()}
    assert "scoundrel" in restored[1].lower() and restored[2] == CLEAN


@pytest.mark.parametrize(
    "hidden",
    [
        '"s c o u n d r e l"',
        "(s c o u n d r e l)",
        "s c o u n d r e l.",
        "s  c  o  u  n  d  r  e  l",
        "s/c/o/u/n/d/r/e/l",
        "s\u200bc\u200bo\u200bu\u200bn\u200bd\u200br\u200be\u200bl",
        "s - c - o - u - n - d - r - e - l",
        "S_C_0_U_N_D_R_3_L,",
        "you are a s c o u n d r e l man",
        "y o u s c o u n d r e l",
        "w h a t a r o t t e n s c 0 u n d r e l",
        "weather,sc0undrel",
        "river/sc0undr3l,stone",
        "t h e " * 12 + "r i v e r s c o u n d r e l " + "t o w n " * 12 + "e n d",
    ],
)
def test_hidden_words_have_edges(spark, insult_model, hidden):
    df = spark.createDataFrame([(1, CLEAN + hidden)], "doc_id long, text string")
    assert toxicity.predict(df, insult_model).first().predicted == 1
    assert "scoundrel" in toxicity.restore_texts(df, insult_model.characters).first().restored.replace(" ", "")


def test_clean_spaced_sentences_stay_clean(spark, insult_model):
    df = spark.createDataFrame([(1, CLEAN + " ".join(CLEAN.replace(" ", "")))], "doc_id long, text string")
    assert toxicity.predict(df, insult_model).first().predicted == 0
    restored = toxicity.restore_texts(df, insult_model.characters).first().restored
    assert restored == CLEAN + CLEAN.strip()


def test_long_words_in_runs(insult_model):
    """Words of any length that the labelled texts hold are read in a run."""
    long = "scoundrel" * 9
    model = toxicity.CharacterModel(insult_model.characters.logs, insult_model.characters.words | {long: -3.0})
    assert toxicity.parted("the" + long + "town", model.words) == f"the {long} town"


def test_letters_keep_their_places():
    """Lower case never makes a text longer, so that n-grams at its end are counted."""
    text = "İ" * 10 + "abc"
    assert len(shared.lowered(text)) == len(text)
    (_, counts), = language.counted([text])
    assert counts.sum() == sum(len(text) - n + 1 for n in language.ORDERS)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert len(shared.lowered(every)) == len(every)


def test_long_runs_are_read_whole(insult_model):
    run = "the weather in the river town was quiet " * 20
    model = insult_model.characters
    assert toxicity.restore_run(" ".join(run.replace(" ", "")), model) == run.strip()
    # Across the 64th place.
    assert "scoundrel" in toxicity.restored_words("weather," * 7 + "sc0undrel", toxicity.decoder(model))


def test_words_of_one_copied_text_are_no_evidence(spark):
    rows = [(i, story(i)) for i in range(120)]
    rows += [(200 + i, story(200 + i) + "scoundrel") for i in range(40)]
    copied = CLEAN + "scoundrel velvet lantern harbour captain"
    rows += [(300 + i, copied + f" copy{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") >= 200).cast("int").alias("toxic")))
    assert "scoundrel" in model.terms and "velvet" not in model.terms
    df = spark.createDataFrame([(1, CLEAN + "velvet lantern harbour captain"), (2, CLEAN + "scoundrel")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.predict(df, model).collect()} == {1: 0, 2: 1}


def test_different_texts_with_a_long_common_passage_are_witnesses():
    passage = " ".join(f"shared{k}" for k in range(200))
    rows = [(1, i, toxicity.sketch(f"{passage} " + story(i)[len(CLEAN) :] * 8 + " ".join(f"own{i}x{k}" for k in range(100))).tobytes()) for i in range(60)]
    assert len({w for _, _, w in toxicity.witnesses_of(rows)}) == 60
    copies = [(1, 100 + i, toxicity.sketch(f"{passage} copy{i}").tobytes()) for i in range(60)]
    assert len({w for _, _, w in toxicity.witnesses_of(copies)}) < 5
    assert toxicity.witnesses_of([(0, 7, b""), (0, 8, b"")]) == [(0, 7, 7), (0, 8, 7)]


def test_a_toxic_word_of_texts_with_one_passage_is_learnt(spark):
    passage = " ".join(f"shared{k}" for k in range(60)) + " "
    rows = [(i, passage + story(i)) for i in range(120)]
    rows += [(200 + i, passage + story(200 + i) + "scoundrel") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") >= 200).cast("int").alias("toxic")))
    assert "scoundrel" in model.terms


def test_copies_do_not_shift_the_curve(spark, monkeypatch):
    seen = {}

    def logistic(strengths, labels, weights):
        seen.update({k: weights[labels == k].sum() for k in (0, 1)})
        return 1.0, 0.0

    monkeypatch.setattr(toxicity, "logistic", logistic)
    rows = [(i, story(i)) for i in range(120)] + [(200 + i, story(200 + i) + "scoundrel") for i in range(40)]
    rows += [(300 + i, story(300) + "scoundrel") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 200).cast("int").alias("toxic"))
    toxicity.fit(docs, labels)
    totals = {r.label: r["count"] for r in shared.learnable(labels, "toxic").groupBy("label").count().collect()}
    assert seen == pytest.approx(totals)


def test_every_labelled_row_is_learnt_from(spark):
    """More rows of a label than any sample took, each with a word of its own."""
    word = F.translate(F.lower(F.hex(F.col("id") * 7919)), "0123456789", "ghijklmnop")
    rows = spark.range(18_060).select(F.col("id").alias("doc_id"), word.alias("word"), (F.col("id") < 60).cast("int").alias("toxic"))
    docs = rows.select("doc_id", F.concat_ws(" ", F.when(F.col("toxic") == 1, "scoundrel"), "word", "word").alias("text"))
    model = toxicity.fit(docs, rows.select("doc_id", "toxic"))
    learnable = {r.word for r in rows.filter(~shared.held_out()).collect()}
    assert len(learnable) > 11_000 and learnable <= set(model.characters.words)
    assert "scoundrel" in model.terms


def test_term_counts_equal_brute_force(spark, monkeypatch):
    """Across many tasks, slices and blocks; copies, exact or near, are one witness with all their terms."""
    monkeypatch.setattr(toxicity, "HELD_TERMS", 40)
    monkeypatch.setattr(toxicity, "TERM_ROWS", 3)
    monkeypatch.setattr(toxicity, "WITNESS_BLOCK", 4)
    copied = " ".join(f"shared{k}" for k in range(200))
    texts = [(i % 2, story(i)) for i in range(30)] + [(1, f"{copied} copy{i}x") for i in range(40)] + [(0, story(0))] * 5 + [(1, "")] * 3
    rows = [(i, text, label) for i, (label, text) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    learnt = toxicity.learnt_texts(docs, docs.select("doc_id", "label")).cache()
    named = toxicity.witnesses(learnt).cache()
    witness = {(r.label, r.hash): r.witness for r in named.collect()}
    assert set(witness) == {(label, toxicity.text_hash(text)) for label, text in texts}
    assert sum(r.copies for r in named.collect()) == len(texts)
    near = {witness[1, toxicity.text_hash(text)] for label, text in texts if text.startswith(copied)}
    assert len(near) < 10
    characters = toxicity.character_model(toxicity.character_counts(docs))
    decode = toxicity.decoder(characters)
    held = {(label, witness[label, toxicity.text_hash(text)], t) for label, text in texts for t in toxicity.terms_of(toxicity.restored_words(text, decode))}
    want = collections.Counter((t, label) for label, _, t in held)
    got = {(r.term, k): n for r in toxicity.term_counts(learnt, named, characters).collect() for k, n in ((1, r.toxic), (0, r.clean)) if n}
    assert got == want


def test_words_of_runs_are_the_mean_over_the_labels(spark, monkeypatch):
    rows = [(1, "rotten rotten day"), (0, "fine day"), (0, "fine day in town")]
    words = toxicity.common_words(spark.createDataFrame(rows, "label int, text string"))
    assert {w: round(np.exp(p), 6) for w, p in words.items()} == {
        "rotten": round(1 / 3, 6), "day": round(1 / 6 + 1 / 6, 6), "fine": round(1 / 6, 6)
    }
    monkeypatch.setattr(toxicity, "LEAST_SHARE", 0.2)
    assert set(toxicity.common_words(spark.createDataFrame(rows, "label int, text string"))) == {"rotten", "day"}


def test_words_read_at_once_equal_those_read_piece_by_piece(insult_model):
    decode = toxicity.decoder(insult_model.characters)
    texts = ["Day, (day) \"day\" day... day### d-day 3rd x² sc0undr3l! sooooo, re$t$ $coundrel 1day a_b __init__ e.g.", story(3)]
    texts += ["s c o u n d r e l", "-s.c.o.u.n.d.r.e.l", "___ ### !!! 111 ½ aaa", "éééé, ñandú; 日日日本!", ""]
    for text in texts:
        lower = shared.lowered(text)
        want = set().union(*(toxicity.token_words(t, decode) for t in lower.split()))
        for run in toxicity.SPACED.findall(lower):
            read = decode(toxicity.spaced(run))
            want |= {*toxicity.LETTER_RUN.findall(read), read.replace(" ", "")}
        assert toxicity.restored_words(text, decode) == want


def test_restoring_equals_a_search_over_all_readings(insult_model):
    model = insult_model.characters

    def every(word):
        best = (-1e18, "")

        def go(i, a, b, score, text):
            nonlocal best
            if i == len(word):
                best = max(best, (score + model.of(a, b, toxicity.EDGE), text))
                return
            for letter, cost in toxicity.readings(word, i):
                if letter:
                    c = toxicity.symbol(letter)
                    go(i + 1, b, c, score + cost + model.of(a, b, c) + np.log(toxicity.SYMBOLS), text + letter)
                else:
                    go(i + 1, a, b, score + cost, text)

        go(0, toxicity.EDGE, toxicity.EDGE, 0.0, "")
        return best[1]

    for word in ("sc0undr3l", "1!|l", "$$aa00", "ssttoonnee", "r1v3r", "--x--", "é1è"):
        assert toxicity.restore(word, model) == every(word)


def test_character_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK_CHARS", 8)
    texts = ["the cat", "", None, "a", "édith  x-y zz top of the hill", "x" * 30]
    got = toxicity.character_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = np.zeros(toxicity.SYMBOLS**3)
    for text in texts:
        if text:
            s = [toxicity.EDGE, toxicity.EDGE, *toxicity.symbols_of(text).tolist(), toxicity.EDGE]
            for a, b, c in zip(s, s[1:], s[2:]):
                a = toxicity.EDGE if b == toxicity.EDGE else a
                want[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += 1
    assert (got == want).all()


def test_toxicity_of_odd_rows(spark, odd, empty, odd_rows, insult_model):
    rows = toxicity.predict(odd, insult_model).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    kept = toxicity.keep(odd, insult_model)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.fit(odd, labels) is None and toxicity.fit(empty, labels) is None
    assert toxicity.predict(odd, None).filter("score > 0").count() == 0
    assert toxicity.predict(empty, insult_model).count() == 0
