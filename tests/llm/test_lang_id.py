import random
import zlib

import numpy as np

from ratingspark.llm import lang_id


def test_held_out_accuracy(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = lang_id.predictions(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_learns_only_from_training_rows(spark, docs):
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(~lang_id.is_training_row("doc_id"), "xx").otherwise(F.col("lang")))
    one = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in lang_id.predictions(docs).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in lang_id.predictions(spoiled).collect()} == one


def test_more_labels_than_families(spark):
    rows = [(k, f"{w} {w}o {w}a", lang) for k, (lang, w) in
            enumerate([("en", "the"), ("de", "der"), ("nl", "het"), ("fr", "les"), ("qq", "zzz")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in lang_id.predictions(docs).collect()}
    assert sum(got[k] == lang for k, _, lang in rows) > 0.95 * len(rows)


def many_labels(spark):
    """Ten labels in nine families, each with letters of its own."""
    rng = random.Random(5)
    letters = [chr(0x250 + k) for k in range(80)]
    labels = ["en", "de", *[f"q{k}" for k in range(8)]]
    words = {lang: ["".join(rng.choices(letters[8 * k:8 * k + 8], k=4)) for _ in range(30)] for k, lang in enumerate(labels)}
    rows = [(k, " ".join(rng.choices(words[labels[k % 10]], k=25)), labels[k % 10]) for k in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_rows_past_the_first_sample_teach_too(spark):
    docs, _ = many_labels(spark)
    every, some = (lang_id.train(docs, sample=n, calibrated=True) for n in (lang_id.SAMPLE, 12))
    assert every.names == some.names and set(every.least) == set(some.least)

    def loss(machines, name, x, y):
        w = machines.weights[machines.names.index(name)]
        weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        return 0.0005 * w @ w + weight @ np.maximum(0, 1 - y * (x @ w)) ** 2

    taught = docs.where(lang_id.is_training_row("doc_id")).collect()
    for name, a, b in lang_id.Machines.pairs(list({r.lang for r in taught})):
        side = (lambda r: r.lang) if name.startswith("label") else lambda r: lang_id.family_of(r.lang)
        rows = [r for r in taught if side(r) in (a, b)]
        x, y = np.stack([lang_id.features(r.text) for r in rows]), np.array([1.0 if side(r) == a else -1.0 for r in rows])
        assert loss(some, name, x, y) <= 1.02 * loss(every, name, x, y)
    assert np.allclose(every.shape, some.shape, rtol=0.1, atol=0.1)
    assert all(abs(every.least[k] - some.least[k]) < 0.05 for k in every.least)


def test_packed_counts_give_the_features_back():
    texts = ["", "!", "one", "a" * 300, "Äö é 漢字 " * 900]
    x = lang_id.unpacked(*zip(*[lang_id.packed_counts(t) for t in texts]))
    assert all((row == lang_id.features(t)).all() for row, t in zip(x, texts))


def test_certain_choice_scores_near_one_with_many_labels(spark):
    docs, rows = many_labels(spark)
    got = {r.doc_id: r for r in lang_id.predictions(docs).collect()}
    assert all(got[k].lang_pred == lang and got[k].score > 0.8 for k, _, lang in rows)


def test_least_score_keeps_clean_rows_and_rejects_letter_junk(spark, docs):
    rng = random.Random(6)
    many, _ = many_labels(spark)
    real = "".join(r.text for r in docs.collect())
    usual, strange = sorted({c for c in real.lower() if c.isalpha()}), [chr(0x250 + k) for k in range(80)]
    for clean, letters in ((many, strange), (docs.select("doc_id", "text", "lang"), usual)):
        machines = lang_id.train(clean, calibrated=True)
        assert machines.least and all(0.3 < x < 0.7 for x in machines.least.values())
        kept = lang_id.identify(clean, machines).where(lang_id.certain(machines))
        assert kept.count() == clean.count()
        junk = [(k, " ".join("".join(rng.choices(letters, k=6)) for _ in range(100))) for k in range(60)]
        left = lang_id.identify(spark.createDataFrame(junk, "doc_id long, text string"), machines)
        assert left.where(lang_id.certain(machines)).count() <= 3


def test_edge_rows(edge_docs, no_docs, docs):
    machines = lang_id.train(docs)
    found = lang_id.identify(edge_docs, machines)
    assert set(found.columns) == {*edge_docs.columns, "score"}
    by_id = {r.doc_id: r for r in found.collect()}
    assert [by_id[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by_id[9].lang_pred != "und"
    assert lang_id.identify(no_docs, machines).count() == 0
    assert lang_id.predictions(no_docs).count() == 0
    one_label = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predictions(edge_docs).collect()}
    assert one_label[4] == ("en", 1.0) and one_label[2] == ("und", 0.0)
    digits = lang_id.identify(edge_docs.selectExpr("doc_id", "'12 34 !' AS text"), machines)
    assert {r.lang_pred for r in digits.collect()} == {"und"}
