import pytest

from ratingspark.llm import license_scan as ls


@pytest.fixture(scope="module")
def model(spark):
    return ls.train(spark)


def test_held_out_accuracy(spark, model):
    """Notices in words of their own, none a training sentence."""
    texts = {
        "apache": "Copyright 2021 Someone. Licensed under the Apache License, Version 2.0 by its authors",
        "mit": "This package is released under the MIT License, see the file",
        "gpl": "It is licensed under the GNU General Public License, version 3 or later",
        "bsd": "Redistribution and use in source and binary forms are permitted provided that",
        "mpl": "subject to the terms of the Mozilla Public License, version 2.0",
        "creative commons": "Text licensed under a Creative Commons Attribution 4.0 International License",
        "unknown": "The driving licence office asked for the permission of a parent",
    }
    rows = [(k, f) for k, f in enumerate(texts)]
    docs = spark.createDataFrame([(k, texts[f]) for k, f in rows], "doc_id long, text string")
    got = {r.doc_id: r.family for r in ls.scan(docs).collect()}
    assert [got[k] for k, _ in rows] == [f for _, f in rows]


def test_scores_match_a_plain_sum(spark, model):
    import math

    rows = ls.training_rows(spark).limit(60).withColumn("words", ls.words(ls.F.col("sentence"))).withColumn(
        "id", ls.F.monotonically_increasing_id()).cache()
    table, names = dict(model.weights), sorted(model.intercepts)
    got = {r.id: r for r in model.scores(rows.drop("family"), ["id"]).collect()}
    for r in rows.withColumn("g", ls.grams("words")).collect():
        found = [table[g] for g in r.g if g in table]
        if not found:
            assert r.id not in got
            continue
        logits = [model.intercepts[n] + sum(w[k] for w in found) for k, n in enumerate(names)]
        p = math.exp(max(logits)) / sum(map(math.exp, logits))
        assert got[r.id].family == names[logits.index(max(logits))] and abs(got[r.id].probability - p) < 1e-9


def test_documents(docs):
    known = {"Licensed under CC BY-NC 4.0.": "creative commons", "Released under the MIT License.": "mit",
             "Licensed under the Apache License, Version 2.0.": "apache",
             "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    want = sorted((r.doc_id, k, known[line]) for r in docs.collect() for k, line in enumerate(r.text.split("\n"))
                  if line in known)
    got = ls.scan(docs).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got if r.confirmed) == want and want


def test_wrapped_notices(spark):
    """Published notices hard-wrapped, bare and in comments, among other text."""
    import textwrap

    rows, want = [], set()
    marks = [("", ""), ("// ", ""), (" * ", "/*\n"), ("# ", "#!/bin/sh\n#\n")]
    for family in ("mit", "bsd", "gpl", "apache", "lgpl", "mpl"):
        for notice in [n for n in ls.NOTICES[family] if len(n) > 100]:
            for mark, before in marks:
                body = "\n".join(mark + line for line in textwrap.wrap(notice, 38))
                head = f"{before}{mark}A tool for tables.\n"
                want.add((len(rows), head.count("\n"), family))
                rows.append((len(rows), f"{head}{body}\n\nplain text follows\nover two lines"))
    rows.append((len(rows), "This work is dedicated to the public\ndomain.\nOther words"))
    want.add((len(rows) - 1, 0, "public domain"))
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in got if r.confirmed} >= want
    assert len({(r.doc_id, r.paragraph) for r in got}) == len(got)


def test_edge_rows(spark, edge_docs, no_docs):
    assert ls.scan(edge_docs).count() == 0 and ls.scan(no_docs).count() == 0
    text = "word " * 50_000 + "released under the MIT License. " + "word " * 50_000
    docs = spark.createDataFrame([(1, text), (1, text), (None, "Released under the MIT License."), (2, "licence"),
                                  (3, "MIT \n\n no grant")], "doc_id long, text string")
    got = [(r.doc_id, r.family) for r in ls.scan(docs).collect()]
    assert got.count((1, "mit")) == 2 and (None, "mit") in got and (2, "unknown") in got and len(got) == 4


def test_long_runs_of_comment_marks(spark):
    """A megabyte of each mark neither overflows a stack nor takes long."""
    marks = ['"', "'", "#;", "/*", "*", "/", "-", ";", "%", "<!--", "dnl ", "REM ", " ", "*/", "-->", "\t", ". ", " *"]
    rows = [(k, mark * (1_000_000 // len(mark)) + " license\n" + "Released under the MIT License.") for k, mark in enumerate(marks)]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got if r.family == "mit"} == set(range(len(marks)))


def test_notices_without_an_anchor(spark):
    rows = [(1, "Some words\nDistributed under CC BY 4.0.\nmore words"), (2, "# Distributed under\n# CC BY-SA 4.0.\n"),
            (3, "The account was held under the bridge by 4.0 men.")]
    got = {(r.doc_id, r.paragraph, r.family) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.confirmed}
    assert got == {(1, 1, "creative commons"), (2, 1, "creative commons")}  # its second line alone is confirmed


def test_signs_lose_no_paragraph(spark):
    """Any words of a notice that would confirm it hold a sign."""
    own, marks = ls.notice_words(), set(ls.signs())
    split = spark.createDataFrame([(s,) for n in ls.NOTICES.values() for s in n], "s string")
    assert [list(dict.fromkeys(r.w)) for r in split.select(ls.words(ls.F.col("s")).alias("w")).collect()] == own
    for words in own:
        assert len([w for w in words if w not in marks]) / len(words) < ls.CONFIRMED
