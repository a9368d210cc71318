import random

import numpy as np

from ratingspark.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for k, y in enumerate(b):
            out.append(row[k] + 1 if x == y else max(out[-1], row[k + 1]))
        row = out
    return row[-1]


def test_lcs_matches_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(8) for _ in range(rng.randrange(1, 40))]
        b = [rng.randrange(8) for _ in range(rng.randrange(0, 60))]
        assert dc.lcs(dc.word_masks(np.array(a)), len(a), b) == brute_lcs(a, b)


def planted(spark, docs, benchmark, seed=6):
    """Documents without leaks, with whole items, and with paraphrases that
    lose or replace a fifth of the words."""
    rng = random.Random(seed)
    clean = [r.text for r in docs.collect()]
    rows, want = [], set()
    for k, item in enumerate(benchmark.collect()):
        words = item.text.split()
        if k % 2:
            words = [w if rng.random() > 0.2 else f"other{rng.randrange(10**6)}" for w in words]
        host = f"host{k} " * 40
        rows.append((1000 + k, host + " ".join(words) + " " + host))
        want.add((1000 + k, item.item_id))
    return spark.createDataFrame(rows + list(enumerate(clean)), "doc_id long, text string"), want


def test_finds_planted_leaks(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    table, want = planted(spark, docs, benchmark)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(table, benchmark).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert not [p for p in got if p[0] >= 1000 and p not in want]


def test_documents_match_exhaustive_comparison(spark, docs):
    """Every document against every item, without any candidate search."""
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, dc.words_of(r.text), dc.words_of(dc.answer_of(r.text))) for r in benchmark.collect()]
    want = set()
    for r in docs.collect():
        words = dc.words_of(r.text).tolist()
        for item, own, answer in items:
            masks, reply = dc.word_masks(own), dc.word_masks(answer)
            for at in range(0, max(1, len(words) - len(own)), 8):
                region = words[at:at + 2 * len(own)]
                share = dc.lcs(masks, len(own), region) / len(own)
                if share >= dc.NEARLY_ALL or share >= dc.COVERED and \
                        dc.lcs(reply, len(answer), region) >= dc.ANSWER_COVERED * len(answer):
                    want.add((r.doc_id, item))
                    break
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(docs, benchmark).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_short_items_are_found_at_any_corpus_size():
    """Short items of usual words, verbatim among words that stand nowhere
    else; each usual word is in a quarter of the documents at every size."""
    rng = random.Random(8)
    usual = [f"usual{k}" for k in range(60)]
    items = [(k, " ".join(rng.sample(usual, 13 + k))) for k in range(12)]
    vocabulary = np.unique(np.concatenate([dc.words_of(t) for _, t in items]))
    for n_docs in (10**3, 10**5, 10**7, 10**9):
        block, find = dc.Block(items, vocabulary, np.full(len(vocabulary), n_docs // 4), n_docs), dc.Lookup(vocabulary)
        block.set_basis(dict(zip(vocabulary.view(np.int64).tolist(), np.eye(len(vocabulary)))))
        for item, text in items:
            for before in range(0, 40, 3):
                host = [f"rare{k}" for k in range(90)]
                leaks = block.leaks(" ".join(host[:before] + text.split() + host[before:]), find, {})
                assert [(r["item_id"], r["lcs_share"]) for r in leaks] == [(item, 1.0)]


def test_each_region_is_judged_by_itself():
    """A quoted question alone, and elsewhere less of the item with its answer."""
    question, answer = [f"q{k}" for k in range(14)], [f"a{k}" for k in range(6)]
    text = " ".join(question) + ". " + " ".join(answer[:5]) + " a5."
    vocabulary = np.unique(dc.words_of(text))
    block = dc.Block([(1, text)], vocabulary, np.ones(len(vocabulary)), 1000)
    block.set_basis(dict(zip(vocabulary.view(np.int64).tolist(), np.eye(len(vocabulary)))))
    quoted, host = text.split()[:14], [f"h{k}" for k in range(200)]
    leak = text.split()[:7] + text.split()[14:]
    found = block.leaks(" ".join(host[:40] + quoted + host + leak + host), dc.Lookup(vocabulary), {})
    assert [(r["item_id"], round(r["lcs_share"], 2), r["answer_share"]) for r in found] == [(1, 0.65, 1.0)]
    assert not block.leaks(" ".join(host[:40] + quoted + host), dc.Lookup(vocabulary), {})


def test_gate_loses_no_region_that_could_be_a_leak():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 50)))) for k in range(20)]
    vocabulary = np.unique(np.concatenate([dc.words_of(t) for _, t in items]))
    block, find = dc.Block(items, vocabulary, np.ones(len(vocabulary)), 100), dc.Lookup(vocabulary)
    leaking = 0
    for _ in range(40):
        text = dc.words_of(" ".join(rng.choices([*words, "x", "y", *["z"] * 60], k=rng.randrange(1, 400))
                                    + items[rng.randrange(20)][1].split() + ["z"] * rng.randrange(200)))
        at, starts = find(text), np.asarray(dc.window_starts(len(text)))
        held = block.held(at)
        for k, (_, own, _) in enumerate(block.items):
            passed = block.may_cover(k, at, starts)
            for s, ok in zip(starts.tolist(), passed.tolist()):
                region = text[max(0, s - len(own)):s + dc.WINDOW + len(own)].tolist()
                if dc.lcs(dc.word_masks(own), len(own), region) >= dc.COVERED * len(own):
                    leaking += 1
                    assert ok and k in held
    assert leaking > 40


def test_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(7)
    dense = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40))
    rows = [(list(range(100, 140)), x.tolist()) for x in dense]
    basis = dc.randomised_svd(spark.createDataFrame(rows, "terms array<long>, weights array<double>"), 5, 8)
    found = np.stack([basis[t] for t in range(100, 140)])
    _, _, vt = np.linalg.svd(dense)
    assert np.allclose(found @ found.T, vt[:5].T @ vt[:5], atol=1e-6)


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "same words in a row here"), (2, None), (3, ""), (None, "long text of many words"),
                                   (4, "same words in a row here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(edge_docs, items).collect()}
    assert got == {(6, 1), (6, 4), (7, 1), (7, 4), (9, None)}
    assert dc.contaminated(no_docs, items).count() == 0
    assert dc.contaminated(edge_docs, items.where("false")).count() == 0
    assert dc.clean(edge_docs, items).columns == edge_docs.columns
    assert dc.clean(edge_docs, items.where("false")).count() == 12
