import re

import numpy as np
import pandas as pd
import pytest

from ratingspark.llm import near_dup
from ratingspark.llm.components import components
from ratingspark.llm.shingles import shingle_set, word_hashes


def brute_shingles(text, width):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))}


def brute_components(rows, width, percent=80):
    sets = [brute_shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def variants(seed=3):
    """Chains and groups of edited texts on either side of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(6):
        words = [f"w{rng.integers(400)}" for _ in range(60)]
        for _ in range(25):
            copy = list(words)
            for at in rng.choice(60, rng.integers(0, 8), replace=False):
                copy[at] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_components_match_brute_force(spark, width):
    rows = variants()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents_match_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = near_dup.near_duplicates(docs, width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_edge_rows(edge_docs):
    got = near_dup.near_duplicates(edge_docs, width=2).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].n_shingles for k in (1, 2, 3, 4, 5, 8)] == [0, 0, 0, 1, 1, 1]
    assert by_id[7].component_id == 6 and not by_id[7].kept
    assert by_id[None].component_id is None and by_id[None].kept
    assert all(by_id[k].component_id == k for k in (1, 2, 3, 4, 5, 8, 9, 10))
    stay = near_dup.deduplicated(edge_docs, width=2)
    assert stay.columns == edge_docs.columns
    assert sorted((r.doc_id or 0) for r in stay.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_empty_table(no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert near_dup.deduplicated(no_docs).columns == no_docs.columns


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            common, left, right = np.split(rng.integers(1, 2**63, 400, dtype=np.int64).astype(np.uint64),
                                           [int(400 * share), int(200 + 200 * share)])
            a, b = (near_dup.superminhash(np.concatenate([common, x]), 96) for x in (left, right))
            errors.append(np.mean(a == b) - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05


def test_signature_of_few_elements_has_every_rank():
    sig = near_dup.superminhash(np.array([12345], dtype=np.uint64), 96).view(np.uint32)
    assert sorted(sig >> 25) == list(range(96))  # one element: each slot at its permutation's rank


def test_long_words_and_pieces_hash_alike():
    text = "ab cd " * 100_000 + "q" * 600_000 + " z"
    assert len(word_hashes(text.encode())) == 200_002
    assert word_hashes(b"x" * 300_000 + b" tail")[1] == word_hashes(b"tail")[0]
    assert (shingle_set("A b\x0bC", 2) == shingle_set("a B c", 2)).all()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5001), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = components(df).toPandas()
    groups = {frozenset(g.node) for _, g in got.groupby("root")}
    assert groups == {frozenset(range(201)), frozenset(range(1000, 1200)), frozenset([5000, 5001])}
    assert components(df.where("false")).count() == 0
    assert isinstance(got, pd.DataFrame)
