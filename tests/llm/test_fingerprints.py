import hashlib

import numpy as np

from ratingspark.llm import fingerprints as fp
from ratingspark.llm.shingles import shingle_set


def test_edited_texts_and_estimates(docs, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 40_000)  # several ranges
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    errors = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        edited = r.text[:len(r.text) - half] + after.text[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == fp.to_string(fp.sketch(r.text))
        a, b = shingle_set(r.text, fp.WIDTH), shingle_set(edited, fp.WIDTH)
        errors.append(g.near_edited - len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))))
    assert len(got) == len(rows) and abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.2


def test_sketch_is_the_bottom_k_and_merges(docs):
    for r in docs.limit(40).collect():
        words = r.text.split(" ")
        all_hashes = np.unique(shingle_set(r.text, fp.WIDTH) >> np.uint64(16))
        assert (fp.sketch(r.text) == all_hashes[:fp.K]).all()
        cut = len(words) // 2  # parts that share the words a shingle needs across the cut
        one, two = " ".join(words[:cut + fp.WIDTH - 1]), " ".join(words[cut:])
        if len(words) > 20:
            assert (fp.merge(fp.sketch(one), fp.sketch(two)) == fp.sketch(r.text)).all()
        assert (fp.from_string(fp.to_string(fp.sketch(r.text))) == fp.sketch(r.text)).all()


def test_estimates():
    a = fp.sketch(" ".join(f"w{k}" for k in range(20_000)))
    b = fp.sketch(" ".join(f"w{k}" for k in range(10_000)))
    assert abs(fp.distinct(a) / 19_996 - 1) < 0.25 and abs(fp.resemblance(a, b) - 0.5) < 0.15
    assert abs(fp.containment(b, a) - 1) < 0.3 and fp.containment(a, b) < 0.75
    empty = fp.sketch(None)
    assert fp.resemblance(empty, empty) == 1 and fp.resemblance(empty, a) == 0 and fp.to_string(empty) == ""


def test_edge_rows(edge_docs, no_docs):
    got = fp.edited_fingerprints(edge_docs).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == ""
    assert by_id[1].n_chars == 0 and by_id[8].n_chars == 300_000
    assert by_id[6].fingerprint == by_id[7].fingerprint
    last = "ünï cödé \U0001f600 ÄÖ"  # followed by the first: the row without an id
    assert by_id[10].edited_sha256 == hashlib.sha256((last[:len(last) - 6] + "a row ").encode()).hexdigest()
    assert fp.edited_fingerprints(no_docs).count() == 0
    assert fp.fingerprints(edge_docs).count() == 12 and fp.fingerprints(no_docs).count() == 0


def test_single_row_follows_itself(spark):
    got = fp.edited_fingerprints(spark.createDataFrame([(1, "abcd efgh")], "doc_id long, text string")).first()
    assert got.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and got.near_next == 1.0
