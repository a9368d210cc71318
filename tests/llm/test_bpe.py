import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratingspark.llm import bpe


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def texts():
    rng = random.Random(1)
    any_char = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    out = ["".join(rng.choices(any_char, k=50)) for _ in range(300)]
    out += ["".join(rng.choices("ab aa\n'tse<|endoftext|>", k=60)) for _ in range(300)]
    return out + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>  x", "a" * 700, " \n\n  a  ", "", "'s're \x1c x\x85y\xa0z"]


def test_matches_the_library(spark, library):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded == library.decode(ids, skip_special_tokens=False) == text


def test_documents_match_the_library(docs, library):
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for r in docs.collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids, dtype="<u4")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_edge_rows(edge_docs, library):
    got = bpe.decode(bpe.encode(edge_docs)).collect()
    want = {(r.doc_id, r.text or "") for r in edge_docs.collect()}
    assert len(got) == 12 and {(r.doc_id, r.decoded) for r in got} == want
    for r in got:
        assert r.n_tokens == len(library.encode(r.decoded, add_special_tokens=False).ids)


def test_empty_table_and_bad_ids(spark, no_docs):
    assert bpe.round_trip(no_docs).count() == 0
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        half = bpe.Vocabulary(file.read()).ids[b"\xc3"]  # the first byte of a longer character
    df = spark.createDataFrame([(1, bytearray(np.array([half], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decode(df).orderBy("doc_id").collect()] == ["\ufffd", ""]


def test_pairs_are_judged_once_and_forgotten_within_the_bound(library, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        text = file.read()
    rng = random.Random(2)
    words = ["".join(rng.choices(["th", "in", "er", "onti", "ble", "wh"], k=5)) for _ in range(3000)]
    want = {w: library.encode(w, add_special_tokens=False).ids for w in words}
    judged = []
    for bound in (10**9, 50):
        monkeypatch.setattr(bpe, "HELD_PAIRS", bound)
        vocabulary = bpe.Vocabulary(text)
        plain = vocabulary._end
        monkeypatch.setattr(vocabulary, "_end", lambda *key: judged.append(key) or plain(*key))
        for _ in range(2):
            got = {w.decode(): np.frombuffer(ids, "<u4").tolist() for w, ids in vocabulary.walk([w.encode() for w in want])}
            assert got == want
        kept = sum(len(near) for near in vocabulary.apart if near)
        assert kept == vocabulary.held <= bound
        if bound == 10**9:
            assert len(judged) == 2 * kept  # both sides of each pair, once


def test_joined_tokens_of_any_part():
    import pyarrow as pa
    spelled = pa.array([b"a", b"", b"\xc3", b"xyz"], pa.binary())
    for codes in ([], [1, 1], [3, 0, 2, 1, 3]):
        want = b"".join(spelled[k].as_py() for k in codes)
        assert bpe._joined(spelled.take(pa.array(np.array(codes, "<u4")))) == want


def test_plain_pattern_splits_as_the_published_one():
    import regex
    rng = random.Random(3)
    published, odd = regex.compile(bpe.PATTERN), "'s't're've'm'll'd  \n\t\x1c\x85\xa0ªº²¼×÷éß'"
    for k in range(3000):
        text = "".join(rng.choices([chr(c) for c in range(256)] if k % 2 else list(odd), k=40))
        assert bpe._below_256(text) and bpe.PLAIN.findall(text) == published.findall(text)
    assert not bpe._below_256("aĀ")
