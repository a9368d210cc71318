import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ratingspark.llm import divergence

SCHEMA = "text string, lang string, source string"


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t)
            for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, least=10, top=10):
    """Plain integers over every kept term."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        every = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            mass = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // mass for t in kept}
        p, q = {s: shares(count[lang, s]) for s in sources}, shares(every)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, apart(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def ran(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select(
        "lang", "source", "part", "item", "value", "rank").collect())


def sample(n=400):
    draw = np.random.default_rng(4)
    words = ["of", "The", "the", "Éa", "éa", "ÉA", "x" * 16, "y" * 17, "Y" * 17, "z" * 40, "w" * 8, "w" * 9, "a", "b_c",
             "日本語の長い言葉です", "don't", "\U0001f600", "q" * 33, "q" * 32, "ab\x00cd"] + [f"n{'abcdefghij'[k % 10] * (k + 1)}" for k in range(20)]
    rows = []
    for k in range(n):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        rows.append((" ".join(draw.choice(words, draw.integers(0, 30))), ["en", "de", None][k % 5 % 3], source))
    return rows + [(None, "en", "none"), ("", "en", "none"), ("one rare line", "xx", "only"), ("one rare line", "xx", "b"),
                   ("the " * 12, "yy", None), (None, None, None)]


def test_equal_to_plain_sums(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert ran(df.repartition(3)) == want
    df = df.select("*", *[F.lit(1).alias(c) for c in ("term", "n", "docs", "total", "p", "q", "rank", "value", "part")])
    assert ran(df.coalesce(1)) == want


def test_small_blocks_and_long_texts(spark, monkeypatch):
    """What the size of a block decides: neither counts nor documents."""
    rows = [(t, "en", s) for t, _, s in sample(120)] + [("w" * 30_000 + " the of " * 900, "en", "s1"), ("é" * 9_000, "en", "s2")]
    rows += [("é" * 9_000 + " of", "en", "s3")] * 12
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(divergence, "BLOCK", 3000)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence, "HELD", 5)
    assert ran(df) == brute(rows)


def test_other_limits_and_empty(spark):
    rows = sample(150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert ran(df, least_docs=2, top=3) == brute(rows, 2, 3)
    assert ran(df.where("false")) == []
    few = [("one", "en", "a"), ("two", "en", "b")]
    assert ran(spark.createDataFrame(few, SCHEMA)) == brute(few) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_radix_order_is_stable_and_sorted():
    draw = np.random.default_rng(5)
    high, low = draw.integers(0, 3, 5000).astype(np.uint64) << np.uint64(40), draw.integers(0, 9, 5000).astype(np.uint64)
    order = divergence.radix_order([high, low])
    assert (order == np.lexsort((low, high))).all()


def test_shares_are_exact_for_large_counts(spark):
    cases = [(2, 7), (10**15, 9 * 10**15), (8 * 10**15, 9 * 10**15), (5, 5), (123456789012345, 123456789012346)]
    df = spark.createDataFrame(cases, "c long, m long").select("c", "m", divergence._share(F.col("c"), F.col("m")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.c // r.m for r in df.collect())
