"""Source divergence audit: how the word use of each source of a language
differs from its other sources and from the language.

Terms are counted in numpy by length-bucketed packing. The bytes of a block of
texts are split into terms with one table look-up. A term of up to 8 bytes
becomes one uint64 word, one of up to 16 bytes two; the words are sorted by a
radix sort of 16-bit digits (numpy's stable sort of uint16 is one counting
pass) and equal neighbours are run-counted. Longer terms go to buckets by
length, each sorted by its bytes. Texts of one group lie together in a block,
so a stable sort by the term leaves its groups and documents as runs.

A block sends one row per (group, term). One shuffle by (language, term) adds
them up and decides which terms are kept. ``p`` and ``q`` are integer
divisions, exact at any size by long division in steps of 1,000.

The sum over *all* kept terms for a pair of sources needs no row per absent
term. With f0 the value where both counts are 0, it is

    V * f0 + sum over s's terms of (f(p, q0) - f0) + the same for t
           + sum over shared terms of (f(p, q) - f(p, q0) - f(p0, q) + f0)

The second part depends on counts alone: a histogram of counts per group
meets each other source once. The third is added up inside the tasks, over the
sources that share a term, and leaves a task as one row per pair of sources.

Defined cases: null text, lang and source are empty strings; a group without
terms still has its ``p`` for every kept term; a language without kept terms
gives value 0 to its pairs; repeated rows are documents of their own; texts of
any length are counted whole; other columns are ignored; an empty table gives
no rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingspark.llm.common import bounded_batches, released, written

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Bytes of text that are counted together.
BLOCK = 8 << 20
#: Pairs of entries that a step holds at once, and sums that a task holds.
PAIRS, HELD = 1 << 20, 1 << 20

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order by uint64 words, the first most significant: one
    counting pass for each 16-bit digit that differs at all."""
    order = None
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order


def _runs(changed: list[np.ndarray], group: np.ndarray, doc: np.ndarray):
    """``(starts, counts, documents)`` of the runs of equal (term, group) in
    sorted entries; ``changed`` holds the term's parts."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    for part in changed:
        new[1:] |= part[1:] != part[:-1]
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(group))), np.add.reduceat(other.astype(np.int64), starts)


def _strings(matrix: np.ndarray) -> pa.Array:
    """The rows of a byte matrix, padded with zeros, as strings."""
    used = matrix != 0
    ends = np.zeros(len(matrix) + 1, np.int32)
    np.cumsum(used.sum(axis=1), out=ends[1:])
    return pa.Array.from_buffers(pa.string(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(matrix[used])])


def count_terms(data: np.ndarray, ends: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """Counts the terms of the joined texts ``data`` (uint8, one separator byte
    after each text), which end at ``ends`` and whose groups ascend: yields
    ``(terms, group codes, counts, documents)`` for each length bucket."""
    inside = _IN_TERM[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    del inside, edge
    if not len(start):
        return
    data = np.append(_LOWER[data], np.zeros(16, np.uint8))
    length, doc = stop - start, np.searchsorted(ends, start, side="right").astype(np.int32)
    for least, most in ((1, 8), (9, 16)):
        here = np.flatnonzero((length >= least) & (length <= most))
        if not len(here):
            continue
        words = []
        for half in range(most // 8):
            word = np.zeros(len(here), np.uint64)
            for at in range(8 * half, 8 * half + 8):
                byte = data[start[here] + at]
                byte[length[here] <= at] = 0
                word = (word << np.uint64(8)) | byte
            words.append(word)
        order = radix_order(words)
        words, docs = [w[order] for w in words], doc[here[order]]
        first, n, seen = _runs(words, group[docs], docs)
        matrix = np.stack([w[first] for w in words], axis=1).astype(">u8").view(np.uint8).reshape(len(first), -1)
        yield _strings(matrix), group[docs[first]], n, seen
    long = np.flatnonzero(length > 16)
    bucket = np.ceil(np.log2(length[long])).astype(np.int64)  # 17-32, 33-64, ... bytes
    for b in np.unique(bucket).tolist():
        here = long[bucket == b]
        width = int(length[here].max())
        matrix = np.zeros((len(here), width), np.uint8)  # at most twice the terms' bytes
        row = np.repeat(np.arange(len(here), dtype=np.int32), length[here])
        column = np.arange(len(row)) - np.repeat(np.cumsum(length[here]) - length[here], length[here])
        matrix[row, column] = data[start[here][row] + column]
        del row, column
        packed = matrix.view(f"S{width}").ravel()
        order = np.argsort(packed, kind="stable")
        docs = doc[here[order]]
        first, n, seen = _runs([packed[order]], group[docs], docs)
        yield _strings(matrix[order[first]]), group[docs[first]], n, seen


def _long_text(text: memoryview) -> tuple[list, list]:
    """``(terms, counts)`` of one text larger than a block, cut between terms."""
    total: Counter = Counter()
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and (outside := np.flatnonzero(~_IN_TERM[data[max(at, end - 4096):end]])).size == 0:
            end = min(len(data), end + 4096)  # a term reaches over the cut
        if end < len(data):
            end = max(at, end - 4096) + int(outside[-1]) + 1
        part = data[at:end]
        for terms, _, n, _ in count_terms(part, np.array([len(part)]), np.zeros(1, np.int64)):
            for term, times in zip(terms.to_pylist(), n.tolist()):
                total[term] += times
        at = end
    return list(total), list(total.values())


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(lang, source, term, n, docs)``, one per group and term of a block."""
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple[str, str], list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        groups = list(held)
        group = np.repeat(np.arange(len(groups)), [len(held[g]) for g in groups])
        texts = [t for g in groups for t in held[g]]
        ends = np.cumsum([len(t) + 1 for t in texts])
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        held.clear()
        del texts
        for terms, code, n, docs in count_terms(data, ends, group):
            of = [pa.DictionaryArray.from_arrays(code.astype(np.int32), [g[k] for g in groups]).cast(pa.string())
                  for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*of, terms, pa.array(n), pa.array(docs)], names=names)

    for batch in batches:
        for text, lang, source in zip(*batch.columns):
            if not text.is_valid or not (data := text.as_buffer().to_pybytes()):
                continue
            key = (lang.as_py(), source.as_py())
            if len(data) > BLOCK:
                terms, n = _long_text(memoryview(data))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(terms), pa.string()), pa.array([key[1]] * len(terms), pa.string()),
                     pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array([1] * len(terms), pa.int64())],
                    names=names)
                continue
            held.setdefault(key, []).append(data)
            size += len(data)
            if size >= BLOCK:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _share(count: Column, mass: Column) -> Column:
    """``1 + floor(UNIT * count / mass)`` for count <= mass, by long division in
    three steps of 1,000: no product leaves the range of a long."""
    count, mass = count.cast("long"), mass.cast("long")
    whole, rest = F.call_function("div", count, mass), count % mass
    for _ in range(3):
        whole = whole * 1000 + F.call_function("div", rest * 1000, mass)
        rest = rest * 1000 % mass
    return whole + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up, for pairs of sources a < b of a language, the shared terms'
    part of the sum. Input rows: lang and the lists of a kept term's sources,
    their ``p`` and their ``p`` of count 0."""
    held: dict[str, tuple[dict, dict]] = {}  # lang: codes of sources, sums by (code, code)

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, (codes, sums) in held.items():
            if sums:
                names = list(codes)
                a, b = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a), pa.string()), pa.array([names[k] for k in a], pa.string()),
                     pa.array([names[k] for k in b], pa.string()), pa.array(sums.values(), pa.int64())],
                    names=["lang", "a", "b", "value"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        term_lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes)
        term = np.repeat(np.arange(batch.num_rows), sizes)
        source = batch.column(1).flatten().dictionary_encode()
        # codes in the order of the names, so that a < b holds for both
        by_name = np.argsort(np.array([s.encode() for s in source.dictionary.to_pylist()], object), kind="stable")
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        names = [source.dictionary[int(k)].as_py() for k in by_name]
        code = rank[source.indices.to_numpy(zero_copy_only=False)] if len(by_name) else np.empty(0, np.int64)
        p, zero = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
        order = np.lexsort((code, term))
        term, term_lang, code, p, zero = term[order], term_lang[order], code[order], p[order], zero[order]
        # the entries after each one within its term are its partners
        end = np.searchsorted(term, term, side="right")
        partners = end - np.arange(len(term)) - 1
        through, at = np.cumsum(partners), 0
        while at < len(term):
            done = through[at] - partners[at]
            to = max(at + 1, int(np.searchsorted(through, done + PAIRS, side="right")))
            left = np.repeat(np.arange(at, to), partners[at:to])
            right = left + 1 + np.arange(len(left)) - np.repeat(through[at:to] - partners[at:to] - done, partners[at:to])
            value = (f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right])
                     + f(zero[left], zero[right]))
            width = len(names)
            key = (term_lang[left].astype(np.int64) * width + code[left]) * width + code[right]
            found, where = np.unique(key, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, where, value)
            for k, v in zip(found.tolist(), sums.tolist()):
                k, b = divmod(k, width)
                g, a = divmod(k, width)
                codes, total = held.setdefault(langs.dictionary[g].as_py(), ({}, {}))
                pair = codes.setdefault(names[a], len(codes)), codes.setdefault(names[b], len(codes))
                total[pair] = total.get(pair, 0) + v
            at = to
            if sum(len(total) for _, total in held.values()) > HELD:
                yield from emptied()
    yield from emptied()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Rows ``(lang, source, part, item, value, rank)``: part ``pair`` against
    each other source, part ``term`` the terms that mark the source most."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"),
                       *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"))])
    counted = rows.mapInArrow(released(_partial_counts), "lang string, source string, term string, n long, docs long")
    kept = written(
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"),
                                     F.collect_list(F.struct("source", "n")).alias("of"))
        .where(F.col("docs") >= least_docs).drop("docs"), "terms")
    entries = kept.select("lang", "term", "total", F.explode("of").alias("e")).select(
        "lang", "term", "total", "e.source", "e.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_mass"))
    groups = written(
        rows.select("lang", "source").distinct()
        .join(entries.groupBy("lang", "source").agg(F.sum("n").alias("mass")), ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"),
                (F.coalesce("mass", F.lit(0)) + 2 * F.col("terms")).alias("mass"),
                (F.col("lang_mass") + 2 * F.col("terms")).alias("lang_mass"))
        .withColumn("zero", _share(F.lit(2), F.col("mass"))), "groups")
    entries = written(
        entries.join(groups, ["lang", "source"])
        .select("lang", "source", "term", "n", "zero", _share(F.col("n") + 2, F.col("mass")).alias("p"),
                _share(F.col("total") + 2, F.col("lang_mass")).alias("q")), "entries")

    terms = (entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                           _apart(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
             .where(F.col("rank") <= top))

    this, other = groups.alias("s"), groups.alias("t")
    f0 = _apart(F.col("s.zero"), F.col("t.zero"))
    # one row per pair of sources, as many as the result has
    base = (this.join(other, (F.col("s.lang") == F.col("t.lang")) & (F.col("s.source") < F.col("t.source")))
            .select("s.lang", F.col("s.source").alias("a"), F.col("t.source").alias("b"),
                    F.coalesce(F.col("s.terms") * f0, F.lit(0)).alias("value")))
    sizes = entries.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times")).alias("s")
    alone = (sizes.join(other, (F.col("s.lang") == F.col("t.lang")) & (F.col("s.source") != F.col("t.source")))
             .select("s.lang", F.least("s.source", "t.source").alias("a"), F.greatest("s.source", "t.source").alias("b"),
                     (F.col("times") * (_apart(F.col("p"), F.col("t.zero")) - f0)).alias("value")))
    together = (entries.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("e"))
                .select("lang", "e.source", "e.p", "e.zero")
                .mapInArrow(released(_shared), "lang string, a string, b string, value long"))
    summed = base.unionByName(alone).unionByName(together).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = (summed.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                              F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
             .select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))))
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
           coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM
      (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d)),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS terms, sum(n) AS mass FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(x.n, 0) AS HUGEINT) AS n, k.n AS total
      FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x
      ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
m AS (SELECT lang, source, sum(n) AS mass FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000 * (c.n + 2) // (m.mass + 2 * v.terms) AS p,
      1 + 1000000000 * (c.total + 2) // (v.mass + 2 * v.terms) AS q
      FROM c JOIN m ON m.lang = c.lang AND m.source = c.source JOIN v ON v.lang = c.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
      LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
      GROUP BY a.lang, a.source, b.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
      row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q),
      row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term)
      FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 10"""
