"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's terms, over all documents.
2. Benchmark texts are cut into passages of ``WINDOW`` words with TF-IDF
   weights; a distributed randomised SVD of the passage-term matrix gives the
   latent space. Passages and term rows stay distributed; only matrices as
   wide as the sketch reach the driver, and the term rows of the final basis.
3. Every document is cut into windows of the same size at every half window.
   A window is compared with the items of which its region (see 4) holds
   enough words, in any order, to cover ``COVERED``: others cannot be leaks, so
   nothing is lost, however rare the words around are and however many
   documents there are. ``COSINE`` and more with a passage is a candidate.
4. A candidate's region of the document is compared with the whole item by the
   longest common subsequence of words, and with the item's answer, its last
   sentence. It is a leak if the subsequence covers ``COVERED`` of the item
   and half of the answer, or ``NEARLY_ALL`` of the item.

The benchmark is taken in blocks of ``BLOCK_ITEMS`` items, so what is
broadcast for a block is bounded; each block sees all documents.

Defined cases: a null or empty item matches nothing; a null or empty document
has no leak; items with equal texts are found together; repeated rows repeat
their results; null ids are carried along; other columns are ignored; without
benchmark rows nothing is a leak; whole texts are read, short ones as one
window."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingspark.llm.common import bounded_batches, give_back, local_table, released, written
from ratingspark.llm.shingles import U64, mix, word_hashes

WINDOW, STEP = 32, 16
RANK, OVERSAMPLE = 128, 16
COSINE = 0.45
#: Windows that are searched at once.
PART = 128
COVERED, ANSWER_COVERED, NEARLY_ALL = 0.6, 0.5, 0.85
BLOCK_ITEMS = 2048

LEAK = "array<struct<item_id: long, cosine: double, lcs_share: double, answer_share: double>>"


def words_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8"))


def answer_of(text: str) -> str:
    """The last sentence of an item."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
    return parts[-1] if parts else ""


def window_starts(n: int) -> range:
    """Starts of the windows of a text of n words; each run of half a window
    and one words lies in one of them."""
    return range(0, max(1, n - STEP), STEP) if n else range(0)


class Lookup:
    """Positions of 64-bit hashes in a sorted vocabulary, -1 for others."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(vocabulary >> U64(48)).astype(np.int64)] = True

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.seen[(words >> U64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == words[maybe]
            out[maybe[same]] = at[same]
        return out


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and the sequence
    whose word positions ``masks`` holds as bits."""
    row = full = (1 << length) - 1
    for word in words:
        if (mask := masks.get(word)) is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def word_masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def document_frequency(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Of each vocabulary term the number of documents that hold it, and the
    number of documents: whole texts of all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shared.value)
        total = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for text in batch.column(0):
                at = find(words_of(text.as_py()))
                total[np.unique(at[at >= 0])] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    rows = (docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(released(count), "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # one row per benchmark term
    total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in rows:
        total[r["term"]] = r["n"]
    return total[:-1], int(total[-1])


def _start(terms: np.ndarray, width: int) -> np.ndarray:
    """Rows of the random start matrix, the same for a term everywhere."""
    with np.errstate(over="ignore"):
        bits = mix(terms[:, None] + np.arange(1, width + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return np.where(bits >> U64(63), 1.0, -1.0)


def randomised_svd(passages: DataFrame, rank: int, oversample: int = OVERSAMPLE) -> dict[int, np.ndarray]:
    """The leading right singular directions of a matrix given as rows of
    ``terms array<long>, weights array<double>``: one vector per term.

    Y = A'(A R) is added up by term; Y'Y, as wide as the sketch, makes its
    columns orthonormal; the eigenvectors of (AQ)'(AQ) turn them."""
    width = rank + oversample

    def unsigned(values) -> np.ndarray:
        return np.asarray(values, dtype=np.int64).view(U64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, np.ndarray] = {}
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z = np.asarray(weights) @ _start(unsigned(terms), width)
                for term, weight in zip(terms, weights):
                    out[term] = out.get(term, 0.0) + weight * z
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.int64()), pa.array(list(out.values()), pa.list_(pa.float64()))],
                names=["term", "y"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out[term] = out.get(term, 0.0) + np.asarray(y)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out.keys(), pa.int64()), pa.array(list(out.values()), pa.list_(pa.float64()))],
            names=["term", "y"])

    def gram(column: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for batch in batches:
                if batch.num_rows:
                    m = np.stack([np.asarray(v) for v in batch.column(column).to_pylist()])
                    total += m.T @ m
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])
        return run

    def summed(df: DataFrame, column: int) -> np.ndarray:
        parts = df.mapInArrow(released(gram(column)), "i long, v array<double>")
        cells = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
        out = np.zeros((width, width))
        for r in cells.collect():
            out[r["i"], r["j"]] = r["x"]
        return out

    # every task that adds up holds the vectors of its own terms
    y = written(passages.select("terms", "weights").mapInArrow(released(spread), "term long, y array<double>")
                .repartition("term").mapInArrow(released(add), "term long, y array<double>"), "sketch")
    values, turn = np.linalg.eigh(summed(y, 1))
    use = values > max(values.max(), 0) * 1e-10 if len(values) else values > 0
    ortho = turn[:, use] / np.sqrt(values[use])
    if not use.any():
        return {}
    basis = {r["term"]: np.asarray(r["y"]) @ ortho for r in y.toLocalIterator()}  # a block's terms: bounded
    shared = passages.sparkSession.sparkContext.broadcast(basis)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        for batch in batches:
            rows = []
            for terms, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                z = np.zeros(width)
                found = np.asarray(weights) @ np.stack([basis[t] for t in terms])
                z[:len(found)] = found
                rows.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], names=["z"])

    # written in between: two Python steps of one task would need two workers
    small = summed(written(passages.select("terms", "weights").mapInArrow(released(project), "z array<double>"), "projected"), 0)
    size = int(use.sum())
    _, vectors = np.linalg.eigh(small[:size, :size])
    best = vectors[:, ::-1][:, :rank]
    return {term: v @ best for term, v in basis.items()}


class Block:
    """What a task needs to search one block of items."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: np.ndarray, frequency: np.ndarray, n_docs: int):
        self.items = [(item, words_of(text), words_of(answer_of(text))) for item, text in items]
        self.idf = np.log((1 + n_docs) / (1 + frequency)) + 0.1
        self.vocabulary = vocabulary
        self.basis = np.zeros((len(vocabulary), 1), dtype=np.float32)
        self.rows = self.basis
        self.passages = np.zeros((0, 1), dtype=np.float32)
        self.first = np.zeros(len(items) + 1, dtype=np.int64)
        self.longest = max((len(own) for _, own, _ in self.items), default=0)
        # an item without words is never held
        self.least = np.array([COVERED * len(own) - 1e-9 if len(own) else np.inf for _, own, _ in self.items])
        find = Lookup(vocabulary)
        self.own = [np.unique(find(own), return_counts=True) for _, own, _ in self.items]
        # which items hold a term, and how often
        terms = np.concatenate([np.empty(0, dtype=np.int64)] + [t for t, _ in self.own])
        order = np.argsort(terms, kind="stable")
        self.holder_first = np.searchsorted(terms[order], np.arange(len(vocabulary) + 1))
        self.holder = np.repeat(np.arange(len(items)), [len(t) for t, _ in self.own])[order]
        self.holder_count = np.concatenate([np.empty(0, dtype=np.int64)] + [c for _, c in self.own])[order]

    def weighted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of a window and their TF-IDF weights."""
        terms, counts = np.unique(at[at >= 0], return_counts=True)
        return terms, counts * self.idf[terms]

    def item_passages(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        find = Lookup(self.vocabulary)
        out = []
        for k, (_, words, _) in enumerate(self.items):
            at = find(words)
            for s in window_starts(len(at)):
                terms, weights = self.weighted(at[s:s + WINDOW])
                out.append((k, terms, weights / np.linalg.norm(weights)))
        return out

    def set_basis(self, vectors: dict[int, np.ndarray]) -> None:
        if vectors:
            self.basis = np.stack([vectors[int(t)] for t in self.vocabulary.view(np.int64)]).astype(np.float32)
        self.rows = self.basis * self.idf[:, None].astype(np.float32)
        parts = self.item_passages()
        if parts:
            z = np.stack([weights @ self.basis[terms] for _, terms, weights in parts]).astype(np.float32)
            self.passages = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            self.first = np.searchsorted([k for k, _, _ in parts], np.arange(len(self.items) + 1))

    def held(self, at: np.ndarray) -> list[int]:
        """Items of which a text holds enough words, each as often as the item
        has it and in any order, to cover ``COVERED``."""
        terms, counts = np.unique(at[at >= 0], return_counts=True)
        size = self.holder_first[terms + 1] - self.holder_first[terms]
        rows = np.repeat(self.holder_first[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.minimum(self.holder_count[rows], np.repeat(counts, size))
        return np.flatnonzero(np.bincount(self.holder[rows], common, len(self.items)) >= self.least).tolist()

    def may_cover(self, k: int, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which windows' regions hold enough words of item k, in any order,
        to cover ``COVERED``: no other window can lead to a leak."""
        terms, counts = self.own[k]
        length = len(self.items[k][1])
        place = np.minimum(np.searchsorted(terms, at), len(terms) - 1)
        hit = np.flatnonzero(terms[place] == at)
        n_halves = -(-len(at) // STEP)
        grid = np.bincount(place[hit] * n_halves + hit // STEP, minlength=len(terms) * n_halves)
        sums = np.zeros((len(terms), n_halves + 1), dtype=np.int64)
        np.cumsum(grid.reshape(len(terms), n_halves), axis=1, out=sums[:, 1:])
        low = np.maximum(starts - length, 0) // STEP
        high = np.minimum(-(-(starts + WINDOW + length) // STEP), n_halves)
        return np.minimum(sums[:, high] - sums[:, low], counts[:, None]).sum(axis=0) >= self.least[k]

    def search(self, words: np.ndarray, find: Lookup) -> dict[int, tuple[float, list[int]]]:
        """Candidate items of a text: best cosine and the windows' starts."""
        n = len(words)
        if not n or not len(self.passages):
            return {}
        at = find(words)
        starts = np.asarray(window_starts(n))
        found: dict[int, tuple[float, list[int]]] = {}
        for low in range(0, len(starts), PART):
            part = starts[low:low + PART]
            begin = max(0, part[0] - self.longest) // STEP * STEP
            around = at[begin:part[-1] + WINDOW + self.longest]
            possible = [(k, part[self.may_cover(k, around, part - begin)]) for k in self.held(around)]
            possible = [(k, where) for k, where in possible if len(where)]
            if not possible:
                continue
            # weights add up word by word: each half window is summed once and used by two windows
            near = at[part[0]:part[-1] + WINDOW]
            known = np.flatnonzero(near >= 0)
            halves = np.zeros((len(part) + 1, self.basis.shape[1]), dtype=np.float32)
            if len(known):
                half, first = np.unique(known // STEP, return_index=True)
                halves[half] = np.add.reduceat(self.rows[near[known]], first, axis=0)
            z = halves[:-1] + halves[1:]
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            for k, where in possible:
                cosine = (z[(where - part[0]) // STEP] @ self.passages[self.first[k]:self.first[k + 1]].T).max(axis=1)
                close = cosine >= COSINE
                if close.any():
                    best, earlier = found.get(k, (0.0, []))
                    found[k] = (max(best, float(cosine.max())), earlier + where[close].tolist())
        return found

    def leaks(self, text: str | None, find: Lookup, masks: dict) -> list[dict]:
        words = words_of(text)
        out = []
        for k, (cosine, starts) in sorted(self.search(words, find).items()):
            item, own, answer = self.items[k]
            if k not in masks:
                masks[k] = word_masks(own), word_masks(answer)
            best = None  # of the regions that are a leak
            last = -1
            for s in sorted(set(starts)):
                low, high = max(0, s - len(own)), s + WINDOW + len(own)
                if last >= 0 and s - last < STEP // 2:
                    continue
                region = words[low:high].tolist()
                share = lcs(masks[k][0], len(own), region) / len(own)
                reply = lcs(masks[k][1], len(answer), region) / len(answer) if len(answer) else share
                if share >= NEARLY_ALL or share >= COVERED and reply >= ANSWER_COVERED:
                    best = max(best or (share, reply), (share, reply))
                last = s
            if best:
                out.append({"item_id": item, "cosine": cosine, "lcs_share": best[0], "answer_share": best[1]})
        return out


def fit_block(docs: DataFrame, text_col: str, items: list[tuple[int, str]], rank: int) -> Block:
    spark = docs.sparkSession
    words = [words_of(text) for _, text in items]
    vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, dtype=U64)
    block = Block(items, vocabulary, *document_frequency(docs, text_col, vocabulary))
    parts = [(vocabulary[terms].view(np.int64).tolist(), weights.tolist()) for _, terms, weights in block.item_passages()]
    if parts:
        passages = written(local_table(spark, parts, "terms array<long>, weights array<double>"), "passages")
        block.set_basis(randomised_svd(passages, rank))
    return block


def _searcher(shared):
    @F.pandas_udf(LEAK)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = shared.value
        find, masks = Lookup(block.vocabulary), {}
        for part in texts:
            yield pd.Series([block.leaks(t, find, masks) for t in part])
        give_back()

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", rank: int = RANK) -> Column:
    """A column expression over ``docs``: the leaked items of each row, as
    structs of ``item_id, cosine, lcs_share, answer_share``."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"),
                             F.col(f"`{item_text_col}`").alias("text")).where("trim(text) != ''")
    blocks = items.count() // BLOCK_ITEMS + 1
    found = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect() if blocks > 1 \
            else items.collect()
        block = fit_block(docs, text_col, sorted((r["item"], r["text"]) for r in rows if r["item"] is not None)
                          + [(None, r["text"]) for r in rows if r["item"] is None], rank)
        search = _searcher(docs.sparkSession.sparkContext.broadcast(block))
        found.append(search(F.col(f"`{text_col}`")))
    return F.concat(*found) if len(found) > 1 else found[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document and leaked item."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col("text"))
    return (rows.select(id_col, F.explode(leaks(rows, benchmark, **options)).alias("leak"))
            .select(id_col, "leak.*"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns unchanged."""
    return docs.where(F.size(leaks(docs, benchmark, **options)) == 0)
