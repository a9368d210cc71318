"""Secret scan: three fixed patterns and dictionary-primed zstandard novelty.

A candidate is a run of 8 and more characters other than spaces and quotes that
begins within ``REACH`` after a sensitive word, with all its joints and however
far it reaches. Its novelty is
the marginal compressed size: bytes of zstandard output for the surrounding
text with the candidate, less those without it, both primed with a dictionary
of the surrounding identifiers that are most common in the corpus. Ordinary
identifiers and prose are cheap under that dictionary; random keys cost close
to their entropy and are reported as ``novel`` spans. The dictionary counts
all surroundings of all rows; only its ``DICTIONARY_WORDS`` commonest reach
the driver.

Spans are in code points, end exclusive. Defined cases: a null text is the
empty one and has no spans; a candidate that a base span covers is still
measured; repeated rows repeat their results; other columns are ignored; an
empty table gives no rows; texts of any length are scanned whole."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Words that make the token after them sensitive, within ``REACH`` characters.
SENSITIVE = r"(?:pass(?:word|wd|phrase)?|secret|token|api_?key|auth|bearer|credential|private|akia|access_?key)"
#: Long tokens that hold the word itself.
HOLDING = r"[A-Za-z0-9+/_-]{16,}={0,2}"
RUN = r"[^\s\"'`]+"
#: A word before an assignment at the start of a run, and signs of the sentence around a run.
WORD, ASSIGNED = re.compile(SENSITIVE, re.IGNORECASE | re.ASCII), re.compile(r"(\w++)[:=]++", re.ASCII)
SIGNS = ":=>,;)]}([{"
TRAIL = ".,;:)]}>"
LEAST_RUN, SHORT = 8, 16
REACH, AROUND = 40, 160
DICTIONARY_WORDS = 4096
#: Marginal bytes per character from which a candidate counts as novel: random
#: hexadecimal text costs 0.5 and more, words of the corpus far less.
NOVELTY = 0.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of the base kinds, each leftmost and
    non-overlapping."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII)
           if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 16]
    # runs of hex digits are maximal, so a least length changes no match
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(out)


def lead_end(text: str, start: int, end: int) -> int:
    """Where a run's content starts: behind signs, and behind words that are
    sensitive and assigned to."""
    while start < end:
        if text[start] in SIGNS:
            start += 1
            continue
        word = ASSIGNED.match(text, start, end)
        if not word or not WORD.search(text, start, word.end(1)):
            break
        start = word.end()
    return start


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that begin within reach after a sensitive word, none within another."""
    out: list[tuple[int, int]] = []
    run, holding = re.compile(RUN), re.compile(HOLDING)
    run_end = holding_end = at = 0
    for word in re.finditer(SENSITIVE, text, re.IGNORECASE | re.ASCII):
        reach = word.end() + REACH
        # the search ends where a match can no longer begin within reach, the match does not
        while m := holding.search(text, max(word.start(), holding_end), reach + 16):
            m = holding.match(text, m.start())
            out.append(m.span())
            holding_end = m.end()
        at = max(at, word.end())  # behind the letters of a word that goes on over this one
        while at < len(text) and "a" <= text[at] <= "z":  # the word goes on, as in "authentication"
            at += 1
        while m := run.search(text, max(at, run_end), reach + 1):
            m = run.match(text, m.start())
            run_end = m.end()
            start = lead_end(text, *m.span())
            end = start + len(text[start:m.end()].rstrip(TRAIL))
            if end - start >= LEAST_RUN:
                out.append((start, end))
    spans: list[tuple[int, int]] = []
    for start, end in sorted(set(out), key=lambda s: (s[0], -s[1])):
        if not spans or end > spans[-1][1]:
            spans.append((start, end))
    return spans


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - AROUND):start], text[end:end + AROUND]


def novelty(before: str, candidate: str, after: str, compressor: zstandard.ZstdCompressor) -> float:
    """Marginal compressed bytes of a candidate per character. With a short one
    the output's own jumps weigh as much as a word does: of it the least with
    both sides or one of them counts."""
    size = lambda s: len(compressor.compress(s.encode("utf-8")))
    added = size(before + candidate + after) - size(before + after)
    if len(candidate) < SHORT and added >= NOVELTY * len(candidate):
        added = min(added, size(before + candidate) - size(before), size(candidate + after) - size(after))
    return max(0, added) / len(candidate)


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the words around candidates the number of texts, added up in each
    batch: the parts of a secret count once, however many candidates are near."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0):
            text = text.as_py() or ""
            counts.update({w for span in candidates(text) for side in surroundings(text, *span)
                           for w in re.findall(r"[^\W\d_]{3,}", side) if len(w) <= 40})
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                                         names=["word", "n"])


def identifier_dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> bytes:
    """The commonest identifiers around candidates, the commonest last, where
    zstandard reaches them with the shortest offsets."""
    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(_identifiers, "word string, n long")
    top = (counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
           .orderBy(F.desc("n"), "word").limit(words).collect())
    return " ".join(r["word"] for r in reversed(top)).encode("utf-8")


def _scan(dictionary: bytes, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        compressor = zstandard.ZstdCompressor(level=6, dict_data=primed) if dictionary else zstandard.ZstdCompressor(6)
        for batch in batches:
            base, novel, levels = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base_spans(text)])
                found = [(s, e, novelty(text[max(0, s - AROUND):s], text[s:e], text[e:e + AROUND], compressor))
                         for s, e in sorted(candidates(text))]
                novel.append([{"kind": "novel", "start": s, "end": e} for s, e, x in found if x >= least])
                levels.append([x for _, _, x in found if x >= least])
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span), pa.array(novel, span), pa.array(levels, pa.list_(pa.float64()))],
                names=["id", "base", "novel", "novelty"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NOVELTY) -> DataFrame:
    """One row per input row: id, arrays ``base`` and ``novel`` of spans
    ``(kind, start, end)``, and ``novelty`` of the novel ones."""
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("base", span),
                           T.StructField("novel", span), T.StructField("novelty", T.ArrayType(T.DoubleType()))])
    dictionary = identifier_dictionary(docs, text_col)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(_scan(dictionary, least), schema)


def span_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    order = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        sortable = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"),
            s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(sortable), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan(docs, id_col, text_col)
    return found.select(F.col(id_col), count("assign"), count("access"), count("hex"),
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.concat("base", "novel")).alias("spans"),
                        F.size("novel").cast("long").alias("n_novel"))
