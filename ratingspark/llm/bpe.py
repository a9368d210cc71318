"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a block of texts form a trie. A depth-first walk gives
each prefix its state: the last token of the prefix's encoding. A token that
ends the prefix is that last token exactly if it starts the word, or if the
state before it and the token are neighbours that no merge would join. So the
encoding of a shared prefix is found once, for all words below it; a word's
ids follow from its states backwards. No merge loop runs over the words.

Defined cases: a null or empty text has no tokens and decodes to the empty
text; the special token's string in a text is the special token; repeated rows
repeat their results; other columns are ignored; an empty table gives no rows.
Texts of any length go in blocks of ``BLOCK`` words."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratingspark.llm.common import bounded_batches, released

BLOCK = 60_000
#: Pairs of tokens whose neighbourhood a task remembers at most.
HELD_PAIRS = 250_000
#: Tokens whose outer parts a task remembers at most.
HELD_ENDS = 20_000
#: Rows that are encoded together, so that their words share one trie.
ROWS = 500
#: Distinct words whose encodings a task holds at most, but for those of one block.
HELD_WORDS = 240_000

#: Fixed value: the published pre-tokenizer pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same for texts whose code points are all below 256, its classes written out: the plainer engine is twice as fast.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
                   rf"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")


def _below_256(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id of a parsed tokenizer file."""
    byte_of = _byte_letters()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *added.values()]) + 1)
    for token, k in spec["model"]["vocab"].items():
        out[k] = token.encode("utf-8") if token in added else bytes(map(byte_of.__getitem__, token))
    for token, k in added.items():
        out[k] = token.encode("utf-8")
    return out


class Vocabulary:
    """Tables of one tokenizer file, given as its JSON text."""

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = token_bytes(spec)
        self.ids = {token: k for k, token in enumerate(self.bytes) if k not in self.special.values()}
        self.longest = max(map(len, self.ids))
        self.merge: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (self.ids[bytes(map(letters.__getitem__, part))]
                           for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merge[left, right] = rank
            self.made[self.ids[self.bytes[left] + self.bytes[right]]] = (rank, left, right)
        self.ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.apart: list[dict[int, bool] | None] = [None] * len(self.bytes)  # by left token, then right
        self.held = 0
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _end(self, token: int, side: int) -> list[tuple[int, int]]:
        """A token's outer parts on one side (1 left, 2 right), from its byte
        up, with the rank that makes each."""
        out = self.ends.get((token, side))
        if out is None:
            out, part = [], token
            while part in self.made:
                out.append((self.made[part][0], part))
                part = self.made[part][side]
            if len(self.ends) >= HELD_ENDS:
                self.ends.clear()
            out = self.ends[token, side] = [*out, (-1, part)][::-1]
        return out

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens ends in just these
        two: the merges of lower rank, then further left, come first, and none
        may cross the border before both tokens are whole."""
        near = self.apart[left]
        if near is None:
            near = self.apart[left] = {}
        elif (known := near.get(right)) is not None:
            return known
        a, b = self._end(left, 2), self._end(right, 1)
        i = j = 0
        never = 1 << 60
        while True:
            cross = self.merge.get((a[i][1], b[j][1]), never)
            grow_a = a[i + 1][0] if i + 1 < len(a) else never
            grow_b = b[j + 1][0] if j + 1 < len(b) else never
            if cross < grow_a and cross <= grow_b:
                known = False
                break
            if grow_a == never and grow_b == never:
                known = True
                break
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1
        if self.held >= HELD_PAIRS:
            self.apart[:] = [None] * len(self.apart)
            self.held, near = 0, {}
            self.apart[left] = near
        self.held += 1
        near[right] = known
        return known

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """``(word, ids as little-endian 32-bit)`` of the distinct words, in
        the depth-first order of their trie: sorted, each word shares with the
        one before the states of their common prefix."""
        ids, longest, stay_apart, apart = self.ids, self.longest, self.stay_apart, self.apart
        states: list[int] = []  # of prefixes of length 1, 2, ...
        lengths: list[int] = []
        before = b""
        for word in sorted(words):
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del states[keep:], lengths[keep:]
            start = keep - lengths[-1] if keep else 0
            for end in range(keep + 1, len(word) + 1):
                # only one token qualifies, so the likeliest goes first: the last one grown by a byte
                token = ids.get(word[start:end])
                if token is not None and start:
                    near = apart[left := states[start - 1]]
                    fits = near.get(token) if near is not None else None
                    if not (stay_apart(left, token) if fits is None else fits):
                        token = None
                if token is None:
                    for start in range(end - 1, max(0, end - longest) - 1, -1):
                        token = ids.get(word[start:end])
                        if token is None:
                            continue
                        if not start:
                            break
                        near = apart[left := states[start - 1]]
                        fits = near.get(token) if near is not None else None
                        if stay_apart(left, token) if fits is None else fits:
                            break
                states.append(token)
                lengths.append(end - start)
            at, out = len(word), array("I")
            while at:
                out.append(states[at - 1])
                at -= lengths[at - 1]
            out.reverse()
            before = word
            yield word, out.tobytes()

    def blocks(self, text: str) -> Iterator[list]:
        """The words of a text in blocks; special tokens come as their id."""
        for k, part in enumerate(self.parts.split(text) if self.parts else [text]):
            if k % 2:
                yield [self.special[part]]
                continue
            words = PLAIN if _below_256(part) else self.words
            if len(part) < BLOCK:
                yield words.findall(part)
            else:
                found = (m.group() for m in words.finditer(part))
                while block := list(islice(found, BLOCK)):
                    yield block


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer.value)
        known: dict = {}
        older: dict = {}  # words known before ``known`` was last full; those met again go over

        def flush(held: list, out: list) -> None:
            nonlocal known, older
            fresh = set().union(*(words for _, words in held)).difference(known)
            if len(known) + len(fresh) > HELD_WORDS // 2:
                known, older = {}, known
                fresh = set().union(*(words for _, words in held))
            again = fresh.intersection(older)
            known.update((w, older[w]) for w in again)
            fresh -= again
            for special in [w for w in fresh if isinstance(w, int)]:
                known[special] = array("I", [special]).tobytes()
                fresh.discard(special)
            order = sorted(fresh)  # code points sort as their UTF-8 does
            for word, (_, code) in zip(order, vocabulary.walk([w.encode("utf-8") for w in order])):
                known[word] = code
            for row, words in held:
                out[row].append(b"".join(map(known.__getitem__, words)))
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out: list = [[] for _ in range(part.num_rows)]
                held: list = []
                size = 0
                for row, text in enumerate(part.column(1)):
                    for words in vocabulary.blocks(text.as_py() or ""):
                        held.append((row, words))
                        size += len(words)
                        if size >= BLOCK:
                            flush(held, out)
                            size = 0
                flush(held, out)
                codes = [b"".join(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array(codes, pa.binary())],
                    names=["id", "n_tokens", "ids"])
    return run


def _joined(parts: pa.BinaryArray) -> bytes:
    """The values of a fresh array one after the other: its buffer."""
    data = parts.buffers()[2]
    return data.to_pybytes()[:np.frombuffer(parts.buffers()[1], "<i4")[len(parts)]] if data else b""


def _decode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = pa.array(token_bytes(json.loads(tokenizer.value)), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for ids in part.column("ids"):
                    codes = np.frombuffer(ids.as_buffer(), dtype="<u4") if ids.is_valid else np.empty(0, "<u4")
                    pieces = [_joined(spelled.take(pa.array(codes[k:k + BLOCK]))) for k in range(0, len(codes), BLOCK)]
                    texts.append(b"".join(pieces).decode("utf-8", errors="replace"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, "decoded"])
    return run


def _tokenizer(df: DataFrame, path: str | None):
    """The tokenizer file's text as a broadcast: a fixed file of a few MB."""
    bounded_batches(df.sparkSession)
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit integers)."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return (docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
            .mapInArrow(released(_encode(_tokenizer(docs, path))), schema))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; bytes that are not UTF-8 become
    U+FFFD, null ids the empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(released(_decode(_tokenizer(encoded, path))), schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them: ``encode``
    and ``decode`` one after the other in the same Python worker."""
    tokenizer = _tokenizer(docs, path)
    there, back = _encode(tokenizer), _decode(tokenizer)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    both = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(released(lambda rows: back(there(rows))), schema)
    return both.select(F.col(f"`{id_col}`"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
