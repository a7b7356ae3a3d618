"""Byte-level BPE: a minimal perfect hash finds whole pre-tokens, a heap over linked bytes merges the others."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import attach, free_name

#: The splitting pattern whose pre-tokens the shortcuts of ``Codec`` know (a fixed value); texts are split by others as they stand.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in a generation of a worker's memory (some 150 bytes each, two generations), and the longest one it remembers.
MEMORY, LONGEST = 400_000, 48
#: Marks that are a pre-token of their own after letters.
ENDS = frozenset(".,;:?!")
#: Python's and regex's \s has these four, the tokenizer's pattern language hasn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space other than the space, as str.isspace() has it.
BLANKS = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c != " ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parsed(f.read())


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings: one displacement per bucket, one slot per key."""

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size)
        marks = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        of = (marks % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=self.buckets))
        starts = ends - np.bincount(of, minlength=self.buckets)
        self.shift = np.zeros(self.buckets, np.uint64)
        free = np.ones(self.size, bool)
        single = []
        for b in np.argsort(starts - ends, kind="stable"):  # largest buckets first
            own = order[starts[b] : ends[b]]
            if len(own) < 2:
                if len(own):
                    single.append(b)
                continue
            d = 0
            while True:
                slots = self.place(marks[own], np.uint64(d))
                if free[slots].all() and len(set(slots.tolist())) == len(own):
                    break
                d += 1
            self.shift[b] = d
            free[slots] = False
        # A bucket of one key takes any free slot, named directly by the top bit.
        for b, slot in zip(single, np.flatnonzero(free)[: len(single)], strict=True):
            self.shift[b] = (1 << 63) | int(slot)
        self.table = np.empty(self.size, object)
        for k, m, b in zip(keys, marks, of, strict=True):
            d = self.shift[b]
            self.table[int(d) & ((1 << 63) - 1) if int(d) >> 63 else int(self.place(np.array([m]), d)[0])] = k
        self.shift = self.shift.tolist()
        self.table = self.table.tolist()

    def place(self, marks: np.ndarray, d: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (marks ^ (d * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
            return ((x ^ (x >> np.uint64(31))) % np.uint64(self.size)).astype(np.int64)

    def slot(self, key: bytes) -> int:
        """The key's slot, or -1 for a string outside the set."""
        if not self.size:
            return -1
        m = xxhash.xxh64_intdigest(key)
        d = self.shift[m % self.buckets]
        if d >> 63:
            s = d & ((1 << 63) - 1)
        else:
            x = ((m ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
            s = (x ^ (x >> 31)) % self.size
        return s if self.table[s] == key else -1


class Codec:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        self.ranks = ranks
        self.hash = table or PerfectHash(list(ranks))
        self.usual = pattern == PATTERN
        self.ids = [ranks[k] for k in self.hash.table]
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, i in ranks.items():
            self.words[i] = k
        self.pattern = regex.compile(pattern)
        self.narrow = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r \x85\xa0  -     　").replace(r"\S", r"[^\t-\r \x85\xa0  -     　]").replace(r"\s", r"[\t-\r \x85\xa0  -     　]"))
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", "[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", "[^\t-\r ]").replace(r"\s", "[\t-\r ]"))
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token outside the vocabulary: the lowest rank first, leftmost on ties.

        A part is known by its first byte; ``after`` and ``before`` link the parts, ``end`` closes them. The heap
        holds rank, first byte and end of each possible merge in one integer.
        """
        rank, n = self.ranks.get, len(piece)
        bits = max(16, n.bit_length() + 1)
        mask, pop, push, two = (1 << bits) - 1, heapq.heappop, heapq.heappush, self.two
        end = list(range(1, n + 1))
        before = list(range(-1, n))
        heap = [(r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := two[a << 8 | b]) >= 0]
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            stop, i = x & mask, x >> bits & mask
            j = end[i]
            if j >= stop or j == 0 or end[j] != stop:
                continue  # one of its halves has been merged since
            end[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    push(heap, (r << bits | i) << bits | end[stop])
            h = before[i]
            if h >= 0 and (r := rank(piece[h:stop])) is not None:
                push(heap, (r << bits | h) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def token(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token, remembered in two generations: what was not met for a generation goes."""
        if (ids := self.tokens.get(text)) is None:
            if (ids := self.older.get(text)) is None:
                piece = text.encode()
                slot = self.hash.slot(piece)
                ids = (self.ids[slot],) if slot >= 0 else self.merge(piece)
            if len(text) <= LONGEST:
                if len(self.tokens) >= MEMORY:
                    self.older = dict(self.tokens)
                    self.tokens.clear()
                self.tokens[text] = ids
        return ids

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a piece of text that begins and ends with whole pre-tokens."""
        if not self.usual:
            found = (self.narrow if SEPARATORS.search(text) else self.pattern).finditer(text)
            return tuple(chain.from_iterable([self.token(m[0]) for m in found]))
        if text[-1:] in ENDS and text[1:-1].isalpha() and text[0] == " ":
            return self.token(text[:-1]) + self.token(text[-1])
        if text[1:].isalpha() and text[0] == " ":
            return self.token(text)
        if text.isascii():
            parts = self.plain.findall(text)
        else:
            parts = (self.narrow if SEPARATORS.search(text) else self.pattern).findall(text)
        return tuple(chain.from_iterable(map(self.token, parts)))

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text. By PATTERN a single space between other characters always starts a pre-token, so the text is cut there and a word met before costs one lookup."""
        if not self.usual:
            return list(self.chunk(text))
        first, *rest = text.split(" ")
        if "" in rest or not first or text[0].isspace() or text[-1].isspace() or any(c in text and (f" {c}" in text or f"{c} " in text) for c in BLANKS):
            return list(self.chunk(text))  # white space beside a space: a cut there would not be a token's start
        known, chunk = self.tokens.get, self.chunk
        return list(chain(chunk(first), chain.from_iterable([known(c) or chunk(c) for c in [" " + x for x in rest]])))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def parsed(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _codec(given: tuple[bytes, str, PerfectHash]) -> Codec:
    """One codec per worker process and vocabulary."""
    raw, pattern, table = given
    mark = (xxhash.xxh64_intdigest(raw), pattern)
    if mark not in _codecs:
        _codecs[mark] = Codec(parsed(raw), pattern, table)
    return _codecs[mark]


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, token_ids (array of int).

    ``vocabulary`` is a rank file that the driver reads; its bytes (bounded: a vocabulary) and the perfect hash that
    is built of them once travel to the workers as a broadcast. Null and empty texts give no ids; the hashes are then those of nothing. Texts of any
    length are encoded whole, each row alone, so ties and repeated rows need no rule. Result columns replace
    inputs of their name.
    """
    spark: SparkSession = df.sparkSession
    with open(vocabulary, "rb") as f:
        raw = f.read()
    shared = spark.sparkContext.broadcast((raw, pattern, PerfectHash(list(parsed(raw)))))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value)
        names = [str(i) for i in range(len(codec.words))]
        for batch in batches:
            counts, marks, backs, lists = [], [], [], []
            for value in batch:
                ids = codec.encode(value.as_py() or "")
                counts.append(len(ids))
                marks.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                backs.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    lists.append(np.array(ids, np.int32))
            columns = [pa.array(counts, pa.int64()), pa.array(marks, pa.string()), pa.array(backs, pa.string())]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]))))
            yield pa.StructArray.from_arrays(columns, [f.name for f in fields])

    coded = F.arrow_udf(run, T.StructType(fields), F.ArrowUDFType.SCALAR_ITER)
    own = free_name(df, "bpe__")
    held = df.withColumn(own, coded(F.col(f"`{text}`")))
    return attach(held, {f.name: F.col(f"{own}.{f.name}") for f in fields}).drop(own)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with decoded (binary): the bytes of each row's ids; null ids give null, an id outside the vocabulary fails the job."""
    words = df.sparkSession.sparkContext.broadcast({i: k for k, i in read_ranks(vocabulary).items()})

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (x := v.as_py()) is None else b"".join([words.value[i] for i in x]) for v in batch], pa.binary())

    return attach(df, {"decoded": F.arrow_udf(run, T.BinaryType(), F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{ids}`"))})
