"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both must agree."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import packed, unpacked
from fringeframe.llm.token_files import NORMALIZERS, SPLIT, Words

#: Characters of a chunk, and of the first overlap of two.
CHUNK, OVERLAP = 32_768, 512
#: Tokens above which a document is over the limit.
LIMIT = 2048
#: Rows that a task holds at a time; with them the bytes that one call counts.
ROWS, CALL_BYTES = 256, 4 << 20

#: Words of a text's part: the places where they start and the number of tokens before each of them; the number of all tokens.
Coded = tuple[np.ndarray, np.ndarray, int]
RESULT = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]


@cache
def joining() -> frozenset[str]:
    """Characters that composition can join to the one before them: second parts of canonical pairs, later Hangul letters, marks."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            found.add(c)
        parts = unicodedata.decomposition(c)
        if parts and parts[0] != "<":
            found.update(chr(int(x, 16)) for x in parts.split()[1:])
    return frozenset(found)


def stable(text: str, at: int) -> bool:
    """Whether normalization joins nothing across a place and makes one character of the one that stands there."""
    c = text[at]
    return c < "\x80" or (c not in joining() and unicodedata.category(c) != "Cn" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1)


def seam(text: str, left: Coded, left_at: int, right: Coded, right_at: int, stop: int, after: int) -> tuple[int, int, int] | None:
    """(place, tokens before it in left, in right) where two overlapping chunks may be spliced; None if they don't meet.

    The place is a word's start in both chunks, beyond ``after`` and before ``stop``, which the left chunk's end can't influence, and
    stable. From the first such place on, all words up to ``stop`` must start, and have as many tokens before them, alike.
    """
    places, a, b = np.intersect1d(left[0] + left_at, right[0] + right_at, return_indices=True)
    inside = (places > after) & (places <= stop)
    places, a, b = places[inside], a[inside], b[inside]
    for k in range(len(places)):
        if stable(text, int(places[k])):
            n_left, n_right = (np.unique(x[(x >= places[k]) & (x <= stop)]).size for x in (left[0] + left_at, right[0] + right_at))
            if n_left == n_right == len(places) - k and np.array_equal(left[1][a[k:]] - left[1][a[k]], right[1][b[k:]] - right[1][b[k]]):
                return int(places[k]), int(left[1][a[k]]), int(right[1][b[k]])
    return None


def spliced(text: str, encode: Callable[[str], Coded], margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a text, of which no more than a few chunks are encoded at a time.

    Words are found from left to right, and where the next one starts depends on nothing before it; a chunk that is right at one
    word's start is therefore right from there to its end, except for what its end cuts (``margin`` characters at most beyond a
    word's last one). The first chunk is right from its start. The next one begins inside it, anywhere: at the first
    place where a word starts in both it is right too, and the chunks are spliced there. If none is found, the overlap is
    doubled; if it would reach behind the last splice, the left chunk is encoded anew with twice its length, at worst
    to the text's end.
    """
    n, total = len(text), 0
    at, end = 0, min(len(text), chunk)
    left, known, before = encode(text[:end]), 0, 0  # the last splice and the tokens before it in the left chunk
    while end < n:
        width, found = overlap, None
        while found is None and end - width > known:
            start = end - width
            stop = min(n, start + max(chunk, 2 * width))
            right = encode(text[start:stop])
            found = seam(text, left, at, right, start, end - margin, known)
            width *= 2
        if found is None:
            end = min(n, at + 2 * (end - at))
            left = encode(text[at:end])
            continue
        known, n_left, n_right = found
        total += n_left - before
        at, end, left, before = start, stop, right, n_right
    return total + left[2] - before


class Counter:
    """Counts of one tokenizer's tokens.

    Texts up to a chunk's length go through the remembered words of the token files. Longer ones are encoded by the library with
    offsets and spliced, if the tokenizer's rules are those for which ``spliced`` holds: a normalizer that works character by
    character but for composition, and a splitter that looks neither back nor further than its longest alternative.
    Any other tokenizer encodes whole texts.
    """

    def __init__(self, raw: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.words = Words(raw)
        self.tokenizer = self.words.tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(raw)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and splits[0].get("pattern") == {"Regex": SPLIT}
        plain = not any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("lstrip", "rstrip", "single_word", "normalized"))
        self.chunked, self.chunk, self.overlap = known and plain, chunk, overlap
        self.margin = max([4, *(len(t["content"]) for t in spec.get("added_tokens", []))])

    def coded(self, text: str) -> Coded:
        """Words of a text's part, with the offsets of the library."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-2))
        starts = np.array(found.offsets, np.int64).reshape(-1, 2)[first, 0]
        return starts, first, len(found.ids)

    def whole(self, texts: list[str]) -> list[int]:
        """Counts of texts that are encoded at once."""
        if not self.words.by_class:
            return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        raw = [t.encode() for t in texts]
        starts = np.array([0, *accumulate(map(len, raw))][:-1], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        full = np.flatnonzero([len(r) > 0 for r in raw])
        counts = np.zeros(len(texts), np.int64)
        if len(full):
            counts[full] = self.words.of(data, starts[full])[1]
        return counts.tolist()

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        out, held, size = [0] * len(texts), [], 0
        for k, text in enumerate(texts):
            if self.chunked and len(text) > self.chunk:
                out[k] = spliced(text, self.coded, self.margin, self.chunk, self.overlap)
                continue
            held.append(k)
            size += len(text)
            if size > CALL_BYTES:
                self.flush(texts, held, out)
                held, size = [], 0
        self.flush(texts, held, out)
        return out

    def flush(self, texts: list[str], held: list[int], out: list[int]) -> None:
        for k, n in zip(held, self.whole([texts[k] for k in held]) if held else (), strict=True):
            out[k] = n


_counters: dict[tuple[int, int, int], Counter] = {}


def _counter(raw: bytes, chunk: int, overlap: int) -> Counter:
    name = zlib.crc32(raw), chunk, overlap
    if name not in _counters:
        _counters[name] = Counter(raw, chunk, overlap)
    return _counters[name]


def count(df: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without its text and with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    Tokens are those of the tokenizers library for the file ``tokenizer``, without added special tokens; special strings inside a
    text are special, as is the library's default. Texts never move: the task that scans a row counts it, huge texts
    chunk by chunk. Null and empty texts have no bytes and no tokens; repeated rows are counted each; an empty table gives
    an empty result; columns of other types and names pass, and results replace inputs of their name.
    """
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    taken = {name for name, _ in RESULT} | {text.lower()}
    others = [c for c in df.columns if c.lower() not in taken]
    kept = df.select(F.col(f"`{text}`").alias("text"), packed(others))
    schema = T.StructType(list(kept.schema.fields)[1:])
    for name, kind in RESULT:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value, chunk, overlap)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [t or "" for t in batch.column(0).to_pylist()]
                n = np.array(counter.counts(texts), np.int64)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], schema.names)

    return unpacked(kept.mapInArrow(run, schema), others, [name for name, _ in RESULT])
