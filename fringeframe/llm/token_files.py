"""Token ids in binary files of patched frame-of-reference blocks."""

from __future__ import annotations

import io
import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.llm.common import cut, shared_folder
from fringeframe.llm.storage import opened, publish

#: Ids in a block, share of them that the packed width holds, ids after which a task starts another file.
BLOCK, SHARE, FILE_IDS = 512, 0.9, 1 << 24
#: Blocks that are packed or unpacked at a time, and how many of them have their bits spread out at a time.
SLAB, SLICE = 2048, 512
#: Bytes of text for each task, and the least number of tasks for each core.
TASK_BYTES, TASKS_A_CORE = 128 << 20, 4
#: Ids that one unit of reading back covers, and tasks that read units, at most.
READ_IDS, READ_TASKS = 1 << 22, 20_000
#: Rows of files in a group of the two-level running sum.
SUM_ROWS = 1 << 16
MAGIC = b"PFOR0002"
#: Bytes of text that are split at a time, words and their ids that a worker remembers in a generation, bytes of the longest.
WINDOW, MEMORY, LONGEST = 4 << 20, 300_000, 48
#: Words that are learnt in one text, and how the tokenizer marks a word's last token.
PLAIN, WORD_END = 1000, "</w>"
#: Classes of characters: white space, letters, digits (each alone), signs (in runs), and those that leave their word to the library.
WHITE, LETTER, DIGIT, SIGN, ODD = range(5)


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of some ids; the last one is filled up with its last id.

    A block is its minimum (u4), width (u1), number of exceptions (u2), the low ``width`` bits of each difference
    from the minimum, then the places (u2) and high bits (u4) of the exceptions. The width holds SHARE of a
    block's differences; what is larger is an exception.
    """
    n = len(ids)
    if not n:
        return []
    blocks = -(-n // BLOCK)
    full = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1])]).astype(np.int64).reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = np.partition(rest, int(np.ceil(SHARE * BLOCK)) - 1, axis=1)[:, int(np.ceil(SHARE * BLOCK)) - 1]
    width = np.ceil(np.log2(at + 1)).astype(np.int64)
    high = rest >> width[:, None]
    bodies: list[bytes] = [b""] * blocks
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        for first in range(0, len(own), SLICE):
            some = own[first : first + SLICE]
            bits = np.unpackbits(rest[some].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :w]
            for b, raw in zip(some.tolist(), np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little"), strict=True):
                bodies[b] = raw.tobytes()
    patched = {b: (p, high[b, p]) for b in np.flatnonzero(high.any(axis=1)).tolist() if len(p := np.flatnonzero(high[b]))}
    none = (np.zeros(0, "<u2"), np.zeros(0, "<u4"))
    out = []
    for b in range(blocks):
        places, values = patched.get(b, none)
        out.append(struct.pack("<IBH", int(low[b]), int(width[b]), len(places)) + bodies[b] + places.astype("<u2").tobytes() + values.astype("<u4").tobytes())
    return out


def unpack_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at ``starts`` of ``raw``, BLOCK for each."""
    out = np.empty((len(starts), BLOCK), np.int64)
    by_width: dict[int, list[tuple[int, int, int]]] = {}
    heads = []
    for k, at in enumerate(starts.tolist()):
        low, width, patches = struct.unpack_from("<IBH", raw, at)
        by_width.setdefault(width, []).append((k, at + 7, low))
        heads.append((at + 7 + BLOCK // 8 * width, width, patches))
    for width, own in by_width.items():
        size = BLOCK // 8 * width
        for first in range(0, len(own), SLICE):
            part = own[first : first + SLICE]
            wide = np.zeros((len(part) * BLOCK, 32), np.uint8)
            if width:
                packed = np.frombuffer(b"".join([raw[a : a + size] for _, a, _ in part]), np.uint8).reshape(len(part), size)
                wide[:, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(-1, width)
            values = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(len(part), BLOCK)
            out[[k for k, _, _ in part]] = values + np.array([low for _, _, low in part], np.int64)[:, None]
    for k, (at, width, patches) in enumerate(heads):
        if patches:
            places = np.frombuffer(raw, "<u2", patches, at)
            out[k, places] += np.frombuffer(raw, "<u4", patches, at + 2 * patches).astype(np.int64) << width
    return out.reshape(-1).astype(np.uint32)


class FileWriter:
    """Documents of one file: ids are packed as they come, so that only packed blocks are held."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.blocks: list[bytes] = []
        self.open: list[np.ndarray] = []
        self.waiting = self.n = 0

    def add(self, keys: list[int | None], counts: list[int], ids: np.ndarray) -> None:
        self.keys += keys
        self.counts += counts
        self.open.append(ids)
        self.n += len(ids)
        self.waiting += len(ids)
        if self.waiting >= SLAB * BLOCK:
            ready = np.concatenate(self.open)
            whole = len(ready) // BLOCK * BLOCK
            for at in range(0, whole, SLAB * BLOCK):
                self.blocks += pack_blocks(ready[at : min(whole, at + SLAB * BLOCK)])
            self.open, self.waiting = [ready[whole:].copy()], len(ready) - whole

    def write(self, out) -> None:
        """Magic, numbers of documents, ids and blocks; which documents have a key, their keys and counts; block starts; blocks."""
        if self.waiting:
            self.blocks += pack_blocks(np.concatenate(self.open))
        known = np.array([k is not None for k in self.keys], np.uint8)
        out.write(MAGIC + struct.pack("<QQQ", len(self.keys), self.n, len(self.blocks)))
        out.write(known.tobytes() + np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array(self.counts, "<u8").tobytes())
        out.write(np.cumsum([0, *map(len, self.blocks)]).astype("<u8").tobytes())
        for block in self.blocks:
            out.write(block)


class FileReader:
    """A token file open for range reads: the documents are read at once, ids block by block through the index of starts."""

    def __init__(self, f):
        head = f.read_at(32, 0)
        if bytes(head[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.f = f
        self.n_docs, self.n_ids, self.n_blocks = struct.unpack_from("<QQQ", head, 8)
        raw = f.read_at(17 * self.n_docs, 32)
        known, keys = np.frombuffer(raw, np.uint8, self.n_docs), np.frombuffer(raw, "<i8", self.n_docs, self.n_docs)
        self.counts = np.frombuffer(raw, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        self.keys = pa.array(keys, pa.int64(), mask=known == 0)
        self.index = 32 + 17 * self.n_docs
        self.body = self.index + 8 * (self.n_blocks + 1)

    def ids(self, first: int, stop: int) -> Iterator[np.ndarray]:
        """Ids ``first`` to ``stop`` in pieces; only the blocks that hold them are read."""
        stop = min(stop, self.n_ids)
        for slab in range(first // BLOCK, -(-stop // BLOCK), SLAB):
            last = min(-(-stop // BLOCK), slab + SLAB)
            starts = np.frombuffer(self.f.read_at(8 * (last - slab + 1), self.index + 8 * slab), "<u8").astype(np.int64)
            raw = self.f.read_at(int(starts[-1] - starts[0]), self.body + int(starts[0]))
            flat = unpack_blocks(raw, starts[:-1] - starts[0])
            yield flat[max(0, first - slab * BLOCK) : stop - slab * BLOCK]

    def marks(self, first: int, stop: int) -> Iterator[tuple[int, int]]:
        """(document, crc32 of its ids as u4) of the documents that start at ids ``first`` to ``stop``."""
        starts = np.cumsum(self.counts) - self.counts
        a, b = np.searchsorted(starts, [first, stop]).tolist()
        if a == b:
            return
        doc, left, crc = a, int(self.counts[a]), 0
        for part in self.ids(int(starts[a]), int(starts[b - 1] + self.counts[b - 1])):
            raw, at = part.astype("<u4").tobytes(), 0
            while at < len(part):
                take = min(left, len(part) - at)
                crc = zlib.crc32(raw[4 * at : 4 * (at + take)], crc)
                at, left = at + take, left - take
                if not left:
                    yield doc, crc
                    doc, crc = doc + 1, 0
                    left = int(self.counts[doc]) if doc < b else 0


class Held:
    """Bytes with the range reads of a file."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def read_at(self, size: int, at: int) -> bytes:
        return self.raw[at : at + size]


def pack(ids: np.ndarray) -> bytes:
    """A file of one document without a key."""
    file, out = FileWriter(), io.BytesIO()
    file.add([None], [len(ids)], ids)
    file.write(out)
    return out.getvalue()


def unpack(raw: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids first to stop of a file; only the blocks that hold them are decoded."""
    file = FileReader(Held(raw))
    return np.concatenate([np.zeros(0, np.uint32), *file.ids(first, file.n_ids if stop is None else stop)])


#: The normalizer and splitter whose words class runs give: lower case, white space dropped, letters, single digits, runs of signs.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """Ids of texts by their words.

    Texts are cut to words by the classes of their characters, whole batches at a time; Arrow's dictionary encoding
    leaves each distinct word of a batch once, and of those only words not remembered go to the library. Classes and
    small letters are asked of the library too, for characters of one or two bytes. A run between white space that
    holds any other character, an apostrophe or a special token's first sign is one word, which the library cuts.
    Ids of remembered words lie in one flat array; what was not met for a generation goes, and words beyond LONGEST
    bytes are never kept.
    """

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_class = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and splits[0].get("pattern") == {"Regex": SPLIT} and spec["model"].get("end_of_word_suffix") == WORD_END
        self.tokenizer = Tokenizer.from_str(raw.decode())
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith(WORD_END)]] = True
        if self.by_class:
            self.classify()
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.ids, self.offsets, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0
        self.older_ids, self.older_offsets = self.ids, self.offsets

    def classify(self) -> None:
        """Class and small letter of every character of one or two bytes, as the library has them."""
        normal, split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        first = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()} | {"'"}
        self.kind, self.small = np.full(0x800, ODD, np.uint8), np.arange(0x800)
        for code in range(0x800):
            c = chr(code)
            seen = normal(f"a{c}a")
            if c in first or unicodedata.category(c)[0] == "M":
                continue
            if seen == "a a":
                self.kind[code] = WHITE
            elif len(seen) == 3 and seen[0] == seen[2] == "a" and len(seen[1].encode()) == len(c.encode()):
                s = seen[1]
                if (normal(c), normal(f"a{c}"), normal(f"{c}a"), normal(f"a{c} a"), normal(s)) != (s, f"a{s}", f"{s}a", f"a{s} a", s):
                    continue
                one, two = len(split(seen)), len(split(f"a{s}{s}a"))
                if (one, two) in ((1, 1), (3, 3), (3, 4)):
                    self.kind[code], self.small[code] = {(1, 1): LETTER, (3, 3): SIGN, (3, 4): DIGIT}[one, two], ord(s)
        self.letter_set = frozenset(chr(c) for c in np.flatnonzero(self.kind == LETTER))
        self.byte_kind, self.byte_small = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
        self.byte_kind[:128], self.byte_small[:128] = self.kind[:128], self.small[:128]

    def cut(self, raw: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(words, their number in each segment) of UTF-8 bytes; a segment goes from its start to the next one's."""
        kind, small = self.byte_kind[raw], self.byte_small[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
        lead = lead[lead + 1 < len(raw)]
        if len(lead):
            code = (raw[lead].astype(np.int64) & 0x1F) << 6 | raw[lead + 1] & 0x3F
            own, low = self.kind[code], self.small[code]
            kind[lead], kind[lead + 1] = own, own
            small[lead], small[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
        begins = np.zeros(len(raw) + 1, bool)
        begins[starts] = True
        begins[-1] = True
        white = kind == WHITE
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            # Runs between white space or segment ends that hold an odd character are one word each.
            edge = np.flatnonzero(begins[:-1] | white | np.r_[False, white[:-1]])
            run = np.unique(np.searchsorted(edge, odd, "right") - 1)
            size = np.append(edge, len(raw))[run + 1] - edge[run]
            inside = np.repeat(edge[run] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            kind[inside], small[inside] = ODD, raw[inside]
        begins[:-1] |= (kind == DIGIT) & (raw < 0x80)
        begins[1:-1] |= kind[1:] != kind[:-1]
        begins[:-1] &= ~white
        first = np.flatnonzero(begins[:-1])
        kept = ~white
        before = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        offsets = np.append(before[first], before[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(small[kept])])
        at = np.searchsorted(first, np.append(starts, len(raw)))
        return words, np.diff(at)

    def remember(self, found: list[tuple[bytes, np.ndarray]]) -> int:
        """Append words' ids to the flat array; the first one's number."""
        base, size = self.n, sum(len(x) for _, x in found)
        at = int(self.offsets[base])
        while at + size > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(found) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        if found:
            self.ids[at : at + size] = np.concatenate([x for _, x in found])
            self.offsets[base + 1 : base + 1 + len(found)] = at + np.cumsum([len(x) for _, x in found])
        self.n += len(found)
        return base

    def learn(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words from the library: those of letters alone many to a text, each closed by its last token's mark."""
        out: list[np.ndarray | None] = [None] * len(words)
        plain = [k for k, w in enumerate(words) if self.letters(w)] if self.by_class else []
        parts = [plain[k : k + PLAIN] for k in range(0, len(plain), PLAIN)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b" ".join([words[k] for k in p]).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(part):
                for k, own in zip(part, np.split(ids, stops[:-1]), strict=True):
                    out[k] = own
        others = [k for k, x in enumerate(out) if x is None]
        texts = [words[k].decode("utf-8", "replace") for k in others]
        for k, e in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def letters(self, word: bytes) -> bool:
        """Whether a word is letters of one or two bytes alone."""
        return word.isalpha() or self.letter_set.issuperset(word.decode("utf-8", "replace"))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        held = [np.split(ids, np.cumsum(counts)[:-1]) for _, counts, ids in encoded(self, pa.array(texts, pa.string()), 0)]
        return [own[:-1] for part in held for own in part]

    def of(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number in each segment) of segments of UTF-8 bytes."""
        if self.by_class:
            words, counts = self.cut(raw, starts)
        else:
            words, counts = pa.array([bytes(x) for x in np.split(raw, starts[1:])], pa.binary()), np.ones(len(starts), np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > MEMORY:
            self.older, self.older_ids, self.older_offsets = self.known, self.ids, self.offsets
            self.known, self.ids, self.offsets, self.n = {}, np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0
        get = self.known.get
        slots = np.array([get(w, -1) for w in distinct], np.int64)
        missing = np.flatnonzero(slots < 0).tolist()
        aged, new = [], []
        for k in missing:
            (new if self.older.get(distinct[k]) is None else aged).append(k)
        found = {}
        for k in aged:
            s = self.older[distinct[k]]
            found[k] = self.older_ids[self.older_offsets[s] : self.older_offsets[s + 1]]
        found.update(zip(new, self.learn([distinct[k] for k in new]), strict=True))
        short = [k for k in missing if len(distinct[k]) <= LONGEST]
        base = self.remember([(distinct[k], found[k]) for k in short])
        slots[short] = base + np.arange(len(short))
        self.known.update(zip([distinct[k] for k in short], range(base, base + len(short))))
        kept = self.n
        long = [k for k in missing if len(distinct[k]) > LONGEST]
        slots[long] = self.remember([(distinct[k], found[k]) for k in long]) + np.arange(len(long))
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        begin, size = self.offsets[slots], self.offsets[slots + 1] - self.offsets[slots]
        code = coded.indices.to_numpy()
        sizes = size[code]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(begin[code] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        self.n = kept
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(edges)


_words: dict[int, Words] = {}


def _tokenizer(raw: bytes) -> Words:
    mark = zlib.crc32(raw)
    if mark not in _words:
        _words[mark] = Words(raw)
    return _words[mark]


def windows(texts: pa.Array, divisible: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, rows, bytes, starts, whether the last row ends) of string rows, about WINDOW bytes at a time.

    A longer text is given in pieces that end at a space or a line's end, or whole where it has none or isn't ``divisible``.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + WINDOW, "right")) - 1)
        own = data[offsets[row] : offsets[stop]]
        if stop > row + 1 or len(own) <= WINDOW or not divisible:
            yield row, stop - row, own, offsets[row:stop] - offsets[row], True
        else:
            at = 0
            while at < len(own):
                end = at + WINDOW
                while end < len(own):
                    gaps = np.flatnonzero((own[at:end] == 32) | (own[at:end] == 10))
                    if len(gaps):
                        end = at + int(gaps[-1]) + 1
                        break
                    end += WINDOW
                end = min(end, len(own))
                yield row, 1, own[at:end], np.zeros(1, np.int64), end == len(own)
                at = end
        row = stop


def encoded(words: Words, texts: pa.Array, end: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first row, ids of each row, all of them) for rows in order, each closed by ``end``; null counts as empty."""
    held: list[np.ndarray] = []
    for row, n, raw, starts, closed in windows(texts, words.by_class):
        ids, counts = words.of(raw, starts) if len(raw) else (np.zeros(0, np.uint32), np.zeros(n, np.int64))
        if held or not closed:
            held.append(ids)
            if not closed:
                continue
            ids = np.concatenate(held)
            counts, held = np.array([len(ids)]), []
        out = np.full(len(ids) + n, end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(counts + 1) - 1] = False
        out[inside] = ids
        yield row, (counts + 1).tolist(), out


def write_files(df: DataFrame, tokenizer: str, folder: str, end: int = 2, text: str = "text", key: str = "doc_id", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Encode whole texts and write their ids, each document closed by ``end``, in ascending key order; one row per file.

    Rows are dealt by ranges of key, then of the text's hash, then at random, so that rows without a key or with a
    common one are many tasks; a task sorts its rows and writes files of about FILE_IDS ids to ``folder`` (an URI that
    all executors reach), each published when whole. Returns part, seq, uri, n_docs, n_ids; ordered by
    (part, seq) the files are in key order. Null keys come first, null and empty texts hold ``end`` alone, rows that
    repeat a key stand side by side, a very long text is encoded in pieces between white space, other columns of any name
    are not read, and an empty table writes no file.
    """
    spark = df.sparkSession
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-total // task_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = _tokenizer(shared.value), TaskContext.get().partitionId(), 0
        file = FileWriter()

        def flush() -> pa.RecordBatch:
            nonlocal file, seq
            with publish(folder, f"tokens-{part:06d}-{seq:04d}") as (out, uri):
                file.write(out)
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_docs": [len(file.keys)], "n_ids": [file.n]}, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            file, seq = FileWriter(), seq + 1
            return row

        for batch in batches:
            keys = batch.column(0)
            for first, counts, ids in encoded(words, batch.column(1), end):
                file.add(keys.slice(first, len(counts)).to_pylist(), counts, ids)
                if file.n >= FILE_IDS:
                    yield flush()
        if file.keys:
            yield flush()

    dealt = rows.withColumns({"mark": F.xxhash64("text"), "salt": F.rand(11)}).repartitionByRange(tasks, "key", "mark", "salt").sortWithinPartitions("key", "mark").select("key", "text")
    return cut(dealt.mapInArrow(run, "part int, seq int, uri string, n_docs long, n_ids long"))


def read_back(files: DataFrame, read_ids: int = READ_IDS) -> DataFrame:
    """One row per document from the files of ``write_files``: key, start (ids of all documents before it), n_tokens, ids_crc32.

    A file is read in units of about ``read_ids`` ids, each through the index of block starts. The running sum over
    files goes by groups of SUM_ROWS parts, then over one row per group.
    """
    grouped = files.withColumn("group", F.expr(f"part div {SUM_ROWS}"))
    inner = Window.partitionBy("group").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("group_base"))
    based = grouped.withColumn("base", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(groups, "group").withColumn("base", F.col("base") + F.col("group_base"))
    spread = based.select("uri", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {read_ids}"))).alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base, unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(uri) as f:
                    file = FileReader(f)
                    found = list(file.marks(unit * read_ids, (unit + 1) * read_ids))
                if found:
                    own = np.array([d for d, _ in found])
                    starts = np.cumsum(file.counts) - file.counts
                    yield pa.RecordBatch.from_arrays([file.keys.take(pa.array(own)), pa.array(starts[own] + base), pa.array(file.counts[own]), pa.array([m for _, m in found], pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    spread = cut(spread)
    return spread.repartition(max(1, min(spread.count(), READ_TASKS)), "uri", "unit").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def encode_to_files(df: DataFrame, tokenizer: str, folder: str | None = None, **options) -> tuple[str, DataFrame]:
    """(folder, rows of the files) in a new folder below the shared one unless one is given."""
    folder = folder or shared_folder(df.sparkSession, "tokens")
    return folder, write_files(df, tokenizer, folder, **options)
