"""Media columns: payloads named by content in tar shards; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import cut, packed, shared_folder, unpacked
from fringeframe.llm.storage import opened, publish

#: Samples in a row of the picture, bytes and members of a shard, and how much of a file the header-only read takes.
WIDTH, SHARD_BYTES, SHARD_MEMBERS, HEADER = 64, 256 << 20, 1 << 18, 33
#: Rows that leave a task at a time.
ROWS = 1024
#: What ``store`` and ``read`` add.
STORED = (("media_bytes_unpadded", "long"), ("media_digest", "string"), ("media_uri", "string"), ("media_offset", "long"), ("media_length", "long"))
READ = (("media_width", "integer"), ("media_height", "integer"), ("media_depth", "integer"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_sha256", "string"), ("media_feature", "string"))
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of WIDTH."""
    return padded((text or "").encode("utf-8", "replace"))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(data: bytes) -> bytes:
    """A grey 8-bit picture, WIDTH samples a row, rows unfiltered: lossless, and its size is in its first bytes."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Metadata from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a picture of this store")
    width, height, depth, colour = struct.unpack_from(">IIBB", head, 16)
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def from_png(media: bytes) -> bytes:
    """The samples of a picture that ``to_png`` made; checks every chunk."""
    meta, at, packed = png_header(media), 8, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("damaged picture")
        if kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(meta["height"], meta["width"] + 1)
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, spread and share of zeros of the samples, and the share of each quarter of their range."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    mean = float(counts @ np.arange(256)) / len(a)
    spread = max(0.0, float(counts @ np.arange(256) ** 2) / len(a) - mean * mean) ** 0.5
    return f"mean={mean:.4f};spread={spread:.4f};zero={counts[0] / len(a):.4f};quarters=" + "/".join(f"{x / len(a):.4f}" for x in counts.reshape(4, 64).sum(axis=1))


class Shards:
    """Tar shards that one task writes, one after the other; a member is named by its payload's digest and stored once in a shard."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.seq, self.open, self.placed = folder, part, 0, None, {}

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """(URI, offset, length) of a payload's picture."""
        if self.open is not None and (self.size >= SHARD_BYTES or len(self.placed) >= SHARD_MEMBERS) and digest not in self.placed:
            self.close()
        if self.open is None:
            self.open = publish(self.folder, f"media-{self.part:06d}-{self.seq:04d}.tar")
            (self.out, self.uri), self.placed, self.size = self.open.__enter__(), {}, 0
            self.seq += 1
        if digest not in self.placed:
            media = to_png(data)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head, rest = info.tobuf(tarfile.PAX_FORMAT), bytes(-len(media) % 512)
            self.out.write(head + media + rest)
            self.placed[digest] = self.size + len(head), len(media)
            self.size += len(head) + len(media) + len(rest)
        return self.uri, *self.placed[digest]

    def close(self) -> None:
        """Close the tar file and give it its name."""
        if self.open is not None:
            self.out.write(bytes(1024))
            self.open.__exit__(None, None, None)
            self.open = None


def store(df: DataFrame, folder: str | None = None, text: str = "text") -> DataFrame:
    """``df`` without its text and with the columns STORED; payloads are in tar shards in ``folder``.

    Each task writes shards of its own and gives them their names when they are whole; a member is named by its
    payload's SHA-256 and stored once in a shard, so repeated rows share it. No row moves between tasks, and a task
    holds a batch of rows and the digests of one shard, SHARD_MEMBERS at most. A task that runs again writes
    new shards, and only rows of one attempt count. Null and empty texts are WIDTH zeros; a very long text is
    one member; an empty table writes no shard; result columns replace inputs of their name.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "media")
    taken = {name for name, _ in STORED} | {text.lower()}
    others = [c for c in df.columns if c.lower() not in taken]
    kept = df.select(F.col(f"`{text}`").alias("text"), packed(others))
    schema = T.StructType(list(kept.schema.fields)[1:])
    for name, kind in STORED:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, TaskContext.get().partitionId())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, placed = whole.slice(at, ROWS), []
                for value in batch.column(0):
                    raw = (value.as_py() or "").encode("utf-8", "replace")
                    data = padded(raw)
                    digest = hashlib.sha256(data).hexdigest()
                    placed.append((len(raw), digest, *shards.add(digest, data)))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([r[c] for r in placed], kind) for c, kind in enumerate(kinds))], schema.names)
        shards.close()

    return unpacked(cut(kept.mapInArrow(run, schema)), others, [name for name, _ in STORED])


def read(stored: DataFrame) -> DataFrame:
    """``stored`` with the columns READ: sizes by header-only range reads, the others from whole pictures.

    Rows are read where they stand, in the order of their shards; a copy costs no second read while it is the last one seen.
    Rows whose text was null or empty read WIDTH zeros, very long ones are one picture each, repeated rows read alike, and an
    empty table gives an empty result. Result columns replace inputs of their name.
    """
    taken = {name for name, _ in READ}
    others = [c for c in stored.columns if c.lower() not in taken]
    where = stored.select(packed(others), "media_uri", "media_offset", "media_length")
    schema = T.StructType(list(where.schema.fields)[:1])
    for name, kind in READ:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris, offsets, lengths = (batch.column(k).to_pylist() for k in (1, 2, 3))
            result: list[tuple] = [()] * batch.num_rows
            for uri in dict.fromkeys(uris):
                with opened(uri) as f:
                    seen: tuple = (None, ())
                    for k in sorted((k for k in range(len(uris)) if uris[k] == uri), key=offsets.__getitem__):
                        if seen[0] != offsets[k]:
                            meta = png_header(f.read_at(HEADER, offsets[k]))
                            media = f.read_at(lengths[k], offsets[k])
                            data = from_png(media)
                            seen = offsets[k], (meta["width"], meta["height"], meta["depth"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), hashlib.sha256(media).hexdigest(), features(data))
                        result[k] = seen[1]
            kinds = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[c] for r in result], kind) for c, kind in enumerate(kinds))], schema.names)

    return unpacked(where.mapInArrow(run, schema), others, [name for name, _ in READ])


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Store and read back: every row of ``df`` (without the text) with its media columns."""
    return read(store(df, text=text))
