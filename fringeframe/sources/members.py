"""Arrays inside npz archives and FITS files, read by byte ranges: a slice of rows costs its own bytes and a header."""

from __future__ import annotations

import io
import logging
import math
import struct
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyarrow import fs

logger = logging.getLogger(__name__)

#: FITS headers and data come in blocks of this many bytes; BITPIX to NumPy.
FITS_BLOCK = 2880
FITS_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: An array stored rows-outermost that is larger than this can't be read by channels without a warning.
TURNED_BYTES = 256 << 20
#: Bytes that hold the header of an array of numbers, and the fixed part of a file header in an archive.
NPY_HEAD, ZIP_HEAD = 512, 30


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for a URI or a local path."""
    if path.startswith("/"):
        path = "file://" + path
    return fs.FileSystem.from_uri(path)


class Ranged:
    """A file of which ranges are read; ``taken`` counts the bytes."""

    def __init__(self, f, size: int):
        self.f, self.size, self.taken = f, size, 0

    def read_at(self, size: int, at: int) -> bytes:
        raw = self.f.read_at(min(size, self.size - at), at)
        self.taken += len(raw)
        return bytes(raw)


class Cursor(io.RawIOBase):
    """A ``Ranged`` file with a position, for readers that seek."""

    def __init__(self, ranged: Ranged):
        self.ranged, self.at = ranged, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.ranged.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        raw = self.ranged.read_at(len(buffer), self.at)
        buffer[: len(raw)] = raw
        self.at += len(raw)
        return len(raw)


@contextmanager
def opened(path: str) -> Iterator[Ranged]:
    files, p = place(path)
    with files.open_input_file(p) as f:
        yield Ranged(f, f.size())


@dataclass
class Member:
    """One array: its bytes start at ``at`` of the file, or it is the deflated member ``name`` of an archive (``at`` is None)."""

    name: str
    shape: tuple[int, ...]
    kind: np.dtype
    at: int | None
    turned: bool = False
    scale: float = 1.0
    zero: float = 0.0

    @property
    def bytes(self) -> int:
        return math.prod(self.shape) * self.kind.itemsize

    def natural(self, a: np.ndarray) -> np.ndarray:
        a = a.astype(self.kind.newbyteorder("="), copy=False)
        return a if (self.scale, self.zero) == (1.0, 0.0) else a * self.scale + self.zero

    def flat(self, f: Ranged, first: int, n: int) -> np.ndarray:
        return np.frombuffer(f.read_at(n * self.kind.itemsize, self.at + first * self.kind.itemsize), self.kind)

    def rows(self, f: Ranged, first: int, stop: int, lead: tuple[int, ...] = ()) -> np.ndarray:
        """Entries first to stop of the axis behind the fixed ``lead`` ones, which cost their own bytes.

        An array that is stored with its first axis innermost costs those rows of all channels; with more axes it is read whole.
        """
        if not self.turned or len(self.shape) == 1:
            inner = math.prod(self.shape[len(lead) + 1 :])
            start = 0
            for n, k in zip(self.shape, lead, strict=False):
                start = start * n + k
            start = (start * self.shape[len(lead)] + first) * inner
            return self.natural(self.flat(f, start, (stop - first) * inner).reshape(-1, *self.shape[len(lead) + 1 :]))
        if len(self.shape) == 2 and lead:
            return self.natural(self.flat(f, first * self.shape[0], (stop - first) * self.shape[0]).reshape(-1, self.shape[0])[:, lead[0]])
        if len(self.shape) == 2:
            return self.natural(np.stack([self.flat(f, k * self.shape[0] + first, stop - first) for k in range(self.shape[1])], axis=1))
        if self.bytes > TURNED_BYTES:
            logger.warning("%s has its rows outermost and is read whole (%.0f MB); store it in C order", self.name, self.bytes / 1e6)
        return self.natural(self.flat(f, 0, math.prod(self.shape)).reshape(self.shape, order="F"))[(*lead, slice(first, stop))]

    def whole(self, f: Ranged) -> np.ndarray:
        """All of a small array, deflated or not."""
        if self.at is None:
            with zipfile.ZipFile(Cursor(f)) as z:
                return np.lib.format.read_array(io.BytesIO(z.read(self.name)), allow_pickle=False)
        return self.natural(self.flat(f, 0, math.prod(self.shape)).reshape(self.shape, order="F" if self.turned else "C"))

    def blocks(self, f: Ranged) -> Iterator[np.ndarray]:
        """The entries of the first axis one after the other, from one pass over the member."""
        if self.at is not None:
            for k in range(self.shape[0]):
                yield self.rows(f, 0, self.shape[1], (k,)) if len(self.shape) > 1 else self.rows(f, k, k + 1)[0]
            return
        with zipfile.ZipFile(Cursor(f)) as z, z.open(self.name) as raw:
            npy_head(raw)
            if self.turned and len(self.shape) > 1:
                if self.bytes > TURNED_BYTES:
                    logger.warning("%s has its rows outermost and is held whole (%.0f MB); store it in C order", self.name, self.bytes / 1e6)
                yield from self.natural(np.frombuffer(raw.read(), self.kind).reshape(self.shape, order="F"))
                return
            size = self.bytes // max(1, self.shape[0])
            for _ in range(self.shape[0]):
                part = raw.read(size)
                if len(part) < size:
                    raise EOFError(f"{self.name} ends early")
                yield self.natural(np.frombuffer(part, self.kind).reshape(self.shape[1:]))


def npy_head(raw) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether the first axis is innermost, and type from the start of an array's stream."""
    version = np.lib.format.read_magic(raw)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, turned, kind = read(raw)
    return tuple(map(int, shape)), turned, kind


def npz_members(f: Ranged) -> dict[str, Member]:
    """The arrays of an archive by name; only the directory and the headers are read."""
    out = {}
    with zipfile.ZipFile(Cursor(f)) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if info.compress_type != zipfile.ZIP_STORED:
                with z.open(info) as raw:
                    shape, turned, kind = npy_head(raw)
                out[name] = Member(info.filename, shape, kind, None, turned)
                continue
            fixed = f.read_at(ZIP_HEAD, info.header_offset)
            at = info.header_offset + ZIP_HEAD + sum(struct.unpack_from("<HH", fixed, 26))
            head = io.BytesIO(f.read_at(min(NPY_HEAD, info.file_size), at))
            shape, turned, kind = npy_head(head)
            out[name] = Member(info.filename, shape, kind, at + head.tell(), turned)
    return out


def fits_header(f: Ranged) -> tuple[dict[str, object], int]:
    """Cards of the primary header and where its data start, read a block at a time."""
    header: dict[str, object] = {}
    at = 0
    while True:
        block = f.read_at(FITS_BLOCK, at).decode("ascii")
        if len(block) < FITS_BLOCK:
            raise ValueError("a FITS header without an end")
        at += FITS_BLOCK
        for k in range(0, FITS_BLOCK, 80):
            card = block[k : k + 80]
            key = card[:8].strip()
            if key == "END":
                return header, at
            if card[8:10] == "= ":
                text = card[10:].strip()
                if text.startswith("'"):
                    header[key] = text[1 : text.index("'", 1)].strip()
                else:
                    value = text.split("/")[0].strip()
                    header[key] = value == "T" if value in ("T", "F") else float(value) if set(value) & set(".E") else int(value)


def fits_member(f: Ranged, name: str = "") -> Member:
    """The primary image of a FITS file."""
    header, at = fits_header(f)
    shape = tuple(int(header[f"NAXIS{k}"]) for k in range(int(header["NAXIS"]), 0, -1))
    return Member(name, shape, np.dtype(FITS_KINDS[int(header["BITPIX"])]), at, False, float(header.get("BSCALE", 1)), float(header.get("BZERO", 0)))
