"""Encoders and binary formats: exact round trips and comparison with the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fringeframe.llm import bpe, media, token_files
from tests.llm.conftest import ROWS

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "é", "中", "1", "²", "'s", "'", "!", "_", "​", "　", "İ", "🙂", " the", "\x00", "...", " word,", "Word"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_the_library(codec, library):
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(5000)]
    for text in [*texts, *(r[1] or "" for r in ROWS), "ab" * 20_000]:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_bpe_memory_may_turn_over(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    for text in ["one two three four five six seven eight, nine. ten", "ten nine eight zzqx qqzx zzqx"] * 3:
        assert codec.encode(text) == library.encode_ordinary(text)


def test_other_patterns_are_split_as_they_stand(codec):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"\p{N}{1,3}|[a-z]+|[^a-z0-9]+"
    own = bpe.Codec(codec.ranks, pattern)
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    draw = random.Random(4)
    for _ in range(500):
        text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        assert own.encode(text) == other.encode_ordinary(text), text
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(3000)] + [b""]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(len(keys)))
    assert all(table.slot(f"x{i}".encode()) == -1 for i in range(500))
    assert bpe.PerfectHash([]).slot(b"a") == -1


def test_bpe_columns(spark, docs, empty, library):
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in out.collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(out, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.encode(empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_blocks_round_trip_with_outliers():
    draw = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 1000, 4096):
        for high in (1, 2, 300, 60_000, 2**32 - 1):
            ids = draw.integers(0, high, n).astype(np.uint32)
            ids[draw.random(n) < 0.05] = 2**32 - 1
            raw = token_files.pack(ids)
            assert np.array_equal(token_files.unpack(raw), ids)
            if n > 10:
                assert np.array_equal(token_files.unpack(raw, 5, n - 3), ids[5 : n - 3])


def test_small_ids_pack_small():
    ids = np.arange(10_000, dtype=np.uint32) % 16
    assert len(token_files.pack(ids)) < 10_000


def test_token_files_equal_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    folder, files = token_files.encode_to_files(docs, path)
    got = sorted(token_files.read_back(files).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted([r[0] for r in ROWS], key=lambda k: (k is not None, k or 0))
    at, by_key = 0, {}
    for key, text, *_ in ROWS:
        by_key.setdefault(key, whole.encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        ids = by_key[r.key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_back(token_files.encode_to_files(empty, path)[1]).count() == 0


@pytest.mark.parametrize("read_ids", [1, 100, 1 << 22])
def test_token_files_are_read_by_block_index(spark, docs, monkeypatch, read_ids):
    monkeypatch.setattr(token_files, "SLAB", 2)
    path = public_tokenizers.path("word_bpe_49k.json")
    files = token_files.encode_to_files(docs, path)[1]
    if read_ids == 1:
        files = files.where("n_ids < 2000")
    want = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_back(files).collect())
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_back(files, read_ids).collect()) == want


def test_a_reader_reads_only_the_blocks_it_needs():
    ids = np.random.default_rng(1).integers(0, 50_000, 100_000).astype(np.uint32)
    held = token_files.Held(token_files.pack(ids))
    file, taken = token_files.FileReader(held), []
    file.f = type("Counted", (), {"read_at": lambda self, size, at: taken.append(size) or held.read_at(size, at)})()
    assert np.array_equal(np.concatenate(list(file.ids(70_000, 70_600))), ids[70_000:70_600])
    assert sum(taken) < len(held.raw) / 30


def test_long_words_are_not_remembered():
    own = token_files.Words(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    own.encode(["a" * 5000 + ".", "b" * 100 + " short", "é" * 40])
    assert {b"short", b"."} <= set(own.known) and max(map(len, own.known)) <= token_files.LONGEST


def test_memory_of_words_may_turn_over(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_files, "MEMORY", 5)
    monkeypatch.setattr(token_files, "WINDOW", 64)
    whole, own = tokenizers.Tokenizer.from_file(path), token_files.Words(open(path, "rb").read())
    draw = random.Random(9)
    texts = [" ".join(f"word{draw.randrange(40)}" for _ in range(draw.randint(0, 60))) for _ in range(300)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_tokenizers_of_other_kinds_encode_whole_texts():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = tokenizers.Tokenizer.from_file(path), token_files.Words(open(path, "rb").read())
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(300)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_words_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = tokenizers.Tokenizer.from_file(path), token_files.Words(open(path, "rb").read())
    draw = random.Random(7)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    letters = [chr(c) for c in range(0x24F) if chr(c).isalpha()]
    texts += [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 8))) + draw.choice(["", ".", ","]) for _ in range(20)) for _ in range(500)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_pictures_round_trip():
    for text in (None, "", "a", "x" * 64, "x" * 65, "é\x00"):
        data = media.payload(text)
        assert len(data) % 64 == 0 and len(data) and data.startswith((text or "").encode())
        picture = media.to_png(data)
        assert media.from_png(picture) == data
        assert media.png_header(picture[: media.HEADER])["height"] == len(data) // 64


def test_media_columns(spark, docs, empty, monkeypatch):
    rows = media.with_media(docs).collect()
    text = {r[0]: r[1] for r in ROWS}
    assert len(rows) == len(ROWS)
    for r in rows:
        data = media.payload(text[r.doc_id])
        assert r.payload_sha256 == r.media_digest == hashlib.sha256(data).hexdigest()
        assert (r.payload_bytes, r.tail_crc32, r.media_bytes_unpadded) == (len(data), zlib.crc32(data[-64:]), len((text[r.doc_id] or "").encode()))
    same = [(r.media_length, r.media_sha256, r.media_feature) for r in rows if r.doc_id in (1, 2)]
    assert same[0] == same[1]
    assert media.with_media(empty).count() == 0


def plain_features(data):
    n, mean = len(data), sum(data) / len(data)
    spread = (max(0.0, sum(x * x for x in data) / n - mean * mean)) ** 0.5
    quarters = [sum(64 * q <= x < 64 * (q + 1) for x in data) / n for q in range(4)]
    return f"mean={mean:.4f};spread={spread:.4f};zero={sum(x == 0 for x in data) / n:.4f};quarters=" + "/".join(f"{q:.4f}" for q in quarters)


@pytest.mark.parametrize("members", [2, 1 << 18])
def test_media_results_equal_a_plain_loop_and_replace_inputs(spark, docs, monkeypatch, members):
    import struct

    monkeypatch.setattr(media, "SHARD_MEMBERS", members)
    given = docs.selectExpr("*", "'x' as Payload_Bytes", "'y' as media_uri", "'z' as media_width")
    out = media.with_media(given)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    text = {r[0]: r[1] for r in ROWS}
    for r in out.collect():
        data = media.payload(text[r.doc_id])
        rows = b"".join(b"\x00" + data[k : k + 64] for k in range(0, len(data), 64))
        picture = b"\x89PNG\r\n\x1a\n"
        for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", 64, len(data) // 64, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows, 1)), (b"IEND", b"")):
            picture += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        assert (r.media_length, r.media_sha256) == (len(picture), hashlib.sha256(picture).hexdigest())
        assert (r.media_width, r.media_height, r.media_depth, r.payload_bytes) == (64, len(data) // 64, 8, len(data))
        assert r.media_feature == plain_features(data)


def test_shards_are_tar_files(spark, docs):
    import io
    import tarfile

    from fringeframe.llm.storage import opened

    rows = media.store(docs).collect()
    for uri in {r.media_uri for r in rows}:
        with opened(uri) as f:
            names = tarfile.open(fileobj=io.BytesIO(f.read())).getnames()
        own = [r.media_digest for r in rows if r.media_uri == uri]
        assert sorted(names) == sorted({f"{d}.png" for d in own})
