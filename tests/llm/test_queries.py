"""Each registered query over a whole table gives the rows of a plain loop, or those of its SQL."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from fringeframe.llm import licenses, media, pii, toxicity
from fringeframe.llm.queries import QUERIES, SQL
from tests.conftest import DATA
from tests.llm.test_scans import base_spans, license_places
from tests.llm.test_tables import filled, grouped, print_of
from tests.llm.test_tokens import plain_features

SF = str(DATA / "sf0.001")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    found = {r[0]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_toxicity(spark, texts):
    got = run(spark, "op1_toxicity")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learnt = [(labels[k], toxicity.features(r.text)) for k, r in texts.items() if labels.get(k) in (0, 1) and r.text is not None and zlib.crc32(str(k).encode()) % 5]
    model = toxicity.train(lambda: iter(learnt))
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert r.score == pytest.approx(model.score(texts[k].text), abs=1e-5) and r.predicted == int(r.score >= 0.5)


def test_bpe(spark, texts):
    tiktoken = pytest.importorskip("tiktoken")
    from fringeframe.llm.bpe import read_ranks

    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = run(spark, "op2_bpe")
    assert set(got) == set(texts)
    for k, r in got.items():
        ids = whole.encode_ordinary(texts[k].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[k].text or "").encode()).hexdigest()


def test_mixing_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.execute(SQL["op3_mixing"]).fetchall()}
    got = run(spark, "op3_mixing")
    assert set(got) == set(want)
    for k, r in got.items():
        assert (r["size"], r.source_size, r.taken) == (want[k][0], want[k][1], want[k][3]) and r.target == pytest.approx(want[k][2])


def test_mixing_targets(spark, texts):
    got, sizes = run(spark, "op3_mixing"), {}
    for r in texts.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, filled([sizes[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    for k, r in got.items():
        assert r.target == pytest.approx(want[texts[k].source]) and r.source_size == sizes[texts[k].source]


def test_pii(spark, texts):
    got = run(spark, "op4_pii")
    assert set(got) == set(texts)
    for k, r in got.items():
        base, spans = base_spans(texts[k].text or ""), pii.find(texts[k].text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x == kind for x, _, _ in base) for kind in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{x}:{a}:{b}" for x, a, b in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans) and r.scores == ",".join(f"{s.score:.2f}" for s in spans)


def test_simhash(spark, texts):
    got, prints = run(spark, "op5_simhash"), {k: print_of(r.text) for k, r in texts.items()}
    keys = sorted(prints)
    want = grouped(keys, [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", want[k]) for k in keys}


def test_token_files(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, at = run(spark, "op6_token_files"), 0
    assert set(got) == set(texts)
    for k in sorted(texts):
        ids = whole.encode(texts[k].text or "", add_special_tokens=False).ids + [2]
        assert tuple(got[k][1:4]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_licenses(spark, texts):
    """Base columns by the contract's words; labels and score by trying every rule on every place, whatever its keyword."""
    got = run(spark, "op7_licenses")
    assert set(got) == set(texts)
    for k, r in got.items():
        n, places = license_places(texts[k].text or "")
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        line = b" " + b" ".join((texts[k].text or "").encode().translate(licenses.WORDS).split()) + b" "
        turned, kept = [m.span() for m in licenses.negations().finditer(line)], []
        for rule in licenses.rules():
            spans = [m.span() for m in rule.pattern.finditer(line)]
            kept += [(rule, *s) for s in spans if rule.fixed or not any(a <= s[0] and s[1] <= b for _, a, b in kept)]
        negated = [any(a <= s <= b + 1 for a, b in turned) for _, s, _ in kept]
        left = [(rule, 0.1 if no else rule.score) for (rule, _, _), no in zip(kept, negated, strict=True) if rule.fixed or not no]
        assert r.labels == ",".join(sorted({rule.label for rule, _ in left})) and r.score == max((x for _, x in left), default=0.0)


def test_sharding(spark, texts):
    got = run(spark, "op8_sharding")
    assert set(got) == set(texts)
    counts = np.bincount([r.shard for r in got.values()], minlength=8)
    assert counts.max() - counts.min() <= 1
    for s in range(8):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(counts[s]))
    for k, r in got.items():
        raw = (texts[k].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_embedding_dedup(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    keys = sorted(rows)
    x = np.array([rows[k] for k in keys], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    want = grouped(keys, [(keys[a], keys[b]) for a, b in np.argwhere(np.triu(close))])
    got = run(spark, "op9_embedding_dedup")
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (int(close[i].sum()), want[k], want[k] == k) for i, k in enumerate(keys)}


def test_media(spark, texts):
    got = run(spark, "op10_media")
    assert set(got) == set(texts)
    for k, r in got.items():
        data, raw = media.payload(texts[k].text), (texts[k].text or "").encode()
        picture = media.to_png(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(picture), hashlib.sha256(picture).hexdigest())
        assert r.feature == f"png=64x{len(data) // 64}x8;{plain_features(data)}"


def test_all_queries_are_tested_here_in_test_tables_or_in_test_counts_trie_audit():
    assert set(QUERIES) == {"op11_token_counts", "op12_prefix_trie", "op13_filter_audit", "op1_toxicity", "op2_bpe", "op3_mixing", "op4_pii", "op5_simhash", "op6_token_files", "op7_licenses", "op8_sharding", "op9_embedding_dedup", "op10_media", "pipeline"}
