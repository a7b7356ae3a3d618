"""Mixing, sharding, near-duplicates and the pipeline against plain loops."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fringeframe.llm import embeddings, jaccard, mixing, sharding, simhash
from fringeframe.llm.components import connected_components
from tests.llm.conftest import ROWS


def filled(sizes, weights):
    """Targets by handing the excess on, round by round."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), [s > 0 for s in sizes]
    left = float(total)
    while any(open_) and left > 1e-9:
        unit = left / sum(w for w, o in zip(weights, open_, strict=True) if o)
        left = 0.0
        for k, s in enumerate(sizes):
            if open_[k]:
                target[k] += unit * weights[k]
                if target[k] >= 3 * s:
                    left += target[k] - 3 * s
                    target[k], open_[k] = 3.0 * s, False
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_the_loop(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, 5, 100, 2000]) for _ in range(draw.randint(1, 12))]
    if not sum(sizes):
        sizes[0] = 3
    df = spark.createDataFrame([(f"s{k:02d}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))])
    assert np.allclose([got[f"s{k:02d}"] for k in range(len(sizes))], want)


def test_mix_of_odd_rows(spark, docs, empty):
    rows = mixing.mix(docs.selectExpr("*", "7 as Size", "'x' as target")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r.copies <= 3
    again = {(r.doc_id, r.text): r.copies for r in mixing.mix(docs.repartition(2)).collect()}
    assert all(again[(r.doc_id, r.text)] == r.copies for r in rows)
    assert mixing.mix(empty).count() == 0
    emitted = mixing.emit(mixing.mix(docs)).count()
    assert emitted == sum(r.copies for r in rows)


def test_mix_hits_targets(spark):
    draw = random.Random(1)
    data = [(k, " ".join(["w"] * draw.randint(1, 50)), "a" if k % 3 else "b") for k in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.05


def test_shards(spark, docs, empty):
    rows = sharding.assign(docs.selectExpr("*", "'x' as Shard", "1 as b")).collect()
    assert len(rows) == len(ROWS) and rows[0].asDict()["b"] == 1
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.max() - counts.min() <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
    assert sharding.assign(empty).count() == 0


def test_shards_are_shuffled_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(df).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(df.repartition(7)).collect()}
    assert a == b
    order = [d for d, _ in sorted(a.items(), key=lambda x: x[1])]
    assert abs(np.corrcoef(order, range(5000))[0, 1]) < 0.05


def print_of(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def grouped(keys, linked):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


def test_fingerprints(docs):
    for _, text, *_ in ROWS:
        assert simhash.fingerprint(text) == print_of(text)


def test_kernel_counts_bits():
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 2**63, 200, dtype=np.uint64)
    for k in range(100, 200):
        flips = draw.choice(64, draw.integers(0, 8), replace=False)
        prints[k] = prints[k - 100] ^ np.uint64(sum(1 << int(b) for b in flips))
    for radius in range(8):
        labels = simhash.link_units(np.zeros(200, int), np.zeros(200, int), prints, radius)
        pairs = [(a, b) for a in range(200) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= radius]
        want = grouped(range(200), pairs)
        assert labels.tolist() == [want[k] for k in range(200)]


@pytest.mark.parametrize("part", [simhash.PART_ROWS, 8])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    draw = random.Random(6)
    base = [draw.getrandbits(64) for _ in range(30)]
    rows = []
    for k in range(400):
        x = draw.choice(base)
        for b in draw.sample(range(64), draw.choice([0, 1, 2, 3])):
            x ^= 1 << b
        rows.append((k, x - (1 << 64) if x >> 63 else x))
    known = spark.createDataFrame(rows, "doc long, print long").repartition(5)
    got = {r.print: r.component for r in simhash.classes(known).collect()}
    pairs = [(a, c) for a, x in rows for c, y in rows if a < c and ((x ^ y) & (2**64 - 1)).bit_count() <= 4]
    want = grouped([k for k, _ in rows], pairs)
    assert {k: got[x] for k, x in rows} == want


@pytest.mark.parametrize("kept", [1, 2, 3])
def test_tables_share_a_key_within_the_radius(kept):
    draw = random.Random(kept)
    masks = simhash.tables(4 + kept, kept)
    for _ in range(500):
        x = draw.getrandbits(64)
        y = x
        for b in draw.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_dedup_of_odd_rows(spark, docs, empty):
    rows = simhash.dedup(docs.selectExpr("*", "'c' as Component_ID")).collect()
    assert len(rows) == len(ROWS)
    keys = [r[0] for r in ROWS if r[0] is not None]
    prints = {r[0]: print_of(r[1]) for r in ROWS}
    want = grouped(set(keys), [(a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert all(r.component_id == want.get(r.doc_id) for r in rows)
    assert simhash.dedup(empty).count() == 0 and simhash.digests(empty).count() == 0


def test_components_of_chains_hubs_and_loops(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (150, 90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = grouped({x for p in links for x in p if x is not None and x != 200}, [p for p in links if None not in p and p[0] != p[1]])
    assert got == want


@pytest.mark.parametrize("part", [embeddings.PART_ROWS, 16])
def test_embedding_links_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART_ROWS", part)
    draw = np.random.default_rng(8)
    base = draw.normal(size=(60, 16))
    m = base[draw.integers(0, 60, 300)] + draw.normal(size=(300, 16)) * 0.12
    m[5] = m[6] = m[7]
    m[8] = m[7] * 3.5
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(m)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, []), (1005, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    x = np.array([r[1] for r in rows[:300]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    found = np.array([got[k].n_links for k in range(300)])
    assert (found <= close.sum(1)).all() and found.sum() >= 0.98 * close.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(1000, 1006))
    want = grouped(range(300), np.argwhere(close).tolist())
    assert np.mean([got[k].component_id == want[k] for k in range(300)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return a == b or (bool(a and b) and 5 * len(a & b) >= 4 * len(a | b))


def edited_copies():
    """(doc_id, text): texts of 60 to 500 words, each with copies of one to some edited words, and unrelated ones."""
    draw, rows = random.Random(9), []
    for k in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([60, 100, 200, 500]))]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, draw.randint(2, 6)):
            own = list(words)
            for _ in range(draw.randint(1, max(1, len(own) // 60))):
                own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
            rows.append((10 * k + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("part", [jaccard.PART_ROWS, 2])
def test_pipeline_drops_edited_copies_like_all_pairs(spark, monkeypatch, part):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(jaccard, "PART_ROWS", part)
    rows = edited_copies()
    sets = {k: shingle_set(t) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    far = sum((simhash.fingerprint(dict(rows)[a], 5) ^ simhash.fingerprint(dict(rows)[b], 5)).bit_count() > 4 for a, b in pairs)
    assert far > 20
    want = grouped(list(sets), pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.dedup(docs).collect()} == want
    assert sorted(r.doc_id for r in pipeline.drop_copies(spark, docs, "").collect()) == sorted(k for k in want if want[k] == k)


def test_jaccard_of_odd_rows(spark, docs, empty):
    rows = jaccard.dedup(docs.selectExpr("*", "'c' as Component_ID")).collect()
    assert len(rows) == len(ROWS)
    sets = {r[0]: shingle_set(r[1]) for r in ROWS if r[0] is not None}
    want = grouped(list(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert all(r.component_id == want.get(r.doc_id) for r in rows)
    assert jaccard.dedup(empty).count() == 0


def test_pipeline_keeps_one_row_of_each_text_group(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, b), (None, c), (None, c), (9, d), (9, d), (None, d), (3, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [(r.doc_id, r.text) for r in pipeline.drop_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (None, c), (9, d), (2, "")], key=str)


def test_pipeline_equals_plain_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from fringeframe.llm import pii, toxicity

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) < 0.5]
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    keys = sorted(sets)
    group = grouped(keys, [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if alike(sets[a], sets[b])])
    rows = [r.asDict() for r in rows if group[r.doc_id] == r.doc_id]
    for r in rows:
        r["text"] = pii.mask(r["text"], pii.find(r["text"]))
    sizes = {}
    for r in rows:
        r["size"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes)
    targets = dict(zip(names, filled([sizes[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    import hashlib

    want = {}
    for r in rows:
        rate = targets[r["source"]] / sizes[r["source"]]
        mark = int(hashlib.md5(f"mix:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:8], 16) / 2**32
        copies = int(rate) + (mark < rate - int(rate))
        if copies:
            want[r["doc_id"]] = (copies, hashlib.sha256(r["text"].encode()).hexdigest())
    got = {}
    for r in pipeline.run(spark, path).collect():
        n = got.get(r.doc_id, (0, ""))[0]
        got[r.doc_id] = (n + 1, r.decoded_sha256)
    assert got == want


#: Columns whose names operators give to their results or use on the way, with values of their own.
CLASHES = ("size", "component_id", "score", "predicted", "held_out", "target", "copies", "source_size", "simhash", "pii_spans", "pii_masked", "row", "words", "node", "keys", "mix_source", "doc", "sketch__", "first", "absent")


def test_pipeline_stages_keep_clashing_columns(spark, docs):
    """Values of columns named like results come out of all stages as they went in; the last stage keeps them too."""
    pipeline = pytest.importorskip("corpus_pipeline")
    extra = [F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES]
    given = docs.withColumn("n_chars", F.length("text").cast("long")).select("*", *extra)
    labels = spark.createDataFrame([(k, int(k == 3)) for k in range(1, 16)], "doc_id long, toxic int")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    labels.write.parquet(f"{folder}/labels.parquet")
    before = given
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, folder)
        if name != "bpe":
            assert after.columns == given.columns, name
        rows = after.collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in CLASHES), name
        before = after
    assert stage(spark, before.limit(0).withColumn("text", F.lit("")), folder).count() == 0


def test_pipeline_stages_of_an_empty_table(spark, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0, name


def test_embedding_links_are_exact_with_the_whole_margin(spark):
    draw = np.random.default_rng(11)
    base = draw.normal(size=(80, 12))
    m = base[draw.integers(0, 80, 1500)] + draw.normal(size=(1500, 12)) * draw.uniform(0.05, 0.5, (1500, 1))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    x = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, share=1.0, cell_rows=50).collect()}
    assert [got[k].n_links for k in range(1500)] == close.sum(1).tolist()
    want = grouped(range(1500), np.argwhere(np.triu(close)).tolist())
    assert {k: got[k].component_id for k in range(1500)} == want
    some = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, cell_rows=50).collect()}
    assert sum(some.values()) >= 0.97 * close.sum() and all(some[k] <= got[k].n_links for k in some)


def test_embeddings_of_several_lengths_and_repeated_keys(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0]), (5, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (6, [1e-300, 0.0]), (7, [1e300, 1e300])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 3), (4, 2, 3), (5, 0, 5), (5, 2, 3), (6, 2, 1), (7, 0, 7)]


@pytest.mark.parametrize("few", [0, 10])
def test_equal_vectors_are_one_node_by_broadcast_or_shuffle(spark, monkeypatch, few):
    monkeypatch.setattr(embeddings, "BROADCAST_ROWS", few)
    rows = [(k, [1.0, 0.0, float(k % 3 == 0)]) for k in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {k: (19, 0) if k % 3 == 0 else (39, 1) for k in range(60)}


def test_simhash_rows_without_a_key(spark):
    text = "one two three four five six"
    rows = [(3, text), (None, text), (None, "quite another text of words"), (1, text), (1, "quite another text of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.fingerprint, r.component_id or 0) for r in simhash.digests(df).collect())
    want = sorted(((k or 0), f"{print_of(t):016x}", 0 if k is None else 1) for k, t in rows)
    assert got == want


@pytest.mark.parametrize("slab_rows", [1, 7, 1000])
def test_running_sums_by_slabs(spark, slab_rows):
    from fringeframe.llm.common import running

    draw = random.Random(3)
    rows = [(k, draw.choice([None, "a", "b"]), draw.randrange(100)) for k in range(50)]
    df = spark.createDataFrame(rows, "k long, s string, v long").repartition(5)
    got = {r.k: (r.n, r.before) for r in running(df, [F.col("s").isNull(), F.col("s"), F.col("k")], {"n": F.lit(1), "before": F.col("v")}, slab_rows).collect()}
    order, total = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0])), 0
    for i, (k, _, v) in enumerate(order):
        assert got[k] == (i, total)
        total += v


def test_written_shards_hold_every_row_in_order(spark, docs):
    folder = sharding.write_shards(docs.select("*", F.lit(1).alias("Slot")), shards=4, bucket_bytes=1000)
    rows = spark.read.parquet(folder).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    counts = np.bincount([r.shard for r in rows], minlength=4)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s])) for s in range(4))


def test_shards_split_a_common_key_by_its_texts(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    placed = sharding.assign(df)
    order = [int(r.text) for r in placed.orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(4000)) and abs(np.corrcoef(order, range(4000))[0, 1]) < 0.06


def test_mix_draws_for_each_row_of_a_common_key(spark):
    data = [(None, f"w{k} " * 5, "a" if k % 4 else "b") for k in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.1


def odd_columns(df, names):
    """``df`` with a column of each name, all of one value, and a map column."""
    return df.selectExpr("*", *(f"'kept' as `{n}`" for n in names), "map('k', doc_id) as `a.map`", "named_struct('m', map(1, text)) as nested")


def applied():
    """Operators with the names that they use inside, and how to run them on documents."""
    import public_tokenizers

    from fringeframe.llm import bpe, filter_audit, licenses, media, pii, token_counts, toxicity

    ranks, words = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    yield "toxicity", lambda df: toxicity.score(df, toxicity.fit(df, df.sparkSession.createDataFrame([(1, 1), (2, 0), (5, 1), (7, 0)], "doc_id long, toxic int"))), ["toxicity__", "features", "model", "key", "word"]
    yield "bpe", lambda df: bpe.encode(df, ranks, public_tokenizers.PATTERN), ["bpe__", "bpe___", "ids"]
    yield "mixing", mixing.mix, ["mix_key", "mix_total", "mix_target", "mix_source", "mix_mark_a", "mix_mark_b", "mix_turn", "rank", "weight", "limit", "level", "d", "b", "n", "part__", "rank__"]
    yield "emit", lambda df: mixing.emit(mixing.mix(df)), ["mix_key", "mix_turn"]
    yield "pii", pii.scan, ["pii__", "spans"]
    yield "simhash", simhash.dedup, ["doc", "component__", "simhash__", "simhash_doc__", "print", "component", "node"]
    yield "jaccard", jaccard.dedup, ["doc", "doc__", "component__", "words", "component", "node", "sketch__"]
    yield "survivors", jaccard.survivors, ["doc", "absent", "words", "row", "first", "component"]
    yield "licenses", licenses.scan, ["license__", "found", "n_words"]
    yield "sharding", sharding.assign, [f"shard_{n}" for n in ("bucket", "place", "mark", "both", "number", "b", "base", "places")] + ["b", "n", "base", "shard__b", "shard__base", "shard__places", "slab__", "part__", "rank__", "d"]
    yield "media", lambda df: media.with_media(df), ["media__text", "uri", "digest", "offset"]
    yield "counts", lambda df: token_counts.count(df, words), ["text_to_count", "text_to_count_"]


@pytest.mark.parametrize("name", ["toxicity", "bpe", "mixing", "emit", "pii", "simhash", "jaccard", "survivors", "licenses", "sharding", "media", "counts"])
def test_inner_names_and_maps_pass(spark, docs, name):
    """A column of every name that an operator uses inside, a map and a nested map keep their values."""
    pytest.importorskip("public_tokenizers")
    run, inner = next((f, inner) for n, f, inner in applied() if n == name)
    got = run(odd_columns(docs, inner)).collect()
    assert got
    texts = {(k, t) for k, t, *_ in ROWS}
    for r in got:
        assert all(r[c] == "kept" for c in inner), r
        assert r["a.map"] == {"k": r.doc_id} and (r.doc_id, r.nested.m[1]) in texts
    if name not in ("survivors", "emit"):
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", ["drop_toxic", "drop_copies", "mask_personal_data", "mix_sources", "encode_texts"])
def test_stages_pass_inner_names_and_maps(spark, docs, name, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(5, 1, 1), *((k, 1, 0) for k in (1, 2, 3, 7, 8, 9, 12, 13))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    inner = ["row", "doc", "bpe__", "pii__", "pii_masked", "mix_key", "copies", "component", "words", "score", "absent"]
    got = getattr(corpus_pipeline, name)(spark, odd_columns(docs, inner), str(tmp_path)).collect()
    assert got and all(r[c] == "kept" for r in got for c in inner) and all(r["a.map"] == {"k": r.doc_id} for r in got)


def test_equal_rows_are_mixed_to_their_targets(spark):
    """Rows that are equal in key and text draw each for itself, in any partitioning."""
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'one two' as text", "if(id < 2500, 'a', 'b') as source")
    counts = []
    for parts in (3, 11):
        rows = mixing.mix(df.repartition(parts)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()
        assert sorted(r.n for r in rows) == [500, 2500]
        assert all(abs(r.taken / r.target - 1) < 0.12 for r in rows), rows
        counts.append(sum(r.taken for r in rows))
    assert len(counts) == 2
    same = [sorted(r.copies for r in mixing.mix(spark.range(500).selectExpr("7L as doc_id", "'x' as text", "'s' as source").unionByName(spark.createDataFrame([(1, "y " * 1000, "t")], "doc_id long, text string, source string")).repartition(p)).where("doc_id = 7").collect()) for p in (2, 9)]
    assert same[0] == same[1] and len(set(same[0])) > 1


def test_numbers_of_equal_rows(spark):
    from fringeframe.llm.common import numbered

    df = spark.range(1000).selectExpr("if(id % 3 = 0, null, id) as a", "if(id % 3 = 0, 'x', 'y') as `b.c`", "map(1, id) as m").repartition(7)
    rows = numbered(df.withColumn("mark", F.coalesce("a", F.lit(-1))), ["mark"], "k").collect()
    assert sorted(r.k for r in rows if r.a is None) == list(range(334)) and all(r.k == 0 for r in rows if r.a is not None)
    assert sorted(r.m[1] for r in rows) == list(range(1000))
    once = numbered(df.where("a is not null"), ["a"], "k")
    assert once.where("k > 0").count() == 0 and once.count() == 666


def test_equal_rows_are_split_over_buckets(spark):
    """A table of one repeated row is many buckets, and its permutation has no gap."""
    df = spark.range(5000).selectExpr("1L as doc_id", "'same text' as text", "id as n")
    rows = sharding.assign(df, bucket_bytes=500).collect()
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.tolist() == [625] * 8
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(625))
    order = [r.n for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sorted(order) == list(range(5000))


def test_permutation_is_the_plain_one(spark):
    """Places recomputed bucket by bucket: a bucket is a stretch of the permutation, in the order that its shuffled places give."""
    df = spark.range(900).selectExpr("id as doc_id", "concat('t', id % 11) as text")
    rows = sharding.assign(df, shards=3).collect()
    at = {r.doc_id: r.shard * 300 + r.slot for r in rows}
    assert sorted(at.values()) == list(range(900))
    keyed = df.select("doc_id", F.xxhash64(F.col("text"), F.lit(7)).alias("m")).select("doc_id", "m", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "m", F.lit(0).cast("long"), F.lit(7)), F.lit(256)).alias("b"), F.xxhash64(F.col("doc_id").cast("string"), "m", F.lit(0).cast("long"), F.lit(8)).alias("o")).collect()
    start = 0
    for b in range(256):
        own = [r.doc_id for r in sorted((r for r in keyed if r.b == b), key=lambda r: r.o)]
        assert sorted(at[k] for k in own) == list(range(start, start + len(own)))
        start += len(own)
