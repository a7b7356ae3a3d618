"""Token counts, the prefix trie and the filter audit against the library and plain loops."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import pytest

from fringeframe.llm import filter_audit, prefix_trie, token_counts
from fringeframe.llm.queries import QUERIES, SQL
from tests.conftest import DATA
from tests.llm.conftest import ROWS

SF = str(DATA / "sf0.001")
WORDS = r"[^\x20\x09-\x0D]+"
#: Pieces of texts that normalizers, splitters and special tokens treat in ways of their own.
PIECES = ["a", "b", "Word", "é", "é", "́", "̣", " ", "  ", "\n", "'s", "'", "'re", "''ll", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|end", "|>", "中", "文", "한", "가", "ᅡ", "--", "≠", "ß", "İ", "Σ", "ς", "🙂", "...", "'d", "don't", "\x85", "़", "क़", "ﬁ", "Å", "ẛ̣"]


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)


def counter(vocabulary, chunk, overlap):
    with open(vocabulary, "rb") as f:
        return token_counts._counter(f.read(), chunk, overlap)


@pytest.mark.parametrize("seed", range(4))
def test_spliced_counts_are_the_librarys(vocabulary, library, seed):
    draw = random.Random(seed)
    for _ in range(150):
        few = draw.sample(PIECES, draw.randint(1, len(PIECES)))
        text = "".join(draw.choice(few) for _ in range(draw.randint(0, 400)))
        tested = counter(vocabulary, draw.choice([20, 40, 64, 100]), draw.choice([17, 20]))
        assert tested.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)], text


@pytest.mark.parametrize("text", ["x" * 3000, "中文" * 900, "é" * 700, "'" * 999, "<|endoftext|>" * 90, "́" * 500, "ab" * 400 + " end " + "-" * 800, "7" * 1000, " " * 1000])
def test_overlaps_widen_where_no_words_meet(vocabulary, library, text):
    assert counter(vocabulary, 100, 20).counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_chunks_are_bounded_and_spliced(vocabulary, library):
    """A long text is never encoded whole: no call sees more than two chunks."""
    tested, seen = counter(vocabulary, 1000, 50), []
    encode = lambda part: (seen.append(len(part)), tested.coded(part))[1]
    text = " ".join(random.Random(2).choice(["alpha", "Beta's", "12", "gamma--", "<|endoftext|>"]) for _ in range(20_000))
    assert token_counts.spliced(text, encode, tested.margin, 1000, 50) == len(library.encode(text, add_special_tokens=False).ids)
    assert max(seen) <= 1000 and len(seen) > 100


def test_other_tokenizers_encode_whole_texts():
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = files.path("byte_bpe_50k.json")
    text = "It's  a <|endoftext|> text\n\n with 123 " * 40
    assert not counter(path, 50, 20).chunked
    assert counter(path, 50, 20).counts([text, ""]) == [len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids), 0]


def test_counts_of_odd_rows(spark, docs, empty, vocabulary, library):
    odd = docs.selectExpr("*", "map('k', doc_id) as m", "7 as N_Tokens", "'x' as text_to_count", "named_struct('a', 1) as s")
    rows = token_counts.count(odd, vocabulary, limit=5, chunk=1000, overlap=100).collect()
    assert len(rows) == len(ROWS)
    want = sorted((str(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 5) and r.text_to_count == "x" and r.m == {"k": r.doc_id} for r in rows)
    assert token_counts.count(empty, vocabulary).count() == 0


def test_count_query(spark, library):
    got = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(got[r.doc_id][1:]) == (len((r.text or "").encode()), n, n > 2048)


def plain_trie(paths):
    """Nodes of {conversation: list of turns} by walking every prefix."""
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in nodes:
        for d in range(len(p) + 1):
            top = p[:d]
            leaves[top] = leaves.get(top, 0) + (p not in kids)
            saved[top] = saved.get(top, 0) + (len(nodes[p]) - 1) * (len(re.findall(WORDS, p[-1][1])) if p else 0)
    ended = lambda p: ",".join(str(c) for c in sorted(c for c in nodes[p] if len(paths[c]) == len(p)))
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ended(p).encode()).hexdigest()) for p, m in nodes.items())


def of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def in_order(rows):
    """Turns of each conversation as the trie orders them: by turn (null first), role, digest of role and text."""
    def name(role, text):
        parts = "".join(f"{len(x.encode())}:{x}" for x in (role, text))
        h = hashlib.sha256(parts.encode()).hexdigest()
        return int(h[:15], 16), int(h[15:30], 16)

    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", *name(role or "", text or ""), text or ""))
    return {c: [(t[2], t[5]) for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        out[c] = base[:h] + turns[h:]
    return out


def talk(seed):
    """Few words, so that prefixes are shared; nulls, ties, repeated rows, one deep conversation, and many equal ones."""
    draw = random.Random(seed)
    rows = [(draw.choice([None, -21, *range(70)]), draw.choice([None, 0, 1, 2, 3, 3]), draw.choice(["u", "a", None]), draw.choice(["hi there", "hi", "", None, " x y "])) for _ in range(300)]
    rows += [(900, k, "u", f"say {k % 3}") for k in range(150)] + [(901, k, "u", f"say {k % 3}") for k in range(130)]
    rows += [(1000 + k, t, "u", f"again {t}") for k in range(600) for t in range(2)]
    return rows


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_the_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLAB_ROWS", 90)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = talk(seed)
    df = spark.createDataFrame(rows, CONV).repartition(3).selectExpr("*", "1 as place", "'x' as words", "map(1, 2) as na", "0 as slab")
    own = in_order(rows)
    assert of(prefix_trie.prefix_trie(df)) == plain_trie(own)
    assert of(prefix_trie.trie(*prefix_trie.branched(prefix_trie.ranked(prefix_trie.turns(df))))) == plain_trie(rebuilt(own))


def test_trie_of_nothing_and_of_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], CONV)).count() == 0
    # Conversation 1 takes three turns of conversation 0, which isn't there, and has none left of its own.
    left = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    df = spark.createDataFrame([(c, 0, "u", "x") for c in left], CONV)
    assert of(prefix_trie.trie(*prefix_trie.branched(prefix_trie.ranked(prefix_trie.turns(df))))) == plain_trie(rebuilt(in_order([(c, 0, "u", "x") for c in left])))


def test_rounds_are_logarithmic(spark, monkeypatch):
    """A chain of 100 turns takes 7 rounds, each written once."""
    said, cut = [], prefix_trie.cut
    monkeypatch.setattr(prefix_trie, "cut", lambda df: (said.append(1), cut(df))[1])
    chain = spark.range(1, 101).selectExpr("id as na", "0L as nb", "if(id = 1, null, id - 1) as pa", "if(id = 1, null, 0L) as pb", "1L as x")
    got = {r.na: r.x for r in prefix_trie.rolled_up(chain, ["x"], 99).collect()}
    assert got == {k: 101 - k for k in range(1, 101)} and len(said) == 1 + 7


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_filter_audit"])
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        c.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = c.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, SF).select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def plain_audit(docs, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least, rows = {}, []
    for k, text, part in docs:
        if k is not None:
            least[text or ""] = min(k, least.get(text or "", k))
    for k, text, part in docs:
        t = text or ""
        words = re.findall(WORDS, t)
        failed = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least[t]), strict=True) if x}
        rows.append((part or "", failed, k in good, k in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, sums, found = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                found.append([part, order, step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*row[:-1], sums[row[-1]]) for row in found]
    return sorted(out)


def test_audit_equals_the_walk(spark):
    draw = random.Random(5)
    texts = [None, "", "one $ two", "SHOUT LOUD now", " ".join(f"w{k}" for k in range(120)), " ".join(["same"] * 130), "é # " * 60, "word " * 20_000, "A&B " + " ".join(f"v{k % 90}" for k in range(100))]
    docs = [(draw.choice([None, *range(60)]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for _ in range(400)]
    docs += [(7, texts[4], "en")] * 3 + [(None, texts[4], "xx")] * 3
    labels = [(draw.choice([None, *range(80)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5).selectExpr("*", "map(1, 2) as digest", "'x' as part", "1 as words", "2 as key", "0 as quality")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as lang", "1 as n")
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = sorted(tuple(r) for r in filter_audit.audit(filter_audit.cells(df, said)).select(*columns).collect())
    assert got == plain_audit(docs, labels)


def test_audit_of_nothing(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(empty, none)).count() == 0
    one = filter_audit.audit(filter_audit.cells(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), none)).collect()
    assert len(one) == 600 and sum(r.removed for r in one) == 120 and {r.part for r in one} == {""}
