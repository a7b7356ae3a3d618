"""Toxicity, personal data and license scans against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fringeframe.llm import licenses, pii, toxicity
from tests.llm.conftest import by_id

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def base_spans(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(PHONE, text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def own_base(text):
    return [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE]


def test_pii_base_spans_of_random_texts():
    draw = random.Random(3)
    parts = ["a", "b@", "@", ".", "c.d", "-", " ", "1", "12", "255", "256", "4111 1111 1111 1111", "+", "(", ")", "0", "é", "\n", "49", "_%"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert own_base(text) == base_spans(text), text


def test_pii_long_runs_stay_linear():
    for text in ("1" * 300_000, "a." * 150_000, "a" * 300_000 + "@", "@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        pii.find(text)


def test_pii_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    spans = pii.find("my iban is GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789; part model 123-45-6789")
    assert [s.kind for s in spans] == ["iban", "ssn"]
    assert pii.mask("a b@c.de f", pii.find("a b@c.de f")) == "a <EMAIL> f"


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NO93 8601 1117 947", "NL91ABNA0417164300", "MT84MALT011000012345MTLCAST001S"])
@pytest.mark.parametrize("after", ["", " The bank", " 2024-01-01", " EUR 50", " BIC COBADEFF", "\nDE", ", x", "."])
def test_pii_ibans_whatever_follows(iban, after):
    text = f"IBAN {iban}{after}"
    assert [(s.start, s.end) for s in pii.find(text) if s.kind == "iban"] == [(5, 5 + len(iban))]
    assert "<IBAN>" + after in pii.mask(text, [s for s in pii.find(text) if s.kind == "iban"])
    assert not [s for s in pii.find(f"IBAN {iban[:-1]}{'0' if iban[-1] != '0' else '1'}{after}") if s.kind == "iban"]


def test_pii_two_ibans_in_a_row():
    assert [(s.kind, s.start) for s in pii.find("DE89370400440532013000 GB82WEST12345698765432 X") if s.kind == "iban"] == [("iban", 0), ("iban", 23)]


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("SSN of the department head: 123-45-6789", 1),
        ("the party gave 123-45-6789", 1),
        ("in particular 123-45-6789", 1),
        ("remodelled 123-45-6789", 1),
        ("part of the file, SSN 123-45-6789", 1),
        ("the counterpart" + "." * 36 + "123-45-6789", 1),
        ("part 123-45-6789", 0),
        ("Models: 123-45-6789, 123-45-6780", 0),
        ("SSNs of model citizens: 123-45-6789, 123-45-6780", 2),
        ("ssn 123-45-6789; part 123-45-6789", 1),
    ],
)
def test_pii_context_is_whole_words(text, kept):
    assert [s.kind for s in pii.find(text)] == ["ssn"] * kept


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("we ship to 10.1.2.3", 0.6),
        ("the hotel +49 170 1234567", 0.6),
        ("she did call nobody. +49 170 1234567", 0.75),
        ("release version 10.1.2.3", 0.3),
        ("10.1.2.3 is the host address", 0.75),
        ("10.1.2.3. The server", 0.6),
        ("4111 1111 1111 1111 (visa)", 0.95),
        ("a@b.com", 0.8),
    ],
)
def test_pii_context_of_both_sides(text, score):
    (span,) = pii.find(text)
    assert span.score == pytest.approx(score)


def test_pii_mask_leaves_unlikely_spans():
    for text, masked in (("release version 10.1.2.3", "release version 10.1.2.3"), ("host 10.1.2.3 up", "host <IP> up")):
        assert pii.mask(text, pii.find(text)) == masked


def test_pii_query_columns(docs, empty):
    rows = [r for r in pii.scan(docs).collect()]
    assert len(rows) == docs.count()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in pii.BASE] == base_spans(r.text or "")
        assert (r.pii_masked is None) == (r.text is None)
    assert pii.scan(empty).count() == 0


def license_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_license_places_of_random_texts():
    draw = random.Random(4)
    parts = "under the mit license MIT License apache version 2 cc by nc CC-BY-NC, é x ; 0 under-the".split(" ")
    for _ in range(3000):
        text = draw.choice([" ", "-", "\n"]).join(draw.choice(parts) for _ in range(draw.randint(0, 20)))
        n, found = licenses.detect(text)
        assert (n, sorted((d.first, d.label) for d in found if d.fixed)) == license_places(text), text


def test_license_rules_are_ordered_and_suppress():
    assert len(licenses.rules()) >= 200
    priorities = [r.priority for r in licenses.rules()]
    assert priorities == sorted(priorities)
    labels = [d.label for d in licenses.detect("licensed under the GNU General Public License version 3")[1]]
    assert labels == ["gpl-3"]
    nc = [d.label for d in licenses.detect("licensed under creative commons attribution noncommercial sharealike 4.0")[1]]
    assert nc == ["cc-by-nc-sa"]


IDENTIFIERS = {
    "GPL-2.0-only": "gpl-2", "GPL-2.0-or-later": "gpl-2-or-later", "GPL-3.0-only": "gpl-3", "GPL-3.0-or-later": "gpl-3-or-later", "LGPL-2.0": "lgpl-2", "LGPL-2.1": "lgpl-2.1", "LGPL-2.1-or-later": "lgpl-2.1-or-later",
    "LGPL-3.0-only": "lgpl-3", "LGPL-3.0-or-later": "lgpl-3-or-later", "AGPL-3.0": "agpl-3", "AGPL-3.0-or-later": "agpl-3-or-later", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2", "EPL-1.0": "epl-1", "EPL-2.0": "epl-2",
    "CDDL-1.0": "cddl-1", "BSL-1.0": "boost-1", "EUPL-1.2": "eupl-1.2", "OFL-1.1": "ofl-1.1", "MIT": "mit", "Apache-2.0": "apache-2", "BSD-3-Clause": "bsd-3-clause", "ISC": "isc", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa",
}
NAMES = {
    "GPLv2": "gpl-2", "GPLv3": "gpl-3", "GPL 3": "gpl-3", "GPL v3 or later": "gpl-3-or-later", "LGPL": "lgpl", "AGPL": "agpl", "GNU GPL": "gpl", "MPL 2.0": "mpl-2", "EPL 2.0": "epl-2", "BSD License": "bsd", "MIT License": "mit",
    "ISC License": "isc", "zlib license": "zlib", "Apache License, v2.0": "apache-2", "Apache License": "apache", "2-Clause BSD": "bsd-2-clause", "New BSD License": "bsd-3-clause", "Boost Software License": "boost-1",
    "SIL Open Font License": "ofl-1.1", "GNU General Public License": "gpl", "GNU General Public License v2": "gpl-2", "GNU General Public License, version 3": "gpl-3", "GNU Lesser General Public License": "lgpl",
    "GNU Lesser General Public License v2.1": "lgpl-2.1", "GNU Lesser General Public License v3": "lgpl-3", "GNU Affero General Public License": "agpl", "GNU Affero General Public License v3": "agpl-3",
    "Mozilla Public License": "mpl", "Mozilla Public License 2.0": "mpl-2", "Eclipse Public License": "epl", "Eclipse Public License 2.0": "epl-2",
}


@pytest.mark.parametrize("name", IDENTIFIERS)
def test_license_identifiers(name):
    assert {d.label for d in licenses.detect(f"// SPDX-License-Identifier: {name}\nint x;")[1]} == {IDENTIFIERS[name]}


@pytest.mark.parametrize("name", NAMES)
def test_license_short_names_and_headings(name):
    assert {d.label for d in licenses.detect(f"{name}\n\nCopyright")[1]} == {NAMES[name]}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("GNU General Public License v3", {"gpl-3"}),
        ("under the GPLv3", {"gpl-3"}),
        ("released under the BSD license", {"bsd"}),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", {"cc-by-nc-sa"}),
        ("released under the GPL v2 or later", {"gpl-2-or-later"}),
        ("dual licensed: MIT License or Apache License 2.0", {"mit", "apache-2"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", {"mit"}),
        ("https://creativecommons.org/licenses/by-sa/4.0/", {"cc-by-sa"}),
        ("isn't released under the GPL v2", set()),
        ("This code is no longer licensed under the Apache License, 2.0", set()),
        ("rather than the GPL", set()),
        ("", set()),
    ],
)
def test_license_statements(text, labels):
    assert {d.label for d in licenses.detect(text)[1]} == labels


def test_negated_fixed_phrases_stay_and_score_low():
    (found,) = licenses.detect("not licensed under the MIT license")[1]
    assert (found.label, found.fixed, found.score) == ("mit", True, licenses.NEGATED)
    assert max(d.score for d in licenses.detect("It is licensed under the MIT license")[1]) == 1.0


def test_every_license_rule_has_its_own_priority_and_keyword():
    own = licenses.rules()
    assert [r.priority for r in own] == list(range(len(own))) and len({(r.label, r.pattern.pattern) for r in own}) == len(own)


def test_suppression_equals_all_pairs():
    draw = random.Random(8)
    for _ in range(200):
        found = []
        for k in range(draw.randint(1, 6)):
            rule = licenses.Rule(k, f"l{k}", b"", re.compile(b"x"), 0.5, draw.random() < 0.2)
            starts = sorted(draw.sample(range(40), draw.randint(1, 5)))
            found.append((rule, np.array([(s, s + draw.randint(1, 12)) for s in starts])))
        kept = []
        for rule, spans in found:
            new = [(s, e) for s, e in spans.tolist() if rule.fixed or not any(a <= s and e <= b for _, a, b in kept)]
            kept += [(rule.label, s, e) for s, e in new]
        assert [(r.label, s, e) for r, own in licenses.unsuppressed(found) for s, e in own.tolist()] == kept


def test_many_detections_stay_linear():
    import time

    n, spans = 100_000, np.arange(100_000)[:, None] * 10
    rules = [licenses.Rule(k, f"l{k}", b"", re.compile(b"x"), 0.5) for k in range(4)]
    began = time.process_time()
    licenses.unsuppressed([(r, np.hstack([spans + k, spans + 8 - k])) for k, r in enumerate(rules)])
    assert time.process_time() - began < 1
    assert len(licenses.detect("released under the MIT License; GPL v2 or later.\n" * 20_000)[1]) == 60_000


def test_license_scan_handles_odd_rows(docs, empty):
    for r in licenses.scan(docs).collect():
        n, places = license_places(r.text or "")
        assert (r.license_words, sorted((d["first"], d["label"]) for d in r.license_found if d["fixed"])) == (n, places)
    assert licenses.scan(empty).count() == 0


def toxic_tables(spark, n=400):
    draw = random.Random(5)
    plain = [f"w{draw.randrange(500)}" for _ in range(600)]
    rows = []
    for k in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(3, 120))]
        if k % 8 == 0:
            words[draw.randrange(len(words))] = draw.choice(["wretchedfool", "vilescum"])
        rows.append((k, " ".join(words), int(k % 8 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_toxicity_held_out_accuracy(spark):
    docs, labels, truth = toxic_tables(spark)
    got = by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held) and not any(got[k].held_out for k in truth if k not in held)
    right = [got[k].predicted == truth[k] for k in held]
    assert np.mean(right) > 0.95
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels, truth = toxic_tables(spark, 120)
    turned = spark.createDataFrame([(k, v if zlib.crc32(str(k).encode()) % 5 else 1 - v) for k, v in truth.items()], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    clash = docs.selectExpr("*", "1 as Score", "2 as predicted")
    assert [c.lower() for c in toxicity.score(clash, model).columns].count("score") == 1


def grams(text):
    """The distinct n-grams of characters by a plain loop."""
    padded = f" {(text or '').lower()} "
    return {padded[i : i + n] for n in toxicity.ORDERS for i in range(len(padded) - n + 1)}


def bucket(gram):
    h = 0x811C9DC5
    for c in gram:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    return (((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 14


@pytest.mark.parametrize("text", [None, "", "a", "Häßliche Ünwörter", "плохие слова здесь", "坏话很多的句子", "🙂 ok"])
def test_features_are_of_characters(text):
    assert toxicity.features(text).tolist() == sorted({bucket(g) for g in grams(text)})


def test_ratios_and_fit_equal_a_plain_loop():
    """Counts, log-count ratios and the loss by loops; the fit must not be beaten by small steps in any weight."""
    import math

    draw = random.Random(2)
    texts = [(int(k % 4 == 0), " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)) + (" vile" if k % 4 == 0 else "")) for k in range(60)]
    rows = [(y, toxicity.features(t)) for y, t in texts]
    model = toxicity.train(lambda: iter(rows))
    n = [sum(y == c for y, _ in rows) for c in (0, 1)]
    counts = [[0] * toxicity.BUCKETS for _ in (0, 1)]
    for y, own in rows:
        for b in own.tolist():
            counts[y][b] += 1
    ratio, used = {}, []
    for b in {b for _, own in rows for b in own.tolist()}:
        ratio[b] = math.log((counts[1][b] + 1) / (n[1] + 2)) - math.log((counts[0][b] + 1) / (n[0] + 2))
        pool = (counts[0][b] + counts[1][b]) / len(rows)
        if abs(counts[1][b] / n[1] - counts[0][b] / n[0]) >= 3 * math.sqrt(max(pool * (1 - pool), 1e-12) * (1 / n[0] + 1 / n[1])):
            used.append(b)
    assert set(np.flatnonzero(model.weights).tolist()) <= set(used) and used

    def loss(weights, bias):
        total = 3.0 * sum((w / ratio[b]) ** 2 for b, w in weights.items())
        for y, own in rows:
            z = bias + sum(weights.get(b, 0.0) for b in own.tolist())
            total += (3.0 if y else 1.0) * math.log1p(math.exp(-z if y else z))
        return total

    fitted = {b: float(model.weights[b]) for b in used}
    best = loss(fitted, model.bias)
    assert best < loss(dict.fromkeys(used, 0.0), model.bias)
    for b in used[:5]:
        for step in (0.05, -0.05):
            assert loss({**fitted, b: fitted[b] + step * ratio[b]}, model.bias) > best - 1e-3
    for y, t in texts:
        z = model.bias + sum(fitted.get(b, 0.0) for b in toxicity.features(t).tolist())
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)))


def test_features_of_long_texts_match_whole_hashing(monkeypatch):
    text = "".join(random.Random(1).choice("abc def") for _ in range(5000))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "WINDOW", 700)
    assert np.array_equal(whole, toxicity.features(text))


@pytest.mark.parametrize("text", ["", None, "é"])
def test_digest_is_plain(text):
    assert hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in pii.find(text)).encode()).hexdigest()
