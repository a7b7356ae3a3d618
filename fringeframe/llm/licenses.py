"""License scan: ordered signature rules behind keyword gates, overlapping detections resolved by priority."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm import license_rules
from fringeframe.llm.common import attach, free_name

#: Phrases and labels that the contract fixes.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Bytes of a word: digits, letters and everything beyond ASCII; other bytes part words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Score of a detection that a negation precedes.
NEGATED = 0.1


@dataclass(frozen=True, order=True)
class Rule:
    """priority: smaller wins; fixed: never suppressed."""

    priority: int
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    score: float
    fixed: bool = False


def _compiled(words: str) -> re.Pattern[bytes]:
    """A pattern of whole words; a closing ``!`` keeps it off a version."""
    last = r"(?= )(?! (?:version |v ?)?[0-9])" if words.endswith("!") else "(?= )"
    return re.compile(f"(?<= ){words.removesuffix('!')}{last}".encode())


@cache
def rules() -> tuple[Rule, ...]:
    """The rules in order, each with a priority of its own: the fixed phrases, then the hand-written lines of ``license_rules``."""
    out = [Rule(k, label, phrase.encode(), _compiled(phrase), 1.0, True) for k, (phrase, label) in enumerate(BASE)]
    blocks = (license_rules.IDENTIFIERS, license_rules.NOTICES, license_rules.ADDRESSES, license_rules.COMMONS, license_rules.VERSIONS, license_rules.STATEMENTS)
    for line in "".join(blocks).splitlines():
        if line:
            label, keyword, score, pattern = line.split(" | ", 3)
            out.append(Rule(len(out), label, keyword.encode(), _compiled(pattern.replace("~", "licen[sc]e")), float(score)))
    return tuple(out)


@cache
def keywords() -> dict[bytes, tuple[Rule, ...]]:
    return {k: tuple(r for r in rules() if r.keyword == k) for k in dict.fromkeys(r.keyword for r in rules())}


@cache
def negations() -> re.Pattern[bytes]:
    return _compiled(f"(?:{'|'.join(license_rules.NEGATIONS)})")


@dataclass(frozen=True)
class Detection:
    label: str
    first: int
    last: int
    score: float
    fixed: bool


def unsuppressed(found: list[tuple[Rule, np.ndarray]]) -> list[tuple[Rule, np.ndarray]]:
    """Of (rule, rows of start and end) by priority, those that no kept span of an earlier rule holds; fixed ones all stay.

    The kept spans are held by start with the farthest end so far, so a span is held if the farthest end of those that
    start no later reaches its own: one search a span, however many there are.
    """
    starts = far = np.zeros(0, np.int64)
    out = []
    for rule, spans in found:
        if not rule.fixed and len(starts):
            at = np.searchsorted(starts, spans[:, 0], "right") - 1
            spans = spans[(at < 0) | (far[at] < spans[:, 1])]
        if len(spans):
            out.append((rule, spans))
            both, ends = np.concatenate([starts, spans[:, 0]]), np.concatenate([far, spans[:, 1]])
            order = np.argsort(both, kind="stable")
            starts, far = both[order], np.maximum.accumulate(ends[order])
    return out


def detect(text: str | None) -> tuple[int, list[Detection]]:
    """(number of words, detections) of a whole text; first and last count words from 0, last is inclusive.

    A rule runs only where its keyword occurs. A detection inside the span of one of higher priority goes, as does
    a tie of equal span; fixed phrases always stay. What a negation precedes goes too, and a fixed phrase then
    scores NEGATED.
    """
    words = (text or "").encode("utf-8", "replace").translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    matched = []
    for keyword, own in keywords().items():
        if keyword in line:
            matched += [(rule, spans) for rule in own if (spans := [m.span() for m in rule.pattern.finditer(line)])]
    if not matched:
        return len(words), []
    kept = unsuppressed([(rule, np.array(spans, np.int64)) for rule, spans in sorted(matched, key=lambda f: f[0].priority)])
    spans = sorted((start, end, rule) for rule, own in kept for start, end in own.tolist())
    turned = [m.span() for m in negations().finditer(line)]
    at, count, k, out = 0, -1, 0, []
    for start, end, rule in spans:
        count += line.count(b" ", at, start)
        at = start
        while k < len(turned) and turned[k][1] + 1 < start:
            k += 1
        negated = k < len(turned) and turned[k][0] <= start
        if rule.fixed or not negated:
            out.append(Detection(rule.label, count, count + line.count(b" ", start, end), NEGATED if negated else rule.score, rule.fixed))
    return len(words), out


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("fixed", T.BooleanType())])))])
ARROW = pa.struct([("n_words", pa.int64()), ("found", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("fixed", pa.bool_())])))])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with license_words (long) and license_found (label, first, last, score, fixed) of each whole text.

    Null and empty texts have no word and no detection; each row is scanned alone, so repeated rows agree; an empty
    table gives an empty result. Very long texts are scanned whole, in time that grows with their length and
    their number of detections. Result columns replace inputs of their name.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for v in batch:
                n, found = detect(v.as_py())
                rows.append({"n_words": n, "found": [vars(d) for d in found]})
            yield pa.array(rows, ARROW)

    own = free_name(df, "license__")
    scanned = df.withColumn(own, F.arrow_udf(run, FOUND, F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text}`")))
    return attach(scanned, {"license_words": F.col(f"{own}.n_words"), "license_found": F.col(f"{own}.found")}).drop(own)
