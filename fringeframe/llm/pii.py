"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import attach, free_name

#: Kinds whose spans the contract fixes, in the order that ties take.
BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
MORE = ("iban", "ssn", "secret")
KINDS = BASE + MORE

# Each is linear: a run of digits is entered at its start only, and quantifiers that can't give back are possessive.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of an IBAN by country: those of the registry, and those in use without being in it.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (
        line.split(":")
        for line in """15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA
        23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:AO,CV,GW,LY,MZ,PT,ST 26:IR,IS,TR,DZ 27:BI,CF,CG,CM,DJ,FR,GA,GQ,GR,IT,KM,MC,MG,MR,SM,TD
        28:AL,AZ,BF,BJ,BY,CI,CY,DO,GT,HN,HU,LB,MA,ML,NE,NI,PL,SN,SV,TG 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU""".split()
    )
    for country in countries.split(",")
}
#: What follows the first four characters of an IBAN of a length, in any grouping by single spaces.
IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"""(?i:\b(?:token|secret|password|passwd|api_?key|access_?key)\b)["']?\s{0,3}[:=]\s{0,3}["']?([A-Za-z0-9_/+=.-]{12,}+)""")

#: Words that make a kind likelier near a span, and those that make it less likely. A plural s is allowed.
CONTEXT = {
    "email": (("mail", "email", "mailto", "contact", "write", "reach"), ("example",)),
    "ip": (("ip", "ipv4", "host", "hostname", "server", "address", "addresse"), ("version", "section", "chapter")),
    "card": (("card", "visa", "credit", "payment", "cc"), ("order", "isbn", "tracking")),
    "phone": (("phone", "telephone", "call", "tel", "mobile", "fax"), ("order", "id")),
    "iban": (("iban", "account", "bank", "transfer"), ()),
    "ssn": (("ssn", "social", "security"), ("part", "model")),
    "secret": (("token", "secret", "key", "password"), ("sample",)),
}
#: The same as patterns of whole words; an underscore parts words.
WHOLE = {
    kind: tuple(re.compile(rf"(?<![a-z0-9])(?:{'|'.join(words)})s?(?![a-z0-9])", re.ASCII | re.IGNORECASE) if words else None for words in both) for kind, both in CONTEXT.items()
}
#: Characters before and behind a span whose words count; behind it, up to the end of its clause.
NEAR, BEHIND = 40, 24
CLAUSE = re.compile(r"[;\n]|[.!?](?=\s)|(?=[0-9@])")
#: Spans of at least this score are masked, and spans of the method's own kinds reported.
LEAST = 0.5
#: Score of a confirmed span before its context: a checksum says more than a shape.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "secret": 0.7}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards, since a scan from the left is quadratic on long runs."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        elif start < at:
            free = max(free, start)
        at = text.find("@", max(at + 1, free))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Places of as many characters as the country's IBANs have and that mod-97 confirms, whatever stands behind."""
    free = 0
    for m in IBAN.finditer(text):
        rest = IBAN_REST[IBAN_LENGTHS[m[1]]].match(text, m.end()) if m[1] in IBAN_LENGTHS and m.start() >= free else None
        if rest and mod97(text[m.start() : rest.end()].replace(" ", "")):
            free = rest.end()
            yield m.start(), free


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in SECRET.finditer(text):
        yield "secret", *m.span(1)


def context(text: str, kind: str, start: int, end: int, last: int) -> float:
    """What the whole words near a span add to its score: a good word outweighs a bad one.

    Words since the last span of the kind and those behind the span in its clause count first; where there are none,
    all within NEAR characters before do, so that the items of a list share their heading.
    """
    near = max(0, start - NEAR)
    stop = CLAUSE.search(text, end, end + BEHIND)
    behind = stop.start() if stop else min(len(text), end + BEHIND)
    for spans in (((max(near, last), start), (end, behind)), ((near, start),)):
        good, bad = (p is not None and any(p.search(text, a, b) for a, b in spans) for p in WHOLE[kind])
        if good or bad:
            return 0.15 if good else -0.3
    return 0.0


def find(text: str | None) -> list[Span]:
    """All spans of a whole text by start, then kind; offsets count code points, the end is exclusive."""
    out, last = [], dict.fromkeys(KINDS, 0)
    for kind, start, end in proposals(text or ""):
        score = PRIOR[kind] + context(text, kind, start, end, last[kind])
        last[kind] = end
        if kind in BASE or score >= LEAST:
            out.append(Span(kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def mask(text: str, spans: list[Span], least: float = LEAST) -> str:
    """The text with the place of each span of score ``least`` or more taken by its kind; of overlapping spans one mark is left, the first's."""
    parts, at = [], 0
    for s in spans:
        if s.score < least:
            continue
        if s.start >= at:
            parts += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with pii_spans (kind, start, end, score) of the whole text and pii_masked, the text with likely spans replaced.

    Base spans are all reported, whatever their score; ``mask`` leaves those below LEAST (an address after "version")
    where they stand. Null texts have no span and stay null; empty texts stay empty; very long texts are scanned whole, in time that
    grows with their length; each row is scanned alone, so repeated rows agree; an empty table gives an
    empty result. Result columns replace inputs of their name.
    """
    kind = T.StructType([T.StructField("spans", SPAN), T.StructField("masked", T.StringType())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for v in batch:
                value = v.as_py()
                spans = find(value)
                rows.append({"spans": [vars(s) for s in spans], "masked": None if value is None or not spans else mask(value, spans)})
            yield pa.array(rows, pa.struct([("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))), ("masked", pa.string())]))

    own = free_name(df, "pii__")
    found = df.withColumn(own, F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text}`")))
    return attach(found, {"pii_spans": F.col(f"{own}.spans"), "pii_masked": F.coalesce(F.col(f"{own}.masked"), F.col(f"`{text}`"))}).drop(own)


def scores(spans) -> Column:
    """The scores of an array of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.format_string("%.2f", s.score)), ",")


def digest(spans) -> Column:
    """kind:start:end of an array column, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


