"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are decided by their expression and check alone; their score only
ranks them. Further kinds (iban, ssn, local_phone) also need a score of at least `MIN_SCORE`, which the
words around them raise or lower. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Scores below this drop a span of a further kind.
MIN_SCORE = 0.5
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 40

#: (score without context, words that raise it by 0.3, words that lower it by 0.3)
RULES = {
    "email": (0.8, ("mail", "contact", "contacto", "kontakt", "courriel"), ()),
    "ip": (0.6, ("ip", "host", "server", "address", "adresse", "login"), ("version", "release", "section")),
    "card": (0.7, ("card", "visa", "mastercard", "carte", "karte", "tarjeta", "payment"), ("order", "serial", "isbn", "tracking")),
    "phone": (0.7, ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "portable"), ("order", "serial")),
    "iban": (0.8, ("iban", "account", "bank", "konto", "compte", "cuenta"), ()),
    "ssn": (0.3, ("ssn", "social", "security", "taxpayer"), ("order", "serial", "part")),
    "local_phone": (0.3, ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "portable"), ("order", "serial", "part")),
}

#: Every match of ip, card and phone lies in one of these regions, and begins where one may begin.
_REGION = re.compile(r"\+?[0-9][0-9 ().-]{6,}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


# The length of each country's IBAN.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(r"(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(IBAN_LENGTHS.values())}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN's check digits hold."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: a match begins where the run of local characters before its @ begins."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """What begins as an IBAN, has its country's length and holds its check digits."""
    for m in _IBAN_HEAD.finditer(text):
        rest = _IBAN_REST[IBAN_LENGTHS[m[1]]].match(text, m.end()) if m[1] in IBAN_LENGTHS else None
        if rest and mod97(text[m.start() : rest.end()]):
            yield m.start(), rest.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    for region in _REGION.finditer(text):
        part, base = region[0], region.start()
        for m in _IP.finditer(part):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                yield "ip", base + m.start(), base + m.end()
        for m in _CARD.finditer(part):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                yield "card", base + m.start(), base + m.end()
        for m in _PHONE.finditer(part):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", base + m.start(), base + m.end()
    for start, end in _ibans(text):
        yield "iban", start, end
    for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    score, raising, lowering = RULES[kind]
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(near)}
    score += 0.3 * any(w in words for w in raising) - 0.3 * any(w in words for w in lowering)
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind; offsets count code points. None has none."""
    spans: list[Span] = []
    for kind, start, end in _proposals(text or ""):
        score = _score(text, kind, start, end)
        if kind in BASE_KINDS or score >= MIN_SCORE:
            spans.append(Span(kind, start, end, score))
    base = [(s.start, s.end) for s in spans if s.kind in BASE_KINDS]
    if len(base) < len(spans):  # a further kind doesn't stand inside a base span
        spans = [s for s in spans if s.kind in BASE_KINDS or not any(a < s.end and s.start < b for a, b in base)]
    return sorted(spans, key=lambda s: (s.start, _RANK[s.kind], s.end))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _run(redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [find(x) for x in texts]
                columns = [part.column("doc_id")]
                columns += [pa.array([sum(s.kind == k for s in x) for x in found], pa.int64()) for k in BASE_KINDS]
                columns.append(pa.array([hashlib.sha256(_listed([s for s in x if s.kind in BASE_KINDS]).encode()).hexdigest() for x in found]))
                columns.append(pa.array([_listed(x) for x in found]))
                columns.append(pa.array([[s.score for s in x] for x in found], pa.list_(pa.float64())))
                if redacted:
                    columns.append(pa.array([x if x is None else redact(x, s) for x, s in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores", *["redacted"] * redacted])

    return run


def detect(docs: DataFrame, redacted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores and, if wanted, redacted.

    No shuffle. Null and empty texts have no spans (and a null text stays null when redacted);
    repeated rows are each searched; an empty table gives no rows.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(common.resting(_run(redacted)), schema + ", redacted string" * redacted)


def _redact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        names = [n for n in batch.schema.names if n != "__text"]
        for part in common.text_slices(batch, "__text"):
            cleaned = pa.array([x if x is None else redact(x, find(x)) for x in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), cleaned], [*names, "__text"])


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with the spans of one text column replaced by their kinds."""
    renamed = docs.withColumn("__text", F.col(text_col)).drop(text_col)
    return renamed.mapInArrow(common.resting(_redact_rows), renamed.schema).withColumnRenamed("__text", text_col).select(docs.columns)
