import hashlib
import re

from helpers import EDGE, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    """The base spans by the patterns themselves."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.text(alphabet="a.@-1 2+()9", max_size=60), st.lists(st.sampled_from(["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0100", "+", "5", " ", "é", "a_b%c+d@x-y.z.w", "00000000000000"]), max_size=12).map("".join)))
def test_base_spans_are_those_of_the_patterns(text):
    assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE_KINDS] == brute(text)


def test_further_kinds_need_context_or_a_checksum():
    assert [s.kind for s in pii.find("Account GB82 WEST 1234 5698 7654 32 please")] == ["iban"]
    for text in ("IBAN BE68 5390 0754 7034 PAID", "IBAN BE68 5390 0754 7034 paid", "DE89370400440532013000 OK", "NO93 8601 1117 947"):
        (span,) = pii.find(text)
        assert span.kind == "iban" and pii.mod97(text[span.start : span.end]) and len(text[span.start : span.end].replace(" ", "")) == pii.IBAN_LENGTHS[text[span.start : span.start + 2]]
    assert not any(s.kind == "iban" for x in ("BE68 5390 0754 70341", "QQ68 5390 0754 7034") for s in pii.find(x))
    assert pii.find("code GB83 WEST 1234 5698 7654 32 please") == []
    assert [s.kind for s in pii.find("my ssn is 219-09-9999")] == ["ssn"]
    assert pii.find("part 219-09-9999") == []
    assert [s.kind for s in pii.find("call 212 555 0100 now")] == ["local_phone"]
    assert pii.find("numbers 212 555 0100 now") == []
    high, low = pii.find("card 4111111111111111")[0].score, pii.find("order 4111111111111111")[0].score
    assert high > low


def test_long_texts_are_scanned_in_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + "(" * 100_000, "1." * 100_000, "@" * 100_000):
        pii.find(text)


def test_redaction():
    text = "é a@b.co and 1.2.3.4!"
    assert pii.redact(text, pii.find(text)) == "é [email] and [ip]!"


def test_detect(spark):
    docs = documents(spark, [*EDGE, "mail x@y.zz 10.0.0.1"])
    rows = pii.detect(docs, redacted=True).collect()
    assert len(rows) == len(EDGE) + 1
    last = rows[-1]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone, last.spans) == (1, 1, 0, 0, "email:5:11,ip:12:20")
    assert last.base_sha256 == hashlib.sha256(last.spans.encode()).hexdigest() and last.redacted == "mail [email] [ip]"
    assert rows[0].spans == "" and rows[0].redacted is None and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    cleaned = pii.redact_column(docs)
    assert cleaned.columns == docs.columns and [r.text for r in cleaned.collect()][-1] == "mail [email] [ip]"
    assert pii.detect(docs.where("false")).count() == 0

