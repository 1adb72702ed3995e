"""Personal data: patterns propose, checksums confirm, context adjusts the score.

Base kinds (``email ip card phone``) follow fixed patterns and checks and are
always reported.  The method adds ``iban`` (mod-97) and ``ssn`` spans; those are
kept when their score, a prior plus what the checksum and nearby words give or
take, reaches ``threshold``.  Matches of a kind are leftmost and do not overlap;
one that fails its check is dropped and not retried, save that an ``iban`` may end
at, and the next one start after, any word of the match.  Null and empty texts have
no spans; repeated rows are scanned one by one; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .spans import Span, scan_spans

BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "ssn")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_LENGTHS = {
    code[:2]: int(code[2:])
    for code in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: No area 000, 666 or 9xx, no group 00, no serial 0000.
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CHECKED = 0.4  # a checksum holds
CONTEXT = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("order", "version", "isbn", "invoice", "serial")
NEAR, STEP = 40, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that end with a word where the country's length and mod-97 hold; the longest such for other codes."""
    m = _IBAN.search(text)
    while m:
        at, length = m.start() + 4, _IBAN_LENGTHS.get(m[0][:2])
        end = m.end()
        while end > m.start():
            size = end - m.start() - text.count(" ", m.start(), end)
            if size >= 15 and size == (length or size) and mod97(text[m.start() : end]):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)
        m = _IBAN.search(text, at)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each ``@`` outward in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # nothing before this sign can be part of a later match
        at = text.find("@", done)


def _score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = set(_WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    score = PRIOR[kind] + CHECKED * checked
    score += STEP * (not near.isdisjoint(CONTEXT[kind])) - STEP * (not near.isdisjoint(AGAINST))
    return min(1.0, max(0.0, score))


def find_pii(text: str, threshold: float = 0.5) -> list[Span]:
    """All spans of one text; base kinds whatever their score."""
    found: list[Span] = []

    def add(kind: str, start: int, end: int, checked: bool = False) -> None:
        score = _score(text, kind, start, end, checked)
        if kind in BASE or score >= threshold:
            found.append((kind, start, end, score))

    if "@" in text:
        for s, e in emails(text):
            add("email", s, e)
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
                add("ip", *m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            add("card", *m.span(), True)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                add("phone", *m.span())
    for s, e in ibans(text):
        add("iban", s, e, True)
    for m in _SSN.finditer(text):
        add("ssn", *m.span())
    return found


def detect_pii(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    return scan_spans(documents, lambda: lambda t: find_pii(t, threshold), base=BASE, added=ADDED, doc_id=doc_id, text=text)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
    return "".join([*out, text[at:]])
