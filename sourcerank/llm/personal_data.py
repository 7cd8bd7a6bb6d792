"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby decide doubtful ones.

Each kind has a pattern, a check (Luhn for cards, mod 97 for IBANs, ranges and calendars for
others) and a score: what the shape alone is worth, more if the check holds, and more or less
for words of the text around it.  Four base kinds (email, ip, card, phone) count whenever
their check holds; the others (iban, ssn, local_phone, ipv6, birthdate) must reach
``LEAST_SCORE`` and must not overlap a span that counts already.

Patterns are written so that a text of any length is read in linear time: no run of characters
is tried again from each of its places.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import datetime
import ipaddress
import itertools
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# A doubtful span counts from this score on.
LEAST_SCORE = 0.6
_CONFIRMED, _NEAR, _AGAINST = 0.3, 0.35, -0.4
# Characters before and after a span whose words count.
_BEFORE, _AFTER = 60, 30

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("iban", "ssn", "local_phone", "ipv6", "birthdate")

# What the shape of a kind is worth before anything else is known.
_SHAPE = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.2, "local_phone": 0.1, "ipv6": 0.4, "birthdate": 0.1}
# Words that speak for a kind, in English, German, French and Spanish.
_SPEAK_FOR = {
    "email": "email mail contact kontakt courriel correo write".split(),
    "ip": "ip address host server adresse dirección client login".split(),
    "card": "card credit visa mastercard amex karte kreditkarte carte tarjeta payment".split(),
    "phone": "phone tel telephone call mobile cell fax telefon anruf handy téléphone appeler teléfono llamar móvil".split(),
    "iban": "iban account bank transfer konto überweisung compte virement cuenta banco".split(),
    "ssn": "ssn social security taxpayer".split(),
    "local_phone": "phone tel telephone call mobile cell fax telefon anruf handy téléphone appeler teléfono llamar móvil".split(),
    "ipv6": "ip ipv6 address host server adresse dirección client login".split(),
    "birthdate": "born birth birthday dob geboren geburtsdatum né née naissance nacido nacida nacimiento".split(),
}
# Words that speak against numbers being personal.
_SPEAK_AGAINST = "isbn order invoice version serial sku article tracking example sample bestellung rechnung commande facture pedido factura".split()

_FOR = {kind: frozenset(words) for kind, words in _SPEAK_FOR.items()}
_OPPOSED = frozenset(_SPEAK_AGAINST)
_WORD = re.compile(r"[^\W\d_]+")

_LOCAL_PART = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9A-Za-z+().-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_DATE = re.compile(r"(?<![0-9./-])(?:([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})|([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4}))(?![0-9./-]*[0-9])")
_DIGIT = re.compile(r"[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of account numbers: letters count from 10, the first four characters go last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses; only the surroundings of each @ are read."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_PART:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain is not None:
            yield start, domain.end()
        done = domain.end() if domain is not None else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers; words in capitals behind one are left off until the checksum holds."""
    for m in _IBAN.finditer(text):
        end = m.end()
        while end > m.start():
            plain = text[m.start() : end].replace(" ", "")
            if len(plain) < 15:
                break
            if len(plain) <= 34 and mod97(plain):
                yield m.start(), end
                break
            end = text.rfind(" ", m.start(), end)


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _locals(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL.finditer(text):
        if 8 <= len(_digits(m.group())) <= 12:
            yield m.span()


def _ipv6s(text: str) -> Iterator[tuple[int, int]]:
    for m in _IPV6.finditer(text):
        try:
            ipaddress.IPv6Address(m.group())
        except ValueError:
            continue
        yield m.span()


def _dates(text: str) -> Iterator[tuple[int, int]]:
    for m in _DATE.finditer(text):
        y, mo, d = (int(x) for x in (m.groups()[:3] if m.group(1) else (m.group(6), m.group(5), m.group(4))))
        try:
            datetime.date(y, mo, d)
        except ValueError:
            continue
        if 1900 <= y <= 2100:
            yield m.span()


_PROPOSED: dict[str, tuple[Callable[[str], Iterator[tuple[int, int]]], Callable[[str, bool], bool]]] = {
    "email": (_emails, lambda text, digit: "@" in text),
    "ip": (_ips, lambda text, digit: digit and "." in text),
    "card": (_cards, lambda text, digit: digit),
    "phone": (_phones, lambda text, digit: digit and "+" in text),
    "iban": (_ibans, lambda text, digit: digit),
    "ssn": (_ssns, lambda text, digit: digit and "-" in text),
    "local_phone": (_locals, lambda text, digit: digit),
    "ipv6": (_ipv6s, lambda text, digit: ":" in text),
    "birthdate": (_dates, lambda text, digit: digit),
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The worth of a confirmed span of ``kind``, with the words around it."""
    near = text[max(0, start - _BEFORE) : start] + " " + text[end : end + _AFTER]
    words = set(_WORD.findall(near.lower()))
    value = _SHAPE[kind] + _CONFIRMED
    value += _NEAR if words & _FOR[kind] else 0
    value += _AGAINST if words & _OPPOSED else 0
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[Span]:
    """All spans of one text, by start, then by kind as listed."""
    digit = _DIGIT.search(text) is not None
    base, more = [], []
    for kind in KINDS:
        propose, worth_it = _PROPOSED[kind]
        if not worth_it(text, digit):
            continue
        for start, end in propose(text):
            span = Span(kind, start, end, score(text, kind, start, end))
            if kind in BASE:
                base.append(span)
            elif span.score >= LEAST_SCORE:
                more.append(span)
    if more:
        base += _apart(base, more)
    return sorted(base, key=lambda s: (s.start, KINDS.index(s.kind)))


def _apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Of ``more`` those that overlap neither a base span nor a better one.

    Better is the higher score, then the longer, then the earlier span.
    """
    taken = sorted(base, key=lambda s: s.start)
    starts = [s.start for s in taken]
    reach = list(itertools.accumulate((s.end for s in taken), max))
    kept: list[Span] = []
    for span in sorted(more, key=lambda s: (-s.score, s.start - s.end, s.start)):
        before = bisect_left(starts, span.end)
        if before and reach[before - 1] > span.start:
            continue
        at = bisect_left(kept, span.start, key=lambda s: s.start)
        if (at and kept[at - 1].end > span.start) or (at < len(kept) and kept[at].start < span.end):
            continue
        kept.insert(at, span)
    return kept


def spans(df: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the spans of each document of ``df``: (kind, start, end, score, base).

    One row for each row of ``df``, repeated ones too; a null text counts as empty and has no
    spans; an empty table gives no rows; columns beside doc_id and text are left behind.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            for first, last in common.slices(offsets):
                part = batch.slice(first, last - first)
                rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score, "base": s.kind in BASE} for s in find(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, _SPANS_ARROW)], ["doc_id", "text", "spans"])

    return common.id_and_text(df).mapInArrow(found, f"doc_id long, text string, spans {_SPANS}")


_SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def masked(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with each span replaced by its kind in brackets; of overlapping spans the first."""

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = common.bytes_of(batch.column(1))
            for first, last in common.slices(offsets):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_masked(t) for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return common.id_and_text(df).mapInArrow(replaced, "doc_id long, text string")


def _masked(text: str) -> str:
    out, at = [], 0
    for s in find(text):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds of :func:`spans`, the sha256 of the base spans and all spans as text."""

    def told(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[of(kind) for kind in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
