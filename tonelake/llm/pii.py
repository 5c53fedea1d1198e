"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Four forms are reported wherever their fixed rule holds. Beyond those, weaker patterns propose bank
accounts, social security numbers, numbers without a country code and cards inside longer chains of
digits; they are reported if checksum, layout and context together reach a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import small_batches

#: The base forms in their order, then the kinds that only the score can admit.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Least score of a span that no base form reports.
ADMITTED = 0.7
#: Score before evidence, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.4, "iban": 0.2, "ssn": 0.4}
#: Code points before and after a span in which its context words are looked for.
BEFORE, AFTER = 48, 24
BATCH_BYTES = 4 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Digits and what may stand between them: every ip, card or phone lies whole in one zone.
_ZONE = re.compile(r"[0-9+][0-9\x20.()+-]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NATIONAL = re.compile(
    r"(?<![0-9+.-])(?:\(?0[0-9]{1,4}\)?(?:[\x20./-]?[0-9]{2,4}){2,4}|\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])"
)
_GROUP = re.compile(r"[0-9]+")
#: First digits and lengths of card numbers in use.
_ISSUED = re.compile(
    r"(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|35[0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12})"
)
_CONTEXT = {
    "card": r"cards?|visa|mastercard|amex|credit|debit|karte|kreditkarte|tarjeta|carte|cc",
    "phone": r"phone|tel|telephone|mobile|cell|call|fax|telefon|handy|mobil|tel[eé]fono|m[oó]vil|t[eé]l[eé]phone|portable",
    "iban": r"iban|account|konto|cuenta|compte|bank|banque|banco",
    "ssn": r"ssn|social|security",
    "ip": r"ip|host|server|address|adresse|direcci[oó]n",
    "email": r"e-?mail|mail|contact|correo|courriel",
}
_CONTEXT = {kind: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.IGNORECASE) for kind, words in _CONTEXT.items()}
#: Words beside numbers that are something else.
_AGAINST = re.compile(
    r"(?<!\w)(?:isbn|issn|order|invoice|version|ticket|serial|tracking|sku|build|rechnung|bestellung|pedido|factura|facture|commande)(?!\w)",
    re.IGNORECASE,
)


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of a bank account number hold (letters count from 10)."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one @; what stands before it reaches back to the last match at most."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        else:
            low = at + 1
        at = text.find("@", low)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def near(text: str, start: int, end: int, kind: str) -> float:
    """What the words around a span add to its score or take from it."""
    around = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
    return 0.35 * bool(_CONTEXT[kind].search(around)) - 0.35 * bool(_AGAINST.search(around))


def _score(text: str, start: int, end: int, kind: str, confirmed: float) -> float:
    return round(min(1.0, max(0.0, PRIOR[kind] + confirmed + near(text, start, end, kind))), 4)


def _inner_cards(chain: str, at: int) -> Iterator[tuple[int, int, float]]:
    """Cards among the groups of a chain that is none as a whole, with what speaks for them."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(chain)]
    for i, (a, _) in enumerate(groups):
        size = 0
        for j in range(i, len(groups)):
            size += groups[j][1] - groups[j][0]
            if size > 19:
                break
            if size < 12 or (i, j) == (0, len(groups) - 1):
                continue
            b = groups[j][1]
            digits = _digits(chain[a:b])
            if not luhn(digits):
                continue
            widths = [y - x for x, y in groups[i : j + 1]]
            printed = widths in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4]) or len(widths) == 1
            issued = _ISSUED.fullmatch(digits) is not None
            yield at + a, at + b, 0.25 * issued + 0.1 * printed


def _zone_spans(text: str, a: int, b: int, base: list[Span], more: list[Span]) -> None:
    zone = text[a:b]

    def add(to: list[Span], start: int, end: int, kind: str, confirmed: float) -> None:
        to.append(Span(start, end, kind, _score(text, start, end, kind, confirmed), to is base))

    for m in _IP.finditer(zone):
        if all(map(_octet, m.groups())):
            add(base, a + m.start(), a + m.end(), "ip", 0.2)
    for m in _CARD.finditer(zone):
        start, end = a + m.start(), a + m.end()
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            add(base, start, end, "card", 0.25 + 0.25 * (_ISSUED.fullmatch(digits) is not None))
        elif len(digits) > 12:
            for x, y, extra in _inner_cards(m.group(), start):
                add(more, x, y, "card", 0.25 + extra)
    for m in _PHONE.finditer(zone):
        if 9 <= len(_digits(m.group())) <= 15:
            add(base, a + m.start(), a + m.end(), "phone", 0.4)
    for m in _SSN.finditer(zone):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            add(more, a + m.start(), a + m.end(), "ssn", 0.0)
    # A bracket before the first digit belongs to the number but not to the zone.
    low = a - 1 if a and text[a - 1] == "(" else a
    for m in _NATIONAL.finditer(text, low, b):
        if 7 <= len(_digits(m.group())) <= 13:
            add(more, m.start(), m.end(), "phone", 0.0)
    if a >= 2 and text[a - 2 : a].isascii() and text[a - 2 : a].isupper() and not text[a - 3 : a - 2].isalnum():
        m = _IBAN.match(text, a - 2)
        # Words in capitals may follow an account, so its end may lie at any space.
        end = m.end() if m else 0
        while m and end - m.start() >= 15:
            if not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
                add(more, m.start(), end, "iban", 0.6)
                break
            end = text.rfind(" ", m.start(), end)


def spans_of(text: str) -> list[Span]:
    """All spans of a text, by start, then by kind as listed; ends are exclusive, in code points.

    Spans of the base forms always stay. Of the others, those with ADMITTED or more are taken, the best
    first, unless they touch one that was taken.
    """
    base: list[Span] = []
    more: list[Span] = []
    if "@" in text:
        for start, end in _emails(text):
            base.append(Span(start, end, "email", _score(text, start, end, "email", 0.0), True))
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a >= 7 or a >= 2 and text[a - 1].isupper():
            _zone_spans(text, a, b, base, more)
    taken = list(base)
    more = [s for s in more if s.score >= ADMITTED]
    covered = bytearray(len(text) if more else 0)
    for s in base if more else ():
        covered[s.start : s.end] = b"\1" * (s.end - s.start)
    for s in sorted(more, key=lambda s: (-s.score, s.start, -s.end)):
        if not any(covered[s.start : s.end]):
            covered[s.start : s.end] = b"\1" * (s.end - s.start)
            taken.append(s)
    return sorted(taken, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPAN = pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("base", pa.bool_())]
)


def found(docs: DataFrame) -> DataFrame:
    """Every row with `spans`, an array of (start, end, kind, score, base), in place of one it may have.

    Whole texts are read, a slice of about BATCH_BYTES at a time; null and empty ones have no span.
    """
    keep = [c for c in docs.columns if c != "spans"]

    def scan(batches):
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows = [[s._asdict() for s in spans_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(_SPAN))], names=[*keep, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    kind = "array<struct<start:int,end:int,kind:string,score:double,base:boolean>>"
    return docs.select(*keep).mapInArrow(scan, f"{fields}, spans {kind}")


def masked(docs: DataFrame) -> DataFrame:
    """Every row of `found` with its spans in the text replaced by their kind in brackets."""

    def step(state: Column, s: Column) -> Column:
        # A span that begins inside the one before it is covered by it as far as that reaches.
        gap = F.greatest(s["start"] - state["at"], F.lit(0))
        piece = F.substring("text", state["at"] + 1, gap)
        mark = F.when(s["start"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(
            F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], piece, mark).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.expr("text").substr(s["at"] + 1, F.length("text"))))
    return docs.withColumn("text", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans by kind, their digest, all spans, and those of the scores."""
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long")
    return found(docs.select("doc_id", "text")).select(
        "doc_id", *map(number, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added.alias("n_added")
    )
