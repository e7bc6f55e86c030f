"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, URL
schemes and identifier cues. Each anchor belongs to a deterministic parser that expands it to the
left or right over the characters its kind allows and validates the result. Every parser keeps the
end of its last match and goes on from there, so each reads a text once: a span is the leftmost that
does not overlap an earlier one of its kind, and a match that fails validation is dropped whole.

Kinds, in this order: email, ip, card, phone (as their patterns say), then `url` (scheme to the next
blank, quote or bracket, with a host), `iban` (two letters, two digits, the country's groups, sum
modulo 97 is 1) and `account` (a cue such as "account", "acct" or "ssn" and the first identifier of
four or more characters with a digit after it, within a few separators). Spans are in code points,
end exclusive; kinds may overlap each other.

Defined cases: null and empty texts have no spans. Repeated rows count each. Very long runs of digits
or letters are read once. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

#: Anchors by parser.
AT = ("@",)
PLUS = ("+",)
DIGITS = tuple("0123456789")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "user id", "member id", "tax id")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_RUN = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")
_DIGITS_ONLY = str.maketrans("", "", " ().-")
_URL = re.compile(r"[A-Za-z]++://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?+(?::[0-9]++)?+(?:[/?#][^\s\"'<>\[\]{}|\\^`]*+)?+")
_IBAN = re.compile(r"[ \t:#-]{0,4}+([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ ._-]?(?:number|num|no|id|nr))?+[\s.:#=-]{1,4}([A-Za-z0-9](?:-?[A-Za-z0-9]){3,33})(?![A-Za-z0-9])", re.I)

Span = tuple[int, int]


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for parser, anchors in enumerate((AT, PLUS, DIGITS, SCHEMES, CUES)):
        for word in anchors:
            found.add_word(word, (parser, len(word)))
    found.make_automaton()
    return found


def _local_start(text: str, at: int, least: int) -> int:
    """The first character of the run of address characters that ends before `at`."""
    reach = 64
    while True:
        begin = max(least, at - reach)
        part = text[begin:at]
        run = len(part) - len(part.rstrip(_LOCAL))
        if run < len(part) or begin == least:
            return at - run
        reach *= 4


def email_at(text: str, at: int, least: int) -> tuple[Span | None, int]:
    domain = _DOMAIN.match(text, at)
    if not domain:
        return None, least
    start = _local_start(text, at, least)
    if start == at:
        return None, least
    return (start, domain.end()), domain.end()


def ip_at(text: str, at: int, least: int) -> tuple[Span | None, int]:
    found = _IP.match(text, at)
    if not found:
        return None, _RUN.match(text, at).end()
    fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.groups())
    return (found.span() if fits else None), found.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def card_at(text: str, at: int, least: int) -> tuple[Span | None, int]:
    found = _CARD.match(text, at)
    if not found:
        return None, at + 1
    if found.end() - at > 38:  # 19 digits and their separators
        return None, found.end()
    digits = found.group().replace(" ", "").replace("-", "")
    fits = 14 <= len(digits) <= 19 and luhn(digits)
    return (found.span() if fits else None), found.end()


def phone_at(text: str, at: int, least: int) -> tuple[Span | None, int]:
    found = _PHONE.match(text, at)
    if not found:
        return None, at + 1
    body = found.group(1).rstrip(" ().-")
    if len(body) < 2:
        return None, at + 1
    digits = 1 + len(body.translate(_DIGITS_ONLY))
    end = at + 2 + len(body)
    return ((at, end) if 10 <= digits <= 15 else None), end


def url_at(text: str, at: int, least: int) -> tuple[Span | None, int]:
    found = _URL.match(text, at)
    if not found:
        return None, at + 1
    end = at + len(found.group().rstrip(".,;:!?)"))
    return (at, end), found.end()


def iban_valid(text: str) -> bool:
    packed = text.replace(" ", "")
    if not 15 <= len(packed) <= 34:
        return False
    turned = packed[4:] + packed[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def identifier_after(text: str, at: int) -> tuple[str, Span] | None:
    """The IBAN or other identifier that a cue ending at `at` announces."""
    found = _IBAN.match(text, at)
    if found and iban_valid(found.group(1)):
        return "iban", found.span(1)
    found = _ACCOUNT.match(text, at)
    if found and any(map(str.isdigit, found.group(1))):
        return "account", found.span(1)
    return None


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    email = ip = card = phone = url = other = 0
    lowered = text.lower()
    if len(lowered) != len(text):  # some capitals lower to two code points
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for last, (parser, size) in automaton().iter(lowered):
        at = last - size + 1
        if parser == 2:
            if at >= ip:
                span, ip = ip_at(text, at, ip)
                if span:
                    found.append((span[0], 1, span[1]))
            if at >= card:
                span, card = card_at(text, at, card)
                if span:
                    found.append((span[0], 2, span[1]))
        elif parser == 0:
            if at >= email:
                span, email = email_at(text, at, email)
                if span:
                    found.append((span[0], 0, span[1]))
        elif parser == 1:
            if at >= phone:
                span, phone = phone_at(text, at, phone)
                if span:
                    found.append((span[0], 3, span[1]))
        elif parser == 3:
            if at >= url:
                span, url = url_at(text, at, url)
                if span:
                    found.append((span[0], 4, span[1]))
        elif at >= other and (at == 0 or not text[at - 1].isalnum()):
            got = identifier_after(text, at + size)
            if got:
                found.append((got[1][0], KINDS.index(got[0]), got[1][1]))
                other = got[1][1]
    found.sort()
    return [(KINDS[k], start, end) for start, k, end in found]


def find_personal_data(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id and `found`, an array of (kind, start, end). One pass, no shuffle."""
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    element = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(element))], ["id", "found"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, found array<struct<kind:string,start:int,end:int>>").withColumnRenamed(
        "id", id_column
    )


def redact(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """The documents with every span replaced by its kind; overlapping spans become one mask, that of
    the first."""
    name = docs.schema[text_column].name

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        parts, at = [], 0
        for kind, start, end in spans(text):
            if start >= at:
                parts += [text[at:start], mask.format(kind=kind)]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(name)
            new = pa.array([hide(t) for t in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, name, new)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    as_text = lambda x: F.concat_ws(":", x.kind, x.start, x.end)
    base = F.filter("found", lambda x: x.kind.isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_column, *[count(k) for k in BASE],
        F.sha2(F.array_join(F.transform(base, as_text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", as_text), ",").alias("spans"),
    )


