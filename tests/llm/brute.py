"""Slow, plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None, k: int = 5) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def dedup_lines(docs: list[tuple], window: int = 3) -> dict[tuple, tuple[str | None, int, int]]:
    """(id, text) to (new text, lines, removed), for documents of distinct (id, text)."""
    lines, seen = {}, {}
    for doc in docs:
        parts: list[str] = []
        for part in (doc[1] or "").split("\n"):
            if parts and (not WORD.search(part) or not WORD.search(parts[-1])):
                parts[-1] += "\n" + part
            else:
                parts.append(part)
        lines[doc] = parts if WORD.search(doc[1] or "") else []
    result = {}
    for doc in sorted(lines, key=lambda d: (d[0] is not None, d[0])):
        parts = lines[doc]
        gone: set[int] = set()
        for i in range(len(parts) - window + 1):
            key = tuple(p.strip(" \t\n\x0b\x0c\r") for p in parts[i : i + window])
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone |= set(range(i, i + window))
        text = "\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else doc[1]
        result[doc] = (text, len(parts), len(gone))
    return result


def contained(docs: list[tuple], items: list[tuple], threshold: float = 0.8) -> set[tuple]:
    found = set()
    for item, text in items:
        own = set(shingles(text))
        if not own:
            continue
        k = len(next(iter(own)))
        for doc, body in docs:
            w = words(body)
            there = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            n = len(own & there)
            if n >= math.ceil(threshold * len(own) - 1e-9):
                found.add((doc, item, len(own), n))
    return found


def fingerprint(text: str | None, k: int = 3) -> int:
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return 0
    hashes = [xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n: int, linked) -> list[int]:
    """The smallest reachable index of each of n things."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = defaultdict(list)
    for i in range(len(w) - 7):
        runs[tuple(w[i : i + 8])].append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def lm(docs: list[tuple], mass: float) -> dict:
    """id to (n_tokens, n_known, train_tokens, base, score with exact levels)."""
    one, two = Counter(), Counter()
    stream = {d: [*words(t), "\0end"] for d, t in docs}
    for d, w in stream.items():
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            one.update(w)
            two.update(zip(["\0start", *w], w))
    total, distinct = sum(one.values()), len(one)
    one["\0start"] = one["\0end"]

    def read(c: int, least: int) -> float:
        if c < least:
            return 0.0
        level = 1 + int(math.log2(c / least) + 1e-9)
        return (least * 2 ** (level - 1) + least * 2**level - 1) / 2

    result = {}
    for d, w in stream.items():
        base = sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w)
        score = 0.0
        for u, v in zip(["\0start", *w], w):
            own, c = (read(one[v], 1) + 1) / (total + distinct + 1), read(one[u], 1)
            score += math.log10((min(read(two[u, v], 2), c) + mass * own) / (c + mass))
        result[d] = (len(w), sum(one[x] > 0 for x in w), total, base, score)
    return result


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def personal_data(text: str | None) -> list[tuple[str, int, int]]:
    found = []
    for i, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"\D", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), i, m.end()))
    return [(PII[i][0], a, b) for a, i, b in sorted(found)]


def first_fit(lengths: list[int], capacity: int = 2048) -> int:
    """Sequences that first fit needs, longest first."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        for i, left in enumerate(room):
            if left >= n:
                room[i] -= n
                break
        else:
            room.append(capacity - n)
    return len(room)
