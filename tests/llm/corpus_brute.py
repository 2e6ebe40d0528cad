"""Plain versions of the operators' results, in Python over lists of rows."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def near(rows: list[tuple]) -> dict:
    """doc_id -> (set size, smallest reachable id), by comparing every pair that shares a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders: dict = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = {(a, b) for held in holders.values() for i, a in enumerate(held) for b in held[:i]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def repeats(rows: list[tuple], length: int = 35) -> list[tuple]:
    cut = [(d, WORD.findall(t or "")) for d, t in rows]
    count: dict = {}
    for _, w in cut:
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            count[k] = count.get(k, 0) + 1
    out = []
    for d, w in cut:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def luhn(value: str) -> bool:
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= sum(c.isdigit() for c in v) <= 19 and luhn(v)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
)


def personal(text: str | None) -> list[tuple[str, int, int]]:
    return [(kind, m.start(), m.end()) for kind, pattern, good in PATTERNS for m in re.finditer(pattern, text or "") if good(m.group())]


def words_for_overlap(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))


def overlaps(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id) by laying every item along every document."""
    out = set()
    for d, t in docs:
        w = words_for_overlap(t)
        for i, u in items:
            v = words_for_overlap(u)
            n, allowed = (13, 2) if len(v) >= 13 else (len(v), 0)
            if v and any(
                sum(x != y for x, y in zip(w[a:a + n], v[b:b + n], strict=True)) <= allowed
                for b in range(len(v) - n + 1) for a in range(len(w) - n + 1)):
                out.add((d, i))
    return out
