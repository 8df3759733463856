"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(edges) -> dict[int, int]:
    """The smallest node that each node of the edges reaches."""
    at = {x: x for e in edges for x in e}
    while True:
        after = dict(at)
        for a, b in edges:
            after[a] = after[b] = min(after[a], after[b])
        if after == at:
            return at
        at = after


def near_components(texts: dict[int, str], percent: int = 85) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = collections.defaultdict(list)
    for i in sorted(sets):
        overlap = collections.Counter(j for s in sets[i] for j in post[s])
        for j, n in overlap.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            post[s].append(i)
    return {i: find(i) for i in sets}


_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text: str) -> list[tuple[str, int, int]]:
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        return kind == "email" or (13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)

    return [(k, m.start(), m.end()) for k, p in _PII for m in re.finditer(p, text or "") if holds(k, m.group())]


def repeated(texts: dict[int, bytes], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i]
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, sha(kept))
    return out
