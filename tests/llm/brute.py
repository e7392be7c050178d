"""Plain single-process versions of the operators, to hold results against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(docs: list[tuple[int, str | None]], length: int) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): bytes of strings that start in two places."""
    texts = [(d, (t or "").encode()) for d, t in docs]
    places = defaultdict(list)
    for k, (_, b) in enumerate(texts):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((k, p))
    starts = defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            for k, p in found:
                starts[k].append(p)
    out = []
    for k, (d, b) in enumerate(texts):
        mark = bytearray(len(b))
        for p in starts[k]:
            mark[p : p + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out.append((d, len(b), sum(mark), spans, sha(kept)))
    return sorted(out, key=repr)


def repeated_words(docs: list[tuple[int, str | None]], length: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256): words of windows that also start earlier; unique doc_ids."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: r[0]):
        words = (t or "").encode().split()
        mark = [False] * len(words)
        for p in range(len(words) - length + 1):
            window = tuple(words[p : p + length])
            if window in seen:
                mark[p : p + length] = [True] * length
            seen.add(window)
        out.append((d, len(words), sum(mark), sha(b" ".join(w for w, m in zip(words, mark, strict=True) if not m))))
    return sorted(out, key=repr)


def simhash(docs: list[tuple[int, str | None]], width: int = 3) -> list[tuple]:
    """(doc_id, fingerprint, component_id)."""
    prints = []
    for d, t in docs:
        words = (t or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    parent = {d: d for d, _ in prints}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d, f"{f:016x}", root(d)) for d, f in prints)


def personal_data(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, rank, kind, end) of the base kinds, by the plain patterns."""
    text, out = text or "", []

    def luhn(digits: str) -> bool:
        total = 0
        for k, d in enumerate(reversed(digits)):
            d = int(d) * (1 + k % 2)
            total += d - 9 * (d > 9)
        return total % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ]
    for rank, (kind, pattern, valid) in enumerate(kinds):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if valid(m.group())]
    return sorted(out)
