"""Plain Python versions of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def spaced_words(text):
    return SPACED.findall((text or "").translate(LOWER))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text) -> list[str]:
    text = text or ""
    only = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(only(v)) <= 19 and luhn(only(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(only(v)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def contamination(docs: dict, items: list[tuple]) -> dict:
    """doc_id: (words, hit words, sorted item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs.items():
        w, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def shingles(text, k: int = 5) -> frozenset:
    w = spaced_words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard(docs: dict) -> dict:
    """doc_id: (set size, smallest id that links lead to), from all pairs of sets that share a shingle."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    classes = {}
    for d in sorted(docs):
        if sets[d]:
            parent[root(d)] = root(classes.setdefault(sets[d], d))
    seen = defaultdict(list)
    for s, d in classes.items():
        shared = defaultdict(int)
        for t in s:
            for other in seen[t]:
                shared[other] += 1
            seen[t].append(d)
        for other, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in docs}


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def phrases(text):
    """(words, starts, labels)."""
    w = plain_words(text)
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    return len(w), sorted(i for i, _ in found), sorted({label for _, label in found})


def mix_targets(sources: dict) -> dict:
    """Words that each source should give, by sharing out again what is over a cap."""
    order = sorted((s for s in sources if s is not None)) + [s for s in sources if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sources.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sources[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sources[s] for s in over}
        left -= sum(2.0 * sources[s] for s in over)
        free -= over
    return out


def masked(text) -> str:
    """Base kinds of personal data replaced; spans that overlap are one."""
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in pii(text)))
    out, at, merged = [], 0, []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [(text or "")[at:a], f"<{k.upper()}>"]
        at = b
    return "".join(out) + (text or "")[at:]
