"""Plain single-machine versions that the operators are held against."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def rule_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def fingerprint(text: str | None, size: int = 3) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int | None]]:
    """(id, fingerprint, smallest id reachable over links of three bits or fewer), per row."""
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(docs):
        known = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(known) if known else None
    return [(d, prints[i], least[find(i)]) for i, (d, _) in enumerate(docs)]


def nearest(rows: dict[int, np.ndarray], queries: list[int], k: int) -> list[tuple[int, int, int, float]]:
    out = []
    for q in queries:
        scored = []
        for v, x in rows.items():
            if v != q:
                s = 0.0
                for a, b in zip(rows[q], x, strict=True):
                    s += float(a) * float(b)
                scored.append((-s, v))
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(sorted(scored)[:k])]
    return out


def targets(sizes: dict[str | None, int], share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Targets by repeated resharing of what exceeds the caps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    capped: set = set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        goal = {s: cap * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        capped |= over
