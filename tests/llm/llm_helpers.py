"""Brute-force versions that several tests share."""

from __future__ import annotations

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str | None, k: int) -> list[str]:
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])


def fingerprint(text: str | None, k: int = 3) -> int:
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, edges) -> dict:
    """Least node reachable, by plain search."""
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    root: dict = {}
    for n in sorted(nodes):
        todo = [n] if n not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += near[x]
    return root
