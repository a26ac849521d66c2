"""Plain versions of the operators, for small tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest node that can be reached, for every node."""
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {n: top(n) for n in nodes}


def exact(rows):
    """doc id -> (keep id, group size, kept, sha256 of the text without blanks)."""
    classes = defaultdict(list)
    for number, text in rows:
        classes[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), number))
    return {number: (min(some)[1], len(some), number == min(some)[1], hashlib.sha256(body.encode()).hexdigest())
            for body, some in classes.items() for _, number in some}


def without_repeats(texts, window):
    """Per text: bytes, removed bytes, spans, what is kept."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i: i + window] for b in bodies for i in range(len(b) - window + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i: i + window]] > 1:
                gone[i: i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def packed(ids):
    """Pieces of (doc, ids with the end id) in order: doc, start, length, crc32, doc tokens, sequence, offset."""
    out, place = [], 0
    for number, some in ids:
        at = 0
        while at < len(some):
            n = min(len(some) - at, 2048 - place % 2048)
            out.append((number, at, n, zlib.crc32(struct.pack(f"<{n}I", *some[at: at + n])), len(some), place // 2048,
                        place % 2048))
            at, place = at + n, place + n
    return out
