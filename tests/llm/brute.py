"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def removed(docs, min_len):
    """{id: (n_bytes, n_removed, n_spans, sha)} with every byte under a repeated window gone."""
    raws = {i: (t or "").encode() for i, t in docs}
    seen = Counter(r[p : p + min_len] for r in raws.values() for p in range(len(r) - min_len + 1))
    out = {}
    for i, r in raws.items():
        gone = bytearray(len(r))
        for p in range(len(r) - min_len + 1):
            if seen[r[p : p + min_len]] > 1:
                gone[p : p + min_len] = b"\1" * min_len
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a)
        out[i] = len(r), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()
    return out


def lpf(raw):
    """The longest match that starts earlier, for each position."""
    n = len(raw)

    def match(p, q):
        h = 0
        while q + h < n and raw[p + h] == raw[q + h]:
            h += 1
        return h

    return [max((match(p, q) for p in range(q)), default=0) for q in range(n)]


def simhash(text, width=4):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    """{id: smallest id reachable}."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
