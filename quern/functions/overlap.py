"""Near copies among ordered bags of words."""

from __future__ import annotations

from collections import Counter, defaultdict

RATIO = 0.7


def near_earlier(bags: list[set[str]], ratio: float = RATIO, kept_only: bool = True) -> list[bool]:
    """Whether each bag shares more than `ratio` of the smaller one's words with one before it, of those kept so far or of all.

    Two bags that share so much share one of the smaller one's rarest words, so many as `ratio` leaves out: those are looked up in
    lists of the bags that hold a word, or hold it among their own rarest ones, and only bags found there are compared.
    """
    seen = Counter(w for b in bags for w in b)
    holding, rare = defaultdict(list), defaultdict(list)
    out = []
    for i, bag in enumerate(bags):
        words = sorted(bag, key=lambda w: (seen[w], w))
        rarest = words[: len(words) - int(ratio * len(words))]
        tried: set[int] = set()

        def near(k: int) -> bool:
            if k in tried:
                return False
            tried.add(k)
            return len(bag & bags[k]) > ratio * min(len(bag), len(bags[k]))

        found = any(near(k) for w in rarest for k in holding[w]) or any(near(k) for w in words for k in rare[w])
        out.append(found)
        if not (found and kept_only):
            for w in words:
                holding[w].append(i)
            for w in rarest:
                rare[w].append(i)
    return out
