"""Plain Python versions of what SQL cannot say."""
from collections import defaultdict


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similar(texts, threshold=0.8):
    """For a list of texts: links per text, and for each text the smallest place of its connected class."""
    sets = [shingles(t) for t in texts]
    holders, common = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            for j in holders[x]:
                common[j, i] += 1
            holders[x].append(i)
    links, up = [0] * len(texts), list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, j), c in common.items():
        if c >= threshold * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return links, [top(i) for i in range(len(texts))]
