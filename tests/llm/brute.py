"""Plain versions of the operators, for small tables."""

from collections import Counter, defaultdict

LEAST = -(1 << 63)


def key(doc_id):
    return LEAST if doc_id is None else doc_id


def windows(rows, n=35):
    """For each row, its words and which of them go."""
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((w, gone))
    return out


def later(rows, n=100):
    """For each row, its bytes and which of them go."""
    first = {}
    raw = [(t or "").encode() for _, t, *_ in rows]
    for (d, *_), b in zip(rows, raw):
        for i in range(len(b) - n + 1):
            s = b[i : i + n]
            first[s] = min(first.get(s, (key(d), i)), (key(d), i))
    out = []
    for (d, *_), b in zip(rows, raw):
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < (key(d), i):
                gone[i : i + n] = [True] * n
        out.append((b, gone))
    return out


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, similar=80):
    """For each row, its set's size and the smallest id that links reach; rows are documents of their own, a null id is larger than others."""
    sets = [shingles(t) for _, t, *_ in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * both >= similar * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least.get(find(i)) if s else d) for i, ((d, *_), s) in enumerate(zip(rows, sets))]
