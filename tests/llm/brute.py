"""Plain versions of the operators, for small inputs."""

import collections
import re

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, low=False):
    raw = (text or "").encode()
    return (raw.translate(LOW) if low else raw).split()


def without_repeats(texts, window):
    """For each text (words, words that go)."""
    split = [words(t) for t in texts]
    counts = collections.Counter(tuple(w[k:k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out.append((w, gone))
    return out


def cut_text(text, window_gone):
    """The text without its removed words and the white space behind each run of them."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    kept, place, k = [], 0, 0
    while k < len(spans):
        if window_gone[k]:
            kept.append(raw[place:spans[k][0]])
            while k < len(spans) and window_gone[k]:
                k += 1
            place = spans[k][0] if k < len(spans) else len(raw)
        else:
            k += 1
    return b"".join([*kept, raw[place:]]).decode()


def shingles(text, n):
    w = words(text, low=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def groups(texts, n, percent):
    """The number of the first text of each text's group."""
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        both = collections.Counter(j for g in s for j in holders[g])
        for j, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in s:
            holders[g].append(i)
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


def boilerplate(rows, min_sites=5, min_chars=12):
    """Boilerplate lines of (site, text) rows."""
    found = collections.defaultdict(lambda: (set(), set(), set()))
    for site, text in rows:
        text = text or ""
        origin = max(re.split(r"[\x20\x09-\x0D]", text), key=lambda w: (len(w), w.encode()))
        for line in text.split("\n"):
            line = line.strip(" \t\r\f\x0b")
            if len(line) >= min_chars:
                sites, whole, origins = found[line]
                if site is not None:
                    sites.add(site)
                whole.add(text)
                origins.add(origin)
    return {x for x, (s, t, o) in found.items() if len(s) >= min_sites and len(o) >= min_sites and 2 * len(o) >= len(t)}


def without_lines(text, gone):
    return "\n".join(x for x in (text or "").split("\n") if x.strip(" \t\r\f\x0b") not in gone)


def kept_by_rules(text):
    w = words(text)
    n = len(w)
    counts = collections.Counter(tuple(w[k:k + 8]) for k in range(n - 7))
    again = [False] * n
    for k in range(n - 7):
        if counts[tuple(w[k:k + 8])] > 1:
            again[k:k + 8] = [True] * 8
    repeat = sum(again)
    chars = sum(len(x.decode()) for x in w)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = len(lines) - len(set(lines))
    shouts = sum(x.endswith(b"!") for x in w)
    top = max(collections.Counter(w).values(), default=0)
    base = n < 20 or 100 * repeat > 30 * n
    other = 10 * symbols > chars or len(lines) >= 4 and 100 * dup > 30 * len(lines) or 2 * shouts > n or n >= 20 and 100 * top > 25 * n
    return (n, chars, symbols, dup, repeat), base, not (base or other)
