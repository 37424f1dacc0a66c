"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

UPPER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def near_groups(texts, size=5, percent=80):
    sets, groups = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets[i] = {tuple(w[p : p + size]) for p in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    post = defaultdict(list)
    for i, s in sets.items():
        groups[i] = i
        for x in s:
            post[x].append(i)

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    both = Counter((a, b) for p in post.values() for a in p for b in p if a < b)
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            groups[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def line_dedup(texts, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(UPPER)
    holders = defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), sha("\n".join(keep)))
    return out


def repeated_words(texts, n=50):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][p : p + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone.update(range(p, p + n))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repeated_bytes(texts, n=400):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[p : p + n] for b in raw.values() for p in range(len(b) - n + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def contamination(texts, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        for p in range(max(0, len(w) - n) + 1) if w else ():
            windows[tuple(w[p : p + n])].add(str(k))
    out = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if ids := windows.get(tuple(w[p : p + size])):
                    hit.update(range(p, p + size))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
