"""Plain Python versions of the contracts, over whole texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def space_words(text):
    return SPACE_WORD.findall(text or "")


def alnum_words(text):
    return ALNUM_WORD.findall((text or "").translate(UP))


def contamination(docs, bench):
    windows = defaultdict(set)
    for item, text in bench:
        w = alnum_words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    lengths = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, items = alnum_words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        yield doc, len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)


def base_quality(text):
    words = space_words(text)
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(tri)
    repeat = {i + d for i, t in enumerate(tri) if count[t] > 1 for d in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n = len(words)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n


def shingles(text):
    w = space_words((text or "").translate(UP))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())


def components(docs):
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets):
        near = Counter(e for s in sets[d] for e in where[s])
        for e, k in near.items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            where[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeated(docs, width=20):
    seen = {}
    for d, t in sorted(docs):
        w = space_words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[i : i + width]), (d, i)) != (d, i):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def base_licenses(text):
    w = alnum_words(text)
    at = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at}))


def check_shards(rows, texts):
    """rows: doc_id, size, text_crc32, shard, slot."""
    sizes, slots = Counter(), defaultdict(list)
    for doc, size, crc, shard, slot in rows:
        raw = (texts[doc] or "").encode()
        assert size == len(raw) + 1 and crc == zlib.crc32(raw)
        sizes[shard] += size
        slots[shard].append(slot)
    for s, got in slots.items():
        assert sorted(got) == list(range(len(got))), s
    largest = max(r[1] for r in rows)
    mean = sum(sizes.values()) / 16
    assert all(abs(sizes[s] - mean) <= largest for s in range(16)), (mean, sizes)
