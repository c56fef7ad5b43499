"""Plain versions of the text operators, for small tables only."""

import collections
import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rows that every operator must take: nulls, empty and blank texts, repeats, ties, a long text, other scripts.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One Line\none line \n\nÉtat ÉTAT"), (4, "One Line\none line \n\nÉtat ÉTAT"), (5, "a b c a b c a b c"), (6, "x" * 5000),
    (7, " ".join(f"w{i % 977}" for i in range(6000))), (8, "日本語 テキスト 12345 's don't\r\n\x0b end"), (None, "a row without an id"), (-9, "negative\nid"), (10, "<|endoftext|> & # $ | %"),
]


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def line_dedup(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or found[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_rules(t):
    t = t or ""
    w = WORD.findall(t)
    n, found = len(w), collections.Counter(zip(w, w[1:], w[2:]))
    cover = {k + j for k in range(n - 2) if found[tuple(w[k : k + 3])] > 1 for j in range(3)}
    said = [x for x in t.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(said) - len(set(said)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def jump(key, n):
    key, b, j = (key or 0) % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def fingerprint(t):
    w = WORD.findall((t or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, most=4):
    fp = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{fp[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]


def crc_fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def edit_within(item, text, most):
    """Fewest edits of the whole item against any part of text, if they are most or fewer."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row) if min(row) <= most else None
