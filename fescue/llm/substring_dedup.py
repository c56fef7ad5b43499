"""Near-duplicate passages across documents by compact windows (min-hash intervals of all subsequences of a text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, uncut

#: Words of a shingle, words of the shortest passage, and the least Jaccard similarity of two passages' shingles.
SHINGLE, PASSAGE, SIMILAR = 5, 50, 0.8
SHORTEST = PASSAGE - SHINGLE + 1
#: Fewest shingles of a passage that its near copy can have, and fewest that the two can have in common.
LEAST = int(np.ceil(SIMILAR * SHORTEST))
#: Shingles of a run that two similar passages share: of n shingles a ninth at most may differ, a changed word changes SHINGLE of
#: them, and what e changes leave of 45 e shingles or more has a stretch of 40 e / (e + 1) or more.
RUN = 20
#: A run's minimum has so many of its shingles on one side at least; they must be equal too, beside the minimum.
BESIDE = RUN // 2
#: Hash functions. The minimum of a shared run is the same in both texts under each of them, so one is enough for a run; the
#: others find pairs whose common shingles make no run of that length.
HASHES = 2
#: Shingles around the outermost shared minima that are compared.
AROUND = 64
#: Diagonals that one comparison covers.
BAND = 32
#: Shingles on either side of a minimum that members of a group are compared by, and members that one task compares at a time.
REACH, BLOCK = 60, 256
#: Members that are verified at a time.
FEW = 32
#: Length of a stretch that two members' surroundings must share to be compared in full; a few under SHORTEST, for the same slack.
NEARLY = SHORTEST - 4
#: What a shingle that only one of two texts has outweighs: 1 / (1 / SIMILAR - 1) = 4 of those that both have, less some slack.
SLACK = 3.75
#: Texts of a batch that share a key from which its rows are dealt into SALTS parts.
HOT, SALTS = 16, 64
#: Shingles that are worked on at a time; places within that many fit in POSITION bits.
CHUNK, POSITION = 1 << 19, 20
#: Steps of the doubling by which a window's ends are found; ends further than 2 ** LEVELS - 1 away need not be known.
LEVELS = 8
#: Two passages of a text that overlap by so many words are one.
OVERLAP = PASSAGE // 2

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = max(2 * n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, x in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """A hash of 64 bits of every SHINGLE consecutive words, with A-Z in lower case and any white space as one space."""
    flat = b" ".join(text.lower().split())
    if not flat:
        return np.empty(0, np.uint64)
    c = np.frombuffer(flat, np.uint8)
    space = np.flatnonzero(c == 32)
    if len(space) < SHINGLE - 1:
        return np.empty(0, np.uint64)
    up, down = _power(len(c) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], dtype=np.uint64)])
    start = np.concatenate([[0], space + 1])[: len(space) + 2 - SHINGLE]
    end = np.concatenate([space, [len(c)]])[SHINGLE - 1 :]
    return _mix((total[end] - total[start]) * down[start])


def windows(s: np.ndarray, least: int = SHORTEST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each hash function (key, place, left, right) of the compact windows of least shingles or more: the shingle at
    place has the smallest hash from left places before it to right places after it (255 at most are told). These are
    nodes of the hashes' Cartesian tree; every subsequence of least shingles lies in just one of them with its
    minimum. Places where s is 0 part texts; no window holds one."""
    out, n = [], len(s)
    low = np.uint64((1 << POSITION) - 1)
    at = np.arange(n, dtype=np.uint64)
    for j in range(HASHES):
        v = _mix(s + np.uint64(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        packed = (v & ~low) | at  # of equal hashes the first is the smaller
        packed[s == 0] = 0
        pad = np.zeros(1 << LEVELS, np.uint64)
        table = [np.concatenate([pad, packed, pad])]
        for p in range(LEVELS - 1):
            m = table[-1].copy()
            m[: -(1 << p)] = np.minimum(m[: -(1 << p)], m[1 << p :])
            table.append(m)
        top, base = least.bit_length() - 1, len(pad)
        end = base + least - (1 << top)
        lowest = np.minimum(table[top][base : base + n], table[top][end : end + n])
        change = np.flatnonzero((lowest != 0) & (lowest != np.concatenate([[np.uint64(0)], lowest[:-1]])))
        c = np.unique((lowest[change] & low).astype(np.int64))
        own, right, left = packed[c], c + base + 1, c + base
        for p in reversed(range(LEVELS)):
            right = np.where(table[p][right] > own, right + (1 << p), right)
            left = np.where(table[p][left - (1 << p)] > own, left - (1 << p), left)
        out.append(((v[c] & ~np.uint64(7)) | np.uint64(j), c, np.minimum(c + base - left, 255), np.minimum(right - c - base - 1, 255)))
    return out


class Content:
    """Hashes of stretches of s, equal where the stretches are."""

    def __init__(self, s: np.ndarray):
        step = 0xA24BAED4963EE407
        up, down = (np.full(len(s) + 1, x, np.uint64) for x in (step, pow(step, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(s * up[: len(s)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]


def seeds(s: np.ndarray, content: Content) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): for every compact window of RUN shingles or more the minimum together with the BESIDE shingles after it,
    and with those before it, where the window has them; the last bit tells the hash function. Texts with an equal run of RUN shingles share such a key."""
    high = np.uint64(0x9FB21C651E98DF25)
    keys, places = [], []
    for j, (key, c, left, right) in enumerate(windows(s, RUN)):
        for side, fits, start in ((1, right >= BESIDE, c), (2, left >= BESIDE, c - BESIDE)):
            a = start[fits]
            whole = _mix((content.of(a, a + BESIDE + 1) ^ key[fits]) * high + np.uint64(side))
            keys.append((whole & ~np.uint64(1)) | np.uint64(j))
            places.append(c[fits])
    return np.concatenate(keys), np.concatenate(places)


def _joined(schema: pa.Schema, *cols: np.ndarray) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)]


_ROW = pa.schema([("k", pa.int64()), ("salt", pa.int32()), ("t", pa.int64()), ("p", pa.int64()), ("sure", pa.bool_())])


def _rows(texts: DataFrame) -> DataFrame:
    """k, salt, t, p, sure: the seeds of all texts (t, text), a text that a task meets again once. Where HOT texts or more of a batch
    have a key, its rows but the first are dealt out by salt; all of them are sure, that is, known not to be alone."""

    def flush(held: list, owner: list, base: list) -> list[pa.RecordBatch]:
        s = np.concatenate(held)
        key, c = seeds(s, content := Content(s))
        who, first = np.concatenate(owner), np.concatenate(base)
        t, k = who[c], key.view(np.int64)
        order = np.lexsort((c, k))  # a text's places are neighbours in c
        k, t, c = k[order], t[order], c[order]
        p = c - first[c]
        # Where a text repeats the same stretch, as a line again and again, the first and the last place of the key stand for those between.
        mid = np.flatnonzero((k[2:] == k[:-2]) & (t[2:] == t[:-2]) & (c[2:] - c[1:-1] == c[1:-1] - c[:-2]) & (p[2:] - p[:-2] == c[2:] - c[:-2])) + 1
        mid = mid[content.of(c[mid - 1], c[mid]) == content.of(c[mid], c[mid + 1])]
        stay = np.ones(len(k), bool)
        stay[mid] = False
        k, t, p = k[stay], t[stay], p[stay]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        group = np.cumsum(new) - 1
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        sure = (np.bincount(group, fresh) >= HOT)[group]
        salt = np.where(sure & ~new, 1 + (_mix(t.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32), 0)
        held.clear(), owner.clear(), base.clear()
        return _joined(_ROW, k, salt.astype(np.int32), t, p, sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held, owner, base, size = [], [], [], 0
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if t in seen:
                    continue
                seen.add(t)
                s = shingles(text.as_py() or b"")
                s[s == 0] = 1
                # A text of over CHUNK shingles goes in parts that overlap, so that no window's worth is cut.
                step = CHUNK - 2 * (1 << LEVELS)
                for at in range(0, len(s), step):
                    part = s[at : at + CHUNK]
                    if len(part) < RUN or at and len(part) <= CHUNK - step:
                        continue
                    if size + len(part) + 1 > CHUNK + 1 and held:
                        yield from flush(held, owner, base)
                        size = 0
                    held += [part, np.zeros(1, np.uint64)]
                    owner.append(np.full(len(part) + 1, t))
                    base.append(np.full(len(part) + 1, size - at, np.int64))
                    size += len(part) + 1
        if held:
            yield from flush(held, owner, base)

    return texts.select("t", "text").mapInArrow(run, "k long, salt int, t long, p long, sure boolean")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of k, salt, t, p those that are sure or not the only text of their key; equal rows once."""
    schema = pa.schema([_ROW.field(x) for x in ("k", "t", "p")])
    held = None
    for batch in batches:
        cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in _ROW.names]
        cols = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        # The last text's rows of the last key wait for what comes next; of a text that all rows belong to, all wait.
        k, salt, t, p, sure = cols
        group = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]) | (salt[1:] != salt[:-1]) | (t[1:] != t[:-1])]))
        last = int(np.searchsorted(group, group[-1]))
        part = slice(0, last)
        held = [c[last:] for c in cols]
        if last:
            # A row that is not sure of its own may follow another text of the same key in the rows just passed.
            yield from _passed([c[part] for c in cols], (k[last], salt[last]), schema)
            if k[last - 1] == k[last] and salt[last - 1] == salt[last]:
                held[4] = np.ones(len(held[4]), bool)
    if held is not None:
        yield from _passed(held, None, schema)


def _passed(cols: list[np.ndarray], following: tuple | None, schema: pa.Schema) -> list[pa.RecordBatch]:
    k, salt, t, p, sure = cols
    same = (k[1:] == k[:-1]) & (salt[1:] == salt[:-1])
    new = np.concatenate([[True], ~same])
    group = np.cumsum(new) - 1
    texts = np.bincount(group, np.concatenate([[True], ~same | (t[1:] != t[:-1])]))
    known = np.bincount(group, sure) > 0
    if following is not None and (k[-1], salt[-1]) == following:
        known[-1] = True
    fresh = np.concatenate([[True], ~same | (t[1:] != t[:-1]) | (p[1:] != p[:-1])])
    stay = ((texts > 1) | known)[group] & fresh
    return _joined(schema, k[stay], t[stay], p[stay])


def members(texts: DataFrame) -> DataFrame:
    """k, t, p: the seeds that two texts or more share."""
    return _rows(texts).repartition("k", "salt").sortWithinPartitions("k", "salt", "t", "p").mapInArrow(_several, "k long, t long, p long")


def star(rows: DataFrame) -> DataFrame:
    """k, t, p, ot, op: every member of a key beside the key's first one, or beside its last one if it is of the first one's text."""
    ends = rows.groupBy("k").agg(F.min(F.struct("t", "p")).alias("x"), F.max(F.struct("t", "p")).alias("y")).where("x.t <> y.t")
    met = rows.join(ends, "k")
    return met.select("k", "t", "p", F.when(F.col("t") == F.col("x.t"), F.col("y")).otherwise(F.col("x")).alias("o")).select("k", "t", "p", F.col("o.t").alias("ot"), F.col("o.p").alias("op"))


def candidates(pairs: DataFrame) -> DataFrame:
    """ta, tb, a0, a1, b0, b1: places of the outermost shared minima of two texts in a band of diagonals."""
    swap = F.col("t") > F.col("ot")
    a, b = F.when(swap, F.col("op")).otherwise(F.col("p")), F.when(swap, F.col("p")).otherwise(F.col("op"))
    found = pairs.select(F.least("t", "ot").alias("ta"), F.greatest("t", "ot").alias("tb"), a.alias("a"), b.alias("b"))
    bands = found.groupBy("ta", "tb", F.floor((F.col("a") - F.col("b")) / BAND).alias("band"))
    return bands.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1")).drop("band")


def _longest(hit: np.ndarray, cost: float) -> tuple[int, int]:
    """Start and end of the longest stretch, from a hit to a hit, whose hits outweigh what is not hit, at cost each."""
    if hit.all():
        return 0, len(hit)
    total = np.zeros(len(hit) + 1)
    np.where(hit, -1.0, cost).cumsum(out=total[1:])
    # The first place from which the sum up to an end is not negative; lowest sums so far never rise (all with the other sign).
    start = np.maximum.accumulate(total).searchsorted(total)
    end = int((np.arange(len(total)) - start).argmax())
    first = int(start[end])
    found = hit[first:end].nonzero()[0]
    return (first + int(found[0]), first + int(found[-1]) + 1) if len(found) else (0, 0)


def _longest_of(hit: np.ndarray, n: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """_longest() of every row of hit, of which the first n places count: starts and ends."""
    rows, width = hit.shape
    at, apart = np.arange(width), 1e12
    total = np.zeros((rows, width + 1))
    np.cumsum(np.where(hit, 1.0, np.where(at < n[:, None], -cost, -1e9)), axis=1, out=total[:, 1:])
    # Rows lie so far apart that one search through all of them stays within each one.
    base = apart * np.arange(rows)[:, None]
    start = np.searchsorted((base - np.minimum.accumulate(total, axis=1)).ravel(), (base - total).ravel()).reshape(rows, -1)
    start -= (width + 1) * np.arange(rows)[:, None]
    end = np.argmax(np.arange(width + 1) - start, axis=1)
    found = hit & (at >= start[np.arange(rows), end][:, None]) & (at < end[:, None])
    some = found.any(axis=1)
    return np.where(some, found.argmax(axis=1), 0), np.where(some, width - found[:, ::-1].argmax(axis=1), 0)


def _held_in(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    at = values.searchsorted(x)
    return values[np.minimum(at, len(values) - 1, out=at)] == x


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted values of a short x, each once."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


#: What a shingle of one run only outweighs; the last takes the longest run without any.
COSTS = 4.0, 6.0, 8.0, 1e6


def verify(a: np.ndarray, b: np.ndarray, hit: np.ndarray | None = None) -> tuple[int, int, int, int, float] | None:
    """The passage that two runs of shingle hashes share: (start, end in a, start, end in b, Jaccard similarity), or None if
    there is none of SHORTEST shingles and SIMILAR. It is the longest run whose shared shingles outweigh the others, first where
    only one run has others, then where both have as many. hit tells which of a are in b, if that is known."""
    hit, tried = _held_in(a, _distinct(b)) if hit is None else hit, set()
    for cost in COSTS:
        a0, a1 = _longest(hit, cost)
        if a1 - a0 < LEAST or (a0, a1) in tried:
            continue
        tried.add((a0, a1))
        x = _distinct(a[a0:a1])
        b0, b1 = _longest(_held_in(b, x), cost)
        if max(a1 - a0, b1 - b0) < SHORTEST or b1 - b0 < LEAST:
            continue
        y = _distinct(b[b0:b1])
        common = int(np.count_nonzero(_held_in(y, x)))
        if common >= SIMILAR * (len(x) + len(y) - common):
            return a0, a1, b0, b1, common / (len(x) + len(y) - common)
    return None


def passages(a: np.ndarray, b: np.ndarray, over: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """All passages of a that b has a near copy of: the one that verify() gives, and those on both sides of it, on and on. A run that
    is no passage parts what is left and right of it in the same way. With over, only parts that hold that place are looked at."""
    out, left, every = [], [(0, len(a))], _held_in(a, _distinct(b))
    while left:
        lo, hi = left.pop()
        if hi - lo < LEAST or over is not None and not lo <= over < hi:
            continue
        part, hit = a[lo:hi], every[lo:hi]
        # A run of LEAST whose hits outweigh the rest at the lowest cost has this many of them.
        if np.count_nonzero(hit) * (1 + 1 / COSTS[0]) < LEAST:
            continue
        got = verify(part, b, hit)
        if got:
            out.append((lo + got[0], lo + got[1], *got[2:]))
            x, y = got[:2]
        else:
            x, y = _longest(hit, COSTS[2])
            if y - x < LEAST:
                continue
        left += [(lo, lo + x), (lo + y, hi)]
    return out


_LINK = "ta long, a0 long, a1 long, tb long, b0 long, b1 long, similarity double"


def _links(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    kinds = [pa.int64()] * 6 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["ta", "a0", "a1", "tb", "b0", "b1", "similarity"])


def _slices(source: DataFrame, ask: DataFrame, around: int, repeated: bool = True) -> DataFrame:
    """t, lo, hi, s: for each asked stretch of a text (t, lo, hi; rep, an id that has the text) its shingles and around more on both
    sides, as 32 bits each, so that they take no more room than the words. Unless source has repeated rows, each is there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            t, lo, hi, texts = batch.columns
            out = []
            for k, (i, x, y) in enumerate(zip(t.to_pylist(), lo.to_pylist(), hi.to_pylist())):
                if i != last:
                    last, known = i, (shingles(texts[k].cast(pa.binary()).as_py()) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                out.append(known[max(0, x - around) : y + around + 1])
            yield pa.RecordBatch.from_arrays([t, lo, hi, pa.array(out, pa.list_(pa.int32()))], names=["t", "lo", "hi", "s"])

    met = source.join(ask.select(F.col("t").alias("_t"), "rep", "lo", "hi"), (F.col("id") == F.col("rep")) & (F.col("t") == F.col("_t")))
    out = met.select("t", "lo", "hi", "text").mapInArrow(run, "t long, lo long, hi long, s array<int>")
    return out.dropDuplicates(["t", "lo", "hi"]) if repeated else out


def _compared(found: DataFrame, source: DataFrame, reps: DataFrame, repeated: bool = True) -> DataFrame:
    """The passages that the candidates' stretches share."""
    ask = found.select(F.col("ta").alias("t"), F.col("a0").alias("lo"), F.col("a1").alias("hi")).union(found.select("tb", "b0", "b1")).distinct()
    cuts = cut(_slices(source, ask.join(reps, "t"), AROUND, repeated), "slices")
    side = lambda n: cuts.select(F.col("t").alias(f"t{n}"), F.col("lo").alias(f"{n}0"), F.col("hi").alias(f"{n}1"), F.col("s").alias(f"s{n}"))
    both = found.join(side("a"), ["ta", "a0", "a1"]).join(side("b"), ["tb", "b0", "b1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb, a0, b0, sa, sb = batch.columns
            rows = []
            for k in range(batch.num_rows):
                x, y = max(0, a0[k].as_py() - AROUND), max(0, b0[k].as_py() - AROUND)
                for p in passages(sa[k].values.to_numpy(), sb[k].values.to_numpy()):
                    rows.append((ta[k].as_py(), x + p[0], x + p[1], tb[k].as_py(), y + p[2], y + p[3], round(p[4], 6)))
            yield _links(rows)

    out = cut(both.select("ta", "tb", "a0", "b0", "sa", "sb").mapInArrow(run, _LINK), "passages")
    uncut(cuts)
    return out


def _both_ways(links: DataFrame) -> DataFrame:
    """t, s0, s1, ot, o0, o1, similarity for each side of every link."""
    flat = lambda x, y: [F.col(f"t{x}").alias("t"), F.col(f"{x}0").alias("s0"), F.col(f"{x}1").alias("s1"), F.col(f"t{y}").alias("ot"), F.col(f"{y}0").alias("o0"), F.col(f"{y}1").alias("o1"), "similarity"]
    return links.select(*flat("a", "b")).union(links.select(*flat("b", "a")))


class _Block:
    """Members (t, p, class or None) of a key with the shingles around their minima."""

    def __init__(self, rows: list[tuple[int, int, int | None]], ctx: list[np.ndarray]):
        self.rows, self.ctx = rows, ctx
        self.t = np.array([r[0] for r in rows])
        known = {c: k for k, c in enumerate(sorted({r[2] for r in rows if r[2] is not None}))}
        self.label = np.array([len(known) + k if r[2] is None else known[r[2]] for k, r in enumerate(rows)])
        self.known = known
        self.values, at = np.unique(np.concatenate(ctx), return_inverse=True)
        none = len(self.values)
        # For each member the places of its shingles among the values, the minimum's in the middle, and which values it has.
        self.near = np.full((len(rows), 2 * REACH + 1), none)
        n = [len(c) for c in ctx]
        who = np.repeat(np.arange(len(rows)), n)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + REACH - np.minimum([r[1] for r in rows], REACH)[who]
        self.near[who, place] = at
        self.n = np.array(n)
        self.run = np.full((len(rows), 2 * REACH + 1), none)
        self.run[who, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)] = at
        self.has = np.zeros((len(rows), none + 1), bool)
        self.has[who, at] = True
        self.once = self.has.sum(axis=1) == self.n

    def places(self, ctx: np.ndarray) -> np.ndarray:
        """Where ctx's shingles are among the values; those that no member has stand behind the last."""
        at = np.searchsorted(self.values, ctx).clip(max=len(self.values) - 1)
        return np.where(self.values[at] == ctx, at, len(self.values))

    def shared(self, opened: list[np.ndarray]) -> np.ndarray:
        """How many of the shingles of each opened member (their places among the values) each member has, as one product of matrices."""
        used, at = np.unique(np.concatenate(opened), return_inverse=True)
        who = np.repeat(np.arange(len(opened)), [len(x) for x in opened])
        times = np.bincount(who * len(used) + at, minlength=len(opened) * len(used)).reshape(len(opened), -1)
        return times.astype(np.float32) @ self.has[:, used].T.astype(np.float32)

    def like(self, found: np.ndarray, q: int, ask: np.ndarray) -> np.ndarray:
        """Of the asked members those that may share a passage over place q of a context, whose places among the values are found: on a
        stretch of NEARLY or more over that place and the member's own, what is shared outweighs what only one of the two has, as it
        does where the similarity is SIMILAR, with some slack because words put in or left out shift the places after them."""
        none = len(self.values)
        spot = np.full(2 * REACH + 1, none)
        inside = slice(REACH - q, REACH - q + len(found))
        spot[inside] = found
        shared = self.has[ask[:, None], spot[None, :]]
        own = np.zeros(none + 1, bool)
        own[spot] = True
        own[none] = False
        near = self.near[ask]
        gain = np.where(shared, np.float32(1), np.float32(-SLACK)) - np.float32(SLACK) * ~own[near]
        gain[near == none] = -1e4
        gain[:, : inside.start] = gain[:, inside.stop :] = -1e4
        total = np.zeros((len(ask), 2 * REACH + 2), np.float32)
        np.cumsum(gain, axis=1, out=total[:, 1:])
        end = np.arange(REACH + 1, 2 * REACH + 2)
        lowest = np.minimum.accumulate(total, axis=1)
        return ask[(total[:, end] >= lowest[:, np.minimum(REACH, end - NEARLY)]).any(axis=1)]

    def open_to(self, found: np.ndarray, q: int, ask: np.ndarray) -> np.ndarray:
        """Of the asked members those that passages() has to look at: verify() is told for all at once, and a whole context that is no
        passage leaves nothing to look at where its longest run holds place q. Members that repeat a shingle are looked at; found must not."""
        none, at, rows = len(self.values), np.arange(2 * REACH + 1), len(ask)
        place = np.full(none + 1, -1)
        place[found] = np.arange(len(found))
        place[none] = -1
        hit, n, pos, run = self.has[ask[:, None], found[None, :]], np.full(rows, len(found)), place[self.run[ask]], self.n[ask]
        look, tried = ~self.once[ask], np.full((rows, 2), -1)
        for cost in COSTS:
            # Those that have to be looked at anyway need no further cost.
            left = np.flatnonzero(~look)
            if not len(left):
                break
            held = pos[left]
            a0, a1 = _longest_of(hit[left], n[left], cost)
            # A stretch under LEAST is none, and one that was tried at the cost before gives the same.
            fits = (a1 - a0 >= LEAST) & ((a0 != tried[left, 0]) | (a1 != tried[left, 1]))
            tried[left, 0], tried[left, 1] = a0, a1
            if cost == COSTS[2]:
                look[left] = (a1 - a0 >= LEAST) & ~((a0 <= q) & (q < a1))
            left, held, a0, a1 = left[fits], held[fits], a0[fits], a1[fits]
            if not len(left):
                continue
            met = (held >= a0[:, None]) & (held < a1[:, None])
            b0, b1 = _longest_of(met, run[left], cost)
            common = (met & (at >= b0[:, None]) & (at < b1[:, None])).sum(axis=1)
            la, lb = a1 - a0, b1 - b0
            look[left] |= (lb >= LEAST) & (np.maximum(la, lb) >= SHORTEST) & (common >= SIMILAR * (la + lb - common))
        return ask[look]

    def links(self, opened: list[tuple[int, int, int | None, np.ndarray]]) -> list[tuple]:
        """Links of the opened members (t, p, class, shingles), each with members that it is not joined with by those before. Members
        of a class are joined from the start."""
        at, out = {r[:2]: k for k, r in enumerate(self.rows)}, []
        found = [self.places(ctx) for *_, ctx in opened]
        enough = self.shared(found) >= LEAST
        for n, (t, p, c, ctx) in enumerate(opened):
            q, a = min(p, REACH), max(0, p - REACH)
            me = at.get((t, p))
            mine = {int(self.label[me])} if me is not None else {self.known[c]} if c in self.known else set()
            ask = np.flatnonzero(enough[n] & (self.t != t))
            ask = ask[~np.isin(self.label[ask], list(mine))] if len(ask) else ask
            ask = self.like(found[n], q, ask) if len(ask) else ask
            once = len(_distinct(ctx)) == len(ctx)
            while len(ask):
                # A few at a time: a link joins this member with all of a class, and they need not be asked any more.
                few, ask = ask[:FEW], ask[FEW:]
                for k in self.open_to(found[n], q, few).tolist() if once else few.tolist():
                    if int(self.label[k]) in mine:
                        continue
                    b, met = max(0, self.rows[k][1] - REACH), False
                    for x in passages(ctx, self.ctx[k], q):
                        if x[0] <= q < x[1]:
                            met = True
                            out.append((t, a + x[0], a + x[1], int(self.t[k]), b + x[2], b + x[3], round(x[4], 6)))
                    if met and me is not None:
                        self.label[self.label == self.label[k]] = self.label[me]
                    elif met:
                        mine.add(int(self.label[k]))
                ask = ask[~np.isin(self.label[ask], list(mine))] if len(ask) else ask
        return out


def _rest(pairs: DataFrame, named: DataFrame, source: DataFrame, reps: DataFrame, repeated: bool = True) -> DataFrame:
    """Links of members of a key, of those of the first hash function, whose passages are not of one class yet (named: t, lo, hi, label): those in no passage and those of
    other classes than the first are held against all members, a large key in blocks, so that each block of such members
    meets each block of all in a task."""
    cover = named.select(F.col("t").alias("_t"), "lo", "hi", "label")
    # Two passages of a text may both hold a place where they overlap a little.
    rows = pairs.where(F.col("k").bitwiseAND(1) == 0).join(cover, (F.col("t") == F.col("_t")) & F.col("p").between(F.col("lo"), F.col("hi") - SHINGLE), "left").groupBy("k", "t", "p").agg(F.min("label").alias("label"))
    rows = cut(rows, "labelled")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("label").alias("main"), F.max("label").alias("last"), F.count("label").alias("m")).where("n > 2 and (n > m or main <> last)")
    rows = rows.join(sizes.select("k", "n", "main"), "k").withColumn("open", ~F.col("label").eqNullSafe(F.col("main")) | F.col("label").isNull())
    count = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    blocks = rows.groupBy("k").agg(F.count_if("open").alias("u"), F.first("n").alias("n")).select("k", count("u").alias("bu"), count("n").alias("bn"))
    rows = rows.join(blocks, "k")
    dealt = lambda n: F.pmod(F.xxhash64("t", "p"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_of = rows.select("k", every("bu").alias("i"), dealt("bn").alias("j"), F.lit(0).alias("side"), "t", "p", "label")
    opened = rows.where("open").select("k", dealt("bu").alias("i"), every("bn").alias("j"), F.lit(1).alias("side"), "t", "p", "label")
    every_row = cut(all_of.union(opened), "dealt")
    ask = every_row.select("t", F.col("p").alias("lo"), F.col("p").alias("hi")).distinct()
    ctx = cut(_slices(source, ask.join(reps, "t"), REACH, repeated), "contexts")
    full = every_row.join(ctx.select("t", F.col("lo").alias("p"), "s"), ["t", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ctx, opened = None, [], [], []
        for batch in batches:
            out = []
            k, i, j, side, t, p, label = (batch.column(x).to_pylist() for x in ("k", "i", "j", "side", "t", "p", "label"))
            for n, s in enumerate(batch.column("s")):
                if (k[n], i[n], j[n]) != key:
                    if held and opened:
                        out += _Block(held, ctx).links(opened)
                    key, held, ctx, opened = (k[n], i[n], j[n]), [], [], []
                if side[n]:
                    opened.append((t[n], p[n], label[n], s.values.to_numpy()))
                else:
                    held.append((t[n], p[n], label[n]))
                    ctx.append(s.values.to_numpy())
            yield _links(out)
        if held and opened:
            yield _links(_Block(held, ctx).links(opened))

    met = full.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "side", "t", "p").mapInArrow(run, _LINK).distinct()
    swap = F.col("ta") > F.col("tb")
    flat = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("ta", "tb"), ("a0", "b0"), ("a1", "b1"), ("tb", "ta"), ("b0", "a0"), ("b1", "a1"))]
    out = cut(met.select(*flat, "similarity"), "rest")
    uncut(every_row, ctx)
    return out


def _spans(links: DataFrame, copies: DataFrame) -> DataFrame:
    """t, s0, s1, lo, hi: each linked stretch of words s0 to s1 and the passage lo to hi that it is part of. Stretches of a text that
    overlap by OVERLAP words or more are one passage. Equal stretches are counted before any is compared."""
    from pyspark.sql import Window

    told = _both_ways(links).select("t", "s0", (F.col("s1") + SHINGLE - 1).alias("s1")).union(copies.select("t", F.lit(0).cast("long"), "n_words")).distinct()
    order = Window.partitionBy("t").orderBy("s0", "s1")
    before = F.max("s1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("s0") > before - OVERLAP, F.lit(True)).cast("int")
    grouped = told.withColumn("new", new).withColumn("g", F.sum("new").over(order))
    own = Window.partitionBy("t", "g")
    return grouped.select("t", "s0", "s1", F.min("s0").over(own).alias("lo"), F.max("s1").over(own).alias("hi"))


def _classes(links: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(t, lo, hi, x, label) of every passage, its number x and its class; (x, n_links); (x, similarity)."""
    spans = cut(_spans(links, copies), "spans")
    # A passage is a node; its number is a hash of text and place.
    node = F.xxhash64("t", "lo", "hi")
    at = lambda n: spans.select(F.col("t").alias(f"t{n}"), F.col("s0").alias(f"{n}0"), (F.col("s1") - SHINGLE + 1).alias(f"{n}1"), node.alias(f"n{n}"))
    edges = links.join(at("a"), ["ta", "a0", "a1"]).join(at("b"), ["tb", "b0", "b1"]).select(F.col("na").alias("u"), F.col("nb").alias("v"))
    edges = cut(edges, "edges")
    reach = components(edges).withColumnRenamed("node", "x")
    degree = edges.select("u").union(edges.select("v")).groupBy(F.col("u").alias("x")).agg(F.count("*").alias("n_links"))
    best = _both_ways(links).groupBy("t", "s0", (F.col("s1") + SHINGLE - 1).alias("s1")).agg(F.max("similarity").alias("similarity"))
    likest = spans.join(best, ["t", "s0", "s1"]).groupBy(node.alias("x")).agg(F.max("similarity").alias("similarity"))
    named = spans.select("t", "lo", "hi", node.alias("x")).distinct().join(reach, "x", "left")
    return named.select("t", "lo", "hi", "x", F.coalesce("label", "x").alias("label")), degree, likest


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, class_id, n_links, rep_doc_id, rep_start_word, rep_end_word, similarity: a row for every document
    and passage of PASSAGE words or more of which another document holds a near copy (Jaccard similarity of the 5-word
    shingles SIMILAR or more), on both sides of each link.

    Passages that links join, directly or through others, form a class: class_id is its smallest document id, rep_* the first
    passage of that document in the class. n_links counts the verified links at the passage, between different texts;
    similarity is the highest of them (1 where the whole text is repeated). Equal texts are compared once, and each of their
    documents has the rows of its text; one of PASSAGE words or more is a passage as a whole. Places count words, ends
    exclusive. Links are those that join a class, not all pairs in it.

    Passages with an equal run of RUN shingles, among them all exact ones, are always compared with each other or through a
    third that is like both; passages this similar have such a run unless shingles differ singly. Passages that repeat
    within one document only are none; null and short texts have none. Rows without an id are left out, and repeated rows
    count once. An empty table gives none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    ids = cut(source.select("id", "t", F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n_words")).groupBy("id", "t", "n_words").agg(F.count("*").alias("times")), "ids")
    classes = cut(ids.groupBy("t").agg(F.min("id").alias("rep"), F.max("n_words").alias("n_words"), F.count("*").alias("n"), F.max("times").alias("times")), "texts")
    repeated = (classes.agg(F.max("times")).first()[0] or 0) > 1
    reps = classes.select("t", "rep")
    rows = cut(members(source), "members")
    pairs = cut(star(rows), "star")
    uncut(rows)
    found = cut(candidates(pairs), "candidates")
    first = _compared(found, source, reps, repeated)
    copies = classes.where((F.col("n") > 1) & (F.col("n_words") >= PASSAGE))
    more = _rest(pairs, _classes(first, copies)[0], source, reps, repeated)
    links = cut(first.union(more).distinct(), "links")
    uncut(found, pairs, first, more)
    named, degree, best = _classes(links, copies)
    whole = copies.select("t", F.lit(1.0).alias("one"))
    named = named.join(reps, "t").join(degree, "x", "left").join(best, "x", "left").join(whole, "t", "left")
    named = cut(named.select("t", "lo", "hi", "rep", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("one", "similarity").alias("similarity")), "named")
    heads = named.groupBy("label").agg(F.min(F.struct("rep", "lo", "hi")).alias("head"))
    out = ids.select("id", "t").join(named.join(heads, "label").drop("rep"), "t")
    return out.select(
        F.col("id").alias(id_col), F.col("lo").alias("start_word"), F.col("hi").alias("end_word"), F.col("head.rep").alias("class_id"), "n_links",
        F.col("head.rep").alias(f"rep_{id_col}"), F.col("head.lo").alias("rep_start_word"), F.col("head.hi").alias("rep_end_word"), "similarity",
    )
