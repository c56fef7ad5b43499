"""Bytes that repeat: every stretch of a fixed length that also starts earlier in the corpus, found by sorting suffixes.

Suffixes are taken at anchors only. The anchor of a window of LEAST bytes is its leftmost least-hashed GRAM, so equal windows have
their anchors at the same offset, and what is equal to a window of a text is found among the suffixes of equal grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, released, shield, uncut

#: Bytes of a window and of the gram that anchors it; a window has REACH places where its anchor may begin.
LEAST, GRAM = 100, 24
REACH = LEAST - GRAM + 1
#: Bytes whose grams are hashed at a time.
CHUNK = 1 << 20
#: Suffixes of one gram that a task sorts together; a gram with more is parted by what stands around it.
GROUP = 20_000
#: Suffixes that are sorted in one call, in whole groups.
BATCH = 40_000
#: Words of eight bytes to which multikey quicksort goes; what is equal so far goes to a blind trie.
SHALLOW = 5

_ODD = 0x9E3779B97F4A7C15
_SALTS = 32


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of the GRAM bytes from each place on: of 8 bytes by doubling, then of three or so of these."""
    h, size = b.astype(np.uint64) + np.uint64(1), 1
    parts = {1: h}
    while size * 2 <= GRAM:
        h = h[: len(h) - size] * np.uint64(pow(_ODD, size, 1 << 64)) + h[size:]
        size *= 2
        parts[size] = h
    n, out, done = len(b) - GRAM + 1, 0, 0
    for size in sorted(parts, reverse=True):
        while GRAM - done >= size:
            out = out * np.uint64(pow(_ODD, size, 1 << 64)) + parts[size][done : done + n]
            done += size
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def lowest(h: np.ndarray) -> np.ndarray:
    """For each run of REACH hashes the place of the lowest, the leftmost of equal ones."""
    n, at, size = len(h) - REACH + 1, np.arange(len(h), dtype=np.int32), 1
    better = lambda a, b: np.where(h[b] < h[a], b, a)
    while size * 2 <= REACH:
        at = better(at[:-size], at[size:])
        size *= 2
    return better(at[:n], at[REACH - size : REACH - size + n])


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the windows of texts that stand end to end in b: places, and the first and last window start of each."""
    places, first, last = [], [], []
    ok = np.ones(len(b), bool)
    for back in range(1, LEAST):
        # No window starts where a text ends before the window does.
        ok[(ends - back)[ends >= back]] = False
    for at in range(0, len(b) - LEAST + 1, CHUNK):
        own = lowest(gram_hashes(b[at : at + CHUNK + LEAST - 1])) + at
        start = np.flatnonzero(ok[at : at + len(own)]) + at
        own = own[start - at]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, int)
        places.append(own[edge].astype(np.int64))
        first.append(start[edge])
        last.append(start[np.append(edge[1:], len(own)) - 1] if len(own) else start)
    if not places:
        return (np.empty(0, np.int64),) * 3
    p, a, z = map(np.concatenate, (places, first, last))
    # An anchor whose windows start on both sides of a chunk's end is one.
    new = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, int)
    return p[new], a[new], z[np.append(new[1:], len(p)) - 1] if len(p) else z


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """who, key (the gram's hash), ctx (a hash of all bytes that any window of the anchor has), at: ((place * 128 + lo) * 128 + hi)
    * 2 + own, with lo and hi the least and most bytes that a window has before the anchor, and own 1 if an earlier
    anchor of the same text has the same key and ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            off = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            raw = memoryview(text.buffers()[2] or b"")[int(off[0]) : int(off[-1])]
            off = off - off[0]
            b = np.frombuffer(raw, np.uint8)
            p, a, z = anchors(b, off[1:])
            if not len(p):
                continue
            doc = np.searchsorted(off, p, "right") - 1
            left, right = np.maximum(off[doc], p - REACH + 1), np.minimum(off[doc + 1], p + LEAST)
            digest = xxhash.xxh3_64_intdigest
            ctx = np.array([digest(raw[x:y], k) for x, y, k in zip(left.tolist(), right.tolist(), (p - left).tolist())], np.uint64).view(np.int64)
            key = _gram_keys(b, p)
            order = np.lexsort((p, ctx, key, doc))
            same = np.append(False, (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1]) & (ctx[order][1:] == ctx[order][:-1]))
            own = np.zeros(len(p), np.int64)
            own[order[same]] = 1
            at = (((p - off[doc]) * 128 + (p - z)) * 128 + (p - a)) * 2 + own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(key), pa.array(ctx), pa.array(at)], names=["who", "key", "ctx", "at"])

    return docs.select("who", "text").mapInArrow(run, f"who {_kind(docs)}, key long, ctx long, at long")


def _gram_keys(b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The hash of the gram at each of some places."""
    h = np.zeros(len(p), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(_ODD) + b[p + k] + np.uint64(1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _kind(df: DataFrame) -> str:
    return df.schema["who"].dataType.simpleString()


def quicksort(words: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows of words by the first most columns within each group (a run of equal values), by multikey quicksort of
    all groups at once: each part is split around a pivot in one column, and what equals it goes on in the next. Also the
    (start, end) of what is equal in all these columns."""
    order = np.arange(len(words))
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, int)
    end, depth, equal = np.append(start[1:], len(group)), np.zeros(len(start), int), []
    while True:
        many = end - start > 1
        deep = many & (depth == most)
        equal += zip(start[deep].tolist(), end[deep].tolist())
        go = many & ~deep
        start, end, depth = start[go], end[go], depth[go]
        if not len(start):
            return order, equal
        n = end - start
        part = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        value, pivot = words[order[at], depth[part]], words[order[start + n // 2], depth][part]
        side = part * 3 + (value == pivot) + 2 * (value > pivot)
        to = np.argsort(side, kind="stable")
        order[at] = order[at[to]]
        side = side[to]
        edge = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        start, end = at[edge], at[np.append(edge[1:], len(side)) - 1] + 1
        depth = depth[side[edge] // 3] + (side[edge] % 3 == 1)


def common(a: bytes, b: bytes, least: int = 0) -> int:
    """Length of the longest common prefix, known to be least or more."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    while most - least > 1:
        half = (least + most) // 2
        if a[least:half] == b[least:half]:
            least = half
        else:
            most = half
    return least


def blind_trie(strings: list[bytes], least: int) -> list[int]:
    """An order of the strings, all of one length and equal in their first least bytes. A node knows the place of the byte in which
    its strings differ and a child for each value of it. A string goes down by these bytes alone to some leaf, which it has
    as long a common prefix with as with any string; the length of that prefix tells where it branches off."""
    root: list = [-1, [0]]  # a leaf: its equal strings; an inner node: [place, {byte: child}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] >= 0:
            kids = node[1]
            node = kids.get(s[node[0]]) or next(iter(kids.values()))
        other = strings[node[1][0]]
        at = common(s, other, least)
        if at == len(s):
            node[1].append(i)
            continue
        above, node = None, root
        while 0 <= node[0] < at:
            above, node = node, node[1][s[node[0]]]
        if node[0] == at:
            node[1][s[at]] = [-1, [i]]
            continue
        new = [at, {other[at]: node, s[at]: [-1, [i]]}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def sort_suffixes(column: pa.BinaryArray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings within their groups and the common prefix of each with the one before it, 0 at a group's first."""
    n, width = len(column), -(-most // 8) * 8
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    size = np.diff(off)
    m = np.zeros((n, width), np.uint8)
    m[np.arange(width) < size[:, None]] = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    words = m.view(">u8").astype(np.uint64)
    # Strings are filled up with zeros, so of equal ones the shortest has to come first: it ends no run of longer ones.
    words = np.column_stack([words, size.astype(np.uint64)])
    order, equal = quicksort(words, group, SHALLOW)
    tail = np.column_stack([m, size.astype(np.uint8)])
    for a, b in equal:
        some = order[a:b]
        order[a:b] = some[blind_trie([r.tobytes() for r in tail[some]], 8 * SHALLOW)]
    x, y = order[1:], order[:-1]
    lcp = np.zeros(n, np.int64)
    for at in range(0, n - 1, BATCH):
        u, v = x[at : at + BATCH], y[at : at + BATCH]
        differ = np.column_stack([m[u] != m[v], np.ones(len(u), bool)]).argmax(axis=1)
        lcp[at + 1 : at + 1 + len(u)] = np.where(group[u] == group[v], np.minimum(differ, np.minimum(size[u], size[v])), 0)
    return order, lcp


def repeats(key: np.ndarray, at: np.ndarray, left: pa.BinaryArray, right: pa.BinaryArray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that also start at an earlier row with the same key. Rows stand by key and, within it, in the order of the corpus;
    low and high (exclusive) bound the bytes before the anchor that are looked at. Gives rows, and the first and end byte (in the
    row's text) of each run of such windows."""
    place, lo, hi = at >> 15, np.maximum((at >> 8) & 127, low), np.minimum((at >> 1) & 127, high - 1)
    by_right, lcp = sort_suffixes(right, key, LEAST)
    by_left, lcs = sort_suffixes(left, key, REACH - 1)
    rows, offsets = [], []
    run_right, run_left = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for o in range(int(lo.min(initial=REACH)), int(hi.max(initial=-1)) + 1):
        some = np.flatnonzero((lo <= o) & (o <= hi))
        if len(some) < 2:
            continue
        # Rows with the window's bytes from the anchor on in common stand together in one order, those before it in the other.
        run_right[by_right] = np.cumsum(lcp < LEAST - o)
        fresh = lcs < o
        if not o:
            fresh = np.append(True, key[by_left][1:] != key[by_left][:-1])
        run_left[by_left] = np.cumsum(fresh)
        _, first = np.unique(run_right[some] * (len(key) + 1) + run_left[some], return_index=True)
        later = np.ones(len(some), bool)
        later[first] = False
        rows.append(some[later])
        offsets.append(np.full(int(later.sum()), o))
    row, o = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, offsets))
    order = np.lexsort((o, row))
    row, o = row[order], o[order]
    edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (o[1:] != o[:-1] + 1))) if len(row) else np.empty(0, int)
    last = np.append(edge[1:], len(row))[: len(edge)] - 1
    return row[edge], place[row[edge]] - o[last], place[row[edge]] - o[edge] + LEAST


def _contexts(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """key, who, at, left, right for asks (who, key, at): the bytes before the anchor, backwards, and from it on. A text meets
    all that is asked of it once."""
    lists = asks.groupBy(F.col("who").alias("asked")).agg(F.collect_list(F.struct("key", "at")).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, who, left, right = [], [], [], [], []
            lists = batch.column(2)
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                text, mine = text.as_buffer(), lists[k].values
                held = np.frombuffer(text, np.uint8)
                key, at = mine.field(0).to_pylist(), mine.field(1).to_pylist()
                keys += key
                ats += at
                who += [k] * len(key)
                for x in at:
                    p = x >> 15
                    left.append(held[max(0, p - REACH + 1) : p][::-1].tobytes())
                    right.append(held[p : p + LEAST].tobytes())
            for at in range(0, len(keys), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part], pa.int64()), batch.column(0).take(pa.array(who[part], pa.int64())), pa.array(ats[part], pa.int64()), pa.array(left[part], pa.binary()), pa.array(right[part], pa.binary())],
                    names=["key", "who", "at", "left", "right"],
                )

    met = docs.join(lists, F.col("who") == F.col("asked")).select("who", "text", "asks")
    return met.mapInArrow(run, f"key long, who {_kind(docs)}, at long, left binary, right binary")


def _sorted_spans(members: DataFrame) -> DataFrame:
    """Spans of windows that repeat, from members (key, low, high, who, at, left, right) of which no key has more than GROUP."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BATCH:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if end:
                yield table.slice(0, end)
            held, n = table.slice(end).to_batches(), table.num_rows - end
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            (batch,) = table.combine_chunks().to_batches() or (None,)
            if batch is None:
                continue
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            row, start, end = repeats(*(col(c).to_numpy() for c in ("key", "at")), *(col(c).cast(pa.binary()) for c in ("left", "right")), *(col(c).to_numpy() for c in ("low", "high")))
            yield pa.RecordBatch.from_arrays([col("who").take(pa.array(row)), pa.array(start), pa.array(end)], names=["who", "start", "end"])

    cols = ["key", "low", "high", "who", "at", "left", "right"]
    dealt = members.select(*cols).repartition("key").sortWithinPartitions("key", "who", "at")
    return dealt.mapInArrow(run, f"who {_kind(members)}, start long, end long")


def _lo(at: Column) -> Column:
    return F.shiftright(at, 8).bitwiseAND(F.lit(127))


def _hi(at: Column) -> Column:
    return F.shiftright(at, 1).bitwiseAND(F.lit(127))


def _shared_spans(members: DataFrame) -> list[DataFrame]:
    """Spans of windows that repeat among members with the same key.

    A key with more than GROUP members is parted: the windows with fewer than half of the bytes before the anchor have the more
    of what follows it in common, the others the more of what precedes it, and each half has its own keys, made of these
    bytes. Halves are halved again; a key that is left with one offset has equal windows only, of which the first stays."""
    out, now = [], members.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(REACH).cast("long")})
    while True:
        size = now.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("high") - F.col("low")).alias("wide"))
        large = cut(size.where(F.col("n") > GROUP).select("key", "wide"), "large")
        if large.isEmpty():
            out.append(_sorted_spans(now.join(size.where("n > 1").select("key"), "key", "left_semi")))
            uncut(large)
            return out
        small = size.where((F.col("n") > 1) & (F.col("n") <= GROUP)).select("key")
        out.append(cut(_sorted_spans(now.join(small, "key", "left_semi")), "spans"))
        hot = now.join(large, "key")
        half = F.floor((F.col("low") + F.col("high")) / 2)
        hot = hot.withColumn("half", half)
        after, before = F.substring("right", F.lit(1), (LEAST + 1 - F.col("half")).cast("int")), F.substring("left", F.lit(1), F.col("half").cast("int"))
        lower = F.when((_lo(F.col("at")) < F.col("half")) & (_hi(F.col("at")) >= F.col("low")), F.struct(F.xxhash64("key", F.lit(0), after).alias("key"), F.col("low"), F.col("half").alias("high")))
        upper = F.when((_hi(F.col("at")) >= F.col("half")) & (_lo(F.col("at")) < F.col("high")), F.struct(F.xxhash64("key", F.lit(1), before).alias("key"), F.col("half").alias("low"), F.col("high")))
        rest = hot.where("wide > 1").select("who", "at", "left", "right", F.explode(F.array(lower, upper)).alias("x")).where("x is not null").select("x.key", "who", "at", "left", "right", "x.low", "x.high")
        # One offset: the window itself is the key.
        window = F.concat(F.substring("left", F.lit(1), F.col("low").cast("int")), F.lit(b"\0"), F.substring("right", F.lit(1), (LEAST - F.col("low")).cast("int")))
        equal = hot.where("wide = 1").select("who", "at", "low", F.xxhash64("low", window).alias("a"), F.xxhash64(F.lit(7), "low", window).alias("b"))
        equal = equal.withColumn("salt", F.pmod(F.xxhash64("who", "at"), F.lit(_SALTS)))
        first = equal.groupBy("a", "b").agg(F.min(F.struct("who", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
        later = equal.join(first, ["a", "b", "salt"]).where(F.struct("who", "at") > F.col("first"))
        start = F.shiftright("at", 15) - F.col("low")
        out.append(cut(later.select("who", start.alias("start"), (start + LEAST).alias("end")), "spans"))
        old, now = now, cut(rest, "parted")
        if hasattr(old, "_cut_path"):
            uncut(old)
        uncut(large)
        released(now.sparkSession)


def _kept(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept."""
    lists = spans.groupBy(F.col("who").alias("whose")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rest = [c for c in docs.columns if c not in ("who", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            texts, lists = batch.column(0).cast(pa.binary()), batch.column(1)
            for k, text in enumerate(texts):
                text, out, done, spans, removed = text.as_py() or b"", [], 0, 0, 0
                if lists[k].is_valid:
                    mine = lists[k].values
                    start, end = mine.field(0).to_numpy(), mine.field(1).to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    edge = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                    for a, z in zip(start[edge].tolist(), end[np.append(edge[1:], len(end)) - 1].tolist()):
                        out.append(text[done:a])
                        done, spans, removed = z, spans + 1, removed + z - a
                n_bytes.append(len(text))
                n_removed.append(removed)
                n_spans.append(spans)
                kept.append(b"".join(out) + text[done:])
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made, batch.column(0)], names=[*rest, "n_bytes", "n_removed", "n_spans", "kept", "text"])

    met = docs.join(lists, F.col("who") == F.col("whose"), "left").select("text", "spans", *[F.col(f"`{c}`") for c in rest])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return met.mapInArrow(run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary, text string")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (long) and kept (binary): the text's bytes (UTF-8) without each byte that is covered
    by a string of LEAST bytes which also starts earlier: in a document with a smaller id, or further ahead in the same one.
    Overlapping strings count, and strings are judged on the texts as they come in. n_spans counts maximal removed runs. Kept
    bytes need be no valid UTF-8.

    A null text counts as empty; shorter texts than LEAST keep all. A null id comes after all others. Different texts that share
    an id are different documents, in the order of a hash; rows equal in id and text are one document: each has the same
    result and none removes from another. Columns with other names pass unchanged, columns of docs named like the new
    ones are replaced. An empty table gives none.

    Anchors of all windows are taken from the texts twice: to sum up each gram, and to find those of grams that are there more than
    once. Anchors with all their bytes in common need no sorting: all but the first repeat. Of the rest the bytes are fetched, one
    anchor for each kind of surroundings, and sorted by what follows and by what precedes, gram by gram."""
    docs, back = shield(docs, id_col, text_col)
    spark, same = docs.sparkSession, F.col(f"`{id_col}`")
    docs = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    twice = not docs.groupBy(same.alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").isEmpty()
    who = F.struct(same.isNull().alias("none"), same.alias("id"), F.xxhash64("__text").alias("x")) if twice else same
    texts = docs.select(who.alias("who"), F.col("__text").alias("text"))
    if twice:
        texts = texts.dropDuplicates(["who"])
    rows = _anchor_rows(texts.where(F.octet_length("text") >= LEAST))
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ctx").alias("a"), F.max("ctx").alias("b"), F.min("who").alias("first")).where("n > 1")
    met = rows.join(keys.select("key", "first", (F.col("a") < F.col("b")).alias("mixed")), "key")
    own = F.col("at").bitwiseAND(F.lit(1)) == 1
    marked = cut(met.where(own | F.col("mixed") | (F.col("who") > F.col("first"))).select("who", "key", "ctx", "at", (own | ~F.col("mixed")).alias("sure")), "marked")
    released(spark)
    mixed = marked.where("not sure")
    firsts = mixed.groupBy("key", "ctx").agg(F.min("who").alias("first"), F.count("*").alias("n"))
    asks = cut(mixed.join(firsts, ["key", "ctx"]).select("who", "key", "at", (F.col("who") > F.col("first")).alias("sure")), "asks")
    place = F.shiftright("at", 15)
    span = lambda df: df.select("who", (place - _hi(F.col("at"))).alias("start"), (place - _lo(F.col("at")) + LEAST).alias("end"))
    members = cut(_contexts(texts, asks.where("not sure").select("who", "key", "at")), "contexts")
    released(spark)
    spans = span(marked.where("sure")).union(span(asks.where("sure")))
    for part in _shared_spans(members):
        spans = spans.union(part)
    spans = cut(spans.select("who", "start", "end"), "spans")
    uncut(marked, asks, members)
    released(spark)
    named = docs.withColumn("who", who).withColumnRenamed(text_col, "__raw").withColumnRenamed("__text", "text")
    out = _kept(named.withColumnRenamed(id_col, "__id"), spans)
    return back(out.withColumnRenamed("__id", id_col).drop("text").withColumnRenamed("__raw", text_col), ["n_bytes", "n_removed", "n_spans", "kept"])
