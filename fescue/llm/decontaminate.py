"""Benchmark passages in documents, edits allowed: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, and edits allowed for each character of an item.
Q, EDITS = 6, 0.1
#: Characters of items that one pass holds; a larger benchmark takes several passes over the documents.
ITEM_CHARS = 4_000_000
#: Characters of documents that are counted at a time.
CHUNK = 1 << 20
#: Share of the grams an item must share that may be left uncounted, the most frequent of its grams first.
SPARED = 0.5

_TABLE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower case, one space for each run of white space, none at the ends."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of 64 bits of the q characters that begin at each place."""
    n = len(c) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = c[:n].astype(np.uint64)
    for j in range(1, q):
        h *= np.uint64(0x100000001B3)
        h += c[j : j + n]
    h *= _ODD
    return h ^ (h >> np.uint64(29))


@dataclass
class Item:
    item_id: int
    text: np.ndarray
    edits: int
    need: int


class Index:
    """The grams of some items: where each is found (items, places), and how many an item must share."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q, self.items, keys, who, place = q, [], [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            c = codes(normal(text))
            if not len(c):
                continue
            g, k = grams(c, q), int(len(c) * edits)
            if len(g) - k * q < 1:
                # One edit changes q grams at most, so the bound says nothing here. Of k + 1 pieces, k edits leave one as it is.
                edge = [len(c) * j // (k + 1) for j in range(k + 2)]
                for a, b in zip(edge, edge[1:]):
                    pieces.setdefault(b - a, []).append((int(grams(c[a:b], b - a)[0]), len(self.items), a))
                self.items.append(Item(item_id, c, k, np.iinfo(np.int64).max))
                continue
            keys.append(g)
            who.append(np.full(len(g), len(self.items), np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
            self.items.append(Item(item_id, c, k, len(g) - k * q))
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        who = np.concatenate(who) if who else np.empty(0, np.int32)
        place = np.concatenate(place) if place else np.empty(0, np.int32)
        if len(key):
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            stay = np.ones(len(key), bool)
            for i, item in enumerate(self.items):
                if item.need == np.iinfo(np.int64).max:
                    continue
                own = np.flatnonzero(who == i) if len(self.items) < 64 else np.arange(np.searchsorted(who, i), np.searchsorted(who, i + 1))
                spare = own[np.argsort(-n[at[own]], kind="stable")][: int(item.need * SPARED)]
                spare = spare[n[at[spare]] > 1]
                # A gram that is not counted lowers what the item must share by one.
                stay[spare] = False
                item.need -= len(spare)
            key, who, place = key[stay], who[stay], place[stay]
        order = np.argsort(key, kind="stable")
        key, self.who, self.place = key[order], who[order], place[order]
        self.keys, self.first = np.unique(key, return_index=True)
        self.first = np.append(self.first, len(key))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _TABLE_BITS)] = True
        self.longest = max((len(x.text) + 2 * x.edits for x in self.items), default=0)
        self.edits = np.array([x.edits for x in self.items], np.int64)
        self.need = np.array([x.need for x in self.items], np.int64)
        self.pieces = {n: (np.array([h for h, _, _ in found], np.uint64), [(i, a) for _, i, a in found]) for n, found in ((n, sorted(x)) for n, x in pieces.items())}

    def short(self, c: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of items whose bound says nothing: where a piece stands, the item is held against the text."""
        out, starts = [], {}
        for n, (keys, owners) in self.pieces.items():
            g = grams(c, n)
            first = np.searchsorted(keys, g)
            for at in np.flatnonzero(keys[first.clip(max=len(keys) - 1)] == g).tolist():
                k = int(first[at])
                while k < len(keys) and keys[k] == g[at]:
                    i, offset = owners[k]
                    starts.setdefault(i, set()).add(at - offset)
                    k += 1
        for i, places in starts.items():
            m, edits = len(self.items[i].text), self.items[i].edits
            at = np.array(sorted(places))
            if not edits:
                at = at[np.all(c[at[:, None] + np.arange(m)] == self.items[i].text, axis=1)]
                out += [(i, a, a + m, 0) for a in at.tolist()]
            else:
                for a in at.tolist():
                    out += [(i, *x) for x in best(self.items[i].text, c, a, a, edits)]
        return out

    def regions(self, c: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) where bands share enough grams. A band of an item spans twice its allowed shift
        plus two diagonals and overlaps the next by half; it is counted as two neighbouring cells."""
        g = grams(c, self.q)
        at = np.flatnonzero(self.table[g >> np.uint64(64 - _TABLE_BITS)]) if len(self.keys) else np.empty(0, np.int64)
        if not len(at):
            return []
        found = np.searchsorted(self.keys, g[at]).clip(max=len(self.keys) - 1)
        real = self.keys[found] == g[at]
        at, found = at[real], found[real]
        n = self.first[found + 1] - self.first[found]
        total = int(n.sum())
        if not total:
            return []
        where = np.repeat(self.first[found] - np.cumsum(n) + n, n) + np.arange(total)
        item, diagonal = self.who[where].astype(np.int64), np.repeat(at, n) - self.place[where] + self.longest
        width = 2 * self.edits[item] + 1
        cells = (len(c) + 2 * self.longest) + 2
        key = item * cells + diagonal // width
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cell, count = key[edge], np.diff(np.append(edge, len(key)))
        both = count.copy()
        near = np.flatnonzero(cell[1:] == cell[:-1] + 1)
        both[near] += count[near + 1]
        hit = np.flatnonzero(both >= self.need[cell // cells])
        out = []
        for k in hit.tolist():
            i, band = divmod(int(cell[k]), cells)
            w = 2 * int(self.edits[i]) + 1
            low, high = band * w - self.longest, (band + 2) * w - 1 - self.longest
            if out and out[-1][0] == i and low <= out[-1][2] + 1:
                out[-1] = (i, out[-1][1], high)
            else:
                out.append((i, low, high))
        return out


def _last_row(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """Edits that take the whole item to a part of text that ends at place low - most + len(item) + d, for each d, on diagonals
    low - most to high + most."""
    low, high = low - most, high + most
    width, m = high - low + 1, len(item)
    padded = np.zeros(width + m + 1, np.uint32)
    a, b = max(low, 0), min(high + m + 1, len(text))
    # Cell d of row i: the first i characters of the item against the text up to diagonal low + d.
    big, steps = np.int64(1 << 30), np.arange(width, dtype=np.int64)
    if b <= a:
        return np.full(width, big)
    padded[a - low : b - low] = text[a:b]
    ends = steps + low
    row = np.where((ends >= 0) & (ends <= len(text)), 0, big)
    for i in range(m):
        after = row + (padded[i : i + width] != item[i])
        after[:-1] = np.minimum(after[:-1], row[1:] + 1)
        after = np.where((ends + i + 1 >= 0) & (ends + i + 1 <= len(text)), after, big)
        row = np.minimum.accumulate(after - steps) + steps
    return row


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the whole item that ends in text, on diagonals low - most to high + most; None if it
    takes more than most edits. Of equals the one that ends first."""
    row = _last_row(item, text, low, high, most)
    at = int(np.argmin(row))
    return (int(row[at]), low - most + at + len(item)) if row[at] <= most else None


def best(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the matches on these diagonals, the fewest edits first and of equals the one that ends first, without
    those that end so near a better one that they must overlap it."""
    row, m, out, taken = _last_row(item, text, low, high, most), len(item), [], []
    for d in sorted(np.flatnonzero(row <= most).tolist(), key=lambda d: (row[d], d)):
        e, near = low - most + d + m, bisect_left(taken, d)
        if any(abs(x - d) < m - most for x in taken[max(0, near - 1) : near + 1]):
            continue
        taken.insert(near, d)
        # Backwards from its end, the match's start is found in the same way.
        back = text[max(0, e - m - most) : e][::-1]
        out.append((e - align(item[::-1], back, -most, most, most)[1] if row[d] else e - m, e, int(row[d])))
    return out


def matches(c: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) in one text; texts of over CHUNK characters in pieces that overlap by the longest match."""
    out, step, lap = set(), CHUNK, index.longest + index.q
    for base in range(0, max(len(c), 1), step):
        part = c[base : base + step + lap]
        found = index.short(part)
        for i, low, high in index.regions(part):
            found += [(i, *x) for x in best(index.items[i].text, part, low, high, index.items[i].edits)]
        out |= {(i, base + start, base + end, n) for i, start, end, n in found}
        if base + step >= len(c):
            break
    # Of matches of one item that overlap, as neighbouring bands or pieces may give, the best is the match.
    kept: list[tuple[int, int, int, int]] = []
    for i, group in groupby(sorted(out, key=lambda m: (m[0], m[3], m[1], m[2])), key=lambda m: m[0]):
        spans: list[tuple[int, int]] = []
        for _, start, end, n in group:
            at = bisect_left(spans, (start, end))
            if (at and spans[at - 1][1] > start) or (at < len(spans) and spans[at][0] < end):
                continue
            spans.insert(at, (start, end))
            kept.append((index.items[i].item_id, start, end, n))
    return sorted(kept)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of ITEM_CHARS characters; the driver holds one block at a time."""
    held, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator():
        if held and size + len(row[1]) > ITEM_CHARS:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edits: float = EDITS) -> DataFrame:
    """id_col, item_col, doc_start, doc_end, edits: where a document holds a whole benchmark item with at most edits times
    its length of characters inserted, deleted or replaced. Places are characters of the text in normal form (lower case,
    white space as single spaces).

    An item of m characters within k edits of a passage shares m - q + 1 - k * q grams with it or more, on diagonals that
    lie 2k apart at most. Where that number is below 1 (items of fewer than q characters, or of 10 and 11 with the given
    values), one of k + 1 pieces of the item stands in the passage unchanged, and is looked for. A text that holds an item
    several times has a row for each; of matches of one item that overlap only the best counts. Null and empty texts hold no items, null ids are returned as they are, and repeated rows have
    their matches repeated. With an empty benchmark nothing is found. The benchmark travels in blocks of ITEM_CHARS
    characters."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, doc_start long, doc_end long, edits int"
    spark, found = docs.sparkSession, None
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for block in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(Index(block, q, edits))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            gap = np.zeros(index.longest + index.q, np.uint32)
            for batch in batches:
                rows, held, size = [], [], 0

                def flush() -> None:
                    """Short texts are searched together, parted by more blanks than a match may skip."""
                    at, parts, marks = 0, [], []
                    for doc, c in held:
                        marks.append(at)
                        parts += [c, gap]
                        at += len(c) + len(gap)
                    starts = np.array(marks)
                    for item, start, end, n in matches(np.concatenate(parts), index) if parts else []:
                        k = int(np.searchsorted(starts, end - 1, "right")) - 1
                        if end - marks[k] <= len(held[k][1]) and start >= marks[k]:
                            rows.append((held[k][0], item, start - marks[k], end - marks[k], n))
                    held.clear()

                for doc, text in zip(batch["id"], batch["text"]):
                    c = codes(normal(text))
                    if len(c) + size > CHUNK - len(gap) and held:
                        flush()
                        size = 0
                    if len(c) > CHUNK // 2:
                        rows += [(doc, *m) for m in matches(c, index)]
                    elif len(c):
                        held.append((doc, c))
                        size += len(c) + len(gap)
                flush()
                yield pd.DataFrame(rows, columns=["id", "item", "doc_start", "doc_end", "edits"]).astype({"doc_start": "int64", "doc_end": "int64", "edits": "int32"})

        part = source.mapInPandas(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "doc_start", "doc_end", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a leak; rows without an id stay. Columns may have any name."""
    bad = leaks(docs.where(F.col(id_col).isNotNull()), benchmark, id_col, text_col).select(id_col).distinct()
    return docs.join(bad, docs[id_col] == bad[id_col], "left_anti")
