"""Near-duplicate documents by SimHash fingerprints, linked through a generalised pigeonhole index (GPH; Qin et al., 2018)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, uncut

SEED = 42
#: Members of a bucket that one task compares at a time.
BLOCK = 1024
#: Cost of a pair held side by side, in terms of a row that is shuffled.
PAIR_COST = 0.02


def shingle_hashes(text: bytes, width: int = 4) -> np.ndarray:
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    view, ends = memoryview(flat), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :]
    return np.fromiter((digest(view[starts[i] : last[i] - 1], SEED) for i in range(n)), np.uint64, n)


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits, each 1 where it is 1 in over half of the shingles' hashes; 0 for a text without words."""
    hashes, ones, part = shingle_hashes(text, width), np.zeros(64, np.int64), 1 << 15
    for at in range(0, len(hashes), part):
        bits = np.unpackbits(hashes[at : at + part].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id_col and fp (long, the 64 bits) for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many distinct fingerprints there are, and for every two bits how many have both set: 64 sums of 64 numbers
    from each task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 64))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            total[:64] += bits.T @ bits
            total[64, 0] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65, dtype=np.int32)), *[pa.array(total[:, i].astype(np.int64)) for i in range(64)]], names=["r", *[f"c{i}" for i in range(64)]])

    sums = nodes.select("fp").mapInArrow(run, "r int, " + ", ".join(f"c{i} long" for i in range(64))).groupBy("r").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(64)])
    table = np.zeros((65, 64), np.int64)
    for row in sums.collect():  # 65 rows
        table[row[0]] = row[1:]
    return int(table[64, 0]), table[:64]


def _bits(fps: np.ndarray) -> np.ndarray:
    return ((fps.astype(np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def _grouped(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in parts of nearly equal width, each grown around a free bit by the bit that correlates most with it."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    strength = np.abs(both / n - np.outer(p, p)) / spread
    free, out = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        own = [max(free, key=lambda b: (sum(strength[b, c] for c in free), -b))]
        free.discard(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (sum(strength[b, c] for c in own), -b)))
            free.discard(own[-1])
        out.append(own)
    return out


def _distances(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated share of fingerprint pairs at distance 0..most within a part: bits differ as in a chain, each given the one
    before it, with all chances taken from the counts over all fingerprints."""
    p = np.diag(both) / n
    same = p**2 + (1 - p) ** 2
    state = np.zeros((2, most + 2))
    state[0, 0], state[1, 1] = same[bits[0]], 1 - same[bits[0]]
    for a, b in zip(bits, bits[1:]):
        p11 = both[a, b] / n
        cells = [p11, p[a] - p11, p[b] - p11, 1 - p[a] - p[b] + p11]
        s00 = sum(x * x for x in cells)
        joint = np.array([[s00, same[a] - s00], [same[b] - s00, 1 - same[a] - same[b] + s00]]).clip(0)
        step = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-12)
        after = np.zeros_like(state)
        after[0] = step[:, 0] @ state
        after[1, 1:] = (step[:, 1] @ state)[:-1]
        state = after
    return state.sum(axis=0)[: most + 1]


def _radii(t: int) -> tuple[int, int]:
    """How far the two sides of a pair reach out, together t."""
    return t // 2, t - t // 2


def _meetings(width: int, d: int, t: int) -> int:
    """Buckets in which two values at distance d meet."""
    near, far = _radii(t)
    n = 0
    for i in range(d + 1):
        for j in range(width - d + 1):
            a, b = i + j, d - i + j
            if (a <= near and b <= far) or (a <= far and b <= near):
                n += comb(d, i) * comb(width - d, j)
    return n


def plan(n: int, both: np.ndarray, most: int = 4) -> list[tuple[int, int, int]]:
    """(mask, width, threshold) of each part that is probed. Two fingerprints that differ in most bits or fewer differ in
    threshold bits or fewer of some part, as the thresholds plus one add up to most plus one. A dynamic programme over
    the parts takes the thresholds, and then the number of parts, whose rows and estimated pairs cost least."""
    n, best = max(n, 1), None
    for parts in range(2, most + 2):
        groups = _grouped(n, both, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            share, nxt = _distances(n, both, bits, most), {}
            for t in range(-1, most + 1):
                rows = 0 if t < 0 else sum(comb(len(bits), r) for r in range(_radii(t)[1] + 1))
                pairs = 0 if t < 0 else n * sum(share[d] * _meetings(len(bits), d, t) for d in range(t + 1)) / 2
                for used, (cost, picked) in table.items():
                    now = (cost + rows + PAIR_COST * pairs, [*picked, t])
                    if used + t + 1 <= most + 1 and (used + t + 1 not in nxt or now[0] < nxt[used + t + 1][0]):
                        nxt[used + t + 1] = now
            table = nxt
        if most + 1 in table and (best is None or table[most + 1][0] < best[0]):
            best = (*table[most + 1], groups)
    return [(sum(1 << b for b in bits), len(bits), t) for bits, t in zip(best[2], best[1]) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(mask: int, radius: int) -> list[tuple[int, int]]:
    bits = [b for b in range(64) if mask >> b & 1]
    return [(_signed(sum(1 << b for b in c)), r) for r in range(radius + 1) for c in combinations(bits, r)]


def _forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels after the pairs a, b are joined; a label is the smallest index of its set."""
    for x, y in zip(a.tolist(), b.tolist()):
        while labels[x] != x:
            x = labels[x]
        while labels[y] != y:
            y = labels[y]
        if x != y:
            labels[max(x, y)] = min(x, y)
    while (labels[labels] != labels).any():
        labels = labels[labels]
    return labels


def _link(frame: pd.DataFrame, most: int) -> pd.DataFrame:
    """Sorted rows of whole blocks (g: number of the block) to links that span what is linked within them."""
    g, fp, side = frame["g"].to_numpy(), frame["fp"].to_numpy(), frame["side"].to_numpy()
    values, at = np.unique(fp, return_inverse=True)
    labels, bits, first, off = np.arange(len(values)), fp.view(np.uint64), np.arange(len(g)), 1
    while len(first := first[first + off < len(g)]) and len(first := first[g[first] == g[first + off]]):
        second = first + off
        near = ((side[first] == 0) | (side[second] == 0)) & (labels[at[first]] != labels[at[second]])
        x, y = first[near], second[near]
        close = np.bitwise_count(bits[x] ^ bits[y]) <= most
        if close.any():
            labels = _forest(at[x[close]], at[y[close]], labels)
        off += 1
    linked = np.flatnonzero(labels != np.arange(len(values)))
    return pd.DataFrame({"u": values[labels[linked]], "v": values[linked]})


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """u, v: links that join exactly the distinct fingerprints (column fp) that differ in most bits or fewer.

    A bucket holds all values that come near its own in one part. Its size is counted first, and a bucket of over BLOCK
    members is dealt into blocks, of which every two meet in one task, so no task holds more than about twice BLOCK
    rows of a bucket; what a task returns is a forest, not all pairs."""
    n, both = bit_counts(nodes)
    frames = []
    for k, (mask, _, t) in enumerate(plan(n, both, most)):
        near, far = _radii(t)
        flips = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(0 if r <= near else 1).alias("s")) for f, r in _flips(mask, far)])
        frames.append(nodes.select("fp", F.explode(flips).alias("x")).select(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.col("x.f")).alias("val"), "fp", F.col("x.s").alias("side")))
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.union(more)
    sizes = cut(rows.groupBy("k", "val").agg(F.count("*").alias("n"), F.min("side").alias("s")).where("n > 1 and s = 0").select("k", "val", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    met = rows.join(sizes, ["k", "val"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("own", own).select("k", "val", "fp", "side", "own", other.alias("other"))
    met = met.select("k", "val", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = pd.concat([held, batch], ignore_index=True) if held is not None else batch
            if batch.empty:
                continue
            key = batch[["k", "val", "i", "j"]].to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            batch["g"] = np.cumsum(new)
            last = int(np.flatnonzero(new)[-1])
            held = batch.iloc[last:].drop(columns="g")
            yield _link(batch.iloc[:last], most)
        if held is not None:
            yield _link(held.assign(g=0), most)

    keys = ["k", "val", "i", "j"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """id_col, fingerprint (16 lower-case hex digits) and component_id for every row of docs.

    Texts are lower-cased (A-Z) and split at ASCII white space into shingles of width words, repeats included; a shorter
    text is one shingle and a text without words (or null) has the fingerprint 0. Fingerprints that differ in most bits
    or fewer are linked; component_id is the smallest id that links lead to, the row's own included (null where all of
    them are null). Repeated rows and equal texts share a fingerprint, which is linked once. An empty table gives none."""
    fps = cut(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    edges = cut(links(nodes, most), "links")
    reach = components(edges)
    labelled = cut(nodes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label")), "labelled")
    least = cut(labelled.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    of = cut(labelled.join(least, "label").select("fp", "component_id"), "of")
    uncut(edges, labelled, least, nodes)
    return fps.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """The rows of docs that stand for their group: those with the smallest id (once each), and rows without an id."""
    found = near_duplicates(docs, id_col, text_col, width, most)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_stay")).distinct()
    kept = docs.join(stay, F.col(id_col) == F.col("_stay"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
