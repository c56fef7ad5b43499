"""Near copies of whole documents: Jaccard similarity of word shingles, candidates by SimHash fingerprints and by min-hash bands,
every link verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._common import components, cut, released, shield, uncut
from .substring_dedup import SHINGLE, shingles

#: The least Jaccard similarity of the sets of SHINGLE-word shingles.
SIMILAR = 0.8
#: Bands of ROWS min-hashes: a pair at the threshold shares one with a probability of 1 - (1 - 0.8 ** 6) ** 24 = 0.9993.
BANDS, ROWS = 24, 6
#: Bits in which the SimHash fingerprints of two linked sets differ at most.
BITS = 4
#: Members of a band's bucket in a block; one task compares the members of two blocks at a time.
BLOCK = 512

_rng = np.random.default_rng(11)
_FLIP, _TURN = (_rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_TURN = _TURN | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of a text, sorted; a text of fewer words, or of none, is one shingle."""
    import xxhash

    found = np.unique(shingles(text))
    return found if len(found) else np.array([xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SHINGLE)], np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each band's min-hashes."""
    import xxhash

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        v = (found[at : at + 2048] ^ _FLIP) * _TURN
        np.minimum(low, (v ^ (v >> np.uint64(32))).min(axis=1), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set: 64 bits, each 1 where it is 1 in over half of the shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 15):
        ones += np.unpackbits(found[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(np.int64)[0])


def _signatures(docs: DataFrame) -> DataFrame:
    """id, node (a hash of the set), fp (its fingerprint) and keys (of the bands) for every row of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, fp, keys = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                found = shingle_set(t.as_py() or b"")
                node.append(xxhash.xxh64_intdigest(found.tobytes()))
                fp.append(fingerprint(found))
                keys.append(bands(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "fp", "keys"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node long, fp long, keys array<long>")


def by_fingerprints(nodes: DataFrame) -> DataFrame:
    """nodes (node, id, fp, keys) with one more key: that of the component of fingerprints, linked where they differ in BITS bits or
    fewer, which the node's is in. Members of a component meet as those of a band's bucket do."""
    fps = cut(nodes.select("fp").distinct(), "fingerprints")
    edges = cut(simhash.links(fps, BITS), "near_fingerprints")
    of = components(edges).select(F.col("node").alias("fp"), "label")
    own = F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp"))
    out = cut(nodes.join(of, "fp", "left").select("node", "id", F.concat("keys", F.array(own)).alias("keys")), "nodes")
    uncut(fps, edges)
    return out


def _sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and s (the set and its size) for nodes (node, id) whose text is that of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "n", "s"])

    return texts.join(nodes.select("node", "id"), "id").select("node", "text").mapInArrow(run, "node long, n int, s array<long>")


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs u, v whose sets have a Jaccard similarity of SIMILAR or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = batch.columns
            stay = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
                # Two sets can only be that similar if their sizes are.
                if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, True))
                    stay[k] = common >= SIMILAR * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(stay))

    side = lambda n, s: nodes.select(F.col("node").alias(n), F.col("s").alias(s))
    # What the sizes alone rule out goes before any set is joined.
    size = lambda n, s: nodes.select(F.col("node").alias(n), F.col("n").alias(s))
    sized = pairs.join(size("u", "na"), "u").join(size("v", "nb"), "v").where(F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb")).select("u", "v")
    return sized.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _forest(block: pa.Table) -> pa.Table:
    """Links that join the members of a block (v, label, s) as all pairs of similar sets under different labels would. What sets have
    in common is counted by products of matrices with a row for each member and a column for each shared shingle."""
    label, sets = block.column("label").to_numpy(), block.column("s").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    size = np.diff(sets.offsets.to_numpy())
    owner = np.repeat(np.arange(len(size)), size)
    _, column, times = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    here = times[column] > 1
    owner, column = owner[here], rank[column[here]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(size), len(size)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        x, y = np.searchsorted(column, (at, at + 4096))
        m = np.zeros((len(size), 4096), np.float32)
        m[owner[x:y], column[x:y] - at] = 1
        common += m @ m.T
    near = (common >= SIMILAR * (size[:, None] + size[None, :] - common)) & (label[:, None] != label[None, :])
    left, u, v = np.ones(len(size), bool), [], []
    for start in range(len(size)):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(near[x] & left)
            left[found] = False
            u += [x] * len(found)
            v += found.tolist()
            todo += found.tolist()
    node = block.column("v").to_numpy()
    return pa.table({"u": node[np.array(u, int)], "v": node[np.array(v, int)]})


def _blocks(known: DataFrame) -> DataFrame:
    """key, i, j, v, label: members (key, v, label) of the buckets that hold several labels, dealt into blocks of which every two meet
    that have members to compare. Members under a bucket's most frequent label have blocks of their own, which meet the
    others' only, so that a few strays in a large group are compared with the group and it is not with itself."""
    each = known.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).where("top.n < n").select("key", (F.col("n") - F.col("top.n")).alias("rest"), F.col("top.n").alias("tops"), F.col("top.label").alias("top"))
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    met = known.join(most, "key").withColumns({"a": count("tops"), "b": count("rest"), "h": F.xxhash64("v")})
    own = F.when(F.col("label") == F.col("top"), F.pmod("h", "a")).otherwise(F.col("a") + F.pmod("h", "b")).cast("int")
    first = F.when(F.col("label") == F.col("top"), F.col("a")).otherwise(F.lit(0))
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(first, F.col("a") + F.col("b") - 1)))
    return met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v", "label")


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: links that join the nodes (node, id, keys) of which two share a band and are similar, as all such pairs would. Only
    nodes that share a key (a band, or a component of fingerprints) have their sets worked out, from the texts (id, text), and written.

    Each member of a bucket is first compared with the bucket's smallest. Then every two members of a bucket that are not
    in one component yet are, in blocks: a block's sets are read once, compared within the task, and only links that join
    its members go on, so that neither many alike nor many unlike members of a bucket make rows of pairs."""
    every = nodes.select("node", F.explode("keys").alias("key")).distinct()
    shared = cut(every.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("u")).where("n > 1").select("key", "u"), "shared")
    every = cut(every.join(shared, "key").select("key", "node", "u"), "members")
    sets = cut(_sets(texts, nodes.join(every.select("node").distinct(), "node", "left_semi")), "sets")
    released(nodes.sparkSession)
    first = cut(every.where("node <> u").select("u", F.col("node").alias("v")).distinct(), "first")
    near = cut(verified(first, sets), "near")
    label = components(near).withColumnRenamed("node", "v")
    known = cut(every.select("key", F.col("node").alias("v")).join(label, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label")), "known")
    dealt = cut(_blocks(known), "dealt")
    met = dealt.join(sets.select(F.col("node").alias("v"), "s"), "v")
    rest = met.groupBy("key", "i", "j").applyInArrow(_forest, "u long, v long").distinct()
    out = cut(near.union(rest), "links")
    uncut(shared, every, sets, known, dealt, first, near)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group of near copies: of each group one text, that with the smallest id (of several
    the first by a hash of its shingles and of itself), in one row; and every row without an id. Two texts are near copies if
    the sets of their SHINGLE-word shingles (A-Z in lower case, any white space as one space) have a Jaccard similarity of
    SIMILAR or more; groups are what such pairs connect. Pairs are looked for by SimHash fingerprints and, as most pairs near
    the threshold differ in more bits than BITS, by min-hash bands too. Different texts that share an id are different documents: each stays
    unless its own group has another that stands for it. An empty table gives none. Other columns pass unchanged; of rows
    equal in id and text one stays."""
    docs, back = shield(docs, id_col, text_col)
    named = docs.where(F.col(id_col).isNotNull())
    texts = named.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x")).alias("id"), F.col(text_col).alias("text"))
    signatures = cut(_signatures(texts), "signatures")
    nodes = cut(signatures.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("id").alias("id")), "nodes")
    plain, nodes = nodes, by_fingerprints(nodes)
    uncut(plain)
    found = links(nodes, texts)
    reach = components(found).select("node", "label")
    label = nodes.select("node", "id").join(reach, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    stay = cut(label.groupBy("label").agg(F.min(F.struct("id.id", "node", "id.x")).alias("s")).select(F.col("s.id").alias("__id"), F.col("s.x").alias("__x")).distinct(), "stay")
    uncut(signatures, nodes, found)
    released(docs.sparkSession)
    kept = named.join(stay, (F.col(id_col) == F.col("__id")) & F.xxhash64(text_col).eqNullSafe(F.col("__x")), "left_semi").dropDuplicates([id_col, text_col])
    return back(kept.unionByName(docs.where(F.col(id_col).isNull())), [])
