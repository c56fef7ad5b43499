"""Ranked search for words: a score that saturates with a word's occurrences, the best documents of each item by MaxScore."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ._common import cut, top_rows, uncut

#: Characters of items that one pass over the documents holds; more items take more passes.
ITEM_CHARS = 4_000_000
#: Documents, or postings, that complete a shard, which one task has in memory; documents of a block, after which the threshold
#: is looked at again.
SHARD, POSTINGS, BLOCK = 16_384, 2_000_000, 2_048

#: ASCII letters in lower case and digits as they are, every byte of other characters too; the rest separates terms.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return (text or b"").translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """The postings of some documents: for each term the documents that have it, in order, and what it adds to their scores."""

    def __init__(self, n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        m = 25 + (75 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(first))
        adds = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.size, self.doc, self.adds, held = len(n), doc[order], adds[order], term[order]
        start = np.flatnonzero(np.append(True, held[1:] != held[:-1])) if len(held) else np.empty(0, int)
        self.at = {int(held[a]): (a, b) for a, b in zip(start, np.append(start[1:], len(held)))}
        self.bound = {t: int(self.adds[a:b].max()) for t, (a, b) in self.at.items()}

    def search(self, item: dict[int, int], least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score for item (term: repeats) may be among the k highest, and their scores; only scores of least or
        more are asked for. Every document at or above the k-th highest score that is found is among them.

        Terms stand in order of the most that each can add. Those at the front that together cannot lift a document to the
        threshold are non-essential: their postings give no candidates and are looked up only for documents that what is
        already known and what is left could still lift there. Blocks of documents raise the threshold as they are done."""
        held = sorted((t for t in item if self.bound.get(t)), key=lambda t: item[t] * self.bound[t])
        if not held:
            return np.empty(0, int), np.empty(0, int)
        most = np.cumsum([item[t] * self.bound[t] for t in held])
        edges = np.arange(0, self.size + BLOCK, BLOCK)
        cuts = [self.at[t][0] + np.searchsorted(self.doc[slice(*self.at[t])], edges) for t in held]
        least, docs, scores = max(least, 1), np.empty(0, int), np.empty(0, int)
        for block in range(len(edges) - 1):
            first = int(np.searchsorted(most, least))  # of the essential terms: those before it add up to less than least
            if first == len(held):
                break
            base, score = edges[block], np.zeros(BLOCK, np.int64)
            for j in range(first, len(held)):
                a, b = cuts[j][block], cuts[j][block + 1]
                score[self.doc[a:b] - base] += item[held[j]] * self.adds[a:b]
            some = np.flatnonzero(score)
            for j in range(first - 1, -1, -1):
                some = some[score[some] + most[j] >= least]
                if not len(some):
                    break
                a, b = cuts[j][block], cuts[j][block + 1]
                if a < b:
                    near = np.searchsorted(self.doc[a:b], some + base).clip(max=b - a - 1)
                    hit = self.doc[a:b][near] == some + base
                    score[some[hit]] += item[held[j]] * self.adds[a:b][near[hit]]
            some = some[score[some] >= least]
            docs, scores = np.append(docs, some + base), np.append(scores, score[some])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                stay = scores >= least
                docs, scores = docs[stay], scores[stay]
        return docs, scores


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[Row]]:
    block, size = [], 0
    for r in items.select(F.col(item_col).alias("item"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text")).toLocalIterator():
        block.append(r)
        size += len(r["text"])
        if size >= ITEM_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _occurrences(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """id, n (terms of the text with repeats), and of the terms in index those that the text has, and how often, for every
    document that has any term at all."""

    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ints = sent.value, pa.list_(pa.int32())
        for batch in batches:
            n, term, tf = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms(text.as_py())
                found = Counter(map(index.get, words))
                found.pop(None, None)
                n.append(len(words))
                term.append(list(found))
                tf.append(list(found.values()))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, ints), pa.array(tf, ints)], names=["id", "n", "term", "tf"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, term array<int>, tf array<int>")


def _best(found: DataFrame, queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of each task for each item: q (the item's place), id, score."""
    sent = found.sparkSession.sparkContext.broadcast((queries, weights))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            postings += len(batch.column(batch.schema.get_field_index("term")).flatten())
            if n >= SHARD or postings >= POSTINGS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, postings = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = sent.value
        best: list[list[tuple]] = [[] for _ in queries]
        kind = None
        for table in gathered(batches):
            ids, kind = table.column("id"), table.schema.field("id").type
            if not table.num_rows:
                continue
            term, tf = (table.column(c).chunk(0) for c in ("term", "tf"))
            first = term.offsets.to_numpy() - term.offsets[0].as_py()
            shard = Shard(table.column("n").to_numpy(), first, term.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64), weights, n_docs, n_terms)
            for q, item in enumerate(queries):
                docs, scores = shard.search(item, -best[q][-1][0] if len(best[q]) == k else 1, k)
                new = [(-int(s), i is None, i) for s, i in zip(scores, ids.take(pa.array(docs)).to_pylist())]
                best[q] = heapq.nsmallest(k, best[q] + new, key=lambda x: x[:2] if x[1] else x)
        if kind is not None:
            rows = [(q, i, -s) for q, b in enumerate(best) for s, _, i in b]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["q", "id", "score"])

    return found.mapInArrow(run, f"q int, id {found.schema['id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k documents with the highest scores above 0 for each row of items.

    The score sums, over the item's terms with repeats, w * ((10^9 tf) div (1000 tf + 8 m)), with w = floor(1000 ln((2 N + 2) /
    (2 df + 1))) and m = 25 + (75 n N) div L: N documents have a term, L terms in all, n in this one, df documents have the
    term, tf times in this one. Every row of docs is a document, rows equal in all columns too; one whose text is null or has
    no term counts nowhere. Equal scores stand by ascending id, null last. Every row of items is an item, whatever its
    id; one without terms, or whose terms no document has, gives no row. An empty table gives none. Ids may be of any
    type that can be ordered; other columns of either table are not read.

    Items go in blocks of ITEM_CHARS characters, of which each is one pass: the documents' occurrences of the block's terms
    are written once, the statistics summed from them, and tasks search shards of SHARD documents by MaxScore."""
    out, spark = None, docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    empty = docs.where("false").select(F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("rank"), F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for block in _blocks(items, item_col, item_text):
        index: dict[bytes, int] = {}
        queries = [{index.setdefault(t, len(index)): n for t, n in Counter(terms(bytes(r["text"]))).items()} for r in block]
        found = cut(_occurrences(docs, index), "occurrences")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not index:
            continue
        weights = np.zeros(len(index), np.int64)
        # A row for each term of the block at most.
        for t, df in found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*")).toLocalIterator():
            weights[t] = weight(n_docs, df)
        best = _best(found, queries, weights, n_docs, n_terms, k)
        ranked = cut(top_rows(best, ["q"], [F.desc("score"), F.asc_nulls_last("id")], k), "ranked")
        uncut(found)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(block)], f"q int, item_id {items.schema[item_col].dataType.simpleString()}")
        part = ranked.join(F.broadcast(names), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = part if out is None else out.union(part)
    return empty if out is None else out
