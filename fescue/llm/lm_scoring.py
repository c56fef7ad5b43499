"""Masked pseudo-likelihood of documents: a window network predicts every word from the words on both sides of it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words on either side, width of the embeddings, and classes of CLASS words each (predicted first the class, then the word).
SIDE, DIM, CLASS = 2, 16, 64
VOCABULARY = CLASS * CLASS
#: Of the vocabulary, places that the words outside it share by their hash.
SHARED = 8 * CLASS
#: One in so many places is a training target: all of them.
EVERY = 1
#: Parts of the corpus, by a hash of the row. Each is one round of training, which begins with the mean of what the tasks of the
#: round before have learnt; together the rounds are one pass.
ROUNDS, RATE, SEED = 2, 0.1, 7
#: Words of a gradient step.
STEP = 16_384
#: Words that go through the classes at a time, so that their scores stay in the processor's cache.
TILE = 1_024
#: Words that a task holds before it counts them and hands the counts on.
HELD = 1_500_000
#: Characters of text that are cut into words at a time.
PIECE = 1 << 20
#: White space that str.split() knows and ascii_split_whitespace() does not.
ODD = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens(text: str) -> list[str]:
    return text.lower().split()


def tokens_of_all(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """tokens() of all texts one after the other, and where each text's begin; at the end, where the last one's end."""
    low = [t.lower() for t in texts]
    cut = pc.utf8_split_whitespace if any(c in t for t in low for c in ODD) else pc.ascii_split_whitespace
    found = cut(pa.array(low, pa.string()))
    words, bounds = found.flatten(), found.offsets.to_numpy()
    # White space at the ends of a text leaves empty words there.
    full = pc.not_equal(words, "")
    if pc.all(full, min_count=0).as_py():
        return words, bounds
    return words.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds]


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about PIECE characters, each with the number of its first; a null is an empty text."""
    held, size = [], 0
    for k, text in enumerate(texts, 1):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= PIECE or k == len(texts):
            yield k - len(held), held
            held, size = [], 0


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def crc32_of_all(words: pa.StringArray, most: int = 64) -> np.ndarray:
    """zlib.crc32() of every word's UTF-8, a byte of all words at a time; of words of over most bytes, one word at a time."""
    if not len(words):
        return np.zeros(0, np.uint32)
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data, size = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(bounds)
    order = np.argsort(np.minimum(size, most + 1).astype(np.uint8), kind="stable")[::-1]
    at, out = bounds[order], np.empty(len(words), np.uint32)
    short = np.minimum(size, most + 1)[order]
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(most):
        # Longer words come first.
        n = len(words) - np.searchsorted(short[::-1], k, "right")
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out[order] = ~crc
    for k in np.flatnonzero(size > most).tolist():
        out[k] = zlib.crc32(data[bounds[k] : bounds[k + 1]])
    return out


class Network:
    """Embeddings e (one for what lies outside the text), a weight for each place of the window, an offset; weights and
    offsets of the classes and of the words."""

    def __init__(self, words: list[str], log_p: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.ids = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.string())
        p = np.exp(log_p).reshape(CLASS, CLASS)
        self.e = (rng.standard_normal((VOCABULARY + 1, DIM)) * 0.1).astype(np.float32)
        self.a = np.ones((2 * SIDE, DIM), np.float32)
        self.b = np.zeros(DIM, np.float32)
        # To begin with, the network is the unigram model.
        self.c = np.zeros((CLASS, DIM + 1), np.float32)
        self.c[:, -1] = np.log(p.sum(axis=1))
        self.w = np.zeros((CLASS, CLASS, DIM + 1), np.float32)
        self.w[:, :, -1] = np.log(p / p.sum(axis=1, keepdims=True))

    def encode(self, text: str, rare: list | None = None) -> np.ndarray:
        """The id of every word; rare, if given, gets those outside the vocabulary."""
        ids, _, _, others = self.encode_all([text])
        if rare is not None:
            rare += others.to_pylist()
        return ids

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
        """The ids of the words of all texts one after the other, where each text's begin and the last one's end, the places of the words
        outside the vocabulary, and these words."""
        words, bounds = tokens_of_all(texts)
        found = pc.index_in(words, self.words)
        others = words.filter(pc.is_null(found))
        ids = pc.fill_null(found, -1).to_numpy().astype(np.int32)
        at, some = np.flatnonzero(ids < 0), 1 << 14
        for k in range(0, len(at), some):
            ids[at[k : k + some]] = VOCABULARY - SHARED + crc32_of_all(others[k : k + some]) % SHARED
        return ids, bounds, at, others

    def windows(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ids around each place, a row for each place of the window; VOCABULARY beyond the ends."""
        padded = np.concatenate([np.full(SIDE, VOCABULARY, np.int32), ids, np.full(SIDE, VOCABULARY, np.int32)])
        return np.stack([padded[at + k] for k in range(2 * SIDE + 1) if k != SIDE])

    def places(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """windows() of all places of texts that lie one after the other, and the words there, STEP places at a time."""
        at = np.arange(SIDE, SIDE + len(ids)) + SIDE * np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        padded = np.full(len(ids) + SIDE * len(bounds), VOCABULARY, np.int32)
        padded[at] = ids
        for a in range(0, len(ids), STEP):
            yield np.stack([padded.take(at[a : a + STEP] + k) for k in range(-SIDE, SIDE + 1) if k]), ids[a : a + STEP]

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.b + self.e[near[0]] * self.a[0]
        for k in range(1, 2 * SIDE):
            total += self.e[near[k]] * self.a[k]
        return np.tanh(total, out=total)

    def _tables(self) -> list[np.ndarray]:
        """What each word adds to the hidden values from each place of the window."""
        tables = [self.e * a for a in self.a]
        tables[0] += self.b
        return tables

    def ready(self) -> Network:
        """Tables of what log_p_only() would else work out again for every text."""
        self.tables = self._tables()
        self.ct, self.wt = np.ascontiguousarray(self.c.T), np.ascontiguousarray(self.w.transpose(0, 2, 1))
        self.cw = (self.c[:, None] + self.w).reshape(VOCABULARY, DIM + 1)
        return self

    def log_p_only(self, near: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log_p() without learning. Scores are small numbers, as the hidden values lie between -1 and 1, so their exponentials
        are taken as they are."""
        n, order = len(word), np.argsort(word.astype(np.uint16), kind="stable")
        near, word = near.take(order, axis=1), word.take(order)
        h, ones = _summed(self.tables, near), np.ones(CLASS, np.float32)
        # A word's score and its class's together, less the logarithms of what all classes and all words of the class have.
        out = np.einsum("ij,ij->i", h, self.cw.take(word, axis=0))
        tops, lows = np.empty(n, np.float32), np.empty(n, np.float32)
        for a in range(0, n, TILE):
            part = slice(a, a + TILE)
            z = h[part] @ self.ct
            np.matmul(np.exp(z, out=z), ones, out=tops[part])
        bounds = np.searchsorted(word, np.arange(0, VOCABULARY + 1, CLASS))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[k], bounds[k + 1])
            z = h[own] @ self.wt[k]
            np.matmul(np.exp(z, out=z), ones, out=lows[own])
        out -= np.log(tops)
        out -= np.log(lows)
        back = np.empty(n, np.float32)
        back[order] = out
        return back

    def log_p(self, near: np.ndarray, word: np.ndarray, learn: Adagrad | None = None) -> np.ndarray:
        h = self.hidden(near)
        top, low = word // CLASS, word % CLASS
        p = _softmax(h @ self.c[:, :-1].T + self.c[:, -1])
        out = np.log(p[np.arange(len(word)), top])
        dh = np.zeros_like(h) if learn else None
        if learn:
            p[np.arange(len(word)), top] -= 1
            dh += p @ self.c[:, :-1]
            learn.step(self.c, np.hstack([p.T @ h, p.sum(axis=0)[:, None]]) / len(word), "c")
        order = np.argsort(top, kind="stable")
        bounds = np.searchsorted(top[order], np.arange(CLASS + 1))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[k] : bounds[k + 1]]
            q = _softmax(h[own] @ self.w[k, :, :-1].T + self.w[k, :, -1])
            out[own] += np.log(q[np.arange(len(own)), low[own]])
            if learn:
                q[np.arange(len(own)), low[own]] -= 1
                dh[own] += q @ self.w[k, :, :-1]
                learn.step(self.w[k], np.hstack([q.T @ h[own], q.sum(axis=0)[:, None]]) / len(word), f"w{k}")
        if learn:
            dz = dh * (1 - h * h) / len(word)
            da = np.stack([(dz * self.e[x]).sum(axis=0) for x in near])
            de = (self.a[:, None, :] * dz).reshape(-1, DIM)
            flat = near.ravel()
            order = np.argsort(flat, kind="stable")
            rows, first = np.unique(flat[order], return_index=True)
            learn.step(self.e, np.add.reduceat(de[order], first, axis=0), "e", rows)
            learn.step(self.a, da, "a")
            learn.step(self.b, dz.sum(axis=0), "b")
        return out

    def learn(self, near: np.ndarray, word: np.ndarray, rates: Adagrad) -> None:
        """A step on log_p() of all these places at once, in the order of the words, so that a class's places are neighbours. Scores
        are small numbers, so their exponentials are taken as they are."""
        order = np.argsort(word.astype(np.uint16), kind="stable")
        near, word, n = near.take(order, axis=1), word.take(order), np.float32(len(word))
        h, ones = _summed(self._tables(), near), np.ones(CLASS, np.float32)
        dh, dc, dw = np.empty((len(word), DIM), np.float32), np.zeros_like(self.c), np.zeros_like(self.w)
        # All that the scores' exponentials are multiplied with is narrower than they are, so that is divided by their sums.
        for a in range(0, len(word), TILE):
            part = slice(a, a + TILE)
            p = h[part] @ self.c.T
            each = np.float32(1) / (np.exp(p, out=p) @ ones)[:, None]
            np.multiply(p @ self.c[:, :-1], each, out=dh[part])
            dc += p.T @ (h[part] * each)
        bounds = np.searchsorted(word, np.arange(0, VOCABULARY + 1, CLASS))
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[k], bounds[k + 1])
            p = h[own] @ self.w[k].T
            each = np.float32(1) / (np.exp(p, out=p) @ ones)[:, None]
            dh[own] += (p @ self.w[k, :, :-1]) * each
            np.matmul(p.T, h[own] * each, out=dw[k])
        # The words that are there, and their classes.
        dh -= (self.c[:, None, :-1] + self.w[:, :, :-1]).reshape(VOCABULARY, DIM).take(word, axis=0)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        there = np.zeros((VOCABULARY, DIM + 1), np.float32)
        there[word[first]] = np.add.reduceat(h, first, axis=0)
        there = there.reshape(self.w.shape)
        dw -= there
        dc -= there.sum(axis=1)
        rates.step(self.c, dc / n, "c")
        rates.step(self.w, dw / n, "w")
        h = h[:, :-1]
        dh *= 1 - h * h
        dh /= n
        # Each place of the window: sums of dh by the word found there, a row for each of its numbers.
        e, wide = np.ascontiguousarray(self.e.T, np.float64), np.ascontiguousarray(dh.T, np.float64)
        de, sums, da = np.zeros_like(e), np.empty_like(e), np.zeros_like(self.a)
        for k, x in enumerate(near.astype(np.intp)):
            for i, column in enumerate(wide):
                sums[i] = np.bincount(x, column, VOCABULARY + 1)
            da[k] = np.einsum("ij,ij->i", sums, e)
            sums *= self.a[k][:, None]
            de += sums
        rows = np.flatnonzero(np.bincount(near.ravel(), minlength=VOCABULARY + 1))
        rates.step(self.e, de.T[rows].astype(np.float32), "e", rows)
        rates.step(self.a, da, "a")
        rates.step(self.b, np.ones(len(dh), np.float32) @ dh, "b")

    def rows(self) -> np.ndarray:
        """All parameters as rows of DIM + 1 numbers."""
        wide = lambda x: np.hstack([x, np.zeros((len(x), 1), np.float32)])
        return np.vstack([wide(self.e), wide(self.a), wide(self.b[None]), self.c, self.w.reshape(-1, DIM + 1)])

    def put(self, rows: np.ndarray) -> None:
        rows = rows.astype(np.float32)
        e, a = VOCABULARY + 1, VOCABULARY + 1 + 2 * SIDE
        self.e, self.a, self.b = rows[:e, :-1].copy(), rows[e:a, :-1].copy(), rows[a, :-1].copy()
        self.c, self.w = rows[a + 1 : a + 1 + CLASS].copy(), rows[a + 1 + CLASS :].reshape(CLASS, CLASS, DIM + 1).copy()


class Adagrad:
    def __init__(self) -> None:
        self.sums: dict[str, np.ndarray] = {}

    def step(self, x: np.ndarray, grad: np.ndarray, name: str, rows: np.ndarray | None = None) -> None:
        total = self.sums.setdefault(name, np.full(x.shape, 1e-4, np.float32))
        at = slice(None) if rows is None else rows
        total[at] += grad * grad
        x[at] -= RATE * grad / np.sqrt(total[at])


def _summed(tables: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Hidden values of each place from the tables' rows of the words around it, and a one beside them for the offsets."""
    total = tables[0].take(near[0], axis=0)
    for table, x in zip(tables[1:], near[1:]):
        total += table.take(x, axis=0)
    out = np.ones((len(total), DIM + 1), np.float32)
    np.tanh(total, out=out[:, :-1])
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    np.maximum(z, 1e-30, out=z)
    return z


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).value_counts()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                held.append(tokens_of_all(texts)[0])
                size += len(held[-1])
                if size > HELD:
                    yield counted()
                    held, size = [], 0
        yield counted()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", counts: DataFrame | None = None) -> Network:
    """The most frequent words of all texts (ties in the order of the words) make the vocabulary. In each of ROUNDS rounds every task
    trains on the texts of its rows that are of that round, Spark sums what the tasks have learnt, weighed by their targets,
    and the mean goes on. Every word of the corpus is a target once; a null text has none. All parameters together are
    about 8,300 rows, however large the corpus; what the tasks send grows with their number."""
    from ._common import cut, uncut

    own = counts is None
    counts = cut(word_counts(docs, text_col), "words") if own else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    best = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - SHARED).collect()
    if own:
        uncut(counts)
    known = np.zeros(VOCABULARY)
    known[: len(best)] = [r["n"] for r in best]
    known[VOCABULARY - SHARED :] = max(0, total - known.sum()) / SHARED
    net = Network([r["word"] for r in best], np.log((known + 0.5) / (known + 0.5).sum()))
    part = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(max(ROUNDS, 1)))
    for turn in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pd.DataFrame]:
            import copy

            own, rates, held, seen, size = copy.deepcopy(sent.value), Adagrad(), [], 0, 0

            def step(least: int) -> int:
                """Whole steps of what is held; the rest waits for more, or is a step if it has least words."""
                near, word = np.concatenate([x[0] for x in held], axis=1), np.concatenate([x[1] for x in held])
                at = 0
                while len(word) - at >= STEP or len(word) - at >= least:
                    own.learn(near[:, at : at + STEP], word[at : at + STEP], rates)
                    at += min(STEP, len(word) - at)
                held[:] = [(near[:, at:], word[at:])]
                return len(word) - at

            for batch in batches:
                for _, texts in pieces(batch.column(0)):
                    for near, word in own.places(*own.encode_all(texts)[:2]):
                        held.append((near[:, ::EVERY], word[::EVERY]))
                        size, seen = size + len(held[-1][1]), seen + len(held[-1][1])
                        if size >= STEP:
                            size = step(STEP)
            if size:
                step(1)
            if seen:
                rows = own.rows() * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(np.full(len(rows), seen, np.int64)), *[pa.array(rows[:, i].astype(np.float32)) for i in range(DIM + 1)]], names=["r", "seen", *[f"v{i}" for i in range(DIM + 1)]])

        cols = [f"v{i}" for i in range(DIM + 1)]
        learnt = docs.where(part == turn).select(text_col).mapInArrow(run, "r int, seen long, " + ", ".join(f"{c} float" for c in cols))
        mean = learnt.groupBy("r").agg(*[(F.sum(c) / F.sum("seen")).alias(c) for c in cols]).orderBy("r").toPandas()
        if len(mean):
            net.put(mean[cols].to_numpy())
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", rare: bool = False) -> DataFrame:
    """id_col, n_tokens, log_likelihood (the sum over all words of the log-probability given the words around each) and
    per_token for every row; a text without words has 0 and null. With rare, also the words outside the vocabulary."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(net.ready()), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                ids, bounds, at, others = net.encode_all(texts)
                found = [net.log_p_only(near, word) for near, word in net.places(ids, bounds)]
                n = np.diff(bounds).astype(np.int64)
                total = np.bincount(np.repeat(np.arange(len(n)), n), np.concatenate([np.zeros(0), *found]), len(n))
                cols = [batch.column(0).slice(first, len(n)), pa.array(n), pa.array(np.round(total, 3))]
                if rare:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), others))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "log_likelihood", "rare"][: len(cols)])

    schema = f"id {kind}, n_tokens long, log_likelihood double" + ", rare array<string>" * rare
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", F.round(F.try_divide(F.col("log_likelihood"), F.col("n_tokens")), 6).alias("per_token"), *["rare"] * rare)


def shares(net: Network, counts: DataFrame) -> DataFrame:
    """h, p: of every word of counts outside the vocabulary a hash, and the logarithm of its share of what its place has."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(w,) for w in net.ids] or [], "word string")
    place = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(SHARED))
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("place", place)
    # SHARED rows, so they go to every task.
    full = rare.groupBy("place").agg(F.sum("n").alias("full"))
    return rare.join(F.broadcast(full), "place").select(F.xxhash64("word").alias("h"), F.log(F.col("n") / F.col("full")).alias("p"))


def _inner(rows: DataFrame, key: str, net: Network, counts: DataFrame) -> DataFrame:
    """key, inner: the sum of shares() over rare, the words of each row outside the vocabulary. Only hashes are shuffled."""
    said = rows.select(key, F.explode("rare").alias("word")).select(key, F.xxhash64("word").alias("h"))
    return said.join(shares(net, counts), "h").groupBy(key).agg(F.sum("p").alias("inner"))


def within_places(texts: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """t, inner: for the texts (columns t and text, each t once) that hold words outside the vocabulary, the sum of the log-probabilities of
    these words given their places, which are their shares of what counts has there. Every word of the corpus has its own
    share; the counts stay in Spark."""
    return _inner(score(texts, net, "t", "text", rare=True).select("t", "rare"), "t", net, counts)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() by a network that train() has fitted to the same rows, with the log-probability of every word outside the vocabulary
    given its place, so that each word of the corpus is predicted itself. Rows of an empty table, of nulls only or repeated
    ones are scored like any other; ids may be null. How the table is cut into tasks moves the fit a little."""
    from ._common import cut, uncut

    counts = cut(word_counts(docs, text_col), "words")
    net = train(docs, text_col, counts)
    scored = score(docs.select(F.struct(F.col(id_col).alias("id")).alias("k"), F.col(text_col).alias("text")), net, "k", "text", rare=True)
    # Written, so that a row's number stays what it is.
    scored = cut(scored.withColumn("r", F.monotonically_increasing_id()), "scored")
    inner = cut(_inner(scored, "r", net, counts), "inner")
    uncut(counts)
    total = F.round(F.col("log_likelihood") + F.coalesce("inner", F.lit(0.0)), 3)
    out = scored.select("k.id", "n_tokens", "log_likelihood", "r").join(inner, "r", "left").select(F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("per_token", F.round(F.try_divide("log_likelihood", "n_tokens"), 6))
