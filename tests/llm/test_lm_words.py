"""Every word is a target, and every word outside the vocabulary has a probability of its own."""

import collections
import math
import random
import zlib

import pytest

SCHEMA = "doc_id long, text string"


def test_every_place_is_a_target():
    from fescue.llm import lm_scoring as L

    assert L.EVERY == 1


def test_words_outside_the_vocabulary_have_their_own_probability(spark, sf):
    from fescue.llm import lm_scoring as L

    rng = random.Random(1)
    prose = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    common = [(500 + k, " ".join(f"c{j}" for j in range(L.VOCABULARY))) for k in range(3)]
    unseen = [(1000 + k, " ".join(f"z{rng.randrange(10**12)}" for _ in range(300))) for k in range(20)]
    rows = [*prose, *common, *unseen, unseen[0], (None, unseen[1][1]), (-5, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = L.pseudo_likelihood(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    counts = spark.createDataFrame(collections.Counter(w for _, t in rows for w in L.tokens(t or "")).items(), "word string, n long")
    net = L.train(docs, counts=counts)
    n, full = dict(counts.collect()), collections.Counter()
    place = lambda w: zlib.crc32(w.encode()) % L.SHARED
    for w in n:
        if w not in net.ids:
            full[place(w)] += n[w]
    inner = {i: sum(math.log(n[w] / full[place(w)]) for w in L.tokens(t) if w not in net.ids) for i, t in unseen}
    texts = spark.createDataFrame([(i, t) for i, t in unseen], "t long, text string")
    found = dict(L.within_places(texts, net, counts).collect())
    assert all(found[i] == pytest.approx(inner[i], rel=1e-9) and inner[i] < -300 for i in inner)
    # Without the word's own term, these are no less likely than prose.
    plain = {r.doc_id: r for r in L.score(docs, net).collect() if r.doc_id is not None}
    assert all(by[i].log_likelihood < plain[i].log_likelihood for i in inner)
    known = [by[i].per_token for i, t in prose if t and len(t.split()) > 100]
    assert max(by[i].per_token for i in inner) < sorted(known)[len(known) // 2]


def test_a_step_follows_the_gradient_of_the_likelihood():
    import copy

    import numpy as np
    from fescue.llm import lm_scoring as L

    rng = np.random.default_rng(3)
    net = L.Network([f"w{k}" for k in range(L.VOCABULARY - L.SHARED)], np.log(np.full(L.VOCABULARY, 1 / L.VOCABULARY)))
    net.c[:, :-1], net.w[:, :, :-1] = rng.normal(0, 0.3, net.c[:, :-1].shape), rng.normal(0, 0.3, net.w[:, :, :-1].shape)
    ids = rng.integers(0, 300, 400).astype(np.int32)
    at = np.arange(400)

    class Seen(L.Adagrad):
        def step(self, x, grad, name, rows=None):
            self.sums[name] = (grad.copy(), rows)

    seen, other = Seen(), Seen()
    net.learn(net.windows(ids, at), ids, seen)
    copy.deepcopy(net).log_p(net.windows(ids, at), ids, other)
    for name in "eabc":
        assert np.allclose(seen.sums[name][0], other.sums[name][0], atol=1e-6)
    mean = lambda n: float(-n.log_p(n.windows(ids, at), ids).mean(dtype=np.float64))
    for name, spot in (("a", (1, 3)), ("b", (5,)), ("c", (2, 4)), ("c", (1, L.DIM)), ("w", (1, 7, 2)), ("e", (int(ids[9]), 6))):
        up, down = copy.deepcopy(net), copy.deepcopy(net)
        getattr(up, name)[spot] += 1e-2
        getattr(down, name)[spot] -= 1e-2
        grad, rows = seen.sums[name]
        got = grad[spot] if rows is None else grad[list(rows).index(spot[0]), spot[1]]
        assert got == pytest.approx((mean(up) - mean(down)) / 2e-2, abs=2e-5)
