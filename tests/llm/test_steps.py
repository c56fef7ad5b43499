"""Steps that were made faster give what the plain ones give."""

import time
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa

from fescue.llm import lm_scoring as lm
from fescue.llm import substring_dedup as sub


def test_batched_passages_equal_single_ones():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 30, 121).astype(np.int32)
    ctx = []
    for n in range(40):
        x = base.copy()
        x[rng.integers(0, 121, n)] = rng.integers(1 << 30, 1 << 31, n).astype(np.int32)
        ctx.append(x)
    block = sub._Block([(k, sub.REACH, None) for k in range(40)], ctx)
    for n in (0, 5, 20):
        found, ask = block.places(ctx[n]), np.array([k for k in range(40) if k != n])
        some = {k for k in ask if any(x[0] <= sub.REACH < x[1] for x in sub.passages(ctx[n], ctx[k], sub.REACH))}
        assert some and some < set(ask) and some <= set(block.open_to(found, sub.REACH, ask).tolist())


def test_steps_of_the_network_agree_with_its_plain_form():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(50)]
    net = lm.Network(words, np.full(lm.VOCABULARY, -np.log(lm.VOCABULARY)))
    net.w += rng.normal(size=net.w.shape).astype(np.float32) * 0.1
    rare = []
    ids = net.encode("w3 Zürich w0  other w49", rare)
    place = lambda w: lm.VOCABULARY - lm.SHARED + zlib.crc32(w.encode()) % lm.SHARED
    assert rare == ["zürich", "other"] and ids.tolist() == [3, place("zürich"), 0, place("other"), 49]
    ids = rng.integers(0, lm.VOCABULARY, 3 * lm.TILE + 7).astype(np.int32)
    near = net.windows(ids, np.arange(len(ids)))
    plain = net.log_p(near, ids)
    assert np.allclose(net.ready().log_p_only(near, ids), plain, atol=1e-4)
    before = net.rows()
    net.learn(near, ids, lm.Adagrad())
    assert not np.allclose(net.rows(), before) and net.log_p(near, ids).mean() > plain.mean()


def _plain_places(net, texts):
    """Word by word and text by text."""
    near, word, rare = [], [], []
    for text in texts:
        said = lm.tokens(text)
        others = [w for w in said if w not in net.ids]
        ids = np.array([net.ids[w] if w in net.ids else lm.VOCABULARY - lm.SHARED + zlib.crc32(w.encode()) % lm.SHARED for w in said], np.int32)
        near.append(net.windows(ids, np.arange(len(ids))))
        word.append(ids)
        rare.append(others)
    return np.concatenate(near, axis=1), np.concatenate(word), rare


def _network(words):
    return lm.Network(words, np.full(lm.VOCABULARY, -np.log(lm.VOCABULARY)))


def test_texts_encoded_together_equal_texts_encoded_one_by_one():
    odd = ["", " ", "\n a  B\tc ", "İI Σας ΟΔΟΣ", "x\x1cy　z\xa0w v", " ", "q" * 70, "é" * 40 + " " + "q" * 70, "a", "日本 語　a"]
    odd += [f"s{c}t" for c in map(chr, range(0x110000)) if c.isspace()]
    net = _network(["a", "b", "w1", "w2", "語"])
    for texts in (odd, odd[:1], odd[:3], ["a b", "b"], [" a ", "", "b c d"], [odd[-1]], ["w1"] * 3 + ["zz"]):
        near, word, rare = _plain_places(net, texts)
        words, bounds = lm.tokens_of_all(texts)
        assert words.to_pylist() == [w for t in texts for w in lm.tokens(t)] and np.diff(bounds).tolist() == [len(lm.tokens(t)) for t in texts]
        ids, bounds, at, others = net.encode_all(texts)
        assert ids.tolist() == word.tolist() and others.to_pylist() == [w for r in rare for w in r]
        assert np.diff(np.searchsorted(at, bounds)).tolist() == [len(r) for r in rare]
        found = list(net.places(ids, bounds))
        assert not len(ids) or np.array_equal(np.concatenate([x[0] for x in found], axis=1), near)
    # White space is what str.isspace() says: ODD and the ASCII six.
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(lm.ODD) | set(" \t\n\v\f\r")
    long = ["w1 w2 w3 " * lm.STEP, "b"]
    near, word, _ = _plain_places(net, long)
    found = list(net.places(*net.encode_all(long)[:2]))
    assert len(found) == 4 and np.array_equal(np.concatenate([x[0] for x in found], axis=1), near) and np.concatenate([x[1] for x in found]).tolist() == word.tolist()


def test_encoding_takes_well_under_the_time_of_single_words():
    rng = np.random.default_rng(5)
    net = _network([f"w{k}" for k in range(lm.VOCABULARY - lm.SHARED)])
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.2, 300) % 400_000) for _ in range(600)]

    def least(run):
        took = []
        for _ in range(5):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    together = lambda: list(net.places(*net.encode_all(texts)[:2]))
    assert least(together) < 0.75 * least(lambda: [net.windows(ids, np.arange(len(ids))) for ids in map(_by_word(net), texts)])


def _by_word(net):
    """One text at a time, a look-up and a checksum for each of its words."""

    def run(text):
        said = lm.tokens(text)
        ids = np.fromiter(map(net.ids.get, said, repeat(-1)), np.int32, len(said))
        at = np.flatnonzero(ids < 0)
        ids[at] = [lm.VOCABULARY - lm.SHARED + zlib.crc32(said[k].encode()) % lm.SHARED for k in at.tolist()]
        return ids

    return run


def test_pieces_hold_every_text_once(monkeypatch):
    texts = ["aa", None, "b" * 9, "", "c", "dd", "e", None, None]
    for size in (1, 3, 4, 100):
        monkeypatch.setattr(lm, "PIECE", size)
        found = list(lm.pieces(pa.array(["before", *texts], pa.string()).slice(1)))
        assert [t for _, run in found for t in run] == [t or "" for t in texts]
        assert [first for first, _ in found] == np.cumsum([0, *[len(run) for _, run in found]])[:-1].tolist()
    assert not list(lm.pieces(pa.array([], pa.string())))


def test_checksums_of_all_words_are_those_of_zlib():
    rng = np.random.default_rng(4)
    words = ["", *["".join(map(chr, rng.integers(33, 900, n))) for n in rng.integers(0, 60, 500)], "x" * 64, "x" * 65, "ü" * 32, "x" * 1000]
    got = lm.crc32_of_all(pa.array(["before", *words], pa.string()).slice(1))
    assert got.tolist() == [zlib.crc32(w.encode()) for w in words] and not len(lm.crc32_of_all(pa.array([], pa.string())))
