import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain import ODD

from fescue.llm import suffix_dedup as S


def plain(rows, least=100):
    """rows: (id, text) without two rows of one id."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = True
            seen.add(w)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))
    return out


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = S.drop_repeats(docs.repartition(5))
    assert got.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(got) == want and sum(x[1] for x in want.values()) > 10_000


def corpus(seed, n=60):
    rng = random.Random(seed)
    some = ["".join(rng.choice("abé日 \n\x00") for _ in range(rng.choice([60, 99, 100, 101, 150, 400]))) for _ in range(6)]
    some += ["-" * 130, "ab" * 90, "\x00" * 105]
    text = lambda: "".join(rng.choice(some) if rng.random() < 0.6 else "".join(rng.choice("xyz w") for _ in range(rng.randrange(80))) for _ in range(rng.randrange(6)))
    return [(i, text()) for i in rng.sample(range(-500, 500), n)]


@pytest.mark.parametrize("seed,group,batch,chunk", [(0, 20_000, 40_000, 1 << 20), (1, 3, 5, 64), (2, 1, 1, 130), (3, 8, 200, 1 << 20)])
def test_random_texts_in_small_groups_and_parted_keys(spark, monkeypatch, seed, group, batch, chunk):
    # Python workers are forked from a daemon that has read the module; its sizes travel with the functions only where they
    # are used on the driver, so anchors and repeats are also held against plain versions below.
    monkeypatch.setattr(S, "GROUP", group)
    table = corpus(seed)
    docs = spark.createDataFrame(table, "doc_id long, text string").selectExpr("1 as who", "text", "2 as kept", "doc_id", "3 as key", "4 as `a.b`").repartition(7)
    got = S.drop_repeats(docs)
    assert got.columns == ["who", "text", "doc_id", "key", "a.b", "n_bytes", "n_removed", "n_spans", "kept"]
    assert rows(got) == plain(table) and {(r.who, r.key, r["a.b"], r.text) for r in got.collect()} == {(1, 3, 4, t) for _, t in table}


@pytest.mark.parametrize("seed", range(3))
def test_anchors_and_chunks(monkeypatch, seed):
    texts = [t.encode() for _, t in corpus(seed, 20)] + [b"", b"x" * 99, b"x" * 100]
    b, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = [x.tolist() for x in S.anchors(b, ends)]
    starts = {s for p, a, z in zip(*whole) for s in range(a, z + 1)}
    assert starts == {e - len(t) + k for t, e in zip(texts, ends) for k in range(len(t) - 99)} and all(z <= p <= a + 76 for p, a, z in zip(*whole))
    for chunk in (1, 7, 100, 1000):
        monkeypatch.setattr(S, "CHUNK", chunk)
        assert [x.tolist() for x in S.anchors(b, ends)] == whole


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in S.drop_repeats(docs).collect())
    want = plain(list(dict.fromkeys(ODD)))
    assert got == Counter((i, want[i][0], want[i][1], want[i][3]) for i, _ in ODD)
    assert S.drop_repeats(docs.where("false")).count() == 0
    one = "same id, different text, long enough to be looked at: " + "".join(map(str, range(40)))
    pair = S.drop_repeats(spark.createDataFrame([("k", one), ("k", one + "!"), ("k", one), (None, one)], "doc_id string, text string")).collect()
    assert sorted(r.n_removed == 0 for r in pair) in ([False, False, True, True], [False, False, False, True])
    assert {r.n_removed for r in pair if r.doc_id is None} == {len(one)}


def test_order_and_common_prefixes():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.choice([0, 3, 40, 60, 100]))) for _ in range(300)]
    strings += [s[: rng.randrange(101)] for s in strings] + [b"a" * n for n in range(101)] + [b"\0" * n for n in range(101)]
    group = np.sort([rng.randrange(40) for _ in strings])
    order, lcp = S.sort_suffixes(pa.array(strings, pa.binary()), group, 100)
    for g in range(40):
        at = np.flatnonzero(group[order] == g)
        own = [strings[k] for k in order[at]]
        assert own == sorted(own, key=lambda s: (s.ljust(100, b"\0"), len(s))) and sorted(order[at]) == np.flatnonzero(group == g).tolist()
        assert [int(x) for x in lcp[at][1:]] == [S.common(a, b) for a, b in zip(own, own[1:])] and not lcp[at][:1].any()
    same = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(200)]
    assert [same[k] for k in S.blind_trie(same, 0)] == sorted(same)
