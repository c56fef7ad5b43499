"""SimHash fingerprints bring near copies together in the pipeline's stage, beside min-hash bands."""

import random

import numpy as np


def test_fingerprints_make_keys_of_their_own(spark):
    from fescue.llm import near_copies as N

    fps = [0, 0b1111, 0b11110000, 1 << 60 | 0xFFFF, -1, -1]
    nodes = spark.createDataFrame([(k, k, fp, [k]) for k, fp in enumerate(fps)], "node long, id long, fp long, keys array<long>")
    got = {r.node: r["keys"] for r in N.by_fingerprints(nodes).collect()}
    assert all(len(got[k]) == 2 and got[k][0] == k for k in got) and len(got) == 6
    # 0 and 4 bits, 0 and 4 others (8 apart, by way of 0), one far from all, and two that are equal.
    assert got[0][1] == got[1][1] == got[2][1] and got[4][1] == got[5][1] and len({got[k][1] for k in (0, 3, 4)}) == 3


def test_near_copies_without_a_common_band_are_one_group(spark):
    from fescue.llm import near_copies as N

    rng, base = random.Random(5), [f"w{k}" for k in range(3000)]
    texts = [" ".join(base), " ".join([*base[:200], "other", *base[201:]]), " ".join(f"u{rng.randrange(10**6)}" for _ in range(3000))]
    sets = [N.shingle_set(t.encode()) for t in texts]
    prints = [np.uint64(N.fingerprint(s) & (1 << 64) - 1) for s in sets]
    assert np.bitwise_count(prints[0] ^ prints[1]) <= N.BITS < np.bitwise_count(prints[0] ^ prints[2])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    # Keys of bands that no two texts have in common.
    nodes = spark.createDataFrame([(int(k), int(k), int(p.view(np.int64)), [int(k)]) for k, p in enumerate(prints)], "node long, id long, fp long, keys array<long>")
    got = N.links(N.by_fingerprints(nodes), docs).select("u", "v").collect()
    assert [sorted(r) for r in got] == [[0, 1]]
