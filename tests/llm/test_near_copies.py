"""Whole documents at, just above and just below a Jaccard similarity of 0.8 on 5-word shingles."""

import random

import numpy as np

SCHEMA = "doc_id long, text string"


def text(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def similarity(a, b):
    from fescue.llm.near_copies import shingle_set

    x, y = (shingle_set(" ".join(t).encode()) for t in (a, b))
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common)


def test_pipeline_stage_takes_near_copies_at_the_threshold(spark):
    import corpus_pipeline as C

    rng, rows, gone = random.Random(5), [], set()
    for k in range(25):
        base = text(rng, 94)  # 90 shingles; two words changed leave 80 of 100
        near, far = list(base), list(base)
        near[30], near[60] = "x", "y"
        far[20], far[40], far[60] = "x", "y", "z"
        assert similarity(base, near) == 0.8 and similarity(base, far) < 0.8
        one = list(base)
        one[50] = "x"
        assert similarity(base, one) > 0.8
        for i, t in ((0, base), (1, near), (2, one)):
            rows.append((10 * k + i, " ".join(t)))
        gone |= {10 * k + 1, 10 * k + 2}
        other = text(rng, 94)
        apart = list(other)
        apart[20], apart[40], apart[60] = "x", "y", "z"
        rows += [(10 * k + 5, " ".join(other)), (10 * k + 6, " ".join(apart))]
    rows += [(900, "a b"), (901, " A  b\n"), (902, "a c"), (903, ""), (904, None), (None, "a b")]
    gone |= {901, 904}
    got = sorted((r.doc_id for r in C.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()), key=str)
    assert got == sorted((i for i, _ in rows if i not in gone), key=str)


def test_groups_are_what_all_pairs_connect(spark):
    """A chain and a star of near copies, with blocks so small that buckets are dealt out."""
    from fescue.llm import near_copies as N

    rng = random.Random(8)
    now, chain = text(rng, 200), []
    for k in range(30):
        chain.append(list(now))
        now[rng.randrange(200)] = f"c{k}"
    base = text(rng, 120)
    star = [[*base[:k], f"s{k}", *base[k + 1 :]] for k in range(0, 120, 3)]
    rows = [(k, " ".join(t)) for k, t in enumerate([*chain, *star])]
    old, N.BLOCK = N.BLOCK, 4
    try:
        got = {r.doc_id for r in N.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        N.BLOCK = old
    assert got == {0, 30}


def test_texts_that_share_an_id_and_odd_rows(spark):
    from fescue.llm.near_copies import keep_one

    rng = random.Random(9)
    a, b, c = (" ".join(text(rng, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (3, b), (4, a), (4, c), (1, a), (None, a), (None, None), (6, None), (5, "")]
    got = keep_one(spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'k' as node", "7 as __x", "1 as s"))
    assert got.columns == ["doc_id", "text", "node", "__x", "s"] and {(r.node, r["__x"], r.s) for r in got.collect()} == {("k", 7, 1)}
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(1, a), (1, b), (2, c), (0, a), (0, ""), (5, "")])
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_template_of_texts_near_the_threshold(spark, monkeypatch):
    """Copies of one template with edits of their own: some pairs reach the threshold, most do not. Groups are those of all pairs,
    and what is compared grows with the members."""
    from fescue.llm import near_copies as N

    rng, base, docs = random.Random(3), [f"t{k}" for k in range(300)], []
    for k in range(160):
        t = list(base)
        for at in rng.sample(range(300), 8 if k < 150 else 2):
            t[at] = f"e{rng.randrange(10**6)}"
        docs.append(t)
    docs += [list(docs[k]) for k in range(5)]
    for k in range(160, 165):
        docs[k][100] = "own"
    rows = [(k, " ".join(t)) for k, t in enumerate(docs)]
    sets = [N.shingle_set(t.encode()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    sent = []
    plain = N._blocks
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "_blocks", lambda known: sent.append((known.count(), plain(known).count())) or plain(known))
    got = {r.doc_id for r in N.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(group) and 20 < len(got) < 155
    members, dealt = sent[0]
    assert dealt <= 4 * members
