"""Near-duplicate passages against all pairs of passages, on planted tables."""

import random

import numpy as np
import pytest

from fescue.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string"


def words(rng, n, kind="u"):
    return [f"{kind}{rng.randrange(10**8)}" for _ in range(n)]


def found(spark, rows):
    from fescue.llm.substring_dedup import near_passages

    got = near_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    return by


def test_exact_passages_beside_shorter_pieces(spark):
    """60 pairs of documents with 60 words in common, and six shorter pieces of each passage in other documents."""
    rng, rows = random.Random(1), []
    for k in range(60):
        p = words(rng, 60, "p")
        for side in (0, 1):
            rows.append((10 * k + side, " ".join([*words(rng, 70), *p, *words(rng, 70)])))
        for j in range(6):
            at = rng.randrange(20)
            rows.append((10 * k + 2 + j, " ".join([*words(rng, 60), *p[at : at + 40], *words(rng, 60)])))
    by = found(spark, rows)
    for k in range(60):
        a, b = by[10 * k], by[10 * k + 1]
        assert len(a) == len(b) == 1
        for r in (*a, *b):
            assert (r.class_id, r.rep_doc_id, r.n_links, r.similarity) == (10 * k, 10 * k, 1, 1.0)
            assert (r.start_word, r.end_word, r.rep_start_word, r.rep_end_word) == (70, 130, 70, 130)
    assert len(by) == 120


def test_two_passages_on_a_diagonal_and_one_twice(spark):
    rng = random.Random(2)
    p, q, twice = words(rng, 60, "p"), words(rng, 55, "q"), words(rng, 64, "t")
    rows = [(k, " ".join([*words(rng, 40), *p, *words(rng, 200), *q, *words(rng, 40)])) for k in (1, 2)]
    rows += [(3, " ".join([*words(rng, 50), *twice, *words(rng, 300), *twice, *words(rng, 9)])), (4, " ".join([*words(rng, 20), *twice, *words(rng, 30)]))]
    by = found(spark, rows)
    spots = lambda i: sorted((r.start_word, r.end_word) for r in by[i])
    assert spots(1) == spots(2) == [(40, 100), (300, 355)]
    assert spots(3) == [(50, 114), (414, 478)] and spots(4) == [(20, 84)]


def similar(a, b):
    """Whether a run of 46 shingles of one text or more is like one of the other, by all pairs of runs of up to 70."""
    x, y = ([tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in (a, b))
    for n in (46, 52, 60, 70):
        for i in range(len(x) - n + 1):
            s = set(x[i : i + n])
            for j in range(max(0, i - 3), min(len(y) - n, i + 3) + 1):
                t = set(y[j : j + n])
                if len(s & t) >= 0.8 * len(s | t):
                    return True
    return False


def test_edited_passages_against_all_pairs(spark):
    """Groups of edited copies of one passage, small and large, with blocks so small that keys are dealt out."""
    from fescue.llm import substring_dedup as S

    rng, rows, want, k = random.Random(3), [], [], 0
    old, S.BLOCK = S.BLOCK, 8
    try:
        for size in (2, 2, 2, 3, 3, 4, 30):
            p, own = words(rng, 75, "p"), []
            for _ in range(size):
                q = list(p)
                for _ in range(rng.randint(0, 2)):
                    q[rng.randrange(75)] = words(rng, 1, "e")[0]
                text = [*words(rng, 30), *q, *words(rng, 30)]
                rows.append((k, " ".join(text)))
                own.append((k, text))
                k += 1
            want += [(a[0], b[0]) for i, a in enumerate(own) for b in own[:i] if similar(a[1], b[1])]
        by = found(spark, rows)
    finally:
        S.BLOCK = old
    classes = {i: {r.class_id for r in by.get(i, [])} for i in range(k)}
    hit = sum(bool(classes[a] & classes[b]) for a, b in want)
    assert len(want) > 100 and hit >= 0.97 * len(want)
    linked = {i for pair in want for i in pair}
    assert linked - set(by) == set() or len(set(by) & linked) >= 0.97 * len(linked)


def test_equal_texts_ties_and_odd_rows(spark):
    from fescue.llm.substring_dedup import near_passages

    rng = random.Random(4)
    whole, short = " ".join(words(rng, 80)), "a b c"
    rows = [(5, whole), (3, whole), (9, whole), (9, whole), (None, whole), (1, short), (2, short), (4, None), (6, ""), (7, "the " * 300), (8, "x " + "the " * 90)]
    got = near_passages(spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "1 as t", "'k' as rep")).collect()
    same = sorted((r.doc_id, r.class_id, r.start_word, r.end_word, r.similarity) for r in got if r.doc_id in (3, 5, 9))
    assert same == [(3, 3, 0, 80, 1.0), (5, 3, 0, 80, 1.0), (9, 3, 0, 80, 1.0)]
    assert {r.doc_id for r in got} == {3, 5, 9, 7, 8}
    named = near_passages(spark.createDataFrame([("b", whole), ("a", whole)], "doc_id string, text string"))
    assert sorted((r.doc_id, r.class_id) for r in named.collect()) == [("a", "a"), ("b", "a")]
    assert near_passages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("gap", [1, 3])
def test_long_texts_are_worked_on_in_parts(spark, gap):
    from fescue.llm import substring_dedup as S

    rng = random.Random(5)
    p = words(rng, 60, "p")
    long = " ".join([*words(rng, 2900 + 37 * gap), *p, *words(rng, 800)])
    old, S.CHUNK = S.CHUNK, 3000
    try:
        by = found(spark, [(1, long), (2, " ".join([*words(rng, 20), *p]))])
    finally:
        S.CHUNK = old
    assert [(r.start_word, r.end_word) for r in by[1]] == [(2900 + 37 * gap, 2960 + 37 * gap)]


def test_many_pairs_at_once_as_one_by_one():
    rng = np.random.default_rng(3)
    hit = rng.random((200, 121)) < 0.9
    n = rng.integers(0, 122, 200)
    hit &= np.arange(121) < n[:, None]
    for cost in sd.COSTS:
        start, end = sd._longest_of(hit, n, cost)
        assert [(int(a), int(b)) for a, b in zip(start, end)] == [sd._longest(h[:k], cost) for h, k in zip(hit, n)]
    # Contexts around a shared passage with changed, added and lost shingles, some of them short or with repeats.
    base, ctx, rows = np.arange(1, 122), [], []
    for k in range(150):
        c = base.copy()
        for at in rng.integers(0, 121, rng.integers(0, 5)):
            c[at : at + 5] = rng.integers(1000, 10**6, len(c[at : at + 5]))
        if k % 4 == 0:
            at = rng.integers(0, 100)
            c = np.delete(c, slice(at, at + rng.integers(0, 12)))[:121]
        if k % 7 == 0:
            c[5] = c[6]
        c = c[: rng.integers(70, 122)].astype(np.int32)
        ctx.append(c)
        rows.append((k, 60, None))
    block, found = sd._Block(rows, ctx), 0
    for k in range(150):
        if len(np.unique(ctx[k])) < len(ctx[k]):
            continue
        told = set(block.open_to(block.places(ctx[k]), 60, np.arange(150)).tolist())
        right = {j for j in range(150) if any(x[0] <= 60 < x[1] for x in sd.passages(ctx[k], ctx[j], 60))}
        assert right <= told
        found += len(right)
    assert found > 2000
