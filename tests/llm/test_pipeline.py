import collections
import os
import sys

import pytest
from plain import LOWER, line_dedup

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline as C
    from fescue.llm._common import cut

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        docs = cut(f(spark, docs, sf), name)
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_rows(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]


def test_rules_keep_whole_rows(stages):
    assert set(map(tuple, stages[1].collect())) <= set(map(tuple, stages[0].collect()))


def test_lines(stages):
    want = [(i, t) for i, _, _, t in line_dedup(pairs(stages[1]))]
    assert collections.Counter(pairs(stages[2])) == collections.Counter(want)
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group(stages):
    """Groups of all pairs with a Jaccard similarity of 0.8 or more of their sets of five-word shingles."""
    before = pairs(stages[2])

    def shingles(text):
        w = (text or "").translate(LOWER).split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, parent = [shingles(t) for _, t in before], list(range(len(before)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(before)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    keep = {}
    for k, (i, _) in enumerate(before):
        keep[find(k)] = min(keep.get(find(k), i), i)
    assert collections.Counter(pairs(stages[3])) == collections.Counter(x for x in before if x[0] in set(keep.values()))


def test_no_benchmark_item_is_left(spark, sf, stages):
    from fescue.llm.decontaminate import normal

    items = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {i for i, _ in pairs(stages[3])} - {i for i, _ in pairs(stages[4])}
    leaking = {i for i, t in pairs(stages[3]) if any(x in normal(t) for x in items)}
    assert leaking <= gone


def test_tokens_round_trip(stages):
    last = stages[5].collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    assert {r.doc_id for r in last} == {i for i, _ in pairs(stages[4])}


def test_run(spark, sf, stages):
    import corpus_pipeline as C

    assert C.run(spark, sf).count() == stages[5].count()
