import math
import random
import re
from collections import Counter

import pytest
from plain import LOWER, ODD

from fescue.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASKED = [(1, "one line w12 w12 w12"), (2, None), (3, ""), (4, "nowhere-to-be-found"), (5, "état 日本語 12345 DON"), (5, "a b c"), (None, "id row w3"), (7, "x" * 5000), (8, " ".join(f"w{i}" for i in range(400)))]


def plain(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(map(tuple, df.collect()))


def test_whole_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(S.search(docs.repartition(5), items)) == want


def test_odd_rows_and_many_blocks_of_items(spark, monkeypatch):
    docs = spark.createDataFrame(ODD * 3, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score", "3 as q")
    items = spark.createDataFrame(ASKED, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id")
    want = plain(ODD * 3, ASKED)
    assert rows(S.search(docs, items)) == want
    monkeypatch.setattr(S, "ITEM_CHARS", 20)
    assert rows(S.search(docs, items)) == want
    assert S.search(docs.where("false"), items).count() == 0 and S.search(docs, items.where("false")).count() == 0
    named = S.search(docs.selectExpr("concat('d', doc_id) as k", "text as body"), items, id_col="k", text_col="body")
    assert {r.doc_id for r in named.collect() if r.item_id == 1} == {"d4", "d7"}


@pytest.mark.parametrize("seed", range(4))
def test_a_shard_skips_no_document_that_qualifies(seed, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng, np = random.Random(seed), S.np
    words = [[min(int(rng.paretovariate(0.6)), 40) - 1 for _ in range(rng.randint(1, 60))] for _ in range(300)]
    tf, n_terms = [Counter(w) for w in words], sum(map(len, words))
    weights = np.array([S.weight(300, sum(t in c for c in tf)) for t in range(40)])
    first = np.cumsum([0] + [len(c) for c in tf])
    shard = S.Shard(np.array(list(map(len, words))), first, np.array([t for c in tf for t in c]), np.array([n for c in tf for n in c.values()]), weights, 300, n_terms)
    for _ in range(30):
        item = Counter(rng.randrange(40) for _ in range(rng.randint(1, 12)))
        score = [sum(n * int(weights[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * len(w) * 300 // n_terms))) for t, n in item.items() if c[t]) for w, c in zip(words, tf)]
        docs, got = shard.search(item, 1, 5)
        least = sorted(score)[-5]
        assert {d: s for d, s in zip(docs.tolist(), got.tolist())}.items() >= {d: s for d, s in enumerate(score) if s >= max(least, 1)}.items()
        assert all(score[d] == s for d, s in zip(docs, got))
