import random
import re
from collections import Counter, defaultdict

import pytest
from plain import LOWER, ODD

from fescue.llm import collocations as C


def plain(rows, least=10, most_words=3, covered=50, top=2_000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, got in f.items():
        long = {g: a for g, a in got.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in long.items():
            for s in {g[i : i + k] for k in range(2, len(g)) for i in range(len(g) - k + 1)}:
                inside[s] = max(inside[s], a)
        found = []
        for g, a in long.items():
            if not (inside[g] and 100 * inside[g] >= covered * a):
                score, _, left, right = min((10**6 * a * a // (got[g[:k]] * got[g[k:]]), k, got[g[:k]], got[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def rows(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return Counter(map(tuple, df.collect()))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = [(r.lang, r.text) for r in docs.collect()]
    assert rows(C.collocations(docs.repartition(4))) == plain(table)
    assert rows(C.collocations(docs, top=7, covered=30)) == plain(table, top=7, covered=30)


@pytest.mark.parametrize("seed", range(2))
def test_ties_null_languages_and_longer_phrases(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "WORDS", 50)
    rng = random.Random(seed)
    table = [(rng.choice([None, "und", "a", ""]), "".join(rng.choice("aAbBcé日\x00") + rng.choice(["", "", " ", " ", "\t ", ".", "\n", "\x0b", ";"]) for _ in range(rng.randrange(200)))) for _ in range(60)]
    table += [("a", t) for _, t in ODD] * 3 + [(None, None), ("z", " \t")]
    docs = spark.createDataFrame(table, "lang string, text string").selectExpr("text", "1 as n", "2 as piece", "lang", "3 as m")
    assert rows(C.collocations(docs, 3, 4)) == plain(table, 3, 4)
    assert rows(C.collocations(docs, 2, 2)) == plain(table, 2, 2)
    assert C.collocations(docs.where("false")).count() == 0


def test_arithmetic_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("x", "a b", 2, 3_000_000_000_000)], "lang string, gram string, k byte, f long")
    every = spark.createDataFrame([("x", "a", 1, 3_000_000_000_001), ("x", "b", 1, 7_000_000_000_003)], "lang string, gram string, k byte, f long")
    (r,) = C.with_parts(phrases, every).collect()
    assert r.score == 10**6 * r.a * r.a // (r.l * r.r) and (r.a, r.l, r.r) == (3 * 10**12, 3 * 10**12 + 1, 7 * 10**12 + 3)
