import collections
import random
import zlib

import numpy as np
import pytest
from plain import ODD, base_rules, components, crc_fold, edit_within, jump, line_dedup, sha
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def test_line_dedup(spark, docs, rows, odd, none):
    from fescue.llm.line_dedup import dedup_lines

    same(dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect(), line_dedup(rows))
    same(dedup_lines(odd, min_docs=2).select("doc_id", "n_lines", "n_dropped", "text").collect(), line_dedup(ODD, 2))
    assert dedup_lines(none).count() == 0
    extra = odd.selectExpr("doc_id", "1 as n_lines", "text", "'k' as _id", "2 as _lines", "3 as `a.b`")
    got = dedup_lines(extra)
    assert got.columns == ["doc_id", "text", "_id", "_lines", "a.b", "n_lines", "n_dropped"] and {(r["_id"], r["_lines"], r["a.b"]) for r in got.collect()} == {("k", 2, 3)}
    many = spark.createDataFrame([(i, "Shared \nown %d" % i) for i in range(30)], SCHEMA)
    assert {r.text for r in dedup_lines(many).collect()} == {f"own {i}" for i in range(30)}


def test_quality_rules(spark, sf, docs, rows, odd, none):
    from fescue.llm.quality_rules import quality_rules

    trusted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for table, plain in ((docs, rows), (odd, ODD)):
        same(quality_rules(table, trusted).select(*cols).collect(), [(i, *base_rules(t)) for i, t in plain])
    assert quality_rules(none, trusted).count() == 0
    extra = quality_rules(odd.selectExpr("'k' as _w", "doc_id", "text", "'x' as kept", "1 as _s"), trusted)
    assert {(r["_w"], r["_s"], type(r["kept"])) for r in extra.collect()} == {("k", 1, bool)}
    # No trusted document: the base rules alone decide.
    got = quality_rules(docs, trusted.where("false")).select("kept", "base_failed", "ratio").collect()
    assert all(r.kept != r.base_failed and r.ratio == 0 for r in got)


def test_quality_ratio_is_the_mean_weight(spark, docs, rows):
    import xxhash
    from fescue.llm import quality_rules as Q

    ids = {i for i, _ in rows[::2]}
    trusted = spark.createDataFrame([(i,) for i in ids], "doc_id long")

    def grams(t):
        w = [x.encode() for x in t.split()]
        h = [xxhash.xxh64_intdigest(x, 42) for x in w]
        # A pair's hash takes the second word with the first one's hash as seed.
        return [x >> (64 - Q.BUCKET_BITS) for x in [*h, *[xxhash.xxh64_intdigest(b, x) for x, b in zip(h, w[1:])]]]

    every, wanted = collections.Counter(), collections.Counter()
    for i, t in rows:
        g = grams(t)
        every.update(g)
        if i in ids:
            wanted.update(g)
    share = sum(wanted.values()) / sum(every.values())
    weight = lambda b: round(Q.SCALE * float(np.log((wanted[b] / share + Q.SMOOTHING) / (every[b] + Q.SMOOTHING))))
    got = dict(Q.quality_rules(docs, trusted).select("doc_id", "ratio").collect())
    for i, t in rows[:40]:
        g = grams(t)
        assert got[i] == pytest.approx(sum(map(weight, g)) / len(g) / Q.SCALE, abs=2e-4)


def test_sharding(docs, rows, odd, none):
    from fescue.llm.sharding import shard

    for table, plain in ((docs, rows), (odd, ODD)):
        got = shard(table, 24).collect()
        same([(r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got], [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", jump(i, 24), jump(i, 25)) for i, t in plain])
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard(none).count() == 0


def test_byte_bpe(docs, rows, odd, none):
    import public_tokenizers as P
    from fescue.llm import byte_bpe as B

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = B._encoding(open(path, "rb").read(), P.PATTERN)
    for table, plain in ((docs, rows), (odd, ODD)):
        got = B.byte_bpe(table, path, P.PATTERN).select("doc_id", "ids", "decoded").collect()
        same([(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got], [(i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in plain])
    assert B.byte_bpe(none, path, P.PATTERN).count() == 0
    rng = random.Random(2)
    long = "".join(rng.choice(["word ", "don't ", "  \n ", "1234", "é", "\t", "!!", " 　x", "\x1c y"]) for _ in range(4000))
    for size in (1, 7, 64, 1000):
        assert [i for p in B.pieces(long, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(long)


def test_simhash(spark, docs, rows, odd, none):
    from fescue.llm.simhash import keep_one, near_duplicates

    same(near_duplicates(docs).collect(), components(rows))
    same(near_duplicates(odd).collect(), components(ODD))
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0
    kept = keep_one(docs).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {c for _, _, c in components(rows)} and len(kept) == len({r.doc_id for r in kept})


def test_simhash_links_all_pairs(spark):
    """Chains, stars and far values against all pairs; blocks are made small so that large buckets are dealt out."""
    from fescue.llm import simhash as S
    from fescue.llm._common import components as joined

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = [int(b) for b in base]
    for b in base[:10]:
        x = int(b)
        for _ in range(60):
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(k)
            values.append(x)
            if rng.random() < 0.5:
                x = int(b)
    fps = np.unique(np.array(values, np.uint64))
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    want = collections.Counter(find(i) for i in range(len(fps)))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    old, S.BLOCK = S.BLOCK, 16
    try:
        labels = dict(joined(S.links(nodes)).collect())
    finally:
        S.BLOCK = old
    got = collections.Counter(labels.get(int(x), int(x)) for x in fps.view(np.int64))
    assert sorted(got.values()) == sorted(want.values())
    for parts in ([(1, 13, 0)], S.plan(10**9, S.bit_counts(nodes)[1] * 0 + np.full((64, 64), 10**9 // 4) + np.diag(np.full(64, 10**9 // 4)))):
        assert parts
    # Thresholds plus one add up to one more than the distance.
    p = S.plan(*S.bit_counts(nodes))
    assert sum(t + 1 for _, _, t in p) == 5


def test_decontamination(spark, sf, docs, rows, odd, none):
    from fescue.llm import decontaminate as D

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, D.normal(r.text)) for r in bench.collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in D.leaks(docs, bench).collect()}
    exact = {(i, k) for i, t in rows for k, x in items if x in D.normal(t)}
    assert exact <= set(got) and all(got[x] == 0 for x in exact)
    rng, edited, sure = random.Random(3), [], []
    for n in range(40):
        k, x = rng.choice(items)
        y = list(x)
        for _ in range(rng.randint(0, len(x) // 7)):
            p = rng.randrange(len(y))
            y[p : p + rng.choice([0, 1])] = rng.choice(["z", "", "q"])
        text = D.normal(rows[n][1])[:400] + " " + "".join(y) + " " + D.normal(rows[n + 40][1])[:400]
        edited.append((n, text))
        sure.append((n, k, edit_within(x, D.normal(text), int(len(x) * D.EDITS))))
    found = {(r.doc_id, r.item_id): r.edits for r in D.leaks(spark.createDataFrame(edited, SCHEMA), bench).collect()}
    for n, k, e in sure:
        assert found.get((n, k)) == e
    assert D.leaks(none, bench).count() == 0 and D.leaks(docs, bench.where("false")).count() == 0
    assert D.leaks(odd, spark.createDataFrame([(1, "A row  WITHOUT an id"), (2, None), (3, "")], "item_id long, text string")).collect()[0]["edits"] == 0
    old, D.ITEM_CHARS = D.ITEM_CHARS, 500
    try:
        assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == set(got)
    finally:
        D.ITEM_CHARS = old
    assert {r.doc_id for r in D.without_leaks(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_decontamination_in_long_texts():
    from fescue.llm import decontaminate as D

    item = "the quick brown fox jumps over the lazy dog and then it rests for a while"
    index = D.Index([(5, item)])
    old, D.CHUNK = D.CHUNK, 1000
    try:
        for at in range(880, 1010, 7):
            text = ("lorem ipsum " * 300)[:at] + item + "dolor sit " * 200
            assert [(m[0], m[1], m[3]) for m in D.matches(D.codes(text), index)] == [(5, at, 0)]
    finally:
        D.CHUNK = old


def test_quality_classifier(spark, sf, docs, rows, odd, none):
    from fescue.llm import quality_classifier as C

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    big, lab = docs, labels
    got = C.quality_scores(big, lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert all(h == (crc_fold(i) == 0) for i, h in zip(got.doc_id, got.held_out))
    j = got.merge(lab.toPandas(), on="doc_id")
    held = j[j.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    # Labels of the held out fold do not matter.
    flipped = lab.withColumn("quality", F.when(C.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert C.quality_scores(big, flipped).toPandas().sort_values("doc_id").score.tolist() == pytest.approx(got.sort_values("doc_id").score.tolist(), abs=1e-5)
    assert C.quality_scores(odd, labels).count() == len(ODD) and C.quality_scores(none, labels).count() == 0
    assert {r.score for r in C.quality_scores(odd, labels.where("false")).collect()} == {0.5}
    x, y = C.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 3, 3]), np.array([2.0, 1, 4, 3]))
    assert (np.diff(y) >= 0).all() and y[0] == pytest.approx(1 / 3)


def test_pseudo_likelihood(docs, rows, odd, none):
    from fescue.llm import lm_scoring as L

    net = L.train(docs)
    got = {r.doc_id: r for r in L.score(docs, net).collect()}
    for i, t in rows[:25]:
        ids = net.encode(t)
        total = 0.0
        for k, word in enumerate(ids):
            near = [ids[k + d] if 0 <= k + d < len(ids) else L.VOCABULARY for d in (-2, -1, 1, 2)]
            h = np.tanh(net.b + sum(net.e[n] * a for n, a in zip(near, net.a)))
            top, low = divmod(int(word), L.CLASS)
            z, q = net.c[:, :-1] @ h + net.c[:, -1], net.w[top, :, :-1] @ h + net.w[top, :, -1]
            total += z[top] - np.log(np.exp(z).sum()) + q[low] - np.log(np.exp(q).sum())
        assert got[i].n_tokens == len(ids) and got[i].log_likelihood == pytest.approx(total, rel=1e-4, abs=1e-2)
    rounds, L.ROUNDS = L.ROUNDS, 0
    try:
        start = L.score(docs, L.train(docs)).agg(F.sum("log_likelihood")).first()[0]
    finally:
        L.ROUNDS = rounds
    assert sum(r.log_likelihood for r in got.values()) > start
    out = {(r.doc_id, r.n_tokens) for r in L.score(odd, net).collect()}
    assert (1, 0) in out and (2, 0) in out and L.score(none, net).count() == 0 and L.pseudo_likelihood(none).count() == 0


def test_compact_windows():
    from fescue.llm import substring_dedup as S

    rng = np.random.default_rng(1)
    s = rng.integers(1, 1 << 60, 700).astype(np.uint64)
    s[300], s[400:420] = 0, s[500:520]
    for j, (_, c, left, right) in enumerate(S.windows(s)):
        v = S._mix(s + np.uint64(0x632BE59BD9B4E019 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        order = (v & ~np.uint64((1 << 20) - 1)) | np.arange(len(s), dtype=np.uint64)
        want = {}

        def cut(lo, hi, order=order, want=want):
            if hi - lo + 1 >= S.SHORTEST:
                m = lo + int(np.argmin(order[lo : hi + 1]))
                want[m] = (min(m - lo, 255), min(hi - m, 255))
                cut(lo, m - 1)
                cut(m + 1, hi)

        cut(0, 299)
        cut(301, len(s) - 1)
        assert {int(a): (int(b), int(d)) for a, b, d in zip(c, left, right)} == want


def test_substring_dedup(spark, docs, rows, odd, none):
    from fescue.llm.substring_dedup import near_passages

    rng = random.Random(6)
    shared = " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))
    clean = [(1000 + k, " ".join(f"u{rng.randrange(10**7)}" for _ in range(300))) for k in range(20)]
    planted = [(2000 + k, " ".join([f"v{rng.randrange(10**7)}" for _ in range(80)] + [shared] + [f"v{rng.randrange(10**7)}" for _ in range(80)])) for k in range(6)]
    got = near_passages(spark.createDataFrame(rows + clean + planted, SCHEMA)).collect()
    ids = {r.doc_id for r in got} | {r.rep_doc_id for r in got}
    assert not ids & {i for i, _ in clean} and {i for i, _ in planted} <= ids
    hit = [r for r in got if r.doc_id >= 2000]
    assert all(r.start_word <= 80 and r.end_word >= 140 and r.rep_start_word <= 80 for r in hit)
    # Whatever shares 50 words is linked, directly or through others.
    runs = collections.defaultdict(set)
    for i, t in rows:
        w = t.lower().split()
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add(i)
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        parent[find(r.doc_id)] = find(r.rep_doc_id)
    assert all(len({find(i) for i in ids}) == 1 for ids in runs.values())
    assert near_passages(none).count() == 0
    # The repeated row of the odd table is one document; nothing else repeats.
    assert near_passages(odd).count() == 0


def test_warc(spark, sf, tmp_path):
    import gzip
    import io

    from fescue.llm import warc as W

    class Raw(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    made = [{"record_type": t, "record_id": f"<urn:page:{i}>", "payload": p, "content_type": "application/http; msgtype=response", "headers": {"X-A": "é"}} for i, (t, p) in enumerate([("response", b"abc"), ("revisit", None), ("response", b""), ("response", bytes(range(256)) * 900), ("response", b"\r\n\r\nWARC/1.1\r\n" * 5000)])]
    flat, packed = b"".join(map(W.record, made)), b"".join(W.member(W.record(r)) for r in made)
    assert gzip.decompress(packed) == flat
    for raw, read in ((flat, W.records), (packed, W.packed_records), (b"".join(gzip.compress(W.record(r)) for r in made), W.packed_records)):
        for size in (7, 1000, 1 << 16):
            assert [b for _, b in read(Raw(raw), size=size)] == [r["payload"] or b"" for r in made]
        assert [h["warc-record-id"] for h, _ in read(Raw(raw), lambda h: h["warc-type"] == "revisit")] == ["<urn:page:1>"]
        with pytest.raises(ValueError):
            list(read(Raw(raw[:-200])))
    big = "x" * 200
    odd = spark.createDataFrame([(3, "u", big), (1, "v", big), (2, "w", "small"), (5, "x", "small"), (4, None, None), (7, "y", big), (7, "y", big), (None, "n", big)], "page_id long, url string, html string")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000000", "url", "html").where("page_id % 3 = 0"))
    for k, table in enumerate((odd, pages)):
        W.write_pages(table, f"file://{tmp_path}/w{k}")
        rows = [(r.page_id, (r.html or "").encode()) for r in table.collect()]
        first: dict = {}
        for i, p in rows:
            if i is not None and len(p) >= 100:
                first[p] = min(first.get(p, i), i)
        want = [(i, len(p), sha(p), "revisit" if (old := i is not None and i > first.get(p, i)) else "response", first[p] if old else None) for i, p in rows]
        same(W.read_pages(spark, f"file://{tmp_path}/w{k}").collect(), want)
    plan = spark.read.format("warc").load(f"file://{tmp_path}/w1").where("record_type = 'revisit'")
    assert plan.count() == len([r for r in want if r[3] == "revisit"])
    spark.createDataFrame([], "page_id long, url string, html string").createOrReplaceTempView("nothing")
    W.write_pages(spark.table("nothing"), f"file://{tmp_path}/none")
    assert W.read_pages(spark, f"file://{tmp_path}/none").count() == 0
