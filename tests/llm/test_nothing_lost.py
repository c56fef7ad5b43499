"""Cases that once were passed over: short benchmark items, items end to end, archives of other writers, ids that are no numbers."""

import gzip
import io
import random

import numpy as np
import pytest


def test_short_items_and_items_end_to_end(spark):
    from fescue.llm import decontaminate as D

    bench = spark.createDataFrame([(1, "abcde"), (2, "Q"), (3, "0123456789"), (4, "elevenchars"), (5, "stands many times")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x abcde y ABCDE"), (2, "qq"), (3, "a 01234x56789 b 012345678 c 0123456789"), (4, "xx elevnchars; eleXXchars"), (5, "stands many times" * 4), (6, "nothing here"), (7, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in D.leaks(docs, bench).collect())
    assert got == [
        (1, 1, 2, 7, 0), (1, 1, 10, 15, 0), (2, 2, 0, 1, 0), (2, 2, 1, 2, 0), (3, 3, 2, 13, 1), (3, 3, 16, 25, 1), (3, 3, 28, 38, 0), (4, 4, 3, 13, 1),
        *[(5, 5, 17 * k, 17 * k + 17, 0) for k in range(4)],
    ]
    named = docs.withColumnsRenamed({"text": "_bad"}).withColumn("id", docs["doc_id"]).withColumn("item", docs["doc_id"])
    assert sorted(r.doc_id for r in D.without_leaks(named, bench, "doc_id", "_bad").collect()) == [6, 7]


def test_short_items_equal_brute_force():
    from fescue.llm import decontaminate as D

    rng = random.Random(4)
    for _ in range(60):
        items = [(k, "".join(rng.choice("ab") for _ in range(rng.choice([1, 3, 5, 10, 11])))) for k in range(4)]
        text = "".join(rng.choice("abc") for _ in range(60))
        index = D.Index(items)
        found = {m[0] for m in D.matches(D.codes(text), index)}
        for k, x in items:
            most = len(x) // 10
            row = np.zeros(len(text) + 1, int)
            for c in x:
                new = np.append(row[0] + 1, row[:-1] + (np.array(list(text)) != c))
                new = np.minimum(new, row + 1)
                for j in range(1, len(new)):
                    new[j] = min(new[j], new[j - 1] + 1)
                row = new
            assert (k in found) == (row.min() <= most)


class Raw(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_members_of_other_writers(size):
    from fescue.llm import warc as W

    made = [{"record_type": "response", "record_id": f"<r:{i}>", "payload": bytes([65 + i]) * (i * 5000), "content_type": "application/http", "headers": {}} for i in range(5)]
    flat = b"".join(map(W.record, made))
    parted = b"".join(gzip.compress(flat[a : a + 3001]) for a in range(0, len(flat), 3001))
    mixed = gzip.compress(W.record(made[0]) + W.record(made[1])) + W.member(W.record(made[2])) + gzip.compress(W.record(made[3]) + W.record(made[4]))
    for raw in (gzip.compress(flat), parted, mixed):
        assert [b for _, b in W.packed_records(Raw(raw), size=size)] == [r["payload"] for r in made]
        assert [h["warc-record-id"] for h, _ in W.packed_records(Raw(raw), lambda h: h["warc-record-id"] != "<r:1>", False, size)] == ["<r:0>", "<r:2>", "<r:3>", "<r:4>"]
        with pytest.raises(ValueError):
            list(W.packed_records(Raw(raw[:-20]), size=size))


def test_headers_and_folders(spark, tmp_path):
    from fescue.llm import warc as W

    W.register(spark)
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r:%d>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nX-Long: one\r\n\ttwo\r\nX-Name: caf\xe9\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for k, folder in enumerate(["", "2024/01", "2024/02", "_temporary", ".hidden"]):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        data = head % k + head % (10 + k)
        (tmp_path / folder / ("a.warc.gz" if k % 2 else "a.warc")).write_bytes(gzip.compress(data) if k % 2 else data)
    got = {r.record_id: r for r in spark.read.format("warc").load(f"file://{tmp_path}").collect()}
    assert sorted(got) == ["<r:0>", "<r:10>", "<r:11>", "<r:12>", "<r:1>", "<r:2>"]
    for r in got.values():
        assert r.headers == {"warc-concurrent-to": "<a>\n<b>", "x-long": "one two", "x-name": "caf\xe9"} and bytes(r.payload) == b"hi"


def test_shards_of_text_ids(spark):
    from fescue.llm.sharding import shard

    docs = spark.createDataFrame([(f"d{i}", "t" * (i % 7)) for i in range(600)] + [("d1", "again"), (None, "x")], "doc_id string, text string")
    rows = shard(docs, 24).collect()
    assert len(rows) == 602 and all(r.grown_shard in (r.shard, 24) for r in rows) and len({r.shard for r in rows if r.doc_id == "d1"}) == 1
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert len(slots) > 5 and slots == list(range(len(slots)))
