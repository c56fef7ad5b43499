"""The target model of the quality rules counts every trusted document, however many there are."""

from pyspark.sql import functions as F


def test_no_trusted_document_is_left_out(spark):
    from fescue.llm.quality_rules import BUCKETS, bucket_weights

    docs = spark.range(0, 203_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    weights = bucket_weights(docs, docs.select("doc_id")).first()[0]
    # Where all are trusted, each bucket's share among trusted documents is its share among all.
    assert len(weights) == BUCKETS and not any(weights)


def test_both_joins_give_the_same(spark, monkeypatch):
    from fescue.llm import quality_rules as Q

    docs = spark.createDataFrame([(k, f"a{k % 5} b{k % 7} c") for k in range(60)] + [(None, "a1 b1")], "doc_id long, text string")
    trusted = docs.where("doc_id % 3 = 0").select("doc_id")
    one = Q.bucket_weights(docs, trusted).first()[0]
    monkeypatch.setattr(Q, "BROADCAST", 5)
    assert any(one) and Q.bucket_weights(docs, trusted.union(trusted)).first()[0] == one
