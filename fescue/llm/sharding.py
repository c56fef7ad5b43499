"""Shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: The generator's multiplier, as the paper has it.
STEP = 2862933555777941757
#: Parts of a shard in which rows are numbered side by side.
PARTS = 4096


def _unsigned(c: Column) -> Column:
    return F.when(c < 0, c.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)")).cast("decimal(20,0)")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a long; a null key stands for 0. The state is the generator's 64 bits, held as a
    decimal because long products would overflow, the last shard jumped to and the next; there are shards jumps at most."""
    wide = F.lit(str(2**64)).cast("decimal(38,0)")

    def draw(s: Column) -> Column:
        k = (s["k"].cast("decimal(20,0)") * F.lit(STEP).cast("decimal(19,0)")).cast("decimal(38,0)") + F.lit(1).cast("decimal(1,0)")
        k = F.pmod(k.cast("decimal(38,0)"), wide).cast("decimal(20,0)")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(k.alias("k"), s["j"].cast("int").alias("b"), s["j"].alias("j")))

    def land(s: Column) -> Column:
        high = F.floor(s["k"] / F.lit(2**33).cast("decimal(10,0)")).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(s["k"].alias("k"), s["b"].alias("b"), F.floor((s["b"] + 1).cast("double") * (F.lit(float(2**31)) / (high + 1).cast("double"))).cast("long").alias("j")))

    start = F.struct(_unsigned(F.coalesce(key.cast("long"), F.lit(0).cast("long"))).alias("k"), F.lit(-1).alias("b"), F.lit(0).cast("long").alias("j"))
    turns = F.sequence(F.lit(1), F.lit(2 * shards))
    # Odd turns draw the next number, even turns land on the shard it leads to.
    return F.aggregate(turns, start, lambda s, i: F.when(i % 2 == 1, draw(s)).otherwise(land(s)), lambda s: s["b"])


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot and grown_shard for every row.

    The id and the number of shards decide the shard; with one more shard a row stays or moves into the new one
    (grown_shard). size: the text's UTF-8 bytes (null: none) plus 8. slot: the row's place in its shard, from 0 without
    gaps, in the order of a hash of id and checksum, then id, size and checksum; rows equal in all of them are alike, so
    it does not matter which comes first. A null id stands for 0 and comes before 0. Ids that are no numbers are placed by
    their 64-bit hash.

    Only ids, sizes and checksums are shuffled. Rows are numbered within PARTS parts of a shard, and the parts' offsets
    (shards times PARTS rows at most) are added."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbers = isinstance(docs.schema[id_col].dataType, NumericType)
    key = F.col(id_col) if numbers else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(5), F.col(id_col)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8).cast("long")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(3), F.col(id_col), F.crc32(F.encode(text, "UTF-8"))), F.lit(PARTS)).cast("int").alias("_part"),
    )
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    first = counts.select("shard", "_part", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32"))
    return rows.withColumn("_place", place).join(F.broadcast(first), ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_first") + F.col("_place") - 1).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard")
    )
