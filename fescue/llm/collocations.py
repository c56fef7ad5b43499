"""Phrases whose words stand together more often than their parts would."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, released, top_rows, uncut

#: Pieces end at these characters; their words are parted by spaces and tabs.
ENDS, GAPS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Words of pieces whose n-grams one call of duckdb adds up before they are shuffled.
WORDS = 1_000_000
#: Words of distinct pieces for each hash bucket that their n-grams are dealt into.
BUCKET = 4_000_000
#: Parts that the requests for one phrase's count are dealt into.
SALTS = 32
#: Memory of one duckdb, beyond which it writes to its own temporary folder.
MEMORY = "320MB"


def pieces(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, piece (its words with single spaces), m: how often the piece stands in the texts of the language."""
    found = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(ascii_lower(F.col(f"`{text_col}`")), ENDS)).alias("piece"))
    one = F.when(F.col("piece").rlike(r"[^\x20\x09]"), F.btrim(F.regexp_replace("piece", GAPS, " "), F.lit(" ")))
    return found.select("lang", one.alias("piece")).where("piece is not null").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _added(batches: Iterable[pa.RecordBatch], sql: str) -> Iterator[pa.RecordBatch]:
    """sql's rows over the batches as t, which duckdb reads as they come. It has MEMORY and, for groups beyond that, a folder of
    its own, which is removed with all it has when the rows are read."""
    import duckdb

    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    with tempfile.TemporaryDirectory(prefix="grams-") as folder:
        con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            con.register("t", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
            yield from con.sql(sql).to_arrow_reader(50_000)
        finally:
            con.close()


def counts(found: DataFrame, most_words: int, least: int, n_words: int) -> DataFrame:
    """lang, gram, k (its words), f: of every phrase of most_words words or fewer that stands least times or more.

    A task adds up the n-grams of WORDS words at a time, each weighted with its piece's multiplicity, so that a phrase of any
    frequency has one row a call. The sums go out as a compressed block for each hash bucket; blocks of a bucket meet in one
    task, where duckdb adds them up, on disk where memory does not do."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(8 * parts, n_words // BUCKET), 65_536)
    words = ", ".join(f"unnest(w[{k}:]) as w{k}" for k in range(1, most_words + 1))
    expand = " union all ".join(f"select lang, m, cast({k} as tinyint) as k, {" || ' ' || ".join(f'w{j}' for j in range(1, k + 1))} as gram from u where w{k} is not null" for k in range(1, most_words + 1))
    sql = f"""with u as (select lang, m, {words} from (select lang, m, string_split(piece, ' ') as w from t))
        select lang, gram, k, cast(sum(m) as bigint) as f, cast(hash(lang, gram) % {buckets} as int) as bucket from ({expand}) group by lang, gram, k order by bucket"""

    def blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(_added(held, sql))).combine_chunks()
        bucket = table.column("bucket").to_numpy()
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        table = table.drop_columns("bucket")
        for some in range(0, len(first), 64):
            at, sent = first[some : some + 65].tolist(), []
            at += [len(bucket)] * (len(first) - some <= 64)
            for x, y in zip(at, at[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(x, y - x))
                sent.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[: len(sent)]]), pa.array(sent, pa.binary())], names=["bucket", "block"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # A batch of long pieces is itself cut at rows.
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                held.append(some)
                size += some.column(1).nbytes // 6
                if size >= WORDS:
                    yield from blocks(held)
                    held, size = [], 0
        if held:
            yield from blocks(held)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (x for batch in batches for block in batch.column(1) for x in pa.ipc.open_stream(block.as_buffer()))
        yield from _added(opened, f"select lang, gram, k, cast(sum(f) as bigint) as f from t group by lang, gram, k having sum(f) >= {int(least)}")

    return found.mapInArrow(part, "bucket int, block binary").repartition("bucket").mapInArrow(whole, "lang string, gram string, k byte, f long")


def _cuts(c: Column, k: Column) -> Column:
    """(cut, side, part) for both parts of a phrase at each of its cuts."""
    words = F.split(c, " ", -1)
    side = lambda i, n, a, b: F.struct(i.alias("cut"), F.lit(n).alias("side"), F.array_join(F.slice(words, a, b), " ").alias("part"))
    return F.flatten(F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.array(side(i, "l", F.lit(1), i), side(i, "r", i + 1, k - i))))


def with_parts(phrases: DataFrame, every: DataFrame) -> DataFrame:
    """phrases (lang, gram, k, f) with l, r and score of the cut with the lowest score, the first of equal ones.

    Each phrase asks for the counts of its parts. Equal questions become one for each of SALTS parts of the askers, meet the
    counts by language and phrase, and the answers go back to where the questions came from, so that a word that begins
    a great many phrases is counted out SALTS times and not to all of them from one task."""
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    asks = phrases.select("lang", "gram", "f", F.explode(_cuts(F.col("gram"), F.col("k").cast("int"))).alias("c")).select("lang", "gram", "f", "c.*")
    asks = asks.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int"))
    told = asks.select("lang", "part", "salt").distinct().join(every.select("lang", F.col("gram").alias("part"), F.col("f").alias("n")), ["lang", "part"])
    met = asks.join(told, ["lang", "part", "salt"]).groupBy("lang", "gram", "cut").agg(F.max("f").alias("a"), F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
    scored = met.withColumns({"sq": F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), "lr": exact("l") * exact("r")}).withColumn("score", F.expr("sq div lr"))
    return scored.groupBy("lang", "gram").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "gram", "a", "s.l", "s.r", "s.score")


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, covered: int = 50, top: int = 2_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank (int, from 1), phrase, a, l, r, n, score (long): of each language the top phrases of 2 to most_words words.

    Texts in lower case (A-Z only) fall into pieces at ENDS and these into words at spaces and tabs. n counts the words of
    a language, f a phrase's occurrences within pieces, overlapping ones too. Candidates have a = f(phrase) of least or more.
    A cut after the first words gives l = f(first part), r = f(rest) and the score 1,000,000 a a div (l r); the cut with
    the lowest score counts, the first of equal ones. A candidate whose words stand together in a longer candidate of which
    100 f is covered * a or more drops out, whether or not the longer one drops out too. Ranks go by score, then a, both
    falling, then by the phrase's bytes. Arithmetic is exact for counts below 10^16.

    A null text has no words, a null language is und. Every row counts, repeated ones too; other columns are not read. A
    language without candidates has no row; an empty table gives none."""
    found = cut(pieces(docs, text_col, lang_col), "pieces")
    released(docs.sparkSession)
    size = F.size(F.split("piece", " ", -1))
    total = cut(found.groupBy("lang").agg(F.sum(F.col("m") * size).alias("n"), F.sum(size).alias("distinct")), "totals")
    every = cut(counts(found, most_words, least, total.agg(F.sum("distinct")).first()[0] or 0), "grams")
    released(docs.sparkSession)
    phrases = every.where("k >= 2")
    inner = phrases.where("k >= 3").select("lang", F.col("f").alias("g"), F.explode(_inside(F.col("gram"), F.col("k").cast("int"))).alias("gram"))
    inner = inner.groupBy("lang", "gram").agg(F.max("g").alias("g"))
    stay = phrases.join(inner, ["lang", "gram"], "left").where(f"g is null or 100 * cast(g as decimal(16,0)) < {int(covered)} * cast(f as decimal(16,0))").drop("g")
    scored = with_parts(stay, every).withColumnRenamed("gram", "phrase")
    best = cut(top_rows(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top), "best")
    # The words of a language are added up for each language, of which top rows at most are there.
    out = best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    out = cut(out, "collocations")
    uncut(found, total, every, best)
    return out


def _inside(c: Column, k: Column) -> Column:
    """The shorter phrases of two words or more that stand in a phrase."""
    words = F.split(c, " ", -1)
    of = lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), k - 1), of)))
