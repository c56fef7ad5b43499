"""Rules and a likelihood ratio that decide whether a document stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import shield, words

SYMBOLS = "#*$%&|<>"
#: Hash buckets of word n-grams; what is gathered and sent out is bounded by this, whatever the corpus holds.
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
#: Parts of 1 in which weights are counted.
SCALE = 10_000
#: N-grams of the corpus's own mixture that are added to a bucket in both counts, so that rare ones weigh little.
SMOOTHING = 60.0
#: Trusted ids up to which they are broadcast; more meet the texts in a shuffled join. All of them count either way.
BROADCAST = 200_000
#: Least mean log-likelihood ratio of a kept document's n-grams.
LEAST_RATIO = -0.12


def _base(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with the measures, _words, and _p, the hashes of neighbouring words. Arrays that are used more than once are columns of their own, as
    Spark would else work them out again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    said = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    df = docs.withColumns({"_words": words(F.col(text_col)), "n_symbols": F.when(text.rlike(f"[{SYMBOLS}]"), symbols).otherwise(0).cast("long"), "_said": said})
    df = df.withColumns({
        "_p": _pairs(F.col("_words")),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_said") - F.size(F.array_distinct("_said"))).cast("long"),
        "_n": F.greatest(F.size("_words") - 2, F.lit(0)),
    })
    df = df.withColumn("_t", F.zip_with(F.slice("_p", 1, F.col("_n")), F.slice("_words", 3, F.col("_n")), lambda h, w: F.xxhash64(h, w)))
    # Only a text with equal windows has them sorted.
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    order = F.sort_array(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_t")) < F.size("_t"), order).otherwise(none))
    # Sorted by window, equal windows are neighbours: each is held against the one before and the one after it.
    others = F.greatest(F.size("_s") - 1, F.lit(0))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_s", 1, others))
    first = F.zip_with("_s", F.slice(before, 1, F.size("_s")), lambda c, p: F.struct(c["h"].alias("h"), c["i"].alias("i"), c["h"].eqNullSafe(p["h"]).alias("d")))
    told = F.zip_with(first, F.slice("_s", 2, others), lambda c, n: F.when(c["d"] | c["h"].eqNullSafe(n["h"]), c["i"]))
    spots = F.sort_array(F.filter(told, lambda i: i.isNotNull()))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(spots, zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_said", "_t", "_s", "_n")


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (words in windows of three that are found
    twice or more, by a hash of 64 bits). A null text has no words. All is worked out within the row."""
    docs, back = shield(docs, text_col)
    return back(_base(docs, text_col).drop("_words", "_p"), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def _pairs(w: Column) -> Column:
    """A hash of each two neighbouring words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column) -> Column:
    """The upper bits of a hash."""
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def bucket_weights(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, weights: for every bucket the log of its share among trusted documents' n-grams over its share among all,
    as a whole number of SCALE parts, so that sums do not depend on their order.

    Both counts are whole: those of all are over every document, those of the target over every trusted one. They are summed
    before they are shuffled, so BUCKETS rows a task at most move. With no trusted document all weights are 0."""
    flags = trusted_ids.select(F.col(id_col).alias("_tid")).where("_tid is not null").distinct()
    few = flags.limit(BROADCAST + 1).count() <= BROADCAST
    flags = flags.withColumn("_t", F.lit(1)).hint("broadcast" if few else "merge")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(flags, F.col("_id") == F.col("_tid"), "left")
    # A row for each word and the one after it, then one for the word and one for both; all of it in generated code.
    said = text.select(F.coalesce("_t", F.lit(0)).alias("_t"), words(F.col("_text")).alias("_a")).withColumn("_b", F.slice("_a", 2, F.greatest(F.size("_a"), F.lit(1))))
    said = said.select("_t", F.explode_outer(F.arrays_zip("_a", "_b")).alias("x")).where("x is not null")
    grams = F.array(F.xxhash64("x._a"), F.when(F.col("x._b").isNotNull(), F.xxhash64("x._a", "x._b")))
    counts = said.select("_t", F.explode(grams).alias("h")).where("h is not null").groupBy(_bucket(F.col("h")).alias("b")).agg(F.count("*").alias("n"), F.sum("_t").alias("t"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    row = full.agg(F.sort_array(F.collect_list(F.struct("b", "n", "t"))).alias("s"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    row = row.select("s", F.try_divide("t", "n").alias("share"))
    weight = lambda x: F.log((x["t"] / F.col("share") + SMOOTHING) / (x["n"] + SMOOTHING))
    return row.select(F.transform("s", lambda x: F.when(F.col("share") > 0, F.round(SCALE * weight(x)).cast("int")).otherwise(0)).alias("weights"))


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """docs with the base measures, base_failed, ratio and kept (replaced where docs has such columns).

    base_failed: under 50 words, or over half of the words in windows of three that the text repeats. ratio: the mean
    weight (bucket_weights) of the text's words and word pairs, so texts of any length compare; 0 for a text without
    words. kept: the base rules hold and ratio is least_ratio or more. trusted_ids has the ids of the documents that
    stand for what is wanted; ids in it twice count once and null ids not at all. Every row is decided on its own, so
    repeated rows fare alike; other columns pass unchanged."""
    docs, back = shield(docs, id_col, text_col)
    found = bucket_weights(docs, trusted_ids, id_col, text_col).select(F.array_join("weights", ",")).first()[0]
    # A constant that Spark folds into one array; a row with BUCKETS numbers would be copied with every document.
    weights = F.split(F.lit(found), ",").cast("array<int>")
    df = _base(docs, text_col)
    none = F.lit(0).cast("long")
    ones = F.aggregate("_words", none, lambda acc, w: acc + F.get(weights, _bucket(F.xxhash64(w))))
    twos = F.aggregate("_p", none, lambda acc, h: acc + F.get(weights, _bucket(h)))
    ratio = F.when(F.col("n_words") > 0, F.round((ones + twos) / (F.size("_words") + F.size("_p")) / SCALE, 9)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = df.withColumns({"_failed": failed, "_ratio": ratio})
    found = F.struct(*names, F.col("_failed").alias("base_failed"), F.col("_ratio").alias("ratio"), (~F.col("_failed") & (F.col("_ratio") >= least_ratio)).alias("kept"))
    # A generated row: a filter on it, such as on kept, stays above and does not work everything out once more for itself.
    return back(df.select(*docs.columns, F.inline(F.array(found))), [*names, "base_failed", "ratio", "kept"])
