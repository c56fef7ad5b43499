"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, ascii_lower, key128, shield

#: Parts that the occurrences of one line are dealt into, so that a line of every document has no task of its own.
SALTS = 16


def line_keys(text: Column) -> Column:
    """Each line's normal form: white space off both ends, A-Z in lower case."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))
    return F.transform(trimmed, ascii_lower)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text column cut, and columns n_lines and n_dropped (replaced where docs has such).

    A text is split at line feeds. Lines whose normal form has min_chars code points or more and is found in min_docs
    documents or more are dropped everywhere; the rest keep their order. Every row counts as a document, repeated rows
    and rows without an id too. A null text is one empty line; a text that loses all its lines becomes empty. Columns
    that are named otherwise pass unchanged.

    A line travels as a hash of 128 bits with its place; the whole texts are shuffled once, to meet their own places.
    """
    docs, back = shield(docs, id_col, text_col)
    who = {"_id": F.col(id_col), "_text": key128(text_col)}
    row = [c.alias(name) for name, c in who.items()]
    keyed = docs.select(*row, F.transform(line_keys(F.col(text_col)), lambda k: F.when(F.char_length(k) >= min_chars, key128(k))).alias("_keys"))
    common = (
        keyed.select(F.explode_outer(F.array_distinct("_keys")).alias("_key"))
        .where("_key is not null")
        .groupBy("_key")
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") >= min_docs)
        .select("_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    places = keyed.select("_id", "_text", F.posexplode_outer("_keys").alias("_at", "_key")).where("_key is not null")
    places = places.withColumn("_salt", F.pmod(F.xxhash64("_id", "_text"), F.lit(SALTS)).cast("int"))
    gone = (
        places.join(common, ["_key", "_salt"], "left_semi")
        .groupBy(F.col("_id").alias("_id2"), F.col("_text").alias("_text2"))
        .agg(F.collect_set("_at").alias("_gone"))
    )
    met = docs.withColumns(who).join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_text") == F.col("_text2")), "left")
    met = met.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    met = met.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"),
        "_left": F.when(F.col("_gone").isNotNull(), F.array_except(every, "_gone")),
    })
    kept = F.array_join(F.transform("_left", lambda i: F.get(F.col("_lines"), i)), "\n")
    kept = F.when(F.col("_left").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept)
    return back(met.withColumn(text_col, kept), ["n_lines", "n_dropped"])
