"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import near_passages

    return near_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import new_path
    from .warc import read_pages, write_pages

    path = new_path(spark, "warc")
    write_pages(_table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import byte_bpe

    out = byte_bpe(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import drop_repeats

    out = drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import search

    return search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), 10)


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_OP1_SQL = r"""
with doc as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from doc),
keyed as (select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line),
common as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
marked as (select keyed.*, common.k is not null as gone from keyed left join common on keyed.k = common.k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

_OP7_SQL = """
with page as (select page_id, encode(coalesce(html, '')) as b from pages),
known as (select page_id, cast(octet_length(b) as bigint) as payload_bytes, sha256(b) as payload_digest from page),
first as (select payload_digest, min(page_id) as first from known where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from known left join first using (payload_digest)
"""

_OP11_SQL = r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) as p from documents),
split as (select lang, [x for x in string_split_regex(p, '[\x20\x09]+') if x <> ''] as w from piece),
gram as (select lang, 1 as k, unnest(w) as g from split
  union all select lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) from split where len(w) >= 2
  union all select lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) from split where len(w) >= 3),
f as (select lang, k, g, cast(count(*) as hugeint) as f from gram group by lang, k, g),
total as (select lang, sum(f) as n from f where k = 1 group by lang),
cand as (select lang, k, g, f as a, string_split(g, ' ') as w from f where k >= 2 and f >= 10),
long as (select lang, a as b, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as g from cand where k = 3),
gone as (select distinct cand.lang, cand.g from cand join long using (lang, g) where 100 * b >= 50 * cand.a),
cuts as (select lang, g, a, 1 as cut, w[1] as x, array_to_string(w[2:], ' ') as y from cand union all select lang, g, a, 2, w[1] || ' ' || w[2], w[3] from cand where k = 3),
part as (select cuts.*, fx.f as l, fy.f as r, (cast(1000000 as hugeint) * a * a) // (fx.f * fy.f) as score from cuts join f fx on fx.lang = cuts.lang and fx.g = x join f fy on fy.lang = cuts.lang and fy.g = y),
best as (select *, row_number() over (partition by lang, g order by score, cut) as nr from part),
ranked as (select best.*, row_number() over (partition by lang order by score desc, a desc, g) as rank from best anti join gone using (lang, g) where nr = 1)
select lang, cast(rank as int) as rank, g as phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join total using (lang) where rank <= 2000
"""

_OP12_SQL = r"""
with doc as (select doc_id, encode(coalesce(text, '')) as t from documents),
win as (select doc_id, t, unnest(range(0, octet_length(t) - 99)) as p from doc),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by t[p + 1:p + 100] order by doc_id, p) as nr from win) where nr > 1),
island as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as k from
  (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh from later)),
span as (select doc_id, min(p) as a, max(p) + 100 as z from island group by doc_id, k),
total as (select doc_id, cast(sum(z - a) as bigint) as n_removed, count(*) as n_spans from span group by doc_id),
edge as (select doc_id, z as a, lead(a) over (partition by doc_id order by a) as z from span union all select doc_id, 0, min(a) from span group by doc_id),
piece as (select doc.doc_id, coalesce(a, 0) as a, t[coalesce(a, 0) + 1:coalesce(z, octet_length(t))] as s from doc left join edge on doc.doc_id = edge.doc_id),
kept as (select doc_id, sha256(unhex(string_agg(hex(s), '' order by a))) as kept_sha256 from piece group by doc_id)
select doc.doc_id, cast(octet_length(t) as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256
from doc join kept on doc.doc_id = kept.doc_id left join total on doc.doc_id = total.doc_id
"""

_OP13_SQL = r"""
with term as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
tf as (select doc_id, t, count(*) as tf from term group by doc_id, t),
doc as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
whole as (select count(*) as nd, cast(sum(n) as bigint) as l from doc),
word as (select t, cast(floor(1000 * ln((2 * nd + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, whole group by t, nd),
ask as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
asked as (select item_id, t, count(*) as times from ask group by item_id, t),
scored as (select item_id, tf.doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) as bigint) as score
  from asked join tf using (t) join word using (t) join doc on tf.doc_id = doc.doc_id, whole group by item_id, tf.doc_id),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1_SQL, "op7_warc": _OP7_SQL, "op11_collocations": _OP11_SQL, "op12_suffix_dedup": _OP12_SQL, "op13_lexical_search": _OP13_SQL}
