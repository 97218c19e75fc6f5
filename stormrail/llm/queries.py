"""Registered queries of the training-data operators (and their DuckDB SQL where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail.llm import (
    decontaminate, fingerprint, line_dedup, main_text, mixing, near_dup, pii, prefix_trie, quality,
    quality_rules, secrets, spans, warc, whitening,
)
from stormrail.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("op4_near_duplicates")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.col("component").alias("component_id"), "kept")


@query("op1_source_mix")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


@query("op2_warc_chunks")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest",
                                         "record_type", "refers_to", "url", "whole")


@query("op3_personal_data")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return spans.report(found, pii.KINDS).withColumnRenamed("doc", "doc_id")


# Lines over ten distinct sources or more, removed from every document with an inked line of its own.
_OP5 = """
with line as (
  select doc_id, text, source, unnest(string_split(text, chr(10))) as line from documents where text is not null),
spread as (
  select line from line where trim(line, ' ') <> '' group by line having count(distinct source) >= 10),
part as (
  select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) as nth,
         unnest(string_split(text, chr(10))) as line from documents where text is not null),
judged as (
  select p.doc_id, p.text, p.nth, p.line, s.line is not null as hit, trim(p.line, ' ') <> '' as inked
  from part p left join spread s on p.line = s.line),
doc as (
  select doc_id, text, count(*) as n_lines,
         count(*) filter (inked and not hit) > 0 as clear,
         count(*) filter (hit) as n_hit, string_agg(line, chr(10) order by nth) filter (not hit) as kept
  from judged group by doc_id, text)
select doc_id, n_lines, case when clear then n_hit else 0 end as n_removed,
       md5(case when clear and n_hit > 0 then coalesce(kept, '') else text end) as text_md5
from doc"""


@query("op5_line_spread", _OP5)
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"),
                        F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op6_main_text")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("page", "page_id")


@query("op7_imatch")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query("op8_decontaminate")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score",
                        F.col("end").alias("end_word"))


@query("op9_quality")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(F.col("doc").alias("doc_id"), "held_out", "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_secrets")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(secrets.secrets(table(spark, sf_dir, "documents")), secrets.KINDS).withColumnRenamed("doc", "doc_id")

# A byte's eight steps of crc32 are a fold over eight zeros that starts with the running value.
_OP12 = """
with turn as (
  select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as t,
         row_number() over (partition by conv_id order by turn nulls first,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as at
  from conversations where conv_id is not null),
conv as (
  select c, c - c % 20 as donor, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::bigint)),
      lambda v, i: xor(v >> 1, case when v & 1 = 1 then 3988292384::bigint else 0::bigint end)))) % 4 as h
  from (select distinct c from turn)),
made as (
  select v.c, 0 as part, t.at, t.r, t.t from conv v join turn t on t.c = v.donor and t.at <= v.h
  union all
  select v.c, 1, t.at, t.r, t.t from conv v join turn t on t.c = v.c and t.at > v.h),
seq as (
  select v.c, coalesce(list({'r': m.r, 't': m.t} order by m.part, m.at) filter (where m.at is not null), []) as s
  from conv v left join made m on m.c = v.c group by v.c),
member as (select c, s[1:d] as p, d, len(s) as size from (select c, s, unnest(range(0, len(s) + 1)) as d from seq)),
node as (
  select p, d, min(c) as c, count(*) as n,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = size), '')) as ends
  from member group by p, d),
child as (select p[1:d - 1] as p, d - 1 as d, count(*) as k from node where d > 0 group by all),
own as (
  select node.*, coalesce(k, 0) as k,
         case when node.d = 0 then 0
              else (n - 1) * len(regexp_extract_all(node.p[node.d].t, '[^\\x20\\x09-\\x0D]+')) end as saved
  from node left join child on node.p = child.p and node.d = child.d),
up as (select p[1:j] as p, j as d, saved, (k = 0)::int as leaf from (select *, unnest(range(0, d + 1)) as j from own)),
total as (select p, d, sum(saved)::bigint as saved, sum(leaf)::bigint as leaves from up group by p, d)
select o.c as conv_id, o.d as depth, q.c as parent_conv_id, o.n as n_convs, o.k as n_children, t.leaves as n_leaves,
       t.saved as saved_tokens, o.ends as ends_sha256
from own o join total t on o.p = t.p and o.d = t.d
left join node q on o.d > 0 and q.d = o.d - 1 and q.p = o.p[1:o.d - 1]"""


@query("op12_prefix_trie", _OP12)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op11_quality_rules")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept", "level", "rules")


@query("op13_whitening")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
