"""The queries op1 to op13 over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepair, flac, langid, linededup, packing, periodic, quality, rowmatch, secrets, simhash, substring, tokencount, tokenstore
from .runtime import bounded_batches, documents, shared_dir


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(documents(spark, sf_dir, "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.encoding_digests(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenstore.write_tokens(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenstore.token_offsets(spark, path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_digests(documents(spark, sf_dir, "doc_id", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(documents(spark, sf_dir, "doc_id", "text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(documents(spark, sf_dir, "doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(documents(spark, sf_dir, "doc_id", "text"))


def op13_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return rowmatch.click_matches(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_substring, op3_quality_rules, op4_byte_bpe, op5_token_store, op6_language_id, op7_packing, op8_flac, op9_token_counts, op10_secrets, op11_line_dedup, op12_periodic_runs, op13_row_patterns)
}

_OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
p as (select doc_id, string_split(text, chr(10)) as lines from d),
u as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from p),
l as (
  select doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from u),
k as (select key, min(doc_id) as first from l where length(key) >= 10 group by key),
m as (select l.doc_id, l.pos, l.line, coalesce(l.doc_id > k.first, false) as gone from l left join k on l.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

#: Rows that may follow as D or U share a chain with the row before them; a match goes to the chain's last U.
_OP13_SQL = """
with r as (
  select distinct * from clicks where client_id is not null and ts is not null),
o as (
  select client_id, click_id, ts, kind, cast(floor(100 * value + 0.5) as bigint) as cents,
    row_number() over (partition by client_id order by ts, click_id) as i
  from r),
w as (
  select *, lag(cents) over (partition by client_id order by i) as was, ts - lag(ts) over (partition by client_id order by i) <= interval 30 minute as near from o),
c as (
  select *, case when near and kind is not null and kind <> 'error' and cents < was then 'D' when near and kind is not null and kind <> 'error' and cents > was then 'U' else 'X' end as letter,
    case when near and kind = 'click' then cents end as goal
  from w),
g as (
  select *, sum(case when letter = 'X' then 1 else 0 end) over (partition by client_id order by i) as chain,
    sum(coalesce(cents, 0)) over (partition by client_id order by i) as upto,
    lead(letter) over (partition by client_id order by i) as next_letter,
    lead(goal) over (partition by client_id order by i) as next_goal,
    lead(click_id) over (partition by client_id order by i) as next_id
  from c),
s as (
  select client_id, chain, min(i) as first_i, max(i) filter (where letter = 'U') as last_u, string_agg(letter, '' order by i) as letters from g group by client_id, chain),
e as (
  select g.client_id, g.i, g.click_id as first_id, g.cents, g.upto - g.cents as before, s.last_u, substr(s.letters, g.i - s.first_i + 2, s.last_u - g.i) as body
  from g join s on g.client_id = s.client_id and g.chain = s.chain
  where g.next_letter = 'D' and s.last_u > g.i),
m as (
  select e.*, z.click_id as end_id, z.upto - e.before as total, coalesce(z.next_goal >= e.cents, false) as reached, z.next_goal, z.next_id
  from e join g z on e.client_id = z.client_id and e.last_u = z.i)
select client_id, row_number() over (partition by client_id order by i) as match_no, first_id,
  case when reached then next_id else end_id end as last_id,
  cast(last_u - i + 1 + case when reached then 1 else 0 end as bigint) as n_rows,
  cast(total + case when reached then next_goal else 0 end as bigint) as sum_cents,
  sha256('A' || body || case when reached then 'P' else '' end) as labels_sha256
from m
"""

ORACLE_SQL: dict[str, str] = {"op11_line_dedup": _OP11_SQL, "op13_row_patterns": _OP13_SQL}
