"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, exact_dedup, filter_audit, language_model, ngram_join, quality, sentencepiece_codec, sharding, token_file, toxicity, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"), byte_tokenizer())


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: As many shards as a training job of this size reads in parallel.
SHARDS = [f"shard-{k:03d}" for k in range(256)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    return sharding.place(docs, "doc_id", SHARDS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.verdicts(table(spark, sf_dir, "pages"))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), byte_tokenizer(), piece_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_model": op1_language_model,
        "op2_token_file": op2_token_file,
        "op3_quality": op3_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_ngram_join": op6_ngram_join,
        "op7_decontaminate": op7_decontaminate,
        "op8_sharding": op8_sharding,
        "op9_toxicity": op9_toxicity,
        "op10_warc": op10_warc,
        "op11_filter_audit": op11_filter_audit,
        "op12_url_filters": op12_url_filters,
        "op13_cross_tokenizer": op13_cross_tokenizer,
    }


OP4_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""


OP7_SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), it as (select item_id, w, least(10, len(w)) as n from iw where len(w) > 0
), win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as t from (select *, unnest(range(1, len(w) - n + 2)) as i from it)
), sizes as (select distinct n from win
), dwin as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)
), hit as (select doc_id, i, dwin.n, item_id from dwin join win using (n, t)
), covered as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id
), named as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, item_id::varchar as name from hit) group by doc_id
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join covered using (doc_id) left join named using (doc_id)
"""


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end) as s from w
), n as (select doc_id, count(*) as n from s group by doc_id
), p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all
), e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), both_ways as (select a, b from e union all select b, a from e
), reach as (select doc_id, doc_id as r from documents union select reach.doc_id, b from reach join both_ways on a = r
)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id from reach left join n using (doc_id) group by doc_id
"""

OP10_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::int >> (15 - i % 4 * 5)::int) & 31) + 1, 1)), lambda a, b: a || b) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from p
"""


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, (case when len(w) < 200 then 'A' else '' end)
    || (case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end)
    || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end)
    || (case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails
  from d left join l using (doc_id)
), n as (select part, good, toxic, fails, count(*) as n from f group by all
), x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x
), o as (
  select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s as (select filter_order, unnest(range(1, 6)) as step from o
), fate as (  -- the step at which a document goes, 6 if it stays
  select part, good, toxic, fails, n, filter_order, coalesce(list_min(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i]))), 6) as goes from n, o
), steps as (
  select part, filter_order, step, filter_order[step] as letter, coalesce(sum(n) filter (goes > step), 0) as kept, coalesce(sum(n) filter (goes = step), 0) as removed,
    coalesce(sum(n) filter (goes < step and contains(fails, filter_order[step])), 0) as redundant, coalesce(sum(n) filter (fails = filter_order[step]), 0) as unique_fails,
    coalesce(sum(n) filter (goes = step and good), 0) as good_lost, coalesce(sum(n) filter (goes = step and toxic), 0) as toxic_lost
  from fate join s using (filter_order) group by all
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from steps
"""

_SITE = r"""regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)"""
_VALUE = r"""replace(regexp_replace(regexp_extract({tag}, '(?i)[\s"'']{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g'), '&amp;', '&')"""
_PLAIN = r"""
  case when contains({url}, '://') then translate(regexp_extract({url}, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://'
    || translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || case when regexp_matches({url}, '(?s)^.*?://[^/?#]*/') then '' else '/' end || regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end"""
_HOST = """translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""
_PATH = """regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"""
OP12_SQL = rf"""
with recursive rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), tags as (
  select url, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:link|meta)[\s/][^>]*>')) as tag from pages where contains(url, '://')
), raw as (
  select url, trim({_VALUE.format(tag="tag", name="href")}, E' \t\n') as t from tags
  where regexp_matches(tag, '(?i)^<link') and list_contains(regexp_split_to_array(lower(trim({_VALUE.format(tag="tag", name="rel")})), '\s+'), 'canonical')
  union all
  select url, trim(regexp_replace(regexp_extract({_VALUE.format(tag="tag", name="content")}, '(?is)^[^;,]*[;,]\s*url\s*=\s*(.*)$', 1), '^["'']|["'']$', '', 'g')) from tags
  where regexp_matches(tag, '(?i)^<meta') and lower(trim({_VALUE.format(tag="tag", name="http-equiv")})) = 'refresh'
), targets as (
  select url, case when t = '' then null when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t
    when starts_with(t, '/') then {_SITE.format(url="url")} || t when starts_with(t, '?') then {_SITE.format(url="url")} || {_PATH.format(url="url")} || t when starts_with(t, '#') then null
    else {_SITE.format(url="url")} || coalesce(nullif(regexp_extract({_PATH.format(url="url")}, '(?s)^(.*/)', 1), ''), '/') || t end as t
  from raw
), edges as (select {_PLAIN.format(url="url")} as a, {_PLAIN.format(url="t")} as b from targets
), pairs as (select a, b from edges where a <> b union select b, a from edges where a <> b
), reach as (select distinct a as node, a as other from pairs union select node, b from reach join pairs on other = a
), ends as (select distinct a as node, {_HOST.format(url="a")} as host, {_PATH.format(url="a")} as path from pairs
), judged as (
  select node, arg_max(verdict, len(h || p)) as verdict from ends join rules on ('.' || host) like ('%.' || h) and starts_with(path, p) group by node
), resource as (
  select reach.node, bool_or(verdict = 'block') and not bool_or(verdict = 'allow') as bad from reach join judged on other = judged.node group by reach.node
), rows as (select row_number() over () as k, page_id, coalesce({_HOST.format(url="url")}, '') as host, coalesce({_PATH.format(url="url")}, '') as path, {_PLAIN.format(url="url")} as node from pages
), own as (
  select k, arg_max(h || p, len(h || p)) as rule, arg_max(verdict, len(h || p)) as verdict from rows join rules on ('.' || host) like ('%.' || h) and starts_with(path, p) group by k
)
select page_id, host, path, rule, coalesce(verdict, case when bad then 'block' end, 'allow') as verdict from rows left join own using (k) left join resource using (node)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_ngram_join": OP6_SQL, "op7_decontaminate": OP7_SQL, "op10_warc": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_url_filters": OP12_SQL}
