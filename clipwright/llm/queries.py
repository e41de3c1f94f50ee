"""Registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipwright.llm import alignment, decontam, embed_dedup, html_crf, langid, mixing, packing, pii, quality, sharding, simhash, turns, warc
from clipwright.llm.common import table


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_text(table(spark, sf_dir, "pages"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(lines, "\n"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(table(spark, sf_dir, "documents"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_quality_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(table(spark, sf_dir, "documents"))


def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score_links(table(spark, sf_dir, "documents"))


def op13_cyk_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_trial(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_crf": op1_html_crf,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_simhash_bktree": op4_simhash_bktree,
    "op5_source_mixing": op5_source_mixing,
    "op6_subspace_pigeonhole": op6_subspace_pigeonhole,
    "op7_quality_empirical_bayes": op7_quality_empirical_bayes,
    "op8_benchmark_containment": op8_benchmark_containment,
    "op9_kneser_ney_langid": op9_kneser_ney_langid,
    "op10_rendezvous_sharding": op10_rendezvous_sharding,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_diagonal_alignment": op12_diagonal_alignment,
    "op13_cyk_turn_repair": op13_cyk_turn_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisits": """
with bare as (
  select page_id, coalesce(html, '') as html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages),
urls as (
  select page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^(www|m)\\.', ''), ':(80|443)$', '') as host,
    regexp_replace(b, '^[^/?]*', '') as rest from bare),
canon as (
  select page_id, html, md5(html) as dig, 'day ' || (page_id % 365) as mod, host || regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') as stem,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z_]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&') as q
  from urls),
keyed as (
  select page_id, html, dig, mod, stem || case when q <> '' then '?' || q else '' end as page
  from canon),
full_ as (select page, page_id * 1000 as at, page_id * 4 as id, '"' || substr(dig, 1, 12) || '"' as tag, mod, dig, length(html) as n from keyed where page_id % 5 <> 0),
asked as (
  select page_id * 4 + 1 as id, page, page_id * 1000 + 3 as at, 1 as v, '"' || substr(dig, 1, 12) || '"' as tag, mod, dig from keyed
  union all select page_id * 4 + 2, page, page_id * 1000 + 600, 2, case when page_id % 4 = 0 then '"other"' end, mod, dig from keyed
  union all select page_id * 4 + 3, page, page_id * 1000 + 2000000, 3, null, null, dig from keyed),
met as (
  select a.*, f.id as fid, f.at as fat, f.tag as ftag, f.mod as fmod, f.dig as fdig, f.n as fn,
    row_number() over (partition by a.id order by f.at desc nulls last, f.id desc) as r
  from asked a left join full_ f on a.page = f.page and f.at < a.at),
judged as (
  select *, case when fid is null then 'no-response'
    when (case when v = 1 then tag = ftag when v = 2 and tag is not null then tag = ftag when v = 2 then mod = fmod else dig = fdig end) then 'resolved' else 'mismatch' end as outcome
  from met where r = 1)
select id as record_id, page as canonical_url, outcome, fid as response_id, fat as response_at,
  case when outcome = 'resolved' then array_to_string(list_sort(list_filter([
    case when v = 3 then 'age: 1' end,
    case when v = 1 then 'cache-control: max-age=600' else 'cache-control: max-age=60' end,
    'content-length: ' || fn, 'content-type: text/html',
    case when v = 2 then 'date: later' end,
    case when v = 1 then 'etag: W/' || tag else 'etag: ' || ftag end,
    'last-modified: ' || fmod], lambda x: x is not null)), chr(10)) end as headers
from judged""",
    "op5_source_mixing": """
with recursive docs as (
  select doc_id, source,
    case when text is null then 0 else len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) end::bigint as size,
    coalesce(case when length(text) > 0 then 1.0::double / (1.0::double + 20.0::double * (length(text) - length(translate(text, '#$%&*|!{}<>=~^', '')))::double / length(text)::double) end, 1.0::double) as weight,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(md5(text), '')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double as u
  from documents),
keyed as (select *, -ln(u) / weight as k from docs),
sources as (
  select source, sum(size)::bigint as source_size,
    (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as share
  from docs group by source),
caps as (select *, source_size * 3.0::double as cap, source_size * 3.0::double / share as full_at from sources),
levels as (
  select *, (sum(source_size) over ()::double - coalesce(sum(cap) over w, 0::double)) / (sum(share) over () - coalesce(sum(share) over w, 0::double)) as lev
  from caps window w as (order by full_at, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, case when cap <= share * (select max(lev) from levels where lev <= full_at) then cap
    else share * (select max(lev) from levels where lev <= full_at) end as target from levels),
placed as (
  select d.doc_id, d.size, d.k, t.source, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
    t.target - epochs * t.source_size as rest,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls last rows between unbounded preceding and 1 preceding), 0)::double as before
  from keyed d join targets t on d.source is not distinct from t.source),
stops as (select source, min(before) as stop, any_value(rest) - min(before) as gap from placed where size > 0 and before + size / 2.0::double > rest group by source),
marked as (
  select p.*, s.stop, s.gap, size > 0 and (s.stop is null or before < s.stop) as drawn,
    coalesce(size > 0 and before > s.stop and size <= 2 * s.gap, false) as small
  from placed p left join stops s on p.source is not distinct from s.source),
behind as (
  select *, length(bin(size)) as class,
    coalesce(sum(size) over (partition by source, length(bin(size)) order by k, doc_id nulls last rows between unbounded preceding and 1 preceding), 0)::double as ahead
  from marked where small),
fill(source, class, gap, got) as (
  select source, 64, gap, 0::double from stops
  union all
  select f.source, f.class - 1, f.gap - f.got,
    (select coalesce(min(case when b.ahead + b.size / 2.0::double > f.gap - f.got then b.ahead end), max(b.ahead + b.size), 0::double)
     from behind b where b.source is not distinct from f.source and b.class = f.class - 1)
  from fill f where f.class > 1)
select doc_id, size, source_size, target, (size * (epochs + case when drawn then 1 else 0 end))::bigint as taken from marked where not small
union all
select b.doc_id, b.size, b.source_size, b.target, (b.size * (b.epochs + case when b.ahead < f.got then 1 else 0 end))::bigint
from behind b join fill f on b.source is not distinct from f.source and b.class = f.class""",
    "op8_benchmark_containment": """
with words as (
  select 'd' as kind, doc_id as id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
  union all
  select 'i', item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') from benchmark),
parts as (
  select distinct kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as shingle
  from words where len(w) > 0),
sizes as (select id, count(*) as n from parts where kind = 'i' group by id),
met as (select d.id as doc_id, i.id as item_id, count(*) as found from parts d join parts i using (shingle) where d.kind = 'd' and i.kind = 'i' group by all)
select doc_id, item_id, found, n as n_shingles, found::double / n::double as containment
from met join sizes on item_id = sizes.id where found >= ceil(n * 0.8::double - 1e-9)""",
    "op10_rendezvous_sharding": """
with recursive bytes as (
  select list_transform(range(256), lambda b: list_reduce([b::bigint] || range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
docs as (
  select row_number() over () as n, doc_id, strlen(coalesce(text, ''))::bigint + 8 as size, hex(encode(coalesce(text, ''))) as h from documents),
summed as (
  select n, doc_id, size, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::bigint),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from docs, bytes),
bids as (
  select s.*, k, -ln((('0x' || substr(md5('shard|' || coalesce(doc_id::varchar, '') || '|' || k), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double) as bid
  from summed s, range(25) r(k)),
won as (
  select n, any_value(doc_id) as doc_id, any_value(size) as size, any_value(text_crc32) as text_crc32,
    arg_min(k, bid) filter (where k < 24)::int as shard, arg_min(k, bid)::int as grown_shard
  from bids group by n)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
  row_number() over (partition by shard order by (('0x' || substr(md5('slot|' || coalesce(doc_id::varchar, '') || '|' || text_crc32), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double, doc_id nulls last, text_crc32, size) - 1 as slot
from won""",
}
