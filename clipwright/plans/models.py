"""Registered queries of stored model analyses, nested documents, tolerant matches and visual scenes, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clipwright import staging as st
from clipwright.operators import captions as cp
from clipwright.operators import evaluations as ev
from clipwright.operators import intervals as iv
from clipwright.operators import objects as ob
from clipwright.operators import reports as rs
from clipwright.operators import vectors as vc
from clipwright.operators import visual as vs
from clipwright.operators import windows as wd
from clipwright.functions import lexicons as lx
from clipwright.plans import oracles as o
from clipwright.plans.oracles import SQL, any_of, q
from clipwright.plans.queries import clip_texts, clips, rounded, scored_clips
from clipwright.plans.recipes import query, sql
from clipwright.sources import documents as dc
from clipwright.sources import replies as rp
from clipwright.sources import store

# Merged analyses

ANALYSES = """staged as (select doc_id // 8 as video_id, doc_id as pos, doc_id % 7 as k, (doc_id % 50)::varchar as t, doc_id % 50 as n, '0.' || (doc_id % 9 + 1) as c, quality, doc_id from labels),
raws as (select video_id, pos, case k
  when 0 then '{"segments":[{"confidence":' || c || ',"end_time":' || (n + 5) || ',"start_time":' || t || '},{"end_time":9,"start_time":6},{"note":"open"}]}'
  when 1 then '{"segments":[],"zoom_decisions":[{"confidence":' || c || ',"end_time":' || (n + 4) || ',"start_time":' || (n + 1) || '}]}'
  when 2 then '{"engagement_analysis":[' || c || ',0.5],"scenes":[{"at":' || t || '},{"at":' || (n + 3) || '}]}'
  when 3 then '{"error":null,"segments":[{"confidence":' || c || ',"end_time":' || (n + 1) || ',"start_time":' || t || '}]}'
  when 4 then '{"scenes":"none","segments":{"start_time":' || t || '}}'
  when 5 then '{"content_category":"' || case when quality = 1 then 'tutorial' else 'talk' end || '","mood' || (doc_id % 3) || '":' || (doc_id % 9 + 1) || ',"segments":[{"confidence":' || c || ',"end_time":' || (n + 8) || ',"start_time":' || (n + 2) || '}]}'
  else '{"segments":[{"confidence":' || c || ',"end_time":' || (n + 5) || ',"start_time":' || t || '},' end as raw from staged),
read as (select video_id, pos, raw::json as reply from raws where json_valid(raw) and not json_exists(raw, '$.error')),
lists as (select video_id, pos, kind, case when json_type(x) = 'ARRAY' then json_extract(x, '$[*]') else [] end as found from (
  select video_id, pos, 'zoom' as kind, (reply->'$.segments') as x from read union all select video_id, pos, 'scene', (reply->'$.scenes') from read union all select video_id, pos, 'engagement', (reply->'$.engagement_analysis') from read))"""


def analyses(spark, sf_dir):
    return rp.staged_analyses(st.table(spark, sf_dir, "labels"))


@query(f"""with {ANALYSES},
chosen as (select video_id, pos, case when (reply->'$.segments') is null or (reply->'$.segments')::varchar in ('[]', '{{}}', 'null', '""', '0', 'false') then (reply->'$.zoom_decisions') else (reply->'$.segments') end as x from read),
rows as (select video_id, pos, unnest(json_extract(x, '$[*]')) as e, unnest(range(len(json_extract(x, '$[*]'))))::int as i from chosen where json_type(x) = 'ARRAY')
select video_id, pos, i, (e->>'$.start_time')::double as start_time, (e->>'$.end_time')::double as end_time, (e->>'$.confidence')::double as confidence from rows where json_exists(e, '$.start_time') and json_exists(e, '$.end_time')""")
def zoom_decisions(spark, sf_dir):
    return ev.zoom_decisions(analyses(spark, sf_dir))


@query(f"""with {ANALYSES},
based as (select *, coalesce(sum(len(found)) over (partition by video_id, kind order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as before from lists)
select video_id, kind, (before + i)::bigint as place, found[(i + 1)::int]::varchar as item from based, unnest(range(len(found))) t(i)""")
def merged_items(spark, sf_dir):
    return ev.merged_items(analyses(spark, sf_dir))


@query(f"""with {ANALYSES},
sums as (select video_id, sum(len(found)) filter (kind = 'zoom')::bigint as zooms, sum(len(found)) filter (kind = 'scene')::bigint as scenes, sum(len(found)) filter (kind = 'engagement')::bigint as engagements,
  sum(list_sum(list_transform(found, lambda e: coalesce((e->>'$.confidence')::double, 0.5::double)))) filter (kind = 'zoom') as c from lists group by video_id),
keys as (select video_id, pos, reply, unnest(json_keys(reply)) as key from read where json_exists(reply, '$.content_category')),
last as (select video_id, key, arg_max(json_extract(reply, '$.' || key)::varchar, pos) as value from keys group by all),
metadata as (select video_id, string_agg(key || '=' || value, '; ' order by key || '=' || value) as metadata from last group by video_id)
select video_id, zooms, scenes, engagements, round(coalesce(c / nullif(zooms, 0), 0.0::double), 6) as confidence, coalesce(metadata, '') as metadata from sums left join metadata using (video_id)""")
def merged_analyses(spark, sf_dir):
    return rounded(ev.merged_summary(analyses(spark, sf_dir)), "confidence", places=6)


# Evaluations in batches

READ = """case when trim(raw) like '{%' and json_valid(trim(raw)) then raw::json
  when regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1) like '{%' and json_valid(regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1)) then regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)\\s*```', 1)::json
  when json_valid(replace(regexp_extract(raw, '(?s)(\\{.*\\})', 1), ',]', ']')) then replace(regexp_extract(raw, '(?s)(\\{.*\\})', 1), ',]', ']')::json end"""


def batches(key: str, index: str, size: int) -> str:
    """Candidates in batches, the replies about them, and the evaluations in these."""
    return f"""{{C}},{{SCORED}},
placed as (select *, place // {size} as batch, place % {size} as idx from (select *, row_number() over (partition by video_id order by segment_id) - 1 as place from scored)),
bodies as (select video_id, batch, '{{"{key}": [' || coalesce(string_agg(case when idx % 3 <> 2 then '{{"{index}":' || idx || ',"overall_score":' || round(quality_score, 2) || ',"recommended":' || case when quality_score >= 0.5 then 'true' else 'false' end || '}}' end, ', ' order by idx), '') as body, (video_id * 3 + batch) % 7 as k from placed group by video_id, batch),
raws as (select video_id, batch, case k when 0 then body || ']}}' when 1 then 'Here:' || chr(10) || '```json' || chr(10) || body || ']}}' || chr(10) || '```' when 2 then 'So: ' || body || ',]}}' when 3 then body || ', {{"{index}": 99, "overall_score": 1}}]}}' when 4 then '{{"other": []}}' when 5 then body || ', {{' end as raw from bodies where k <> 6),
parsed as (select video_id, batch, {READ} as reply from raws),
found as (select video_id, batch, unnest(json_extract(reply, '$.{key}[*]')) as e from parsed where reply is not null)"""


@query(sql(f"""with {batches('evaluations', 'segment_index', 10)}
select p.video_id, segment_id, 0.5 as relevance, 0.5 as intent, coalesce((e->>'$.overall_score')::double, 0.5) as overall, coalesce((e->>'$.recommended')::boolean, false) as recommended
from placed p join found f on p.video_id = f.video_id and p.batch = f.batch and p.idx = (e->>'$.segment_index')::int"""))
def contextual_evaluations(spark, sf_dir):
    scored = scored_clips(spark, sf_dir)
    return ev.contextual_evaluations(scored, rp.staged_batches(ev.placed(scored, 10), "evaluations", "segment_index"))


@query(sql(f"""with {batches('segments', 'index', 8)}
select p.video_id, segment_id, coalesce((e->>'$.overall_score')::double, 0.0) as overall, coalesce((e->>'$.recommended')::boolean, false) as recommended, 'model' as method
from placed p join found f on p.video_id = f.video_id and p.batch = f.batch and p.idx = (e->>'$.index')::int
union all select video_id, segment_id, 0.3, false, 'fallback' from placed p where not exists (select 1 from parsed r where r.video_id = p.video_id and r.batch = p.batch and reply is not null)"""))
def batch_evaluations(spark, sf_dir):
    scored = scored_clips(spark, sf_dir)
    return ev.batch_evaluations(scored, rp.staged_batches(ev.placed(scored, 8), "segments", "index"))


@query(sql("""with {C},{PROMPTS},
s as (select video_id, segment_id, round(len(list_filter(string_split_regex(lower(prompt), '\\s+'), lambda w: w <> '' and contains(lower(text), w))) * 0.2
  + case when text = '' then 0.0 else case when len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) between 10 and 100 then 0.3 else 0.0 end + case when regexp_matches(text, '[.!?]') then 0.2 else 0.0 end end, 6) as score from clip_texts join prompts on request_id = video_id)
select video_id, segment_id, least(1.0, score) as overall, score > 0.4 as recommended, row_number() over (partition by video_id order by least(1.0, score) desc, segment_id)::int as place from s
qualify row_number() over (partition by video_id order by least(1.0, score) desc, segment_id) <= 5"""))
def basic_matches(spark, sf_dir):
    return ev.basic_matches(clip_texts(spark, sf_dir).join(st.prompts(spark, sf_dir).withColumnRenamed("request_id", "video_id"), "video_id"))


REFINEMENTS = """{C},{SCORED}, listed as (select *, row_number() over (partition by video_id order by segment_id) - 1 as place from scored),
told as (select conv_id as video_id, turn, (turn * 2 % 7)::int as idx, case when turn % 3 <> 2 then (turn % 10)::double / 10 end as s, case when turn % 2 = 0 then 'high' end as p from conversations),
r as (select video_id, list({'s': s, 'p': coalesce(p, 'medium')} order by turn) as steps, idx from told group by video_id, idx)"""


def refinements(spark, sf_dir):
    """A reply for each conversation, with a refinement for each of its turns; some places come twice, some aren't there."""
    e = F.concat(
        F.lit('{"index":'), F.col("turn") * 2 % 7, F.when(F.col("turn") % 3 != 2, F.concat(F.lit(',"refined_score":'), F.col("turn") % 10 / 10.0)).otherwise(""), F.when(F.col("turn") % 2 == 0, F.lit(',"priority":"high"')).otherwise(""), F.lit("}")
    )
    said = st.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("turn", e.alias("e")))).alias("es"))
    return said.select("video_id", F.concat(F.lit('{"segment_refinements":['), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]}")).alias("raw"))


@query(sql(f"""with {REFINEMENTS},
mixed as (select l.video_id, segment_id, l.place, round(case when steps is null then quality_score else list_reduce(list_prepend(quality_score, list_transform(steps, lambda x: coalesce(x.s, -1.0))), lambda a, x: case when x < 0 then a * 0.7 + a * 0.3 else x * 0.7 + a * 0.3 end) end, 6) as refined,
  steps[-1].p as priority, case when steps is not null then 'consider' end as recommendation from listed l left join r on r.video_id = l.video_id and r.idx = l.place)
select video_id, segment_id, refined, priority, recommendation, row_number() over (partition by video_id order by refined desc, place)::int as rank from mixed"""))
def refined_scores(spark, sf_dir):
    return ev.refined(scored_clips(spark, sf_dir).select("video_id", "segment_id", "quality_score"), refinements(spark, sf_dir), "quality_score")


# Objects

SPANS = """spans as (select event_type as video_id, 'object_' || user_id as object_id, min(t)::double as start_sec, max(t)::double as end_sec from (
  select *, sum(fresh) over (partition by event_type, user_id order by t) as run from (
    select *, case when t - lag(t) over (partition by event_type, user_id order by t) <= 1440 then 0 else 1 end as fresh from (
      select distinct event_type, user_id, floor((epoch_us(ts) / 1000000.0 - 1704067200) / 60)::bigint as t from events))) group by event_type, user_id, run)"""
HITS = """unit as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
scores as (select r.vec_id as ref_id, u.vec_id, list_dot_product(r.v, u.v) / (sqrt(list_dot_product(r.v, r.v)) * sqrt(list_dot_product(u.v, u.v))) as c from unit r join unit u on r.vec_id % 50 = 0),
hits as (select ref_id, 'object_' || vec_id as object_id, sign(c) * floor(abs(c) * 1000 + 0.5) / 1000 as score from scores where sign(c) * floor(abs(c) * 1000 + 0.5) / 1000 >= 0.2),
matched as (select video_id, ref_id, object_id, start_sec, end_sec, score from spans join hits using (object_id))"""


def object_spans(spark, sf_dir):
    """Sessions of each user in the timeline of an event type, a day of minutes apart at least: an object's appearances in a video."""
    seen = st.table(spark, sf_dir, "events")
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1_704_067_200) / 60).cast("long")
    rows = seen.select(F.col("event_type").alias("video_id"), F.concat(F.lit("object_"), "user_id").alias("object_id"), minute.alias("t")).distinct()
    return wd.sessions(rows, ["video_id", "object_id"], "t", 1440).select("video_id", "object_id", F.col("start_sec").cast("double").alias("start_sec"), F.col("end_sec").cast("double").alias("end_sec"))


def matched_segments(spark, sf_dir, documents):
    """Segments of the objects near to the vectors whose ids are divisible by 50."""
    vectors = st.table(spark, sf_dir, "embeddings")
    references = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    hits = vc.search(vectors, references, 0.2, vectors.count() or 1).select("ref_id", F.concat(F.lit("object_"), "vec_id").alias("object_id"), "score", "place")
    return ob.hit_segments(documents, hits)


@query(sql(f"with {SPANS},{HITS} select * from matched"))
def reference_segments(spark, sf_dir):
    return matched_segments(spark, sf_dir, ob.object_documents(object_spans(spark, sf_dir)))


@query(sql(f"""with {SPANS},{HITS}, last as (select video_id, object_id, start_sec, end_sec, arg_max(score, ref_id) as score from matched group by all)
select s.*, score as reference_score from spans s left join last using (video_id, object_id, start_sec, end_sec)"""))
def reference_scores(spark, sf_dir):
    documents = ob.object_documents(object_spans(spark, sf_dir))
    vectors = st.table(spark, sf_dir, "embeddings")
    references = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    # the last score of a segment stays, so an object needs its last reference only
    hits = vc.last_references(vectors, references, 0.2).select("ref_id", F.concat(F.lit("object_"), "vec_id").alias("object_id"), "score", F.lit(1).alias("place"))
    found = ob.with_reference_scores(documents, ob.hit_segments(documents, hits))
    rows = found.select("video_id", F.explode("objects").alias("o")).select("video_id", "o.object_id", F.explode("o.segments").alias("s"))
    return rows.select("video_id", "object_id", "s.start_sec", "s.end_sec", F.col("s.reference_match.score").alias("reference_score"))


@query(sql(f"""with {SPANS}, o as (select video_id, object_id, start_sec as obj_start, end_sec as obj_end, 0.5 + (end_sec - start_sec) / 10000 as score from spans),
bounds as (select video_id, min(obj_start) + 60 as lo, max(obj_end) - 60 as hi from o group by all),
near as (select o.*, lo, hi from o join bounds using (video_id) where obj_end >= lo and obj_start <= hi),
w as (select *, 'object_appearance' as method, greatest(lo, (obj_start + obj_end) / 2 - 7.5) as seg_start, least(hi, greatest(lo, (obj_start + obj_end) / 2 - 7.5) + 15) as seg_end from near
  union all select *, 'object_appearance_long', greatest(lo, obj_start), least(hi, obj_start + least(60.0, obj_end - obj_start)) from near where obj_end - obj_start > 15),
c as (select w.video_id, w.object_id, w.obj_start, w.obj_end, method, o.object_id as other, max(o.score) as score, least(1.0, sum(least(seg_end, o.obj_end) - greatest(seg_start, o.obj_start)) / greatest(any_value(seg_end - seg_start), 1e-6)) as coverage
  from w join o on o.video_id = w.video_id and o.obj_start < seg_end and o.obj_end > seg_start group by all),
b as (select video_id, object_id, obj_start, obj_end, method, least(1.0, sum(coverage * score)) as object_score, arg_min(other, (-score, other)) as top_object from c group by all)
select video_id, object_id, obj_start, obj_end, method, seg_start, seg_end, round(coalesce(object_score, 0), 5) as object_score, top_object from w left join b using (video_id, object_id, obj_start, obj_end, method)"""))
def object_windows(spark, sf_dir):
    spans = object_spans(spark, sf_dir).select("video_id", "object_id", F.col("start_sec").alias("obj_start"), F.col("end_sec").alias("obj_end"), (0.5 + (F.col("end_sec") - F.col("start_sec")) / 10000).alias("score"))
    bounds = spans.groupBy("video_id").agg((F.min("obj_start") + 60).alias("range_start"), (F.max("obj_end") - 60).alias("range_end"))
    return rounded(ob.object_windows(spans, bounds), "object_score", places=5)


# Matching, scenes, words, logs


@query(sql("""with {T}, v as (select video_id, start + seg_idx % 5 - 2 as v_start, "end" + seg_idx % 3 - 1 as v_end, seg_idx as pos, ['action', 'talking_head', 'demonstration', 'unknown'][(seg_idx % 4 + 1)::int] as scene from transcript),
once as (select video_id, v_start, v_end, min(pos) as pos, arg_max(scene, pos) as scene from v group by all),
met as (select t.video_id, seg_idx, pos, v_start = start and v_end = "end" as exact, scene from transcript t left join once o on o.video_id = t.video_id and abs(v_start - start) < 2 and abs(v_end - "end") < 2)
select video_id, seg_idx as segment_id, exact, coalesce(scene, 'unknown') as scene_type, scene is not null as has_vision from met qualify row_number() over (partition by video_id, seg_idx order by exact desc, pos) = 1"""))
def tolerant_vision(spark, sf_dir):
    lines = st.transcript(spark, sf_dir)
    vision = st.vision_segments(spark, sf_dir).join(lines.select("video_id", F.col("seg_idx").alias("pos"), (F.col("end") + F.col("seg_idx") % 3 - 1).alias("v_end")), ["video_id", "pos"])
    segments = lines.select("video_id", F.col("seg_idx").alias("segment_id"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    found = iv.tolerant_match(segments, vision.select("video_id", "pos", F.col("start").alias("v_start"), "v_end", "scene_type"), 2.0, "scene_type")
    return found.select("video_id", "segment_id", "exact", F.coalesce("scene_type", F.lit("unknown")).alias("scene_type"), F.col("scene_type").isNotNull().alias("has_vision"))


@query(sql("""with recursive frames as (select label as video_id, vec_id * 10 as frame_no, list_transform(embedding, lambda x: x::double) as v from embeddings where embedding is not null),
paired as (select video_id, frame_no, v, lag(v) over (partition by video_id order by frame_no) as u from frames),
parts as (select video_id, frame_no, len(v) as n, list_sum(v) as sv, list_sum(u) as su, list_dot_product(u, v) as uv, list_dot_product(u, u) as uu, list_dot_product(v, v) as vv from paired where u is not null),
alike as (select video_id, frame_no, frame_no / 25.0 as ts, case when abs((uu - su * su / n) * (vv - sv * sv / n)) > 2.220446049250313e-16 then (uv - su * sv / n) / sqrt((uu - su * su / n) * (vv - sv * sv / n)) else 1.0 end as r from parts),
c as (select *, row_number() over (partition by video_id order by ts) as i from alike where r < 1 - 0.3),
walk(video_id, i, last, taken) as (
  select video_id, i, ts, true from c where i = 1
  union all select c.video_id, c.i, case when c.ts - last >= 5.0 then c.ts else last end, c.ts - last >= 5.0 from walk w join c on c.video_id = w.video_id and c.i = w.i + 1)
select c.video_id, frame_no, ts, round(1 - r, 5) as confidence from c join walk w on w.video_id = c.video_id and w.i = c.i where taken"""))
def scene_changes(spark, sf_dir):
    frames = st.table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), (F.col("vec_id") * 10).alias("frame_no"), F.col("embedding").alias("vector"))
    return rounded(vs.scene_changes(frames), "confidence", places=5)


VISUAL = """{FEAT}, means as (select *, avg(complexity) over (partition by video_id) as mean from features),
flags as (select video_id, frame_no, ts, 0 as kind, motion > 30.0 as high, 4 as least from means union all select video_id, frame_no, ts, 1, complexity > mean * 1.5, 4 from means union all select video_id, frame_no, ts, 2, -motion > -20.0, 30 from means),
marked as (select *, lead(ts) over w as next_ts, row_number() over w - sum(high::int) over w as run from flags window w as (partition by kind, video_id order by frame_no)),
runs as (select kind, video_id, min(ts) as run_start, arg_max(coalesce(next_ts, -1), frame_no) as run_end from marked where high group by kind, video_id, run having arg_max(coalesce(next_ts, -1), frame_no) - min(ts) >= any_value(least)),
ordered as (select *, max(run_end) over (partition by video_id order by run_start, kind, run_end rows between unbounded preceding and 1 preceding) as before from runs),
islands as (select *, sum(case when run_start <= before + 5.0 then 0 else 1 end) over (partition by video_id order by run_start, kind, run_end rows unbounded preceding) as island from ordered),
g as (select video_id, min(run_start) as seg_start, max(run_end) as seg_end, list(kind order by run_start, kind, run_end) as ks from islands group by video_id, island)"""


@query(sql("with " + VISUAL + """
select video_id, seg_start, seg_end, list_max(list_transform(ks, lambda k: [0.8, 0.7, 0.6][k + 1])) as activity, array_to_string(list_transform(ks, lambda k: ['action', 'detailed', 'silent_visual'][k + 1]), '+') as scene_type,
  coalesce(list_filter(list_transform(ks, lambda k: ['high', 'medium', 'unknown'][k + 1]), lambda x: x <> 'unknown')[-1], 'unknown') as motion_level, list_contains(ks, 0) as has_people,
  list_max(list_transform(ks, lambda k: [0.6, 0.8, 0.5][k + 1])) as color_diversity, list_max(list_transform(ks, lambda k: [0.5, 0.9, 0.6][k + 1])) as complexity,
  round(list_reduce(list_transform(ks, lambda k: [0.0, 0.3, 1.0][k + 1]), lambda a, x: (a + x) / 2), 5) as silence from g"""))
def visual_segments(spark, sf_dir):
    frames = st.frame_features(spark, sf_dir)
    still = wd.runs_above(frames.withColumn("stillness", -F.col("motion")), "stillness", F.lit(-20.0), 30.0)
    return rounded(vs.visual_segments(wd.motion_runs(frames, 30.0, 4.0), wd.complexity_runs(frames, 1.5, 4.0), still), "silence", places=5)


WORDS = """lines as (select video_id, seg_idx, start, "end", list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as ws from transcript),
timed_lines as (select video_id, seg_idx, start, "end", list_transform(range(len(ws)), lambda i: {'word': ws[(i + 1)::int], 'start': start + i * (("end" - start) / len(ws)), 'end': start + (i + 1) * (("end" - start) / len(ws))}) as words from lines where len(ws) > 0)"""


def timed_lines(spark, sf_dir):
    lines = st.transcript(spark, sf_dir)
    return cp.timed_words(lines).join(lines.select("video_id", "seg_idx", "start", "end"), ["video_id", "seg_idx"])


@query(sql(f"""with {{T}},{WORDS} select video_id, sum(len(words))::bigint as words, sum(len(list_filter(words, lambda w: w."start" <> w."end")))::bigint as timed, sum(len(list_filter(words, lambda w: w."start" <> w."end"))) > 0 as has_timing from timed_lines group by video_id"""))
def word_timing(spark, sf_dir):
    return cp.has_word_timing(timed_lines(spark, sf_dir))


@query(sql(f"""with {{T}},{{CLIPS}},{WORDS},
met as (select c.video_id, segment_id, seg_start, seg_end, seg_idx, start, "end", words, (least("end", seg_end) - greatest(start, seg_start)) / ("end" - start) as share from clips c join timed_lines t on t.video_id = c.video_id and t.start < seg_end and t."end" > seg_start),
tiers as (select *, case when share >= 0.8 then 0.0 when share >= 0.6 then 0.1 else 0.3 end as early from met where share >= 0.5),
kept as (select *, list_filter(words, lambda w: w."end" > seg_start and w."start" < seg_end and w."start" - seg_start >= early) as inside from tiers)
select video_id, segment_id, seg_idx, round(greatest(greatest(0, start - seg_start), early), 4) as line_start, round(greatest(greatest(0, start - seg_start) + 0.01, "end" - seg_start), 4) as line_end, i::int as i, inside[(i + 1)::int].word as word,
  round(inside[(i + 1)::int]."start" - seg_start, 4) as word_start, round(greatest(inside[(i + 1)::int]."start" - seg_start + 0.01, inside[(i + 1)::int]."end" - seg_start), 4) as word_end from kept, unnest(range(len(inside))) t(i)"""))
def clip_words(spark, sf_dir):
    found = cp.clip_words(clips(spark, sf_dir), timed_lines(spark, sf_dir))
    rows = found.select("video_id", "segment_id", "seg_idx", "line_start", "line_end", F.posexplode("words").alias("i", "w"))
    return rounded(rows.select("video_id", "segment_id", "seg_idx", "line_start", "line_end", "i", "w.word", F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end")), "line_start", "line_end", "word_start", "word_end")


@query(sql("""with {T},{DET},
entries as (select 'audio' as kind, video_id, coalesce(speaker, 'unknown') as class, n_words as words, length(coalesce(text, '')) as chars, null::double as score from transcript
  union all select 'object', video_id, coalesce(class_name, 'unknown'), 0, 0, null from detections
  union all select 'vision', video_id, ['action', 'talking_head', 'demonstration', 'unknown'][(seg_idx % 4 + 1)::int], 0, 0, nullif((n_words % 7)::double / 7, 0) from transcript)
select kind, class, video_id, 'kind' || case when grouping(class) = 0 then '+class' else '' end || case when grouping(video_id) = 0 then '+video' else '' end as level, count(*) as entries, sum(words)::bigint as words, sum(chars)::bigint as chars,
  count(distinct class) as classes, count(distinct video_id) as videos, round(coalesce(avg(score), 0), 5) as mean_score, round(coalesce(min(score), 0), 5) as least_score, round(coalesce(max(score), 0), 5) as most_score
from entries group by grouping sets ((kind), (kind, class), (kind, video_id), (kind, class, video_id))"""))
def run_report(spark, sf_dir):
    entries = rs.log_entries(st.transcript(spark, sf_dir), st.detections(spark, sf_dir), st.vision_segments(spark, sf_dir))
    return rounded(rs.run_report(entries), "mean_score", "least_score", "most_score", places=5)


# The transcript store


@query(sql("""with {T}, spoken as (select 'v' || video_id as asked, count(*) as lines, max("end") as stop from transcript group by all),
pieces as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') as p, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as w from documents),
runs as (select doc_id, case when len(p) > 0 then list_transform(p, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> ''))) else list_transform(range(0, len(w), 50), lambda i: least(50, len(w) - i)) end as n from pieces)
select asked, lines, round(stop, 4) as stop from spoken union all select 'd' || doc_id, len(n), round(list_sum(list_transform(n, lambda x: greatest(1.0, x * 0.5))), 4) from runs where len(n) > 0"""))
def transcript_store(spark, sf_dir):
    """Transcripts saved by video id, some of them first without their lines, and documents by upload id, read through either."""
    spoken = dc.transcript_documents(st.transcript(spark, sf_dir))
    value = F.to_json(F.struct("text", "segments"))
    path = f"{vc.shared_folder(spark)}/{uuid.uuid4()}"
    none = F.lit(None).cast("string").alias("uploaded_video_id")
    first = spoken.select(F.concat(F.lit("v"), "video_id").alias("video_id"), none, F.lit("not yet").alias("value"))
    texts = st.table(spark, sf_dir, "documents").select(F.lit(None).cast("string").alias("video_id"), F.concat(F.lit("d"), "doc_id").alias("uploaded_video_id"), F.coalesce("text", F.lit("")).alias("value"))
    store.save(first.unionByName(texts), path)
    store.save(spoken.select(F.concat(F.lit("v"), "video_id").alias("video_id"), none, value.alias("value")), path)
    asked = first.select("video_id", none).unionByName(texts.select("video_id", "uploaded_video_id"))
    values = store.found(asked, store.stored(spark, path)).select(F.coalesce("video_id", "uploaded_video_id").alias("video_id"), "value")
    return rounded(store.lines(values).groupBy(F.col("video_id").alias("asked")).agg(F.count("*").alias("lines"), F.max("end").alias("stop")), "stop")


# SQL for queries that are registered elsewhere

SQL["prompt_focus_tokens"] = sql("""with {PROMPTS}, p as (select request_id, prompt, lower(prompt) as low from prompts),
t as (select request_id, list_concat(list_concat(list_concat(list_transform(regexp_extract_all(low, '\\b(60|75|90|100|120|144|150|165|170|180|200|240|300|360)\\s*-?\\s*(?:hz|hertz)\\b', 1), lambda x: x || 'hz'), case when {HIGH} then ['high_refresh'] else [] end),
  list_concat(list_transform(regexp_extract_all(low, '\\b(\\d+[\\d.,]*\\s?(?:mah|gb|g|w|nm|fps|nit|nits|inch|in|mm|ghz|khz|mhz|k|kwh|%|mp))\\b', 1), lambda x: regexp_replace(x, '[\\s,]', '', 'g')), regexp_extract_all(low, '\\b(4k|8k|2k|1080p|1440p|2160p|720p)\\b', 1))),
  list_concat(list_filter([{PARTS}], lambda x: x is not null), list_transform(regexp_extract_all(prompt, '\\b([a-zA-Z]+\\d+[a-zA-Z\\d]*)\\b', 1), lambda x: lower(x)))) as found from p)
select request_id, array_to_string(list_sort(list_distinct(list_filter(found, lambda x: length(x) >= 3 and x not in ({STOP})))), ',') as tokens from t""",
    HIGH=any_of("prompt", lx.HIGH_REFRESH), PARTS=", ".join(f"case when contains(low, {q(c)}) then {q(c)} end" for c in lx.COMPONENTS), STOP=", ".join(map(q, lx.FOCUS_STOP)))

QUALITY = f"""heard as (select video_id, seg_idx, start, "end", text as whole, {o.TRIM} as text, lag({o.TRIM}) over w as before, lag("end") over w as before_stop from transcript window w as (partition by video_id order by seg_idx)),
firsts as (select *, coalesce(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')[1], '') as first, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n,
  coalesce(length(text) >= 3 and regexp_matches(before, '[.!?]$') and regexp_matches(text, '^[\\p{{Lu}}"'']'), false) as opens, coalesce(start - before_stop >= 0.5 or regexp_matches(before, '(,|;|:|--|—)$'), false) as rests from heard where text <> ''),
marked as (select video_id, start, "end",
  round(greatest(0.0, least(1.0, 0.5 - case when first in ({', '.join(map(q, lx.CONTINUATION))}) then 0.4 else 0.0 end + case when first in ({', '.join(map(q, lx.OPENERS))}) then 0.3 else 0.0 end + case when opens then 0.3 else 0.0 end
    + case when first in ({', '.join(map(q, lx.QUESTION_WORDS))}) then 0.2 else 0.0 end + case when rests then 0.2 else 0.0 end - case when regexp_matches(text, '^\\p{{Ll}}') then 0.2 else 0.0 end)), 4) as sq,
  round(greatest(0.0, least(1.0, 0.5 + case when regexp_matches(text, '[.!?]$') then 0.4 when regexp_matches(text, '(,|;|:|--|—)$') then 0.2 else 0.0 end - case when regexp_matches(lower(text), {q(lx.INCOMPLETE)}) then 0.4 else 0.0 end - case when n < 3 then 0.2 else 0.0 end
    + case when {any_of('text', lx.CLOSING)} then 0.1 else 0.0 end)), 4) as eq from firsts)"""
SQL["boundary_adjust"] = sql(f"""with {{T}},{{CLIPS}},{QUALITY},
s as (select video_id, segment_id, start as new_start from clips c join marked m using (video_id) where start between seg_start - 5.0 and seg_start + 5.0 qualify row_number() over (partition by video_id, segment_id order by sq desc, abs(start - seg_start), start) = 1),
e as (select video_id, segment_id, "end" as new_end from clips c join marked m using (video_id) where "end" between seg_end - 5.0 and seg_end + 5.0 qualify row_number() over (partition by video_id, segment_id order by eq desc, abs("end" - seg_end), "end") = 1),
r as (select video_id, segment_id, coalesce(new_start, seg_start) as a, coalesce(new_end, seg_end) as z from clips left join s using (video_id, segment_id) left join e using (video_id, segment_id)),
met as (select r.video_id, segment_id, "end", eq, "end" - a as d from r join marked m on m.video_id = r.video_id),
longer as (select * from met where d between 15.0 and 60.0 qualify row_number() over (partition by video_id, segment_id order by eq desc, d) = 1),
shorter as (select * from met where d between 60.0 * 0.8 and 60.0 qualify row_number() over (partition by video_id, segment_id order by eq desc, d desc) = 1)
select r.video_id, r.segment_id, a as seg_start, case when z - a < 15.0 then coalesce(l."end", a + 15.0) when z - a > 60.0 then coalesce(h."end", a + 60.0) else z end as seg_end
from r left join longer l using (video_id, segment_id) left join shorter h using (video_id, segment_id)""")
