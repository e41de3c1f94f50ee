"""Registered queries of the evaluation and selection recipes, of scenes and of small rules, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clipwright import staging as st
from clipwright.functions import lexicons as lx
from clipwright.functions import text as tx
from clipwright.functions import titles as tt
from clipwright.operators import candidates as cd
from clipwright.operators import framing as fr
from clipwright.operators import intervals as iv
from clipwright.operators import prompts as pr
from clipwright.operators import recipes as rc
from clipwright.operators import reports as rs
from clipwright.operators import retention as rt
from clipwright.operators import scenes as sc
from clipwright.operators import select as sl
from clipwright.operators import tracking as tk
from clipwright.operators import windows as wd
from clipwright.plans import oracles as o
from clipwright.plans.oracles import SQL, any_of, count, hits, n_words, q
from clipwright.plans.queries import QUERIES, clip_texts, clips, daily, days, hours, noted_clips, prompt_scores, rounded, scored_clips, zooms
from clipwright.sources import documents as dc
from clipwright.sources import requests as rq
from clipwright.sources import subtitles as su

_PARTS = {
    "B": o._B, "C": o._C, "T": o._T, "SCORED": o.SCORED, "PROMPTS": o.PROMPTS, "CLIPS": o.CLIPS, "DET": o.DETECTIONS, "DAYS": o.DAYS, "DAILY": o.DAILY, "HOURS": o.HOURS, "APP": o.APPEARANCES, "FEAT": o.FEATURES, "FILES": o.FILES,
    "ZOOM": o.ZOOM, "CROPS": o.CROPS,
    "INTENT": f"list_distinct({o._INTENT} || list_transform(list_filter(string_split_regex(lower(prompt), '\\s+'), lambda x: length(x) > 3), lambda x: regexp_replace(x, '^[.,?!]+|[.,?!]+$', '', 'g')))",
    "TYPED": "typed as (select *, ['face', 'person', 'object'][(det_id % 3 + 1)::int] as type, ['person', 'car', 'dog', 'elephant', 'kite'][(det_id % 5 + 1)::int] as thing from detections)",
}


def sql(template: str, **parts: str) -> str:
    """A template with all decimals as doubles, then with its parts put in."""
    text = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.:])", r"\1::double", template)
    for name, part in {**_PARTS, **parts}.items():
        text = text.replace("{" + name + "}", part)
    return text


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# Refinement

VALID = """{C},{SCORED},
measured as (select video_id, segment_id, seg_start, seg_end, text, quality_score, length(text) / greatest(d, 1) / 5 as r, d, {N}::double / ({DOTS} + 1) as m from scored),
valid as (select *, case when d between 15 and 60 then 1.0 when d between 10 and 90 then 0.7 else 0.3 end * 0.25 + 0.7 * 0.3 + 0.6 * 0.25 + case when r between 2 and 4 then 1.0 when r between 1 and 6 then 0.7 else 0.4 end * 0.2 as heuristic,
  ((case when text = '' then 0.0 when m between 8 and 20 then 0.8 else 0.5 end) + 0.6 + (case when text = '' then 0.0 else least(1.0, 0.5 + case when regexp_matches(text, '[.!?]') then 0.3 else 0.0 end + case when {CONTEXT} then 0.2 else 0.0 end) end)) / 3 as coherence from measured),
crossed as (select *, round(quality_score * 0.5 + heuristic * 0.3 + coherence * 0.2, 6) as composite, least(quality_score, heuristic, coherence) as confidence from valid)"""
_PARTS["VALID"] = sql(VALID, N=n_words("replace(text, '.', ' ')"), DOTS=count("text", "."), CONTEXT=any_of("text", rc.CONTEXT))


def crossed(spark, sf_dir):
    return rc.cross_validated(sl.scored(rc.validated(noted_clips(spark, sf_dir))).withColumn("model_score", F.col("quality_score")))


@query(sql("with {VALID} select video_id, segment_id, round(heuristic, 4) as heuristic, round(coherence, 4) as coherence from valid"))
def validation_scores(spark, sf_dir):
    return rounded(rc.validated(noted_clips(spark, sf_dir)).select("video_id", "segment_id", "heuristic", "coherence"), "heuristic", "coherence")


@query(sql("with {VALID} select video_id, segment_id, composite, composite >= 0.6 as passed, round(confidence, 4) as confidence from crossed"))
def cross_validation(spark, sf_dir):
    return rounded(crossed(spark, sf_dir).select("video_id", "segment_id", "composite", "passed", "confidence"), "confidence")


@query(sql("with {VALID} select video_id, count(*) as segments, count(*) filter (composite >= 0.6) as passed, count(*) filter (composite >= 0.6) / count(*)::double as rate, round(coalesce(avg(composite) filter (composite >= 0.6), 0), 5) as confidence, round(avg(composite), 5) as mean from crossed group by video_id"))
def cross_validation_summary(spark, sf_dir):
    return rounded(rc.validation_summary(crossed(spark, sf_dir)), "confidence", "mean", places=5)


KINDS = "['tutorial', 'entertainment', 'documentary'][(request_id % 3 + 1)::int]"


def asked(spark, sf_dir):
    """Prompts of videos, with staged kinds of content and preferred places."""
    kinds = F.array(*[F.lit(x) for x in ("tutorial", "entertainment", "documentary")])
    places = F.array(*[F.lit(x) for x in ("peak", "end", "beginning", "any")])
    rows = st.prompts(spark, sf_dir).withColumn("video_id", F.col("request_id"))
    return rows.withColumn("content_kind", F.element_at(kinds, (F.col("request_id") % 3 + 1).cast("int"))).withColumn("preferred", F.element_at(places, (F.col("request_id") % 4 + 1).cast("int")))


@query(sql("""with {VALID},{PROMPTS}, k as (select request_id, string_split_regex(lower(prompt), '\\s+') as ws, {INTENT} as factors, {KINDS} as kind from prompts),
j as (select c.*, list_filter(ws, lambda x: x <> '') as ws, factors, kind from crossed c join k on video_id = request_id)
select video_id, segment_id, round(greatest(0.0, least(1.0, composite * 0.3 + (len(list_filter(ws, lambda x: contains(lower(text), x)))::double / greatest(len(ws), 1) * 0.6 + case when len(factors) > 0 then len(list_filter(factors, lambda x: contains(lower(text), lower(x))))::double / len(factors) else 0.5 end * 0.4) * 0.25
  + case kind when 'tutorial' then least(1.0, {TUT}::double / 3) when 'entertainment' then least(1.0, {ENT}::double / 2) else 0.5 end * 0.15
  + least(1.0, 0.5 + least({ATT} * 0.1, 0.3) + least({ASK} * 0.05, 0.1) + least({CRY} * 0.05, 0.1)) * 0.15 + 0.7 * 0.1 + 0.6 * 0.05)), 8) as enhanced from j""",
    KINDS=KINDS, TUT=hits("text", rc.TUTORIAL), ENT=hits("text", rc.ENTERTAINMENT), ATT=hits("text", rc.ATTRACTION), ASK=count("text", "?"), CRY=count("text", "!")))
def enhanced_quality(spark, sf_dir):
    rows = crossed(spark, sf_dir).join(asked(spark, sf_dir).select("video_id", "prompt", "content_kind", pr.intent_keywords(F.col("prompt")).alias("factors")), "video_id")
    return rounded(rc.enhanced_quality(rows).select("video_id", "segment_id", "enhanced"), "enhanced", places=8)


@query(sql("""with recursive {C},{SCORED},
ordered as (select video_id, segment_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as w, row_number() over (partition by video_id order by quality_score desc, seg_start, segment_id) as rn from scored where d between 15 and 60),
chosen(video_id, rn, kept, ids) as (
  select distinct video_id, 0::bigint, []::varchar[][], []::bigint[] from ordered
  union all
  select o.video_id, o.rn, case when take then list_append(kept, w) else kept end, case when take then list_append(ids, segment_id) else ids end
  from (select o.*, c.kept, c.ids, len(c.ids) < 10 and len(list_filter(c.kept, lambda k: len(list_intersect(k, o.w))::double / greatest(len(list_distinct(list_concat(k, o.w))), 1) > 0.7)) = 0 as take
    from chosen c join ordered o on o.video_id = c.video_id and o.rn = c.rn + 1) o)
select video_id, unnest(range(1, len(ids) + 1))::int as place, unnest(ids) as segment_id from chosen qualify rn = max(rn) over (partition by video_id)"""))
def unlike_selection(spark, sf_dir):
    return rc.unlike_selection(scored_clips(spark, sf_dir))


@query(sql("""with {C},{SCORED} select video_id, segment_id, round(case when segment_id % 3 = 0 then 0.3 when segment_id % 2 = 0 and segment_id % 5 = 0 and text <> '' then 0.05 when segment_id % 2 = 0 and segment_id % 5 = 0 then 0.0
  else greatest(0.0, least(1.0, greatest(case when segment_id % 2 = 1 then quality_score end, case when segment_id % 5 <> 0 then engagement_score end))) end, 4) as score from scored"""))
def filled_scores(spark, sf_dir):
    some = F.col("segment_id")
    rows = scored_clips(spark, sf_dir).withColumn("score", F.when(some % 3 == 0, 0.3).when(some % 3 == 1, 0.0))
    rows = rows.withColumn("quality_score", F.when(some % 2 == 1, F.col("quality_score"))).withColumn("engagement_score", F.when(some % 5 != 0, F.col("engagement_score")))
    return rounded(rc.filled_scores(rows, "score", ["quality_score", "engagement_score"]).select("video_id", "segment_id", "score"), "score")


# Requests

CONTEXTUAL = """{C},{PROMPTS}, stops as (select video_id as v, max("end") as stop from transcript group by video_id),
placed as (select c.*, request_id, prompt, {KINDS} as kind, ['peak', 'end', 'beginning', 'any'][(request_id % 4 + 1)::int] as preferred, seg_start / stop as place, {N} as n from clip_texts c join prompts on request_id = video_id join stops on v = video_id),
contextual as (select *, round(0.5 + case when (kind = 'tutorial' and contains(lower(prompt), 'educational')) or (kind in ('movie', 'documentary') and {FIT}) then 0.2 else 0.0 end
  + case when (preferred = 'peak' and place between 0.3 and 0.8) or (preferred = 'end' and place > 0.7) or (preferred = 'beginning' and place < 0.3) then 0.1 else 0.0 end + case when n between 10 and 100 and regexp_matches(text, '[.!?]') then 0.15 else 0.0 end, 6) as score from placed)"""
_PARTS["CONTEXTUAL"] = sql(CONTEXTUAL, KINDS=KINDS, N=n_words("text"), FIT=any_of("prompt", ["climax", "dramatic", "best"]))
_PARTS["HEUR"] = f"heur as ({SQL['prompt_heuristic']})"


def contextual(spark, sf_dir):
    stop = st.transcript(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("stop"))
    return rc.contextual_scores(clip_texts(spark, sf_dir).join(asked(spark, sf_dir), "video_id").join(stop, "video_id"))


@query(sql("with {CONTEXTUAL} select request_id, segment_id, least(1.0, score) as relevance, least(1.0, round(score * 0.9, 6)) as engagement, score > 0.6 as recommended from contextual"))
def contextual_scores(spark, sf_dir):
    return contextual(spark, sf_dir).select("request_id", "segment_id", "relevance", "engagement", "recommended")


def requested(spark, sf_dir):
    return prompt_scores(spark, sf_dir).select("request_id", "segment_id", "text", "seg_start", "keywords", F.col("heuristic").alias("score"))


@query(sql("""with {HEUR}, t as (select *, max((heuristic > 0.75)::int) over w as own, max((heuristic >= 0.6)::int) over w as low, max((heuristic >= 0.65)::int) over w as high, row_number() over (partition by request_id order by heuristic desc, segment_id) as place from heur window w as (partition by request_id))
select request_id, segment_id from t where case when own = 1 then heuristic > 0.75 when low = 1 then heuristic >= 0.6 when high = 1 then heuristic >= 0.65 else place <= 3 end"""))
def recommended_clips(spark, sf_dir):
    rows = requested(spark, sf_dir).withColumn("recommended", F.col("score") > 0.75)
    return rc.recommended_or_best(rows, 0.6, 0.65).where("recommended").select("request_id", "segment_id")


@query(sql("""with {HEUR}, {C},{PROMPTS}, k as (select request_id, {INTENT} as tokens from prompts)
select h.request_id, h.segment_id, len(list_filter(tokens, lambda t: contains(lower(text), t)))::int as matched, heuristic > 0.75 or (len(list_filter(tokens, lambda t: contains(lower(text), t))) > 0 and heuristic >= 0.5) as recommended
from heur h join k using (request_id) join clip_texts c on c.video_id = h.request_id and c.segment_id = h.segment_id"""))
def boosted_clips(spark, sf_dir):
    rows = requested(spark, sf_dir).withColumn("recommended", F.col("score") > 0.75).withColumnRenamed("keywords", "tokens")
    return rc.boosted(rows, 0.5).select("request_id", "segment_id", F.size("matches").alias("matched"), "recommended")


@query(sql("""with {HEUR}, r as (select *, round(heuristic * 0.9, 6) as engagement from heur),
t as (select *, max((heuristic >= 0.7 and engagement >= 0.7)::int) over w as first, max((heuristic >= 0.7 - 0.2 and engagement >= 0.7 - 0.2)::int) over w as second, count(*) over w as n, row_number() over (partition by request_id order by heuristic desc, segment_id) as place from r window w as (partition by request_id))
select request_id, segment_id from t where case when first = 1 then heuristic >= 0.7 and engagement >= 0.7 when second = 1 then heuristic >= 0.7 - 0.2 and engagement >= 0.7 - 0.2 else place <= case when n // 2 = 0 then 3 else n // 2 end end"""))
def qualified_clips(spark, sf_dir):
    rows = requested(spark, sf_dir).withColumn("relevance", F.col("score")).withColumn("engagement", F.round(F.col("score") * 0.9, 6))
    return rc.qualified(rows, 0.7, 0.7).select("request_id", "segment_id")


@query(sql("""with {HEUR}, chosen as (select request_id, segment_id, heuristic from heur where heuristic >= 0.65), have as (select request_id, count(*) as n from chosen group by request_id),
rest as (select h.*, row_number() over (partition by h.request_id order by h.heuristic desc, h.segment_id) as place, coalesce(n, 0) as n from heur h left join have using (request_id) where h.heuristic < 0.65)
select request_id, segment_id from chosen union all select request_id, segment_id from rest where place <= 3 - n"""))
def topped_up(spark, sf_dir):
    rows = requested(spark, sf_dir).select("request_id", "segment_id", "score")
    return rc.at_least(rows, F.col("score") >= 0.65, "request_id", 3, "score").select("request_id", "segment_id")


@query(sql("with {C} select video_id, segment_id, case when p <= 0.1 then 0.8 when p >= 0.85 then 0.9 when p between 0.4 and 0.6 then 0.7 else 0.5 end as bonus from (select video_id, segment_id, seg_start / stop as p from clips join (select video_id, max(\"end\") as stop from transcript group by all) using (video_id))"))
def position_bonuses(spark, sf_dir):
    stop = st.transcript(spark, sf_dir).groupBy("video_id").agg(F.max("end").alias("stop"))
    return clips(spark, sf_dir).join(stop, "video_id").select("video_id", "segment_id", rc.position_bonus(F.col("seg_start") / F.col("stop")).alias("bonus"))


SQL["prompt_matches"] = sql("""with {HEUR}, t as (select request_id, segment_id, heuristic as score, count(*) filter (heuristic >= 0.6) over (partition by request_id) as high from heur)
select request_id, segment_id, score, row_number() over (partition by request_id order by score desc, segment_id)::int as place from t where case when high >= 3 then score >= 0.6 else score >= 0.5 end qualify row_number() over (partition by request_id order by score desc, segment_id) <= 3""")


@query(sql("with {C},{SCORED} select video_id, count(*) filter (quality_score > 0.7) as high, count(*) filter (quality_score between 0.4 and 0.7) as medium, count(*) filter (quality_score < 0.4) as low, round(avg(quality_score), 5) as mean, min(quality_score) as least, max(quality_score) as most from scored group by video_id"))
def confidence_distribution(spark, sf_dir):
    return rounded(rc.confidence_distribution(scored_clips(spark, sf_dir), "quality_score"), "mean", places=5)


# Breaks and windows

_PARTS["MERGED"] = """ordered_breaks as (select video_id, ts, type, confidence, row_number() over (partition by video_id order by ts, type, confidence) as rn from breaks),
folded as (
  select *, 1 as g from ordered_breaks where rn = 1
  union all
  select n.video_id, case when n.ts - f.ts >= 2 or n.confidence > f.confidence then n.ts else f.ts end, case when n.ts - f.ts >= 2 or n.confidence > f.confidence then n.type else f.type end,
    case when n.ts - f.ts >= 2 or n.confidence > f.confidence then n.confidence else f.confidence end, n.rn, f.g + (n.ts - f.ts >= 2)::int
  from folded f join ordered_breaks n on n.video_id = f.video_id and n.rn = f.rn + 1),
merged as (select video_id, ts, type, confidence from folded qualify row_number() over (partition by video_id, g order by rn desc) = 1)"""
_PARTS["PRE"] = f"pre as ({SQL['preroll_end']})"
SQL["merged_breaks"] = sql("with recursive {B},{MERGED} select * from merged")


@query(sql("""with recursive {B},{MERGED},{PRE}, spans as (select video_id, before_end as s, start as e from lined where start > before_end + 0.5),
later as (select m.*, exists (select 1 from spans x where x.video_id = m.video_id and x.s < preroll_end and m.ts between x.s and x.e) as inside from merged m join pre using (video_id) where ts > preroll_end)
select video_id, ts, type, confidence from later qualify not inside or (bool_and(inside) over (partition by video_id) and row_number() over (partition by video_id order by ts, type) = 1)"""))
def filtered_breaks(spark, sf_dir):
    said = st.transcript(spark, sf_dir)
    spans = wd.silence_periods(said).select("video_id", F.col("silence_start").alias("span_start"), F.col("silence_end").alias("span_end"))
    return rc.filtered_breaks(sl.merged_breaks(st.breaks(spark, sf_dir)), spans, wd.preroll_end(said, st.videos(spark, sf_dir)))


@query(sql("""with {B},{PRE}, quiet as (select video_id, before_end as s, start as e, preroll_end from lined join pre using (video_id) where start > before_end + 0.5 and start > preroll_end)
select video_id, ts from breaks join pre using (video_id) where ts > preroll_end union select video_id, greatest(s, preroll_end) from quiet union select video_id, e from quiet"""))
def break_points(spark, sf_dir):
    said = st.transcript(spark, sf_dir)
    return rc.break_points(st.breaks(spark, sf_dir), wd.silence_periods(said), wd.preroll_end(said, st.videos(spark, sf_dir)))


@query(sql("with {C},{SCORED} select video_id, segment_id, row_number() over (partition by video_id order by engagement_score desc, segment_id)::int as place from scored where quality_score >= 0.6 and d between 20 and 60"))
def gated_segments(spark, sf_dir):
    return rc.gated(scored_clips(spark, sf_dir), 0.6, 20.0, 60.0).select("video_id", "segment_id", "place")


@query(sql("""with {T} select video_id, 0.0 as seg_start, greatest(5.0, duration - 0.1) as seg_end from videos where duration <= 45
union all select video_id, m + i * 30, least(duration - m, m + i * 30 + 60) from (select *, least(10.0, duration * 0.05) as m from videos where duration > 45), unnest(range(0, 10)) t(i) where m + i * 30 + 15 < duration - m"""))
def fallback_windows(spark, sf_dir):
    return rc.fallback_windows(st.videos(spark, sf_dir))


@query(sql("with {C} select video_id, segment_id from clips qualify row_number() over (partition by video_id, round(seg_start, 2), round(seg_end, 2) order by segment_id) = 1"))
def distinct_spans(spark, sf_dir):
    return rc.first_of(clips(spark, sf_dir), [F.round("seg_start", 2), F.round("seg_end", 2)], ["segment_id"]).select("video_id", "segment_id")


@query(sql("with {C} select video_id, segment_id from clips qualify row_number() over (partition by video_id, seg_start order by segment_id) = 1"))
def distinct_starts(spark, sf_dir):
    return rc.first_of(clips(spark, sf_dir), [F.col("seg_start")], ["segment_id"]).select("video_id", "segment_id")


@query(sql("""with l as ({LINEAR}), f as ({FALL}) select video_id, seg_start, seg_end from l union all select video_id, seg_start, seg_end from f where not exists (select 1 from l where l.video_id = f.video_id and l.seg_start = f.seg_start and l.seg_end = f.seg_end)""", LINEAR=SQL["linear_cuts"], FALL=SQL["fallback_windows"]))
def appended_candidates(spark, sf_dir):
    videos = st.videos(spark, sf_dir)
    return rc.appended(cd.linear_cuts(videos).select("video_id", "seg_start", "seg_end"), rc.fallback_windows(videos), ["video_id", "seg_start", "seg_end"])


@query(sql("""with c as (select video_id, seg_start, seg_end, 'quality_driven' as method from ({QUALITY}) union all select video_id, seg_start, seg_end, 'scene_based' from ({PAIRS}))
select method, count(*) as segments, count(distinct video_id) as videos, round(sum(seg_end - seg_start), 3) as seconds, min(seg_end - seg_start) as shortest, max(seg_end - seg_start) as longest from c group by method""", QUALITY=SQL["quality_windows"], PAIRS=SQL["break_pair_candidates"]))
def selection_report(spark, sf_dir):
    videos, columns = st.videos(spark, sf_dir), ["video_id", "seg_start", "seg_end", "method"]
    rows = cd.quality_windows(st.transcript(spark, sf_dir), videos).select(*columns).unionByName(cd.break_pairs(st.breaks(spark, sf_dir), videos).select(*columns))
    return rounded(rc.selection_report(rows), "seconds", places=3)


# Folds

SQL["near_duplicates_merged"] = sql("""with recursive {C},{SCORED}, ordered as (select video_id, segment_id, seg_start, seg_end, quality_score, row_number() over (partition by video_id order by seg_start, seg_end, segment_id) as rn from scored),
f as (
  select *, 1 as g from ordered where rn = 1
  union all
  select video_id, case when take then segment_id else k_id end, case when take then seg_start else k_s end, case when take then seg_end else k_e end, case when take then quality_score else k_q end, rn, g + far::int
  from (select n.*, f.segment_id as k_id, f.seg_start as k_s, f.seg_end as k_e, f.quality_score as k_q, f.g, abs(n.seg_start - f.seg_start) > 5 or abs(n.seg_end - f.seg_end) > 5 as far,
      abs(n.seg_start - f.seg_start) > 5 or abs(n.seg_end - f.seg_end) > 5 or n.quality_score > f.quality_score as take
    from f join ordered n on n.video_id = f.video_id and n.rn = f.rn + 1))
select video_id, segment_id, seg_start, seg_end, quality_score from f qualify row_number() over (partition by video_id, g order by rn desc) = 1""")
SQL["resolved_overlaps"] = sql("""with recursive {C}, ordered as (select video_id, segment_id, seg_start as s, seg_end as e, row_number() over (partition by video_id order by seg_start, seg_end, segment_id) as rn from clips),
f as (
  select *, null::double as closed from ordered where rn = 1
  union all
  select video_id, segment_id, case when split then middle else s end, case when split then greatest(middle, e) else e end, rn, case when split then middle else k_e end
  from (select n.*, f.e as k_e, n.s < f.e as split, (greatest(f.s, n.s) + greatest(greatest(f.s, n.s), least(f.e, n.e))) / 2 as middle from f join ordered n on n.video_id = f.video_id and n.rn = f.rn + 1))
select video_id, segment_id, s as seg_start, coalesce(lead(closed) over (partition by video_id order by rn), e) as seg_end from f""")
SQL["actor_segments"] = sql("""with recursive {APP}, ordered as (select video_id, actor, t::double as t, greatest(0.0, t - 30) as seg_start, greatest(0.0, t - 30) + 60 as seg_end, row_number() over (partition by video_id, actor order by t) as rn from appearances),
f as (
  select *, true as taken, seg_end as stop from ordered where rn = 1
  union all
  select n.*, n.seg_start >= f.stop, case when n.seg_start >= f.stop then n.seg_end else f.stop end from f join ordered n on n.video_id = f.video_id and n.actor = f.actor and n.rn = f.rn + 1)
select video_id, actor, t, seg_start, seg_end from f where taken""")
SQL["greedy_top_n"] = sql("""with recursive {C},{SCORED}, ordered as (select video_id, segment_id, seg_start, seg_end, quality_score, row_number() over (partition by video_id order by quality_score desc, seg_start, seg_end, segment_id) as rn from scored),
f(video_id, rn, segment_id, kept, taken) as (
  select distinct video_id, 0::bigint, 0::bigint, []::double[][], false from ordered
  union all
  select video_id, rn, segment_id, case when take then list_append(kept, [seg_start, seg_end]) else kept end, take
  from (select n.*, f.kept, len(f.kept) < 3 and len(list_filter(f.kept, lambda k: n.seg_start < k[2] and k[1] < n.seg_end)) = 0 as take from f join ordered n on n.video_id = f.video_id and n.rn = f.rn + 1))
select o.video_id, o.segment_id, o.seg_start, o.seg_end, o.quality_score from f join ordered o using (video_id, rn) where taken""")
SQL["nms_subjects"] = sql("""with recursive {DET},{DAILY}, ordered as (select video_id, day, det_id, x1, y1, x2, y2, row_number() over (partition by video_id, day order by confidence desc, det_id) as rn from daily),
f(video_id, day, rn, det_id, kept, taken) as (
  select distinct video_id, day, 0::bigint, 0::bigint, []::double[][], false from ordered
  union all
  select video_id, day, rn, det_id, case when take then list_append(kept, [x1, y1, x2, y2]::double[]) else kept end, take
  from (select n.*, f.kept, len(list_filter(f.kept, lambda k: least(n.x2, k[3]) > greatest(n.x1, k[1]) and least(n.y2, k[4]) > greatest(n.y1, k[2])
      and (least(n.x2, k[3]) - greatest(n.x1, k[1])) * (least(n.y2, k[4]) - greatest(n.y1, k[2])) / ((n.x2 - n.x1) * (n.y2 - n.y1) + (k[3] - k[1]) * (k[4] - k[2]) - (least(n.x2, k[3]) - greatest(n.x1, k[1])) * (least(n.y2, k[4]) - greatest(n.y1, k[2]))) > 0.1)) = 0 as take
    from f join ordered n on n.video_id = f.video_id and n.day = f.day and n.rn = f.rn + 1))
select video_id, day, det_id from f where taken""")


# Seen and said

SEEN = """{DET},{DAYS}, v as (select d.video_id, segment_id, count(distinct case when det_id % 3 = 0 then det_id % 5 end) as face_count, avg(case when det_id % 3 = 1 then confidence end) as m, count(*) filter (det_id % 3 = 2) as scene_changes
  from days d left join detections t on t.video_id = d.video_id and t.ts between seg_start and seg_end group by all),
seen as (select video_id, segment_id, face_count, scene_changes, face_count > 0 as has_faces, case when m > 0.7 then 'high' when m > 0.3 then 'medium' else 'low' end as motion_level from v)"""
LOOK = "least(1.0, case when has_faces then 0.3 else 0.0 end + case motion_level when 'medium' then 0.3 when 'high' then 0.25 else 0.2 end + case when scene_changes <= 2 then 0.2 when scene_changes <= 5 then 0.1 else 0.0 end + case when face_count >= 2 then 0.1 else 0.0 end)"


@query(sql("with {SEEN} select *, round({LOOK}, 4) as visual_quality from seen", SEEN=sql(SEEN), LOOK=sql(LOOK)))
def visual_content(spark, sf_dir):
    d = F.col("det_id")
    seen = st.detections(spark, sf_dir).select("video_id", d.alias("pos"), "ts", F.when(d % 3 == 0, d % 5).alias("face_id"), F.when(d % 3 == 1, F.col("confidence")).alias("motion"), (d % 3 == 2).alias("is_change"))
    return rounded(rc.visual_content(days(spark, sf_dir), seen, width=86_400.0), "visual_quality")


@query(sql("""with {C}, s as (select video_id, segment_id, text, {N} as n, seg_end - seg_start as d, {ENGAGING} as engaging, {ASK} as questions, {FELT} as emotional, segment_id % 2 = 0 as has_faces, segment_id % 3 as face_count, segment_id % 7 as scene_changes, ['low', 'medium', 'high'][(segment_id % 3 + 1)::int] as motion_level from clip_texts),
r as (select *, {LOOK} as visual_quality, n / (d / 60) as rate from s)
select video_id, segment_id, round(least(1.0, case when n > 0 then 0.8 * 0.4 + case when rate between 120 and 180 then 0.3 when rate between 100 and 200 then 0.2 else 0.1 end + case when engaging > 0 then 0.2 else 0.0 end + case when questions > 0 then 0.1 else 0.0 end else 0.0 end * 0.25 + visual_quality * 0.25
  + (case when emotional > 0 then 0.3 else 0.0 end + case when has_faces then 0.3 else 0.0 end + case when motion_level <> 'low' then 0.2 else 0.0 end + case when questions > 0 then 0.2 else 0.0 end) * 0.3 + (0.5 + case when d between 20 and 45 then 0.3 when d between 15 and 60 then 0.2 else 0.0 end + case when n > 10 then 0.2 else 0.0 end) * 0.2), 4) as quality,
  round(least(1.0, least({ENERGY} * 0.1, 0.3) + least(questions * 0.1, 0.2) + least(emotional * 0.05, 0.2) + case when has_faces then 0.15 else 0.0 end + case motion_level when 'high' then 0.1 when 'medium' then 0.05 else 0.0 end + case when face_count >= 2 then 0.1 else 0.0 end + case when {PHRASES} then 0.15 else 0.0 end), 4) as engagement from r""",
    N=n_words("text"), ENGAGING=hits("text", lx.TEXT_ENGAGEMENT), ASK=count("text", "?"), FELT=hits("text", lx.EMOTION["high"]), LOOK=sql(LOOK), ENERGY=hits("text", rc.ENERGY), PHRASES=any_of("text", rc.PHRASES)))
def segment_scores(spark, sf_dir):
    text, k = F.col("text"), F.col("segment_id")
    levels = F.array(*[F.lit(x) for x in ("low", "medium", "high")])
    rows = clip_texts(spark, sf_dir).select(
        "video_id", "segment_id", "text", tx.n_words(text).alias("n_words"), (F.col("seg_end") - F.col("seg_start")).alias("duration"), tx.hits(text, lx.TEXT_ENGAGEMENT).alias("engaging"), tx.occurrences(text, "?").alias("questions"),
        tx.hits(text, lx.EMOTION["high"]).alias("emotional"), (k % 2 == 0).alias("has_faces"), (k % 3).alias("face_count"), (k % 7).alias("scene_changes"), F.element_at(levels, (k % 3 + 1).cast("int")).alias("motion_level"), F.lit(0.8).alias("clarity"),
    )
    rows = rows.withColumn("visual_quality", rc.visual_quality())
    return rounded(rows.select("video_id", "segment_id", rc.segment_quality().alias("quality"), rc.segment_engagement().alias("engagement")), "quality", "engagement")


@query(sql("""with {C}, s as (select *, ['demonstration', 'slides', 'talking_head', 'action'][(segment_id % 4 + 1)::int] as scene_type, segment_id % 2 = 0 as has_people, segment_id % 3 = 0 as has_action, segment_id % 5 = 0 as has_emotion, segment_id % 11 as interest, segment_id % 10 as engagement from clip_texts),
a as (select *, case when text = '' then 0.3 else greatest(0.0, least(1.0, 0.5 + case when has_action and {SHOWN} then 0.2 else 0.0 end + case when has_people and {PERSONAL} then 0.2 else 0.0 end + case when scene_type = 'demonstration' and {STEPS} then 0.2 else 0.0 end - case when scene_type = 'slides' and {PERSONAL} then 0.1 else 0.0 end)) end as al,
  case when text = '' then 0.0 else least(1.0, least({PULL} * 0.1, 0.3) + least({ASK} * 0.1, 0.2) + least({CRY} * 0.05, 0.1) + case when {DIRECT} then 0.2 else 0.0 end) end as pull, (interest + engagement) / 2.0 as visual, {N} > 5 as said from s),
c as (select *, round((visual * 0.6 + pull * 5 * 0.4) * al, 6) as score from a)
select video_id, segment_id, round(al, 4) as alignment, case when score >= 8 and said then 'highly_recommended' when score >= 6 and said then 'recommended' when score >= 4 or (visual >= 6 and not said) then 'consider' else 'not_recommended' end as recommendation,
  case when interest >= 7 and engagement >= 7 then case when has_emotion or has_action then 'excellent_for_shorts' else 'good_for_shorts' end when interest >= 5 and engagement >= 5 then case when scene_type in ('talking_head', 'demonstration') and has_people then 'suitable_for_shorts' else 'consider_for_shorts' end
    when scene_type = 'slides' or not has_people then 'poor_for_shorts' else 'marginal_for_shorts' end as visual_recommendation from c""",
    SHOWN=any_of("text", rc.SHOWN), PERSONAL=any_of("text", rc.PERSONAL), STEPS=any_of("text", rc.STEPS), PULL=hits("text", rc.TEXT_PULL), ASK=count("text", "?"), CRY=count("text", "!"), DIRECT=any_of("text", lx.DIRECT_ADDRESS), N=n_words("text")))
def audiovisual_alignment(spark, sf_dir):
    k = F.col("segment_id")
    kinds = F.array(*[F.lit(x) for x in ("demonstration", "slides", "talking_head", "action")])
    rows = clip_texts(spark, sf_dir).withColumns({
        "scene_type": F.element_at(kinds, (k % 4 + 1).cast("int")), "has_people": k % 2 == 0, "has_action": k % 3 == 0, "has_emotion": k % 5 == 0, "visual_interest": k % 11, "engagement": k % 10,
    })
    rows = rows.withColumn("alignment", rc.alignment()).withColumn("recommendation", rc.recommendation(F.col("alignment"))).withColumn("visual_recommendation", rc.visual_recommendation())
    return rounded(rows.select("video_id", "segment_id", "alignment", "recommendation", "visual_recommendation"), "alignment")


@query(sql("""with {C},{SCORED}, seen as (select video_id, seg_idx as pos, start + seg_idx % 5 - 2 as start, n_words % 11 / 10.0 as visual_score, seg_idx % 3 as people, ['action', 'talking_head', 'demonstration', 'unknown'][(seg_idx % 4 + 1)::int] as scene_type from transcript),
first as (select s.video_id, s.segment_id, min(v.pos) as pos from scored s join seen v on v.video_id = s.video_id and abs(v.start - s.seg_start) < 5 group by all)
select s.video_id, s.segment_id, f.pos as vision_pos, v.scene_type, v.people > 0 as people_visible, round(case when v.pos is not null then least(1.0, (s.engagement_score * 0.6 + v.visual_score * 0.4) * (1 + v.pos % 10 / 10.0 * 0.2)) end, 4) as combined
from scored s left join first f using (video_id, segment_id) left join seen v on v.video_id = f.video_id and v.pos = f.pos"""))
def dual_modal(spark, sf_dir):
    vision = st.vision_segments(spark, sf_dir).withColumn("alignment", F.col("pos") % 10 / 10.0)
    found = rc.with_first_vision(scored_clips(spark, sf_dir).withColumn("audio_score", F.col("engagement_score")), vision)
    return rounded(found.select("video_id", "segment_id", "vision_pos", "scene_type", "people_visible", "combined"), "combined")


# Scenes


def typed(spark, sf_dir):
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("det_id") % n + 1).cast("int"))
    return daily(spark, sf_dir).withColumn("type", pick(("face", "person", "object"), 3)).withColumn("class_name", pick(("person", "car", "dog", "elephant", "kite"), 5))


PRIORITY = "case thing " + " ".join(f"when {q(k)} then {v}" for k, v in sc.PRIORITIES.items()) + " else 0.3 end"


@query(sql("with {DET},{TYPED} select video_id, det_id, {P} as priority, row_number() over (partition by video_id order by {P} desc, confidence desc, det_id)::int as place from typed where confidence >= case type when 'face' then 0.55 when 'person' then 0.6 else 0.5 end", P=sql(PRIORITY)))
def prioritised_subjects(spark, sf_dir):
    return sc.prioritised(typed(spark, sf_dir), ["video_id"]).select("video_id", "det_id", "priority", "place")


@query(sql("with {DET},{TYPED}, w as (select *, floor(ts / 86400.0)::bigint as day, case type when 'face' then 1 when 'person' then 0.8 else 0.3 end::decimal(6,2) as w from typed) select video_id, day, round(least(1.0, sum(confidence::decimal(18,9) * w)::double / sum(w)::double)::decimal(20,12), 6)::double as confidence from w group by all"))
def type_confidence(spark, sf_dir):
    found = sc.weighted_confidence(typed(spark, sf_dir), ["video_id", "day"])
    return found.withColumn("confidence", F.round(F.col("confidence").cast("decimal(20,12)"), 6).cast("double"))


@query(sql("with {DET},{DAILY} select video_id, day, round(avg(confidence), 9) as confidence, round(avg(relevance), 9) as relevance, round(avg(confidence) * avg(relevance), 9) as focus from daily group by all"))
def decision_confidence(spark, sf_dir):
    return rounded(sc.decision_confidence(daily(spark, sf_dir), ["video_id", "day"]), "confidence", "relevance", "focus", places=9)


COMPOSED = """{DET},{DAILY}, b as (select *, (x1 + x2) / 2.0 as mx, (y1 + y2) / 2.0 as my, (x2 - x1) * (y2 - y1) / 2073600.0 as share, least(x1, y1, 1920 - x2, 1080 - y2) as edge from daily),
c as (select video_id, day, avg(((1 - least(1.0, least(abs(mx - 640), abs(mx - 1280)) / 320)) + (1 - least(1.0, least(abs(my - 360), abs(my - 720)) / 180))) * 0.3 + case when share between 0.1 and 0.6 then 1.0 else greatest(0.2, 1 - abs(share - 0.35) / 0.35) end * 0.7) as composition,
  least(1.0, sum(case when det_id % 2 = 0 then (x2 - x1) * (y2 - y1) else 0 end) / 2073600.0) as face_ratio,
  avg(greatest(case when edge < 10 then 1.0 else greatest(0.0, 1 - edge / 50.0) end, case when share < 0.05 then 1.0 else 0.0 end, case when mx < 192 or mx > 1728 then 0.5 else 0.0 end + case when my < 108 or my > 972 then 0.5 else 0.0 end)) as risk from b group by all)"""


@query(sql("""with {COMPOSED} select video_id, day, round(composition, 9) as composition, round(face_ratio, 9) as face_ratio, round(risk, 9) as risk, round(least(1.0, composition * 0.3 + face_ratio * 0.4 + (1 - risk) * 0.3), 9) as frame_score,
  array_to_string(list_filter([case when face_ratio < 0.1 then 'low_face_visibility' end, case when risk > 0.3 then 'awkward_crop_risk' end, case when composition < 0.5 then 'poor_composition' end, case when composition * 5 > 2.5 then 'high_zoom_level' end], lambda x: x is not null), ',') as flags from c""", COMPOSED=sql(COMPOSED)))
def frame_composition(spark, sf_dir):
    found = sc.frame_composition(daily(spark, sf_dir).withColumn("is_face", F.col("det_id") % 2 == 0), ["video_id", "day"])
    flagged = sc.quality_flags(found.withColumn("zoom", F.col("composition") * 5).withColumn("subjects", F.lit(1)))
    flagged = flagged.withColumn("flags", F.array_join("flags", ",")).drop("zoom", "subjects")
    return rounded(flagged, "composition", "face_ratio", "risk", "frame_score", places=9)


@query(sql("""with {DET}, f as (select *, (x2 - x1) * (y2 - y1)::double as area, greatest(0, least(x2, 1920) - greatest(x1, 0)) * greatest(0, least(y2, 1080) - greatest(y1, 0))::double as shown from detections),
v as (select *, shown / area * case when area / 2073600 between 0.15 and 0.8 then 1.0 when area / 2073600 < 0.15 then area / 2073600 / 0.15 else 0.8 / (area / 2073600) end as visibility from f)
select det_id, round(visibility, 6) as visibility, round(least(1.0, [1.0, 0.7, 0.2, 0.3][(det_id % 4 + 1)::int] * confidence * 0.6 + visibility * 0.4), 6) as face_priority from v"""))
def face_priorities(spark, sf_dir):
    turns = F.array(*[F.lit(x) for x in ("frontal", "profile", "back", "unknown")])
    rows = st.detections(spark, sf_dir).withColumn("orientation", F.element_at(turns, (F.col("det_id") % 4 + 1).cast("int")))
    return rounded(sc.face_priority(rows).select("det_id", "visibility", "face_priority"), "visibility", "face_priority", places=6)


@query(sql("""with {DET}, c as (select *, floor((x1 + x2) / 2.0)::bigint as centre_x, floor((y1 + y2) / 2.0)::bigint as centre_y from detections)
select det_id, centre_x, centre_y, (x2 - x1) * (y2 - y1) as area, greatest(0, x1 - 50) as pad_x1, greatest(0, y1 - 50) as pad_y1, least(1920, x2 + 50) as pad_x2, least(1080, y2 + 50) as pad_y2, greatest(0, centre_x - 303) as crop_x1, greatest(0, centre_y - 540) as crop_y1,
  least(1920, greatest(0, centre_x - 303) + 607) as crop_x2, least(1080, greatest(0, centre_y - 540) + 1080) as crop_y2 from c"""))
def crop_regions(spark, sf_dir):
    names = ["centre_x", "centre_y", "area", "pad_x1", "pad_y1", "pad_x2", "pad_y2", "crop_x1", "crop_y1", "crop_x2", "crop_y2"]
    return sc.padded_crops(st.detections(spark, sf_dir)).select("det_id", *names)


@query(sql("""with {DET}, daily as (select *, floor(ts / 86400.0)::bigint as day, floor(ts / 86400.0)::bigint % 3 <> 0 as speaking from detections), f as (select video_id, day, det_id, round(confidence / (1.0 + abs((x1 + x2) / 2.0 / 1920 - 0.5) + abs((y1 + y2) / 2.0 / 1080 - 0.4)), 9) as s from daily where speaking)
select video_id, day, det_id, s as speaker_score from f where s > 0 qualify row_number() over (partition by video_id, day order by s desc, det_id) = 1"""))
def active_speakers(spark, sf_dir):
    faces = daily(spark, sf_dir).withColumn("speaking", F.col("day") % 3 != 0)
    return sc.active_speakers(faces, ["video_id", "day"])


@query(sql("""with {DET},{DAILY},{CROPS}, h as (select video_id, day, x1, y1, objects, list({'x': x1, 'y': y1, 'z': objects / 10.0}) over (partition by video_id order by day rows between 5 preceding and 1 preceding) as h from crops)
select video_id, day as ts, round(case when h is null or len(h) = 0 then 1.0 else (greatest(0.0, 1 - list_avg(list_transform(h, lambda p: (abs(x1 - p.x) + abs(y1 - p.y))::double)) / 100) + greatest(0.0, 1 - list_avg(list_transform(h, lambda p: abs(objects / 10.0 - p.z))) / 0.5)) / 2 end, 5) as stability from h"""))
def framing_stability(spark, sf_dir):
    crops = tk.weighted_crops(daily(spark, sf_dir), "day").select("video_id", F.col("day").alias("ts"), F.col("x1").alias("crop_x"), F.col("y1").alias("crop_y"), (F.col("objects") / 10.0).alias("zoom"))
    return rounded(sc.stability(crops).select("video_id", "ts", "stability"), "stability", places=5)


@query(sql("""with {DET},{DAILY}, p as (select video_id, day, count(*) filter (relevance >= 0.5) as objects from daily group by all), m as (select *, day - row_number() over (partition by video_id order by day) as run from p where objects > 0)
select video_id, min(day) as first_frame, max(day) as last_frame, count(*) as frames, arg_max(objects, day) as objects from m group by video_id, run"""))
def presence_runs(spark, sf_dir):
    frames = daily(spark, sf_dir).groupBy("video_id", F.col("day").alias("frame_no")).agg(F.count_if(F.col("relevance") >= 0.5).alias("objects"))
    return sc.presence_runs(frames)


@query(sql("""with {FEAT}, m as (select *, motion > 1.5 * avg(motion) over (partition by video_id) as high, coalesce(lead(ts) over w, ts) as next_ts from features window w as (partition by video_id order by frame_no)),
r as (select *, row_number() over w - sum(high::int) over w as run from m window w as (partition by video_id order by frame_no))
select video_id, min(ts) as run_start, max(next_ts) as run_end from r where high group by video_id, run having max(next_ts) - min(ts) >= 4"""))
def speech_runs(spark, sf_dir):
    return sc.speech_runs(st.frame_features(spark, sf_dir), "motion", 1.5, 4.0)


@query(sql("""with {DET},{DAYS}, f as (select video_id, det_id, ts::double as ts from detections), m as (select f.*, segment_id, seg_start, seg_end, ts between seg_start and seg_end as inside, row_number() over (partition by det_id order by (ts between seg_start and seg_end) desc, abs(ts - seg_start), seg_start) as r from f join days using (video_id))
select video_id, ts, segment_id as decision_id, inside from m where r = 1"""))
def decision_lookup(spark, sf_dir):
    decisions = days(spark, sf_dir).select("video_id", F.col("segment_id").alias("decision_id"), F.col("seg_start").alias("start"), F.col("seg_end").alias("stop"))
    return sc.decisions_at(st.detections(spark, sf_dir), decisions)


@query(sql("with {FEAT} select video_id, floor(ts / 60)::bigint as minute, frame_no, motion as score from features qualify row_number() over (partition by video_id, floor(ts / 60) order by motion desc, frame_no) = 1"))
def best_frames(spark, sf_dir):
    return sc.best_frames(st.frame_features(spark, sf_dir).withColumn("minute", F.floor(F.col("ts") / 60)), ["video_id", "minute"], "motion")


@query(sql("""with {FEAT}, r as (select *, floor(ts / 60)::bigint as minute, row_number() over w - 1 as i, count(*) over (partition by video_id, floor(ts / 60)) as n from features window w as (partition by video_id, floor(ts / 60) order by frame_no))
select video_id, minute, frame_no from r where n <= 3 or (n < 4 and i < 4) or (n >= 4 and (i = 0 or i = n - 1 or i = least(n // 3, n - 1) or i = least(2 * (n // 3), n - 1)))"""))
def representative_frames(spark, sf_dir):
    frames = st.frame_features(spark, sf_dir).withColumn("minute", F.floor(F.col("ts") / 60))
    return sc.representative_frames(frames, ["video_id", "minute"], 40.0).select("video_id", "minute", "frame_no")


@query(sql("""with {FEAT}, t as (select * from features qualify row_number() over (partition by video_id order by complexity desc, frame_no) <= 5), a as (select video_id, count(*) as frames, avg(complexity) as quality from t group by all)
select video_id, frames, round(quality, 6) as quality, round(least(10.0, greatest(1.0, quality * 10)), 5) as interest, case when quality * 10 >= 7 then 'good' when quality * 10 >= 5 then 'fair' else 'poor' end as assessment, quality > 0.6 as suitable from a"""))
def quick_assessment(spark, sf_dir):
    return rounded(rounded(sc.quick_assessment(st.frame_features(spark, sf_dir), "complexity"), "interest", places=5), "quality", places=6)


@query(sql("""with {DET}, t as (select video_id, class_name as kind, floor(cx / 100.0) as a, floor(cy / 100.0) as b, count(*) as n from detections group by all) select video_id, kind, count(*) as tracks, count(*) filter (n < 2) as active from t group by all"""))
def track_counts(spark, sf_dir):
    cell = [F.floor(F.col("cx") / 100).alias("a"), F.floor(F.col("cy") / 100).alias("b")]
    tracks = st.detections(spark, sf_dir).groupBy("video_id", F.col("class_name").alias("kind"), *cell).agg(F.count("*").alias("detections"))
    return sc.track_counts(tracks, 2)


@query(sql("""with {DET}, r as (select * from detections qualify row_number() over (partition by video_id, class_name order by ts desc, det_id desc) <= 4)
select video_id, class_name, string_agg(det_id::varchar, ',' order by ts, det_id) as boxes, round(avg(confidence), 6) as confidence from r group by all"""))
def recent_boxes(spark, sf_dir):
    found = sc.recent_boxes(st.detections(spark, sf_dir), "class_name", 4)
    ids = F.array_join(F.transform("boxes", lambda b: b["det_id"].cast("string")), ",")
    mean = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size("boxes")
    return rounded(found.select("video_id", "class_name", ids.alias("boxes"), mean.alias("confidence")), "confidence", places=6)


@query(sql("""with {APP}, a as (select distinct video_id, upper(actor) as asked from appearances union all select distinct video_id, 'NOBODY' from appearances)
select a.video_id, asked, count(p.t) as appearances, count(p.t) > 0 as found from a left join appearances p on p.video_id = a.video_id and lower(p.actor) = lower(asked) group by all"""))
def actor_requests(spark, sf_dir):
    seen = st.appearances(spark, sf_dir)
    wanted = seen.select("video_id", F.upper("actor").alias("asked")).distinct().unionByName(seen.select("video_id", F.lit("NOBODY").alias("asked")).distinct())
    return sc.actor_requests(wanted, seen)


# Texts, files and records


@query(sql("""with w as (select doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') as ws from documents)
select doc_id, round(case when len(ws) = 0 then 0.0 else least(1.0, (len(list_filter(ws, lambda x: x in ({EMPH}))) + len(list_filter(ws, lambda x: upper(x) = x and lower(x) <> x)))::double / len(ws) + ({ASK} + {CRY})::double / length(text)) end, 6) as emphasis from w""", EMPH=", ".join(map(q, lx.EMPHASIS_TOKENS)), ASK=count("text", "?"), CRY=count("text", "!")))
def emphasis_levels(spark, sf_dir):
    return rounded(st.table(spark, sf_dir, "documents").select("doc_id", tt.emphasis_level(F.coalesce("text", F.lit(""))).alias("emphasis")), "emphasis", places=6)


NAMED = ["how_to.mp4", "Funny_cats.mp4", "clip.mp4", "LESSON.mov", "talk.mkv"]


@query()
def video_kinds(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in NAMED]), (F.col("doc_id") % 5 + 1).cast("int"))
    return st.table(spark, sf_dir, "documents").select("doc_id", tt.video_kind(name, F.col("text")).alias("kind"))


SQL["video_kinds"] = f"""with n as (select doc_id, text, [{', '.join(map(q, NAMED))}][(doc_id % 5 + 1)::int] as name from documents),
c as (select *, {hits('text', tt.KIND_WORDS['educational'])} as taught, {hits('text', tt.KIND_WORDS['entertainment'])} as fun from n)
select doc_id, case when {any_of('name', tt.NAMES['educational'])} then 'educational' when {any_of('name', tt.NAMES['entertainment'])} then 'entertainment' when taught > fun and taught > 2 then 'educational' when fun > 2 then 'entertainment' else 'social_media' end as kind from c"""


@query("select p_partkey, upper(p_name) as shouted, lower(p_name) as small, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) as capital from part")
def text_transforms(spark, sf_dir):
    name = F.col("p_name")
    return st.table(spark, sf_dir, "part").select("p_partkey", tt.text_transform(name, "uppercase").alias("shouted"), tt.text_transform(name, "lowercase").alias("small"), tt.text_transform(name, "capitalize").alias("capital"))


@query(sql("with {FEAT}, t as (select *, floor(ts * 100)::bigint as s from features) select video_id, frame_no, (frame_no - 1) / 25.0 as seconds, lpad((s // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as clock from t"))
def time_codes(spark, sf_dir):
    return st.frame_features(spark, sf_dir).select("video_id", "frame_no", tt.frame_seconds(F.col("frame_no"), F.lit(25.0)).alias("seconds"), tt.clock(F.col("ts") * 100).alias("clock"))


@query(sql("""with d as (select doc_id, {EMOTION} as emotion, {ASK} as asks, {URGENT} as urgent, {VIRAL} as viral, doc_id % 2 = 0 as faces, doc_id % 3 = 0 as still, doc_id % 60 as dur from documents)
select doc_id, array_to_string(list_filter([case when emotion > 0.7 then 'Add dynamic cuts during emotional peaks' end, case when asks > 0 then 'Pause briefly after questions for impact' end, 'Ensure clear speech throughout', case when urgent > 0 then 'Consider faster pacing for urgency' end, case when faces then 'Ensure faces are clearly visible' end,
  case when still then 'Consider adding motion or zoom effects' end, case when dur > 45 then 'Consider faster pacing or cutting content' when dur < 20 then 'Could expand with additional context' end, case when viral = 0 then 'Consider adding hook words or phrases' end, case when asks = 0 then 'Add rhetorical questions to engage viewers' end], lambda x: x is not null), '; ') as notes from d""",
    EMOTION=o.EMOTION, ASK=count("coalesce(text, '')", "?"), URGENT=hits("text", lx.URGENCY), VIRAL=hits("text", lx.VIRAL)))
def technical_notes(spark, sf_dir):
    docs, text = tx.prepared(st.table(spark, sf_dir, "documents").select("doc_id", "text"))
    k = F.col("doc_id")
    notes = tt.technical_notes(tx.emotional_intensity(text), tx.occurrences(F.coalesce("text", F.lit("")), "?"), tx.hits(text, lx.URGENCY), tx.hits(text, lx.VIRAL), k % 2 == 0, F.when(k % 3 == 0, "low").otherwise("high"), k % 60)
    found = docs.select("doc_id", notes.alias("n"))
    parts = ["recommended_edits", "audio_recommendations", "visual_recommendations", "pacing_notes", "engagement_tips"]
    return found.select("doc_id", F.array_join(F.concat(*[F.col(f"n.{p}") for p in parts]), "; ").alias("notes"))


@query("select md5(text) as hash, count(*) as files, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1")
def duplicate_contents(spark, sf_dir):
    return dc.duplicates(st.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))).withColumnRenamed("first", "first_id")


@query("select n_nationkey, json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey)::varchar as record from nation")
def json_records(spark, sf_dir):
    rows = st.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return rows.select("n_nationkey", dc.json_record(*rows.columns).alias("record"))


@query("""with r as (select o_orderkey as k, case when k % 11 <> 0 then 'v' || k end as v, case when k % 22 = 0 then 'up' || k end as u, case when k % 13 = 0 then 'square' when k % 3 = 0 then 'shorts' else 'clips' end as canvas, case when k % 19 = 0 then '9x16' when k % 7 = 0 then null else '9:16' end as ratio from orders)
select k as request_id, coalesce(v, u) as media_id, case when regexp_matches(ratio, '^[0-9]+:[0-9]+$') then 9 when canvas = 'shorts' then 9 else 16 end as ratio_w, case when regexp_matches(ratio, '^[0-9]+:[0-9]+$') then 16 when canvas = 'shorts' then 16 else 9 end as ratio_h, k % 2 = 0 and k % 5 <> 0 as kinetic from r""")
def request_fields(spark, sf_dir):
    k = F.col("request_id")
    rows = st.requests(spark, sf_dir).withColumn("subtitle_overlay", k % 2 == 0).withColumn("external_srt_url", F.when(k % 5 == 0, "http://srt"))
    return rq.derived(rows).select("request_id", "media_id", "ratio_w", "ratio_h", "kinetic")


@query(sql("with {FILES} select count(*) as files, sum(size)::bigint as bytes, round(count(*) filter (mtime % 7200 = 0) / count(*)::double, 6) as hit_rate from files"))
def cache_stats(spark, sf_dir):
    return rounded(dc.cache_stats(st.files(spark, sf_dir).withColumn("hit", F.col("mtime") % 7200 == 0)), "hit_rate", places=6)


@query(sql("with {T} select video_id, array_to_string(list_filter([case when duration < 100 then 'too_short' end], lambda x: x is not null), ',') as issues from videos"))
def video_issues(spark, sf_dir):
    return rs.video_issues(st.videos(spark, sf_dir), shortest=100.0).select("video_id", F.array_join("issues", ",").alias("issues"))


@query("""select p_partkey as clip_id, json_object('clip_id', p_partkey, 'video_id', p_partkey % 7, 'key', p_type, 'thumbnail', p_brand, 'ai_title', substr(p_name, 1, 100), 'ai_description', substr(p_type, 1, 500), 'tags', [p_brand, p_type], 'duration', round(p_size / 8.0::double, 2))::varchar as record from part""")
def clip_records(spark, sf_dir):
    rows = st.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("clip_id"), (F.col("p_partkey") % 7).alias("video_id"), F.col("p_type").alias("key"), F.col("p_brand").alias("thumbnail"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.array("p_brand", "p_type").alias("tags"), (F.col("p_size") / 8.0).alias("duration")
    )
    return dc.clip_records(rows)


@query(sql("with {C} select video_id, segment_id, (seg_start + seg_end) / 2 / duration > 0.92 or {CRED} >= 2 as credits from clip_texts join videos using (video_id)", CRED=hits("text", lx.CREDITS)))
def credits_clips(spark, sf_dir):
    rows = clip_texts(spark, sf_dir).join(st.videos(spark, sf_dir).select("video_id", "duration"), "video_id")
    return rows.select("video_id", "segment_id", sl.is_credits(rows).alias("credits"))


@query(sql("with {FEAT} select video_id, frame_no, (floor(x / 3600))::bigint || ':' || lpad((floor(x / 60) % 60)::bigint::varchar, 2, '0') || ':' || lpad(printf('%.2f', x - floor(x / 60) * 60), 5, '0') as ass from (select *, ts * 37.25 as x from features)"))
def ass_times(spark, sf_dir):
    return st.frame_features(spark, sf_dir).select("video_id", "frame_no", su.ass_time(F.col("ts") * 37.25).alias("ass"))


@query(sql("""with {DET},{DAYS} select det_id, min(segment_id) as segment_id from detections d join days s on s.video_id = d.video_id and ts between seg_start and seg_end group by det_id"""))
def first_spans(spark, sf_dir):
    points = st.detections(spark, sf_dir).select("video_id", "det_id", F.col("ts").cast("double").alias("ts"))
    spans = days(spark, sf_dir).select("video_id", F.col("seg_start").alias("span_start"), F.col("seg_end").alias("span_end"), "segment_id")
    return iv.first_containing(points, spans, ["video_id", "det_id"], width=86_400.0).select("det_id", "segment_id")


@query(sql("""with {C}, l as ({LINEAR}) select video_id, segment_id from clips c where not exists (select 1 from l where l.video_id = c.video_id and l.part = 1 and (least(c.seg_end, l.seg_end) - greatest(c.seg_start, l.seg_start)) / (c.seg_end - c.seg_start) > 0.3)""", LINEAR=SQL["linear_cuts"]))
def free_candidates(spark, sf_dir):
    taken = cd.linear_cuts(st.videos(spark, sf_dir)).where("part = 1")
    return iv.without_overlapping(clips(spark, sf_dir), taken).select("video_id", "segment_id")


@query(sql("with {HOURS}, g as (select video_id, seg_end as gap_start, lead(seg_start) over (partition by video_id order by seg_start, seg_end) as gap_end from hours) select * from g where gap_end - gap_start > 5"))
def segment_gaps(spark, sf_dir):
    return iv.gaps_between(hours(spark, sf_dir))


@query(sql("with {APP} select video_id, actor, t, greatest(0.0, t - d / 2.0) as seg_start, greatest(0.0, t - d / 2.0) + d as seg_end from appearances, unnest([60, 120]) x(d)"))
def actor_windows(spark, sf_dir):
    return cd.actor_windows(st.appearances(spark, sf_dir)).select("video_id", "actor", "t", "seg_start", "seg_end")


@query(sql("""with {C}, s as (select *, case when seg_end - seg_start < 15 then [0.25, 0.75] when seg_end - seg_start < 45 then [0.2, 0.5, 0.8] else [0.15, 0.4, 0.6, 0.85] end as shares from clips)
select video_id, segment_id, i::int as i, round(seg_start + shares[i + 1] * (seg_end - seg_start), 4) as ts from s, unnest(range(0, len(shares))) t(i)"""))
def representative_times(spark, sf_dir):
    return rounded(cd.representative_times(clips(spark, sf_dir)), "ts")


@query(sql("with {C}, n as (select v.video_id, count(c.video_id) as n from videos v left join clips c using (video_id) group by all) select count(*) as videos, count(*) filter (n = 0) as without_segments, sum(n)::bigint as segments, round(avg(n), 5) as segments_per_video from n"))
def run_summary(spark, sf_dir):
    return rounded(rs.run_summary(clips(spark, sf_dir), st.videos(spark, sf_dir)), "segments_per_video", places=5)


@query(sql("""with {DET},{DAYS}, s as (select d.video_id, segment_id, coalesce(avg(relevance), 0) as r, coalesce(avg(confidence), 0) as c, count(det_id) as n, count(distinct class_name) as k from days d left join detections t on t.video_id = d.video_id and ts between seg_start and seg_end group by all)
select video_id, segment_id, round(least(1.0, segment_id % 10 / 10.0 * 0.4 + (r * 0.3 + c * 0.2 + 0.5 * 0.4) * 0.6 + least(0.2, n * 0.05 + k * 0.1)), 6) as live,
  round(least(1.0, segment_id % 10 / 10.0 * 0.25 + (r * 0.3 + c * 0.2 + 0.5 * 0.4) * 0.4 + 0.5 * 0.25 + case when segment_id % 4 = 0 then 0.8 else 0.0 end + least(0.1, n * 0.03 + k * 0.05)), 6) as referenced from s"""))
def combined_scores(spark, sf_dir):
    k = F.col("segment_id")
    rows = iv.object_scores(days(spark, sf_dir), st.detections(spark, sf_dir)).withColumns({"prompt_match_score": k % 10 / 10.0, "object_prompt_match": F.lit(0.5), "presence": F.lit(0.5), "reference_score": (k % 4 == 0).cast("double")})
    return rounded(rows.select("video_id", "segment_id", sl.combined_score().alias("live"), sl.combined_score("references").alias("referenced")), "live", "referenced", places=6)


@query(sql("""with {FEAT} select video_id, frame_no, round(greatest(0.0, least(1.0, (1 - abs(frame_no % 256 / 255.0 - 0.5) * 2) * 0.25 + least(1.0, motion / 100) * 0.25 + least(1.0, frame_no * 10 / 1000.0) * 0.3 + complexity * 0.2)), 6) as quality from features"""))
def frame_quality(spark, sf_dir):
    rows = st.frame_features(spark, sf_dir).withColumns({"brightness": (F.col("frame_no") % 256).cast("double"), "contrast": F.col("motion"), "sharpness": F.col("frame_no") * 10.0, "content_ratio": F.col("complexity")})
    return rounded(tk.frame_quality(rows).select("video_id", "frame_no", "quality"), "quality", places=6)


@query(sql("""with {DET},{DAILY},{CROPS}, f as (select *, greatest(0.7, least(1.3, 0.9 + confidence * 0.3 - objects * 0.1)) as f from crops), s as (select *, floor((x2 - x1) * f + 0.000000001)::bigint as w, floor((y2 - y1) * f + 0.000000001)::bigint as h from f)
select video_id, day, greatest(0, cx - floor(w / 2.0)::bigint) as x1, greatest(0, cy - floor(h / 2.0)::bigint) as y1, least(1920, greatest(0, cx - floor(w / 2.0)::bigint) + w) as x2, least(1080, greatest(0, cy - floor(h / 2.0)::bigint) + h) as y2 from s"""))
def rescaled_crops(spark, sf_dir):
    crops = rounded(tk.weighted_crops(daily(spark, sf_dir), "day"), "confidence", places=6)
    return fr.rescaled(crops, fr.adaptive_factor(F.col("confidence"), F.col("objects"))).select("video_id", "day", "x1", "y1", "x2", "y2")


@query(sql("with {FILES}, o as (select directory as input, path as output from files union all select 'input', 'gone' ) select input from o group by input having bool_and(output in (select path from files))"))
def finished_inputs(spark, sf_dir):
    files = st.files(spark, sf_dir)
    outputs = files.select(F.col("directory").alias("input"), F.col("path").alias("output"))
    gone = outputs.where("input = 'input'").select("input", F.lit("gone").alias("output")).distinct()
    return rt.finished_inputs(outputs.unionByName(gone), files)
