"""DuckDB SQL for the registered queries, written from the operators' rules."""

from __future__ import annotations

from clipwright.functions import lexicons as lx

TRANSCRIPT = """
said as (select conv_id as video_id, turn as seg_idx, role as speaker, text, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::bigint as n_words from conversations),
timed as (select *, sum(n_words * 0.5 + [0.0, 0.5, 1.0, 2.5][(seg_idx % 4 + 1)::int]) over (partition by video_id order by seg_idx)::double as "end" from said),
transcript as (select *, ("end" - n_words * 0.5)::double as start from timed),
videos as (select video_id, (max("end") + 5)::double as duration from transcript group by video_id),
lined as (select *, lead(start) over w as next_start, lag("end") over w as before_end, lag(text) over w as before_text, lead(n_words / ("end" - start + 0.001)) over w as next_rate from transcript window w as (partition by video_id order by seg_idx))"""
BREAKS = """
breaks as (
  select video_id, before_end as ts, 'audio' as type, 0.8::double as confidence from lined where start - before_end >= 1
  union all select video_id, (i * 7.0)::double, 'visual', (i % 10 / 10.0)::double from videos, unnest(range(1, floor(duration / 7)::bigint + 1)) t(i) where duration >= 7)"""
APPEARANCES = """
appearances as (select distinct event_type as video_id, 'u' || (user_id % 10) as actor, floor((epoch_us(ts) / 1000000.0 - 1704067200) / 60)::bigint as t from events)"""
DETECTIONS = """
detections as (
  select user_id as video_id, event_id as det_id, floor(epoch_us(ts) / 1000000.0)::bigint - 1704067200 as ts, event_type as class_name, (event_id % 100)::double / 100 as confidence, (event_id % 8)::double / 8 as relevance,
    event_id * 37 % 1920 as cx, event_id * 91 % 1080 as cy, 20 + event_id % 60 as half, cx - half as x1, cy - half as y1, cx + half as x2, cy + half as y2
  from events)"""
FEATURES = """
features as (
  select user_id as video_id, frame_no, frame_no * 2.0::double as ts, value as motion, k / 100.0::double as complexity
  from (select *, row_number() over (partition by user_id order by ts, event_id) as frame_no, json_extract_string(props, '$.k')::double as k from events))"""
FILES = """
named as (select ['input', 'output', 'temp'][(doc_id % 3 + 1)::int] as directory, ['.mp4', '.mov', '.log', '.mkv', '.json'][(doc_id % 5 + 1)::int] as extension, doc_id, n_chars as size, 1704067200 + doc_id * 3600 as mtime, case when doc_id % 17 = 0 then 'sample' else 'clip' end as stem from documents),
files as (select directory, directory || '/' || stem || '_' || doc_id || extension as path, extension, size, mtime, stem <> 'sample' and extension not in ('.log', '.json') and 1706227200 - mtime >= 300 as may, extension in ('.mp4', '.mov', '.mkv') as video from named)"""


def q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def hits(text: str, words) -> str:
    return "(" + " + ".join(f"contains(lower(coalesce({text}, '')), {q(w)})::int" for w in words) + ")"


def any_of(text: str, words) -> str:
    return "(" + " or ".join(f"contains(lower(coalesce({text}, '')), {q(w)})" for w in words) + ")"


def count(text: str, sign: str) -> str:
    return f"(length({text}) - length(replace({text}, {q(sign)}, '')))"


def n_words(text: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda w: w <> ''))"


def tokens(text: str, words) -> str:
    return f"len(list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w in ({', '.join(map(q, words))})))::bigint"


def best(text: str, groups, default: str) -> str:
    """First group with most hits."""
    top = "greatest(" + ", ".join(hits(text, w) for w in groups.values()) + ")"
    return f"case when {top} = 0 then {q(default)} " + " ".join(f"when {hits(text, w)} = {top} then {q(g)}" for g, w in groups.items()) + " end"


def open_end(text: str) -> str:
    return f"({text} like '%...' or {text} like '%-' or {text} like '%,')"


def segment_quality(t: str) -> str:
    return f"""case when coalesce({t}, '') = '' then 0 else least(1.0, case when {n_words(t)} between 5 and 50 then 0.3 when {n_words(t)} > 0 then 0.1 else 0 end
      + case when regexp_matches({t}, '[.!?]') then 0.3 else 0 end + least({hits(t, lx.TEXT_ENGAGEMENT)} * 0.1, 0.2) + case when {open_end(t)} then 0 else 0.2 end) end"""


def clip_quality(t: str) -> str:
    return f"""case when coalesce({t}, '') = '' then 0 else case when {n_words(t)} between 10 and 100 then 0.3 when {n_words(t)} >= 5 then 0.1 else 0 end
      + case when regexp_replace({t}, '[.\\s]', '', 'g') <> '' then 0.2 else 0 end + case when {open_end(t)} then 0 else 0.1 end + case when regexp_matches({t}, '[?!]') then 0.1 else 0 end end"""


def engagement(t: str) -> str:
    return f"""case when coalesce({t}, '') = '' then 0 else least(1.0, least({hits(t, lx.CLIP_ENGAGEMENT)} * 0.05, 0.2) + least({hits(t, lx.CLIP_PRACTICE)} * 0.08, 0.3) + least({hits(t, lx.CLIP_INSTRUCTION)} * 0.06, 0.2)
      + least({count(t, '?')} * 0.08, 0.15) + least({count(t, '!')} * 0.05, 0.1) + case when {any_of(t, lx.CLIP_ADDRESS)} then 0.15 else 0 end
      + case when {any_of(t, lx.CLIP_BREATH)} then 0.1 else 0 end + case when {any_of(t, lx.CLIP_MOVEMENT)} then 0.1 else 0 end) end"""


def clip_type(t: str) -> str:
    pose = any_of(t, lx.POSE)
    rules = "".join(f" when {any_of(t, w)}{f' or contains({t}, {q(chr(63))})' if g == 'interactive' else ''} then {q(g)}" for g, w in lx.CLIP_TYPES.items())
    return f"""case when coalesce({t}, '') = '' then 'general' when {pose} and {any_of(t, ['breathe', 'inhale', 'exhale', 'hold'])} then 'yoga_breathing'
      when {pose} and {any_of(t, ['move', 'flow', 'transition'])} then 'yoga_movement' when {pose} then 'yoga_instruction'{rules} else 'instruction' end"""


def viral(t: str) -> str:
    feeling = f"least({hits(t, lx.FEELINGS)} * 0.2, 1.0)"
    return f"""least(1.0, least({hits(t, lx.VIRAL)} * 0.1, 0.3) + least({hits(t, lx.HOOKS)} * 0.1, 0.2) + least({feeling} * 0.15, 0.15) + least({count(t, '?')} * 0.05, 0.1)
      + least({hits(t, lx.URGENCY)} * 0.05, 0.1) + least({hits(t, lx.SOCIAL_PROOF)} * 0.05, 0.1))"""


def optimization(t: str, viral_: str, duration: str) -> str:
    return f"""0.5 * 0.4 + {viral_} * 0.3 + (least({hits(t, lx.VIRAL)} * 0.1, 0.3) + least({hits(t, lx.HOOKS)} * 0.15, 0.3) + least(least({hits(t, lx.FEELINGS)} * 0.2, 1.0), 0.2) + least({hits(t, lx.ACTIONS)} * 0.1, 0.2)) * 0.2
      + case when {duration} between 15 and 30 then 1.0 when {duration} between 30 and 45 then 0.8 when {duration} between 45 and 60 then 0.6 else 0.3 end * 0.1"""


AUDIENCE = "case " + " ".join(f"when {any_of('text', w)} then {q(a)}" for a, w in lx.AUDIENCES.items()) + f" else coalesce(map_from_entries([{', '.join(f'({q(c)}, {q(a)})' for c, a in lx.CATEGORY_AUDIENCE.items())}])[{best('text', lx.CATEGORIES, 'general')}], 'general') end"
LINE_QUALITY = f"""(case when {n_words('text')} >= 5 then 0.3 else 0 end + case when regexp_matches(text, '[.!?]') then 0.2 else 0 end
  + case when {any_of('text', lx.QUALITY_ENGAGEMENT)} then 0.3 else 0 end + case when {any_of('text', lx.DIRECT_ADDRESS)} then 0.2 else 0 end)"""


def windows(source: str, columns: str, step: int) -> str:
    """Centred windows of 15 to 60 seconds around the rows of `source`."""
    return f"""select video_id, seg_idx, seg_start, least(duration, seg_start + d) as seg_end, {columns} from (
      select *, greatest(0, (start + "end") / 2 - d / 2.0::double)::double as seg_start from {source} join videos using (video_id), unnest(range(15, 61, {step})) t(d)) where least(duration, seg_start + d) - seg_start >= 15"""


CLIPS = f"""
lively as (select * from (select *, round({LINE_QUALITY}::double, 4) as quality_score from transcript) where quality_score >= 0.4),
quality_windows as ({windows('lively', 'quality_score', 10)}),
clips as (select video_id, row_number() over (partition by video_id order by seg_start, seg_end, seg_idx) as segment_id, seg_start, seg_end from quality_windows)"""
TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
CLIP_TEXTS = f"""
clip_texts as (
  select c.*, coalesce((select string_agg({TRIM}, ' ' order by t.start, t.seg_idx) from transcript t where t.video_id = c.video_id and t.start < c.seg_end and t."end" > c.seg_start and {TRIM} <> ''), '') as text from clips c)"""
FACTOR = "case when d between 60 and 90 then 1.0 when d > 90 and d <= 120 then 0.95 when d >= 45 and d < 60 then 0.8 else 0.7 end"
SCORED = f"""
scored as (
  select *, round(least(1.0, (0.5 + {clip_quality('text')}) * {FACTOR})::double, 4) as quality_score, round(least(1.0, 0.5 + {engagement('text')})::double, 4) as engagement_score
  from (select *, seg_end - seg_start as d from clip_texts))"""
HOURS = """
hours as (select video_id, s as segment_id, (s * 120.0)::double as seg_start, (s * 120.0 + 60)::double as seg_end from (select event_type as video_id, floor(min(floor((epoch_us(ts) / 1000000.0 - 1704067200) / 60)) / 120)::bigint as lo, floor(max(floor((epoch_us(ts) / 1000000.0 - 1704067200) / 60)) / 120)::bigint as hi from events group by 1), unnest(range(lo, hi + 1)) t(s))"""
DAYS = """
days as (select video_id, s as segment_id, (s * 172800.0)::double as seg_start, (s * 172800.0 + 86400)::double as seg_end from (select user_id as video_id, floor((min(floor(epoch_us(ts) / 1000000.0)) - 1704067200) / 172800)::bigint as lo, floor((max(floor(epoch_us(ts) / 1000000.0)) - 1704067200) / 172800)::bigint as hi from events group by 1), unnest(range(lo, hi + 1)) t(s))"""
COVERAGE = """
coverage as (
  select h.video_id, segment_id, actor, least(1.0, count(*) / 60.0)::double as coverage from hours h join appearances a on a.video_id = h.video_id and a.t between seg_start and seg_end group by all)"""
SESSIONS = """
marked as (select *, case when t - lag(t) over w <= 10 then 0 else 1 end as fresh from appearances window w as (partition by video_id, actor order by t)),
sessions as (select video_id, actor, min(t) as start_sec, max(t) as end_sec, count(*) as n from (select *, sum(fresh) over (partition by video_id, actor order by t) as run from marked) group by video_id, actor, run)"""
DAILY = """
daily as (select *, floor(ts / 86400.0)::bigint as day from detections)"""
CROPS = """
sums as (
  select video_id, day, sum(relevance * confidence * (x2 - x1) * (y2 - y1) * cx) as wx, sum(relevance * confidence * (x2 - x1) * (y2 - y1) * cy) as wy, sum(relevance * confidence * (x2 - x1) * (y2 - y1)) as w,
    sum(cx) as sx, sum(cy) as sy, count(*) as objects, avg(confidence) as conf from daily group by all),
centres as (select *, (case when w > 0 then floor(wx / w + 1e-9) else floor(sx / objects) end)::bigint as cx, (case when w > 0 then floor(wy / w + 1e-9) else floor(sy / objects) end)::bigint as cy from sums),
crops as (select video_id, day, cx, cy, greatest(0, cx - 303) as x1, greatest(0, cy - 540) as y1, least(1920, greatest(0, cx - 303) + 607) as x2, least(1080, greatest(0, cy - 540) + 1080) as y2, objects, round(conf, 6) as confidence from centres)"""
PAIRS = """
ranked as (select video_id, ts, row_number() over (partition by video_id order by ts) as r from (select distinct video_id, ts from points)),
pairs as (select a.video_id, a.ts as seg_start, b.ts as seg_end, (b.r - a.r - 1)::int as inner_points from ranked a join ranked b on a.video_id = b.video_id and b.ts - a.ts between 15 and 60)"""
GROUPS = """
worded as (select *, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from transcript),
linked as (select *, lag(w) over o as v, lag("end") over o as before from worded window o as (partition by video_id order by seg_idx)),
flagged as (select *, case when before is null or not (start - before < 5 or coalesce(len(list_distinct(list_intersect(w, v))) / nullif(greatest(len(w), len(v)), 0), 0) > 0.2) then 1 else 0 end as fresh from linked),
grouped as (select video_id, grp, min(start) as group_start, max("end") as group_end, count(*) as lines from (select *, sum(fresh) over (partition by video_id order by seg_idx) as grp from flagged) group by video_id, grp having count(*) >= 2)"""
INTENSITY = f"""
intense as (
  select video_id, seg_idx, start, "end", (least({hits('text', lx.INTENSITY_VOLUME)} * 0.2, 1.0) * 0.4 + least({hits('text', lx.INTENSITY_EMOTION)} * 0.15, 1.0) * 0.4
    + case when "end" <= start then 0.0 when n_words / ("end" - start) > 3 or n_words / ("end" - start) < 1 then 0.8 when n_words / ("end" - start) > 2.5 or n_words / ("end" - start) < 1.5 then 0.6 else 0.4 end * 0.2)::double as intensity from transcript)"""
EMOTION = f"""case when {n_words('text')} > 0 then least(1.0, ({hits('text', lx.EMOTION['high'])} * 1.0 + {hits('text', lx.EMOTION['medium'])} * 0.5 + {hits('text', lx.EMOTION['low'])} * 0.1 + {count('text', '!')} * 0.2 + {count('text', '?')} * 0.1)::double / {n_words('text')}) else 0 end"""


def runs(value: str, threshold: str) -> str:
    return f"""with {FEATURES},
marked as (select *, {value} > {threshold} as high, lead(ts) over w as next_ts, row_number() over w - sum(({value} > {threshold})::int) over w as run from (select *, avg(complexity) over (partition by video_id) as mean from features) window w as (partition by video_id order by frame_no))
select video_id, min(ts) as run_start, arg_max(coalesce(next_ts, -1), frame_no) as run_end from marked where high group by video_id, run having arg_max(coalesce(next_ts, -1), frame_no) - min(ts) >= 4"""


def themes() -> str:
    out = []
    for theme, parts in lx.THEMES.items():
        keywords, feelings, patterns = parts
        found = " + ".join(f"{any_of('text', p.split())}::int" for p in patterns)
        score = f"case when text = '' then 0 else least(1.0::double, {hits('text', keywords)}::double / {len(keywords)} * 0.5::double + {hits('text', feelings)}::double / {len(feelings)} * 0.3::double + ({found})::double / {len(patterns)} * 0.2::double) end"
        out.append(f"select video_id, segment_id, '{theme}' as theme, round({score}, 4) as score from clip_texts")
    return " union all ".join(out)


_T, _B, _C = TRANSCRIPT, f"{TRANSCRIPT},{BREAKS}", f"{TRANSCRIPT},{CLIPS},{CLIP_TEXTS}"
_ENERGY = f"case when rate > 180 or {count('text', '!')} + {count('text', '?')} > 0 then 'high' when rate > 120 then 'medium' else 'low' end"
_VIDEO = "video_id, segment_id"

SQL: dict[str, str] = {
    "pause_patterns": f"""with {_T} select video_id, seg_idx, "end" as pause_start, next_start as pause_end, next_start - "end" as pause,
  case when next_start - "end" < 0.5 then 'short' when next_start - "end" < 1.5 then 'medium' when next_start - "end" < 3 then 'long' else 'extended' end as kind from lined where next_start - "end" > 0.1""",
    "silence_periods": f"with {_T} select video_id, seg_idx, before_end as silence_start, start as silence_end from lined where start > before_end + 0.5",
    "long_silences": f"""with {_T} select video_id, seg_idx, before_end as silence_start, start as silence_end, kind from lined, (values ('speech_gap'), ('detected_silence')) k(kind)
  where start - before_end >= 2.0""",
    "speaker_changes": f"""with {_T}, rates as (select *, n_words / ("end" - start + 0.001) as rate from lined where next_start is not null)
select video_id, seg_idx, "end" as ts, round(least((next_start - "end") / 5.0, 1.0)::double, 4) as confidence, 'long_pause' as indicator from rates where next_start - "end" > 2
union all select video_id, seg_idx, next_start, round(least(abs(rate - next_rate) / (rate + 0.001), 1.0)::double, 4), 'rate_change' from rates where abs(rate - next_rate) / (rate + 0.001) > 0.5""",
    "topic_cuts": f"""with {_T}, worded as (select video_id, seg_idx, start, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as w from transcript),
both_ as (select *, lag(w) over (partition by video_id order by seg_idx) as v from worded)
select video_id, before_end as ts, 'natural_break' as kind, 0.8::double as confidence from lined where start - before_end > 1
union all select video_id, start, 'topic_change', 0.6::double from both_ where v is not null and coalesce(len(list_intersect(w, v)) / nullif(len(list_distinct(w || v)), 0), 0) < 0.3""",
    "smoothed_intensity": f"""with {_T},{INTENSITY} select video_id, seg_idx, start, "end", round(coalesce((lag(intensity) over w + intensity + lead(intensity) over w) / 3, intensity), 4) as intensity from intense window w as (partition by video_id order by seg_idx)""",
    "intensity_summary": f"""with {_T},{INTENSITY} select video_id, round(avg(intensity), 4) as mean, round(max(intensity), 4) as most, round(var_pop(intensity), 4) as variance, count(*) filter (intensity > 0.7) as peaks from intense group by video_id""",
    "sentence_starts": f"""with {_T}, said2 as (select *, {TRIM} as s, regexp_replace(before_text, '^\\s+|\\s+$', '', 'g') as b from lined)
select video_id, seg_idx, coalesce(length(s) >= 3 and regexp_matches(b, '[.!?]$') and regexp_matches(s, '^[\\p{{Lu}}"'']'), false) as sentence_start,
  coalesce(start - before_end >= 0.5 or regexp_matches(b, '(,|;|:|--|—)$'), false) as pause_before from said2""",
    "transcript_stats": f"""with {_T} select video_id, max("end") as total_duration, sum(n_words)::bigint as total_words, count(*) as total_segments, count(distinct speaker) as speakers,
  round(sum(n_words) / count(*), 4) as words_per_segment, round(case when max("end") > 0 then sum(n_words) / max("end") * 60 else 0 end, 4) as words_per_minute from transcript group by video_id""",
    "speech_stats": f"""with {_T}, rows_ as (select video_id, n_words / ("end" - start + 0.001) as rate, {EMOTION} as emotion, {best('text', lx.ZOOM, 'medium_shot')} as zoom from transcript),
pauses as (select video_id, count(*) as pauses, avg(next_start - "end") as mean_pause from lined where next_start - "end" > 0.1 group by video_id)
select video_id, count(*) as segments, round(avg(rate), 4) as mean_rate, round(var_pop(rate), 4) as rate_variance, round(avg(emotion), 4) as mean_emotion, round(max(emotion), 4) as peak_emotion,
  {', '.join(f"round((count(*) filter (zoom = '{z}'))::double / count(*) * 100, 4) as {z}_percent" for z in lx.ZOOM)},
  coalesce(any_value(pauses), 0) as pauses, round(coalesce(any_value(mean_pause), 0), 4) as mean_pause from rows_ left join pauses using (video_id) group by video_id""",
    "transcript_enriched": f"""with {_T}, a as (select *, case when "end" > start then n_words / ("end" - start) * 60 else 0 end as rate, {tokens('text', lx.KEY_TOKENS)} as emphasis, {any_of('text', lx.PERSONAL)} as personal from transcript),
b as (select *, {_ENERGY} as energy from a),
c as (select *, case when emphasis > 0 or personal then 'close_up' when {any_of('text', lx.GROUP)} then 'wide_shot' when energy = 'high' then 'dynamic' else 'medium_shot' end as strategy,
  round(least(1.0, 0.5 + case when emphasis > 0 then 0.2 else 0 end + case energy when 'high' then 0.2 when 'medium' then 0.1 else 0 end + case when personal then 0.1 else 0 end + case when rate between 120 and 200 then 0.1 else 0 end)::double, 4) as engagement from b)
select video_id, seg_idx, round(rate, 4) as rate, energy, emphasis, strategy, engagement, case when engagement > 0.8 then 'high' when engagement > 0.6 then 'medium' else 'low' end as viral from c""",
    "appearance_sessions": f"with {APPEARANCES},{SESSIONS} select * from sessions",
    "motion_runs": runs("motion", "30.0"),
    "complexity_runs": runs("complexity", "mean * 1.5::double"),
    "preroll_end": f"""with {_T} select video_id, least(coalesce(greatest(
    max("end") filter (start <= least(60.0, duration * 0.15) and {any_of('text', lx.INTRO)}), max(start) filter (before_end < least(60.0, duration * 0.15) and start - before_end > 5)), 0), any_value(duration) * 0.25)::double as preroll_end
  from lined join videos using (video_id) group by video_id""",
    "text_quality": f"select doc_id, round(({segment_quality('text')})::double, 4) as segment_quality, round(({clip_quality('text')})::double, 4) as clip_quality from documents",
    "text_engagement": f"select doc_id, round(({engagement('text')})::double, 4) as engagement from documents",
    "content_type": f"""select doc_id, {clip_type('text')} as clip_type, case when contains(text, '?') then 'question' {' '.join(f"when {any_of('text', w)} then {q(g)}" for g, w in lx.SPEECH_TYPES.items())} else 'general' end as speech_type,
  {best('text', lx.CATEGORIES, 'general')} as category from documents""",
    "emotional_intensity": f"select doc_id, round(({EMOTION})::double, 4) as emotion, {best('text', lx.ZOOM, 'medium_shot')} as zoom from documents",
    "viral_potential": f"select doc_id, viral, round(({optimization('text', 'viral', '30')})::double, 4) as optimization, {AUDIENCE} as audience from (select *, round({viral('text')}::double, 4) as viral from documents)",
    "speech_tokens": f"select doc_id, {n_words('text')}::bigint as n_words, {tokens('text', lx.ENGAGEMENT_TOKENS)} as engagement, {tokens('text', lx.EMOTION_TOKENS)} as emotion, {tokens('text', lx.FILLER_TOKENS)} as filler, {tokens('text', lx.ACTION_TOKENS)} as actions from documents",
    "music_pattern": f"""with {_T}, w as (select video_id, seg_idx, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') as w from transcript)
select video_id, seg_idx, {any_of('text', lx.MUSIC)} or (len(w) > 8 and coalesce((select max(c) from (select count(*) as c from unnest(w) u(x) where length(x) > 2 group by x)), 0) > 3) as music from w""",
    "sentence_pieces": f"""with {_T}, s as (select video_id, seg_idx, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as p from transcript)
select video_id, seg_idx, unnest(range(0, len(p))) as i, unnest(p) as sentence from s""",
    "prompt_theme_score": f"with {_C} select * from ({themes()}) where score >= 0.01",
    "segment_text": f"with {_C} select * from clip_texts",
    "break_counts": f"with {_B},{CLIPS} select {_VIDEO}, (select count(*) from breaks b where b.video_id = c.video_id and ts > seg_start and ts < seg_end) as break_count from clips c",
    "clip_scores": f"with {_C},{SCORED} select {_VIDEO}, quality_score, engagement_score, {clip_type('text')} as content_type from scored",
    "candidate_quality": f"""with {_C} select {_VIDEO}, round(least(1.0, ({segment_quality('text')}) * 0.4 + case when seg_end - seg_start between 20 and 90 then 0.2 when seg_end - seg_start between 15 and 120 then 0.1 else 0 end + 0.8 * 0.2 + 0.05)::double, 4) as preliminary_quality from clip_texts""",
    "nearest_vision": f"""with {_C},{SCORED}, seen as (select video_id, seg_idx as pos, start + seg_idx % 5 - 2 as v, (n_words % 11)::double / 10 as visual_score, (n_words % 7)::double / 7 as interest, seg_idx % 3 as people,
    ['action', 'talking_head', 'demonstration', 'unknown'][(seg_idx % 4 + 1)::int] as scene from transcript),
vision as (select video_id, v, min(pos) as pos, arg_max(visual_score, pos) as visual_score, arg_max(interest, pos) as interest, arg_max(people, pos) as people, arg_max(scene, pos) as scene from seen group by video_id, v),
met as (select s.*, v.v, visual_score, interest, people, scene, row_number() over (partition by s.video_id, segment_id order by abs(v - seg_start), pos) as r from scored s left join vision v on v.video_id = s.video_id and abs(v - seg_start) < 10)
select {_VIDEO}, v is not null as has_vision, v as vision_start, scene as scene_type,
  round(case when v is null then quality_score else least(1.0, quality_score * 0.6 + visual_score * 0.4 + case when people > 0 then 0.1 else 0 end) end, 4) as quality_score,
  round(case when v is null then engagement_score else least(1.0, engagement_score * 0.6 + interest * 0.4 + case when people > 0 then 0.1 else 0 end + case when scene in ('action', 'demonstration', 'presentation') then 0.05 else 0 end) end, 4) as engagement_score from met where r = 1""",
    "actor_coverage": f"with {APPEARANCES},{HOURS},{COVERAGE} select video_id, segment_id, actor, round(coverage, 4) as coverage, 1.0::double as conf from coverage",
    "actor_presence": f"with {APPEARANCES},{HOURS},{COVERAGE} select video_id, segment_id, round(least(1.0, sum(coverage)), 4) as presence, arg_max(actor, (coverage, actor)) as top_actor from coverage group by video_id, segment_id",
    "object_coverage": f"""with {APPEARANCES},{SESSIONS},{HOURS} select h.video_id, segment_id, actor as object_id, round(least(1.0, sum(least(seg_end, end_sec) - greatest(seg_start, start_sec)) / 60)::double, 4) as coverage, max(n / 10.0)::double as score
  from hours h join sessions s on s.video_id = h.video_id and start_sec < seg_end and end_sec > seg_start group by all""",
    "object_scores": f"""with {DETECTIONS},{DAYS} select d.video_id, segment_id, seg_start, seg_end, round(coalesce(avg(relevance), 0), 6) as object_relevance, round(coalesce(avg(confidence), 0), 6) as object_confidence, count(det_id) as objects_detected, count(distinct class_name) as object_classes
  from days d left join detections t on t.video_id = d.video_id and ts between seg_start and seg_end group by all""",
    "asof_detection": f"""with {DETECTIONS},{DAYS}, met as (select d.video_id, seg_start::bigint as ts, det_id, t.ts as seen_at, confidence, row_number() over (partition by d.video_id, segment_id order by t.ts > seg_start, case when t.ts <= seg_start then -t.ts else t.ts end, case when t.ts <= seg_start then -det_id else det_id end) as r from days d join detections t on t.video_id = d.video_id)
select video_id, ts, det_id, round(confidence * greatest(0.5, 1 - abs(ts - seen_at) / 86400.0::double), 6) as confidence from met where r = 1""",
    "caption_lines": f"""with {_T},{CLIPS}, met as (select c.video_id, segment_id, seg_idx, seg_start, start, {TRIM} as text, (least("end", seg_end) - greatest(start, seg_start)) / ("end" - start) as share, greatest(start, seg_start) as lo, least("end", seg_end) as hi
  from clips c join transcript t on t.video_id = c.video_id and start < seg_end and "end" > seg_start),
placed as (select *, greatest(0, lo - seg_start + 1.7::double) as s, hi - seg_start + 1.7::double as e from met where share >= 0.5 and text <> '')
select video_id, segment_id, seg_idx, text, round(s, 4) as cap_start, round(greatest(s + 0.1::double, e), 4) as cap_end from placed where s >= case when share >= 0.8 then 0 when share >= 0.6 then 0.1 else 0.3 end""",
    "sliding_windows": f"""with {_T} select video_id, (i * 15)::double as seg_start, (i * 15 + d)::double as seg_end, 'sliding_window' as method, 10 as priority
  from (select *, unnest([15, 17, 20, 22, 25, 30, 35, 37, 40, 45, 50, 53, 55, 58, 60]) as d from videos) v, unnest(range(0, greatest(0, floor((duration - d) / 15)::bigint + 1))) t(i) where d <= duration""",
    "break_pair_candidates": f"""with {_B}, points as (select video_id, ts from breaks join videos using (video_id) where ts between 0 and duration union all select video_id, unnest([0.0::double, duration]) from videos),{PAIRS}
select *, 'scene_based' as method, 2 as priority from pairs""",
    "audio_cue_candidates": f"""with {_T}, points as (select video_id, "end" as ts from lined where regexp_matches(text, '[.!?]') or next_start - "end" > 1 union all select video_id, unnest([0.0::double, duration]) from videos),{PAIRS}
select *, 'audio_cue' as method, 3 as priority from pairs""",
    "content_groups": f"with {_T},{GROUPS} select video_id, group_start, group_end, lines from grouped",
    "content_aware_candidates": f"""with {_T},{GROUPS}, g as (select *, group_end - group_start as dur from grouped where group_end - group_start >= 15)
select video_id, group_start as seg_start, group_end as seg_end, 'content_aware' as method, 1 as priority from g where dur <= 30
union all select video_id, group_start + o, group_start + o + d, 'content_aware_partial', 3 from g, unnest(range(15, least(31, floor(dur)::bigint))) t(d), unnest(range(0, floor(dur - d)::bigint + 1, 10)) u(o)""",
    "high_value_windows": f"""with {_T}, rich as (select *, array_to_string(list_filter([{', '.join(f"case when contains(lower(text), {q(w)}) then {q(w)} end" for w in lx.HIGH_VALUE)}], lambda x: x is not null), ',') as keywords from transcript)
{windows("(select * from rich where keywords <> '')", "'content_aware' as method, 1 as priority, keywords", 15)}""",
    "quality_windows": f"with {_T},{CLIPS} select *, 'quality_driven' as method, 2 as priority from quality_windows",
    "linear_cuts": f"with {_T} select video_id, p::int as part, (p * 30)::double as seg_start, least(duration, (p + 1) * 30)::double as seg_end from videos, unnest(range(0, 5)) t(p) where p * 30 < duration",
    "platform_top_k": f"""with {_C}, v as (select *, round({viral('text')}::double, 4) as viral from clip_texts), o as (select *, round(({optimization('text', 'viral', '(seg_end - seg_start)')})::double, 4) as optimization from v),
p as (select {_VIDEO}, platform, round(viral * wv + optimization * we, 4) as platform_score from o, (values {', '.join(f"('{k}', {a}::double, {b}::double)" for k, (a, b) in lx.PLATFORMS.items())}) p(platform, wv, we))
select video_id, platform, place, segment_id, platform_score from (select *, row_number() over (partition by video_id, platform order by platform_score desc, segment_id)::int as place from p) where place <= 3""",
    "tiered_selection": f"""with {_C},{SCORED}, t as (select {_VIDEO}, engagement_score, sum((engagement_score >= 0.9)::int) over w as high, sum((engagement_score >= 0.72)::int) over w as low, row_number() over (partition by video_id order by engagement_score desc, segment_id) as place from scored window w as (partition by video_id))
select {_VIDEO}, engagement_score from t where case when high >= 3 then engagement_score >= 0.9 when low > 0 then engagement_score >= 0.72 else place <= 3 end""",
    "flow_labels": f"""with {_C}, f as (select *, coalesce(string_split_regex(lower(text), '\\s+')[1], '') as first from clip_texts),
s as (select *, case when first not in ({', '.join(map(q, lx.CONTINUATION))}) and regexp_matches(text, '^\\p{{Lu}}') then 0.25 else 0 end + case when regexp_matches(text, '[.!?]$') then 0.25 else 0 end
  + case when len(list_filter(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) >= 2 then 0.25 when len(list_filter(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) >= 1 then 0.15 else 0 end
  + case when {n_words('text')} between 20 and 150 then 0.25 when {n_words('text')} between 10 and 200 then 0.15 else 0 end as score from f)
select {_VIDEO}, case when text = '' then 'poor' when score >= 0.8 then 'excellent' when score >= 0.6 then 'good' when score >= 0.4 then 'acceptable' else 'poor' end as flow from s""",
    "vector_search": """with r as (select vec_id as ref_id, embedding::double[] as ref from embeddings where vec_id % 50 = 0),
met as (select ref_id, vec_id, round(list_dot_product(embedding::double[], ref) / sqrt(list_dot_product(ref, ref)) / sqrt(list_dot_product(embedding::double[], embedding::double[])), 3) as score from embeddings, r)
select ref_id, vec_id, score, place from (select *, row_number() over (partition by ref_id order by score desc, vec_id)::int as place from met where score >= 0.2) where place <= 5""",
    "track_summary": f"""with {DETECTIONS} select video_id, class_name || '_' || floor(cx / 100.0)::bigint || '_' || floor(cy / 100.0)::bigint as track, count(*) as detections, round(avg(confidence), 6) as mean_confidence, max(confidence) as best_confidence,
  round(avg(relevance), 6) as relevance, max(ts) - min(ts) as span, round(least(1.0, count(*) / greatest(1, max(ts) - min(ts)))::double, 4) as consistency from detections group by all having count(*) >= 2""",
    "class_summary": f"with {DETECTIONS} select video_id, class_name, count(*) as detections, count(*) filter (relevance > 0.5) as relevant, round(avg(confidence), 6) as mean_confidence from detections group by all",
    "weighted_crop_center": f"with {DETECTIONS},{DAILY},{CROPS} select * from crops",
    "iou_pairs": f"""with {DETECTIONS},{DAILY}, p as (select a.video_id, a.day, a.det_id, b.det_id as other_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as shared, 4 * a.half * a.half + 4 * b.half * b.half as area
  from daily a join daily b on a.video_id = b.video_id and a.day = b.day and a.det_id < b.det_id) select video_id, day, det_id, other_id, round(shared::double / (area - shared), 4) as iou from p where shared > 0""",
    "pan_speed": f"""with {DETECTIONS},{DAILY},{CROPS} select video_id, day as ts, round(coalesce(sqrt((cx - lag(cx) over w) ** 2 + (cy - lag(cy) over w) ** 2) / (day - lag(day) over w), 0), 4) as pan_speed from crops window w as (partition by video_id order by day)""",
    "gap_fill": f"""with {DETECTIONS},{DAILY},{CROPS}, l as (select *, lag(day) over w as p, lag(x1) over w as px1, lag(y1) over w as py1, lag(x2) over w as px2, lag(y2) over w as py2 from crops window w as (partition by video_id order by day))
select video_id, day::double as ts, x1, y1, x2, y2, false as filled from crops union all select video_id, (day + p) / 2.0::double, trunc((x1 + px1) / 2.0)::bigint, trunc((y1 + py1) / 2.0)::bigint, trunc((x2 + px2) / 2.0)::bigint, trunc((y2 + py2) / 2.0)::bigint, true from l where day - p > 1""",
    "predicted_centres": f"""with {DETECTIONS}, s as (select *, cx - lag(cx) over w as dx, cy - lag(cy) over w as dy, row_number() over (partition by video_id, class_name order by ts desc, det_id desc) as r from detections window w as (partition by video_id, class_name order by ts, det_id))
select video_id, class_name, trunc(max(cx) filter (r = 1) + avg(dx) * 5)::bigint as px, trunc(max(cy) filter (r = 1) + avg(dy) * 5)::bigint as py from s where r <= 4 group by all having avg(dx) is not null""",
    "layout_hysteresis": f"""with {DETECTIONS}, f as (select video_id, row_number() over (partition by video_id order by ts, det_id)::int as frame_no, case when floor(det_id / 4.0)::bigint % 3 >= 2 then 'split_screen' else 'single_speaker' end as own from detections)
select video_id, frame_no, case when count(own) over n = 3 and min(own) over n = max(own) over n then own when count(own) over o > 0 and min(own) over o = max(own) over o then min(own) over o else own end as layout
from f window n as (partition by video_id order by frame_no rows between 2 preceding and current row), o as (partition by video_id order by frame_no rows between 5 preceding and 3 preceding)""",
    "retention_by_age": f"with {FILES} select directory, path, size, 'age' as rule from files where video and may and mtime < 1706227200 - case directory when 'temp' then 24 else 48 end * 3600",
    "retention_by_size": f"""with {FILES}, total as (select directory, sum(size) as total from files group by directory), f as (select *, coalesce(sum(size) over (partition by directory order by mtime, path rows between unbounded preceding and 1 preceding), 0) as freed from files where video and may)
select directory, path, size, 'size' as rule from f join total using (directory) where freed < total - 100000""",
    "retention_by_count": f"with {FILES} select directory, path, size, 'count' as rule from (select *, row_number() over (partition by directory order by mtime desc, path) as place from files where video) where place > 20 and may",
    "directory_info": f"with {FILES} select directory, count(*) as files, sum(size)::bigint as bytes, arg_min(path, (mtime, path)) as oldest, arg_max(path, (mtime, path)) as newest from files group by directory",
    "request_validation": """with r as (select o_orderkey as k from orders)
select k as request_id, array_to_string(list_filter([
  case when k % 11 = 0 and k % 22 <> 0 then 'identifier' end,
  case when k % 2 = 0 and k % 700 not between 5 and 600 then 'linear_duration' end,
  case when k % 2 = 0 and k % 4 = 0 then 'final_video_ids' end,
  case when k % 13 = 0 then 'canvas_type' end,
  case when k % 120 <= 15 then 'duration' end,
  case when k % 19 = 0 then 'aspect_ratio' end,
  case when k % 23 = 0 then 'llm_provider' end,
  case when k % 2300 - 50 not between 0 and 2000 then 'overlay_x' end], lambda x: x is not null), ',') as errors from r""",
    "reply_parse": """select doc_id as reply_id, (case when doc_id % 4 = 3 then doc_id % 7 else doc_id % 7 end)::int as segment_index, (doc_id % 10 / 10.0)::double as overall_score,
  case when doc_id % 4 = 3 then quality = 1 or doc_id % 10 / 10.0 > 0.6 else quality = 1 end as recommended from labels""",
}
SQL["retention_plan"] = f"""with {FILES}, total as (select directory, sum(size) as total from files group by directory),
ruled as (
  select directory, path, size, 1 as p, 'age' as rule from files where video and may and mtime < 1706227200 - case directory when 'temp' then 24 else 48 end * 3600
  union all select directory, path, size, 2, 'size' from (select *, coalesce(sum(size) over (partition by directory order by mtime, path rows between unbounded preceding and 1 preceding), 0) as freed from files where video and may) join total using (directory) where freed < total - 100000
  union all select directory, path, size, 3, 'count' from (select *, row_number() over (partition by directory order by mtime desc, path) as place from files where video) where place > 20 and may)
select directory, path, size, arg_min(rule, p) as rule from ruled group by directory, path, size"""

_ASKED = [
    "Show me a few funny moments", "The most dramatic turning point, in detail", "Many short clips that explain how to learn this", "The 5000 mAh battery and 120 Hz display of the X200 in 4k",
    "Quick action and movement, visual only", "Touching people, please", "Anything",
]
PROMPTS = f"""
prompts as (select conv_id as request_id, concat_ws('. ', [{', '.join(map(q, _ASKED))}][(conv_id % 7 + 1)::int], text) as prompt from conversations where turn = 0)"""
SENTENCES = "list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 10)"


def climax() -> str:
    terms = []
    for phrase in lx.CLIMAX:
        parts = [w for w in phrase.split() if len(w) > 4] if " " in phrase else []
        weak = f" when {any_of('prompt', parts)} then 0.3" if parts else ""
        terms.append(f"case when contains(lower(prompt), {q(phrase)}) then 1.0{weak} else 0 end")
    return f"not ({any_of('prompt', lx.NOT_CLIMAX)} or ({any_of('prompt', lx.NOT_CLIMAX_UNLESS_PEAK)} and not contains(lower(prompt), 'peak'))) and {' + '.join(terms)} + {hits('prompt', lx.CLIMAX_CLUES)} * 0.5 >= 1.2"


COMEDY = f"({hits('prompt', lx.COMEDY_WORDS)} + {hits('prompt', lx.COMEDY_PHRASES)} * 1.5 >= 1.0)"


def theme_confidences() -> str:
    out = []
    for theme, (keywords, feelings, _) in lx.THEMES.items():
        k, f = keywords, feelings
        comedy = f" + case when {COMEDY} then 0.8 else 0 end" if theme == "comedy" else ""
        out.append(f"round((case when contains(lower(prompt), {q(theme)}) then 0.5 else 0 end + {hits('prompt', k)}::double / {len(k)} * 0.3 + {hits('prompt', f)}::double / {len(f)} * 0.2{comedy})::double, 4) as c_{theme}")
    return ", ".join(out)


_TOP = "greatest(" + ", ".join(f"c_{t}" for t in lx.THEMES) + ")"
_TITLES = "".join(f" when category = {q(c)} and phrase is not null then replace({q(p)}, '%s', phrase)" for c, p in lx.TITLE_PATTERNS.items())
_TAGS = "case " + " ".join(f"when category = {q(c)} then [{', '.join(map(q, t))}]" for c, t in lx.CATEGORY_TAGS.items()) + " else ['general', 'content'] end"
SHORT = lambda x: f"substr({x}, 1, 50) || case when length({x}) > 50 then '...' else '' end"
_INTENT = " || ".join(f"case when {any_of('prompt', w)} then [{', '.join(map(q, w))}] else []::varchar[] end" for w in lx.INTENTS.values())
ZOOM = """
boxes as (select video_id, day, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as subjects from daily group by all),
z as (select *, greatest(1.0::double, least(3.0::double, case when (y2 - y1) / 1080.0::double < 0.3 then 0.3 / ((y2 - y1) / 1080.0::double) when (y2 - y1) / 1080.0::double > 0.8 then 0.8 / ((y2 - y1) / 1080.0::double) else 1 end)) as zoom from boxes),
c as (select *, greatest(0.5 / zoom, least(1 - 0.5 / zoom, (x1 + x2) / 2.0::double / 1920)) as cx, greatest(0.5 / zoom, least(1 - 0.5 / zoom, (y1 + y2) / 2.0::double / 1080)) as py, 1080.0::double / zoom as h, 1080.0::double / zoom * 9 / 16 as w from z),
t as (select *, case when abs(cx - 1 / 3.0::double) <= abs(cx - 2 / 3.0::double) then 1 / 3.0::double else 2 / 3.0::double end as third from c),
p as (select *, case when abs(third - cx) < 0.1 then cx * 0.7 + third * 0.3 else cx end as px from t)"""

SQL |= {
    "generated_titles": f"""with s as (select doc_id, text, {SENTENCES} as p, {best('text', lx.CATEGORIES, 'general')} as category, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: contains(x, '?'))[1] as asked from documents),
r as (select *, (select x from unnest(p) with ordinality u(x, i) where {hits('x', lx.VIRAL)} * 2 + {hits('x', lx.PHRASE_ACTIONS)} > 0 order by {hits('x', lx.VIRAL)} * 2 + {hits('x', lx.PHRASE_ACTIONS)} desc, i limit 1) as phrase,
  {_TAGS} || case when {hits('text', lx.VIRAL)} > 0 then ['viral', 'trending', 'amazing', 'mustwatch'] else [] end || case when contains(text, '?') then ['interactive'] else [] end || case when least({hits('text', lx.FEELINGS)} * 0.2, 1.0) > 0.5 then ['emotional'] else [] end || ['shorts', 'short', 'quickwatch', 'vertical'] as tags,
  array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:5], ' ') as five from s)
select doc_id, case when {hits('text', lx.VIRAL)} > 0 and phrase is not null then 'This Will Blow Your Mind: ' || phrase when asked is not null then {SHORT('asked')}{_TITLES} when phrase is not null then {SHORT('phrase')} else 'Amazing Short Video' end as title,
  array_to_string(list_filter(tags, lambda x, i: list_position(tags, x) = i)[1:10], ',') as tags, case when length(text) > 20 then case when length(five) > 50 then substr(five, 1, 47) || '...' else five end else 'clip - 30s Clip' end as fallback from r""",
    "clean_names": f"with {FILES} select path, upper(substr(n, 1, 1)) || substr(n, 2) as name from (select path, replace(regexp_replace(string_split(path, '/')[2], '\\.[^.]*$', ''), '_', ' ') as n from files)",
    "excerpts": """with f as (select doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as t from documents), w as (select *, string_split(t, ' ') as w from f)
select doc_id, case when length(t) > 500 and len(w) > 80 then array_to_string(w[1:40], ' ') || ' ... ' || array_to_string(w[-40:], ' ') else t end as excerpt from w""",
    "prompt_analysis": f"""with {PROMPTS}, c as (select *, {theme_confidences()} from prompts)
select request_id, case when {_TOP} <= 0.1 then 'general' {' '.join(f"when c_{t} = {_TOP} then {q(t)}" for t in lx.THEMES)} end as theme, {climax()} as climax, {COMEDY} as comedy,
  case when not {any_of('prompt', ['short', 'brief', 'quick'])} and {any_of('prompt', ['long', 'extended', 'detailed'])} then 45 else 15 end as min_duration,
  case when {any_of('prompt', ['short', 'brief', 'quick'])} then 30 when {any_of('prompt', ['long', 'extended', 'detailed'])} then 120 else 60 end as max_duration,
  case when not {any_of('prompt', ['few', 'couple', 'some'])} and {any_of('prompt', ['many', 'several', 'multiple'])} then 7 else 3 end as min_count,
  case when {any_of('prompt', ['few', 'couple', 'some'])} then 5 when {any_of('prompt', ['many', 'several', 'multiple'])} then 15 else 10 end as max_count,
  not {any_of('prompt', ['silent', 'quiet', 'no speech', 'visual only'])} as needs_speech, {any_of('prompt', ['visual', 'see', 'show', 'watch', 'look'])} as needs_visuals,
  {any_of('prompt', ['people', 'person', 'speaker', 'presenter'])} as needs_people, {any_of('prompt', ['action', 'movement', 'demo', 'demonstrate'])} as needs_action from c""",
    "prompt_heuristic": f"""with {_C},{PROMPTS}, k as (select request_id, list_distinct({_INTENT} || list_transform(list_filter(string_split_regex(lower(prompt), '\\s+'), lambda x: length(x) > 3), lambda x: regexp_replace(x, '^[.,?!]+|[.,?!]+$', '', 'g'))) as k from prompts),
j as (select c.*, request_id, k, seg_end - seg_start as d, stop, {n_words('text')} / greatest(seg_end - seg_start, 1) as rate from clip_texts c join k on request_id = video_id join (select video_id as v, max("end") as stop from transcript group by video_id) on v = video_id)
select request_id, segment_id, round(least(1.0::double, least(1.0::double, len(list_filter(k, lambda x: contains(lower(text), x)))::double / len(k) * 2) * 0.3 + 0.12
  + case when d between 15 and 45 then 1.0 when d between 10 and 60 then 0.8 when d between 5 and 90 then 0.5 else 0.2 end * 0.15 + case when text = '' then 0.3 when rate between 1.5 and 3.5 then 1.0 when rate between 1 and 5 then 0.7 else 0.4 end * 0.15
  + case when seg_start / stop <= 0.1 then 0.8 when seg_start / stop >= 0.85 then 0.9 when seg_start / stop between 0.4 and 0.6 then 0.7 else 0.5 end * 0.1 + ({engagement('text')})::double * 0.2), 6) as heuristic from j""",
    "zoom_plan": f"""with {DETECTIONS},{DAILY},{ZOOM} select video_id, day, subjects, round(zoom, 4) as zoom, greatest(0, least(1920 - trunc(w + 1e-9), trunc(px * 1920 - w / 2 + 1e-9)))::bigint as crop_x,
  greatest(0, least(1080 - trunc(h + 1e-9), trunc(py * 1080 - h / 2 + 1e-9)))::bigint as crop_y, trunc(w + 1e-9)::bigint as crop_w, trunc(h + 1e-9)::bigint as crop_h from p""",
    "zoom_quality": f"""with {DETECTIONS},{DAILY},{ZOOM}, r as (select video_id, abs(zoom - lag(zoom) over w) / (day - lag(day) over w) as rate from p window w as (partition by video_id order by day))
select video_id, round(1 - least(coalesce(max(rate), 0) / 0.5, 1), 4) as stability, 1 - least(coalesce(max(rate), 0) / 0.5, 1) < 0.8 as too_fast from r group by video_id""",
}

CLIMAX = f"""
smooth as (select video_id, start, "end", coalesce((lag(intensity) over w + intensity + lead(intensity) over w) / 3, intensity) as intensity from intense window w as (partition by video_id order by seg_idx)),
joined as (select c.*, coalesce((select avg(intensity) from smooth s where s.video_id = c.video_id and s.start < seg_end and s."end" > seg_start), 0) as intensity, stop, (seg_start + seg_end) / 2 / stop as place
  from scored c join (select video_id, max("end") as stop from smooth group by video_id) using (video_id)),
climax as (select *, greatest(0, intensity * 0.25::double + greatest(0, 1 - abs(place - 0.75) * 2) * 0.2::double + quality_score * 0.15::double
  + case when d between 30 and 90 then 1.0 when d between 20 and 120 then 0.8 when d between 15 and 150 then 0.6 else 0.3 end * 0.1
  + case when place > 0.92 or {hits('text', lx.CREDITS)} >= 2 then -0.9 when place > 0.9 then -0.7 when place > 0.87 then -0.4 else 0 end
  + case when place between 0.6 and 0.8 then 0.15 when place between 0.5 and 0.85 then 0.1 else 0 end) as climax_score from joined)"""

SQL |= {
    "climax_scores": f"with {_C},{SCORED},{INTENSITY},{CLIMAX} select video_id, segment_id, round(intensity, 4) as intensity, round(climax_score, 4) as climax_score from climax",
    "climax_top": f"""with {_C},{SCORED},{INTENSITY},{CLIMAX}, p as (select *, row_number() over (partition by video_id order by climax_score desc, segment_id) as p from climax),
k as (select *, row_number() over (partition by video_id order by climax_score desc, segment_id)::int as place_ from p where p <= 6 and climax_score > 0.4 and intensity * 4 > 0.3)
select video_id, segment_id, place_ as place, round(climax_score, 4) as climax_score from k where place_ <= 3""",
    "segment_summary": f"""with {_C},{SCORED} select video_id, count(*) as segments, sum(d) as total_duration, min(d) as shortest, max(d) as longest, round(avg(quality_score), 6) as mean_quality, round(avg(engagement_score), 6) as mean_engagement,
  count(*) filter (quality_score > 0.7) as high, count(*) filter (quality_score between 0.4 and 0.7) as medium, count(*) filter (quality_score < 0.4) as low, count(distinct {clip_type('text')}) as content_types from scored group by video_id""",
    "content_type_counts": f"with {_C} select video_id, {clip_type('text')} as content_type, count(*) as segments from clip_texts group by all",
    "sampled_candidates": f"""with {_T},{CLIPS}, r as (select *, row_number() over (partition by video_id order by seg_start, seg_end, segment_id) - 1 as i, greatest(1, floor(count(*) over (partition by video_id) / 10.0)) as k from clips)
select video_id, segment_id from r where i % k = 0 and i / k < 10""",
    "primary_subjects": f"with {DETECTIONS},{DAILY} select video_id, day, det_id, place from (select *, row_number() over (partition by video_id, day order by relevance desc, confidence desc, half desc, det_id)::int as place from daily) where place <= 3",
    "frame_layouts": f"""with {DETECTIONS},{DAILY}, r as (select *, row_number() over (partition by video_id, day order by confidence desc, x1, det_id) as r from daily),
s as (select video_id, day, list_sort(list((x1, det_id))) as s, avg(confidence) as c, count(*) as n from r where r <= 2 group by all)
select video_id, day, case when n = 1 then 'single_speaker' else 'split_screen' end as layout, s[1][2] as left_id, case when n = 2 then s[2][2] end as right_id, round(c, 6) as confidence from s""",
    "smoothed_speakers": f"""with {DETECTIONS}, k as (select *, floor(cx / 100.0)::bigint || '_' || floor(cy / 100.0)::bigint as speaker from detections),
n as (select *, row_number() over (partition by video_id, speaker order by ts, det_id) as i from k),
j as (select a.video_id, a.speaker, a.det_id, b.x1, b.y1, b.x2, b.y2, b.i - greatest(a.i - 4, 1) + 1 as w from n a join n b on a.video_id = b.video_id and a.speaker = b.speaker and b.i between a.i - 4 and a.i)
select video_id, speaker, det_id, floor(sum(x1 * w) / sum(w)::double)::bigint as s_x1, floor(sum(y1 * w) / sum(w)::double)::bigint as s_y1, floor(sum(x2 * w) / sum(w)::double)::bigint as s_x2, floor(sum(y2 * w) / sum(w)::double)::bigint as s_y2 from j group by all""",
}
