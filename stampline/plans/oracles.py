"""DuckDB SQL that says the same as the registered queries."""

from __future__ import annotations

WORDS = r"""words as (select file_id, pos, word, e - dur as "start", e as "end" from (
 select *, (sum(gap + dur) over (partition by file_id order by pos rows unbounded preceding))::bigint as e from (
  select file_id, pos, word, case when (file_id * 31 + pos * 17) % 13 = 0 then 700 else 80 end as gap,
   case when (file_id + pos) % 41 = 0 then 6000 else 200 + 50 * (length(word) % 4) end as dur
  from (select doc_id as file_id, unnest(ws) as word, unnest(range(len(ws)))::bigint as pos
   from (select doc_id, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') as ws from documents)))))"""
FILES = """files as (select doc_id as file_id, source || '_' || doc_id || case when doc_id % 5 = 0 then '.mp4' else '.wav' end as name,
 doc_id % 5 = 0 as is_video, duration from documents left join (select file_id as f, max("end") as duration from words group by 1) on f = doc_id)"""
CLAMPED = r"""clamped as (select file_id, pos, word, "start" as raw, s, case when l then least(g, s + 2000) else g end as e, fin from (
 select *, case when l then greatest("start", g - 2000) else "start" end as s from (
  select *, greatest("start", "end") as g, greatest("start", "end") - "start" > 2000 as l, regexp_matches(word, '[.?!。？！]\s*$') as fin from words))),
hp as (select file_id, bool_or(fin) as hp from clamped group by 1)"""


def _raw(words: int, most: int) -> str:
    return f"""with recursive {WORDS}, {CLAMPED},
fold as (
 select c.file_id, c.pos, c.word, c.e, 0 as seg, c.raw as sstart,
  case when cl then 1 else 0 end as nseg, case when cl then c.e else c.raw end as nstart, case when cl then 0 else 1 end as n
 from (select *, (hp and fin) or e - raw > {most} or (not hp and 1 >= {words}) as cl from clamped join hp using (file_id) where pos = 0) c
 union all
 select file_id, pos, word, e, case when gap then nseg + 1 else nseg end, case when gap then s else nstart end,
  case when gap or cl then nseg + 1 else nseg end, case when gap then s when cl then e else nstart end, case when gap then 1 when cl then 0 else n + 1 end
 from (select c.file_id, c.pos, c.word, c.s, c.e, f.nseg, f.nstart, f.n, f.n > 0 and c.s - f.e >= 500 as gap,
   (hp and fin) or c.e - f.nstart > {most} or (not hp and f.n + 1 >= {words}) as cl
  from fold f join clamped c on c.file_id = f.file_id and c.pos = f.pos + 1 join hp on hp.file_id = c.file_id)),
raw as (select file_id, seg as seg_no, min(sstart) as "start", arg_max(e, pos) as "end", count(*) as n_words, string_agg(word, ' ' order by pos) as text from fold group by 1, 2)"""


_MERGED = r""",
orphans as (
 select file_id, seg_no, "start", "end", n_words, text, 0 as grp, "end" as gend, regexp_matches(text, '[.?!。？！]\s*$') as fin from raw where seg_no = 0
 union all
 select file_id, seg_no, "start", "end", n_words, text, case when j then grp else grp + 1 end, case when j then greatest(gend, "end") else "end" end, f2
 from (select r.*, o.grp, o.gend, r.n_words <= 2 and r."start" - o.gend <= 500 and not o.fin as j, regexp_matches(r.text, '[.?!。？！]\s*$') as f2
  from orphans o join raw r on r.file_id = o.file_id and r.seg_no = o.seg_no + 1)),
merged as (select file_id, grp as seg_no, arg_min("start", seg_no) as "start", arg_max(gend, seg_no) as "end", sum(n_words)::bigint as n_words, string_agg(text, ' ' order by seg_no) as text from orphans group by 1, 2),
final as (select file_id, seg_no, "start", greatest("start", least(greatest("start", "end"), coalesce(nx, greatest("start", "end")))) as "end", n_words, text
 from (select *, lead("start") over (partition by file_id order by seg_no) as nx from merged) where regexp_matches(text, '\S'))"""
_SEG = 'select file_id, seg_no::int as seg_no, "start", "end", n_words::int as n_words, text from '


def _srt(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', (({ms}) // 3600000)::bigint, (({ms}) % 3600000 // 60000)::bigint, (({ms}) % 60000 // 1000)::bigint, (({ms}) % 1000)::bigint)"


def _txt(ms: str) -> str:
    return f"printf('[%02d:%02d:%02d]', (({ms}) // 3600000)::bigint, (({ms}) % 3600000 // 60000)::bigint, (({ms}) % 60000 // 1000)::bigint)"


def _xmys(ms: str) -> str:
    return f"printf('%dm %ds', (({ms}) // 60000)::bigint, (({ms}) % 60000 // 1000)::bigint)"


def _sec(ms: str) -> str:
    return f"printf('%d.%03d', (({ms}) // 1000)::bigint, (({ms}) % 1000)::bigint)"


def _quoted(x: str) -> str:
    return f"""'"' || replace({x}, '"', '""') || '"'"""


def _csv(start: str, end: str, text: str) -> str:
    return f"{_sec(start)} || ',' || {_sec(end)} || ',' || {_sec(f'({end}) - ({start})')} || ',' || {_quoted(text)}"


def _block(no: str, start: str, end: str, text: str) -> str:
    return f"({no}) || chr(10) || {_srt(start)} || ' --> ' || {_srt(end)} || chr(10) || {text} || chr(10)"


_COUNT = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"
_CHUNK, _OVER = 30000, 2000
_MEMBERS = f"""members as (select *, k * {_CHUNK} as cs, greatest(k * {_CHUNK} - {_OVER}, 0) as rd from (
 select *, unnest(range(lo, greatest(hi, lo) + 1)) as k from (
  select *, greatest(floor(("start" - {_OVER}) / {_CHUNK}), 0)::bigint as lo, floor(("end" + {_OVER}) / {_CHUNK})::bigint as hi from words))
 where "end" > k * {_CHUNK} - {_OVER} and "start" < k * {_CHUNK} + {_CHUNK} + {_OVER})"""
_SHIFTED = """shifted as (select file_id, k as chunk_no, pos, word, cs, s as "start", greatest(s, e - l + cs) as "end" from (
 select *, greatest(greatest(b, l) - l + cs, 0) as s from (select *, "start" - rd as b, "end" - rd as e, cs - rd as l from members)) where e > l)"""
_RESULTS = f"""results as (select file_id, name, is_video, duration, error is null as ok, error,
  case when error is null then said else '[Transcription failed: ' || error || ']' end as text, case when error is null then {_COUNT.format('said')} else 0 end::bigint as n_words
 from (select files.*, said, case when f is null then 'no result' when said = '' then 'empty text' end as error from files
  left join (select d.doc_id as f, case when quality = 1 then text else '' end as said from documents d join labels l on l.doc_id = d.doc_id) on f = file_id))"""
_BAD = "(select distinct doc_id as bad from labels where quality = 0)"
_TALKS = f"""talks as (select file_id, name, duration, case when bad is not null then '[Transcription failed: empty text]' else text end as text from (
  select conv_id as file_id, 'talk_' || conv_id || '.wav' as name, count(*) * 3000 as duration, arg_min(text, turn) as text from conversations group by conv_id) left join {_BAD} on bad = file_id),
stamps as (select conv_id as file_id, turn as pos, turn * 3000 as "start", turn * 3000 + 2500 as "end", text from conversations where role = 'assistant')"""
_ESTIMATE = f"greatest(5000, 400 * {_COUNT.format('t.text')})"
_GOOD = "not starts_with(text, '[Transcription failed: ')"
_CATALOG = """status as (select choice, c.filename, min_size_gb, size_gb is not null as "exists", coalesce(size_gb, 0.0)::double as size_gb, coalesce(size_gb, 0.0) >= min_size_gb as valid
 from (values ('1', 'fast.bin', 2.0::double), ('2', 'large.bin', 4.0), ('3', 'large-v2.bin', 4.5), ('4', 'fast-ctc.bin', 4.5)) c(choice, filename, min_size_gb)
 left join (values ('fast.bin', 2.4::double), ('large.bin', 3.5), ('other.bin', 9.0)) l(filename, size_gb) on l.filename = c.filename)"""
_GAPS = """select file_id, count(*) as n_words, count(*) filter (gap >= {0}) as n_gaps, coalesce(max(gap), 0) as longest_gap
 from (select *, "start" - lag("end") over (partition by file_id order by pos) as gap from words) group by 1"""

_PAGES = """status as (select page_id, page_id::varchar as filename, 1.0::double as min_size_gb, size_gb is not null as "exists", coalesce(size_gb, 0.0) as size_gb, coalesce(size_gb, 0.0) >= 1 as valid
 from pages left join (select doc_id, n_chars::double / 1024 as size_gb from documents where lang <> 'en') on doc_id = page_id)"""

ORACLE_SQL: dict[str, str] = {
    "word_stream": f'with {WORDS} select file_id, pos, word, "start", "end" from words',
    "word_clamp": f"with {WORDS}, {CLAMPED} select file_id, pos, s, e from clamped",
    "sentence_flags": f"with {WORDS}, {CLAMPED} select file_id, count(*) as n_words, count(*) filter (fin) as n_final, bool_or(fin) as punctuated from clamped group by 1",
    "silence_gaps": f"with {WORDS} {_GAPS.format(500)}",
    "event_gaps": 'with words as (select user_id as file_id, epoch_us(ts) // 1000 as "start", epoch_us(ts) // 1000 as "end", row_number() over (partition by user_id order by ts, event_id) as pos from events) ' + _GAPS.format(6 * 3600 * 1000),
    "time_formats": f"with {WORDS}, {FILES} select file_id, {_srt('duration')} as srt, {_txt('duration')} as txt, {_xmys('duration')} as xm_ys, "
    "printf('%02d:%02d:%02d,%03d', floor(s / 3600)::bigint, floor((s % 3600) / 60)::bigint, floor(s % 60)::bigint, floor((s % 1) * 1000)::bigint) as srt_of_seconds from (select *, duration::double / 1000 as s from files) where duration is not null",
    "segments_raw_srt": _raw(8, 5000) + _SEG + "raw",
    "segments_raw_txt": _raw(12, 8000) + _SEG + "raw",
    "segments_merged": _raw(8, 5000) + _MERGED + _SEG + "merged",
    "segments_final": _raw(8, 5000) + _MERGED + _SEG + "final",
    "srt_cues_single": _raw(8, 5000) + _MERGED + f"""select file_id, cue_no, {_block('cue_no', '"start"', '"end"', 'text')} as cue from (select *, row_number() over (partition by file_id order by seg_no)::int as cue_no from final)""",
    "srt_estimated": f"select doc_id as file_id, {_block('1', '0', 'est', 'said')} as cue from (select doc_id, said, (greatest(5.0, {_COUNT.format('said')} / 2.5) * 1000)::bigint as est from (select doc_id, case when bad is not null then '' else text end as said from documents left join {_BAD} on bad = doc_id))",
    "csv_estimated": f"select doc_id as file_id, {_csv('0', 'est', 'said')} as line from (select doc_id, said, (greatest(5.0, {_COUNT.format('said')} / 2.5) * 1000)::bigint as est from (select doc_id, case when bad is not null then '' else text end as said from documents left join {_BAD} on bad = doc_id))",
    "txt_plain": f"select doc_id as file_id, '[00:00:00] ' || case when bad is not null then '' else text end as line from documents left join {_BAD} on bad = doc_id",
    "output_headers": f"""with {WORDS}, {FILES} select file_id, 'Audio File: ' || name || chr(10) || 'Model: fast' || chr(10) || 'Duration: ' || {_xmys('coalesce(duration, 0)')} || chr(10) || printf('Processing Time: %d.%02ds', (h // 100)::bigint, (h % 100)::bigint)
 || chr(10) || 'ITN Applied: Yes' || chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'TRANSCRIPTION' || chr(10) || repeat('=', 60) || chr(10) as header, regexp_replace(name, '\\.[^.]*$', '') || '_transcription' as stem from (select *, (file_id % 7000 + 5) // 10 as h from files)""",
    "audio_validation": f"""with {WORDS}, {FILES} select file_id, case when duration::double / 1000 < 0.1 then 'too_short' when duration::double / 1000 > 86400 then 'too_long' when energy < 0.001 then 'silent' end as error from files left join
 (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (x::double / (vec_id % 4 * 200 + 1)) * (x::double / (vec_id % 4 * 200 + 1)))) / len(embedding)) as energy from embeddings) on vec_id = file_id""",
    "csv_rows": f"""with {WORDS} select file_id, pos, {_csv('"start"', '"end"', 'word')} as line from words""",
    "txt_lines": _raw(12, 8000) + _MERGED + f"""select file_id, seg_no::int as seg_no, {_txt('"start"')} || ' ' || text as line from final""",
    "talk_srt": f"""with {_TALKS}, parts as (select file_id, -1 as cue_no, 0 as "start", 2000 as "end", '[FILE: ' || name || ']' as text from talks where {_GOOD}
 union all select t.file_id, coalesce(s.pos, 0), coalesce(s."start", 0), case when s.pos is null then {_ESTIMATE} else s."end" end, case when s.pos is null then t.text else s.text end
 from talks t left join stamps s on t.file_id = s.file_id where not starts_with(t.text, '[Transcription failed: '))
 select no, file_id, {_block('no', '"start"', '"end"', 'text')} as cue from (select *, row_number() over (order by file_id, cue_no) as no from parts)""",
    "talk_csv": f"""with {_TALKS} select file_id, pos, {_quoted('name')} || ',' || {_csv('st', 'en', 'text')} as line from (
 select t.file_id, t.name, coalesce(s.pos, 0) as pos, case when s.pos is null then 0 else s."start" end as st, case when s.pos is null then t.duration else s."end" end as en,
  case when s.pos is null then t.text else s.text end as text from talks t left join stamps s on s.file_id = t.file_id where not starts_with(t.text, '[Transcription failed: '))""",
    "talk_txt": f"""with {_TALKS} select file_id, 0 as part, 0::bigint as pos, chr(10) || 'FILE ' || (file_id + 1) || ': ' || name || chr(10) || 'Duration: ' || {_xmys('duration')} || chr(10) || repeat('=', 60) || chr(10) as line from talks
 union all select t.file_id, 1, coalesce(s.pos, 0), case when s.pos is null then t.text else {_txt('s."start"')} || ' ' || s.text end from talks t left join stamps s on s.file_id = t.file_id""",
    "chunk_plan": f"""with {WORDS}, {FILES} select file_id, k as chunk_no, cs as chunk_start, ce as chunk_end, greatest(cs - {_OVER}, 0) as read_start, least(ce + {_OVER}, duration) as read_end, cs - greatest(cs - {_OVER}, 0) as left_ctx
 from (select *, k * {_CHUNK} as cs, least(k * {_CHUNK} + {_CHUNK}, duration) as ce from (select *, unnest(range(ceil(duration / {_CHUNK})::bigint)) as k from files where duration > 0))""",
    "chunk_membership": f"with {WORDS}, {_MEMBERS} select file_id, k as chunk_no, count(*) as n_words, min(pos) as first_pos, max(pos) as last_pos from members group by 1, 2",
    "overlap_shift_reference": f'with {WORDS}, {_MEMBERS}, {_SHIFTED} select file_id, chunk_no, pos, "start", "end" from shifted',
    "overlap_shift_dedup": f'with {WORDS}, {_MEMBERS}, {_SHIFTED} select file_id, chunk_no, pos, "start", "end" from shifted where "start" < cs + {_CHUNK}',
    "chunk_text": f"with {WORDS}, {_MEMBERS}, {_SHIFTED} select file_id, chunk_no, count(*) as n_words, string_agg(word, ' ' order by pos) as text from shifted group by 1, 2",
    "merged_text": f"with {WORDS}, {_MEMBERS}, {_SHIFTED}, t as (select file_id, chunk_no, string_agg(word, ' ' order by pos) as text from shifted group by 1, 2) select file_id, count(*) as n_chunks, string_agg(text, ' ' order by chunk_no) as text from t group by 1",
    "long_routing": f"with {WORDS}, {FILES} select file_id, duration, coalesce(duration, 0) > 150000 as is_long, (select coalesce(max(duration > 150000), false) from files) as batch_chunked from files",
    "level_fallback": rf"""select doc_id, level, case when toxic = 1 then 'disabled' when level = 'none' then 'requested, not available' else level || '-level' end as status from (
 select d.doc_id, toxic, case when toxic = 1 then 'none' when quality = 1 and {_COUNT.format('text')} > 0 then 'word' when quality is not null and regexp_matches(text, '\S') then 'segment' when {_COUNT.format('text')} > 0 then 'char' else 'none' end as level
 from documents d left join labels l on l.doc_id = d.doc_id)""",
    "attempt_choice": "select user_id, event_type, min(event_id) as attempt, true as ok from events where value > 50 group by 1, 2",
    "file_checks": f"with {WORDS}, {FILES}, {_RESULTS} select file_id, ok, error, text, starts_with(text, '[Transcription failed: ') as failed from results",
    "batch_totals": f"with {WORDS}, {FILES}, {_RESULTS} select count(*) as n_files, count(*) filter (ok) as n_ok, count(*) filter (not ok) as n_failed, count(*) filter (is_video) as n_videos, coalesce(sum(n_words), 0)::bigint as n_words, coalesce(sum(duration), 0)::bigint as duration from results",
    "file_stats": f"with {WORDS}, {FILES}, {_RESULTS} select file_id, name, duration, n_words, round(case when file_id % 7 > 0 then (duration::double / 1000) / (file_id % 7) else 0 end, 6) as rtf from results",
    "file_status_lines": f"with {WORDS}, {FILES}, {_RESULTS} select file_id, '**' || file_id || '. ' || name || '** (' || case when is_video then 'video' else 'audio' end || ')' || case when ok then ': ' || {_xmys('duration')} || ', ' || n_words || ' words' else ': ❌ Failed: ' || error end as line from results",
    "combined_blocks": f"with {WORDS}, {FILES}, {_RESULTS} select file_id, chr(10) || '=== ' || name || ' ===' || chr(10) || chr(10) || text || chr(10) as block from results",
    "duration_validity": "select doc_id, case when d < 0.1 then 'too_short' when d > 86400 then 'too_long' end as error from (select doc_id, (length(text) * doc_id % 1000000)::double / 10 as d from documents)",
    "energy_validity": "select label, round(most, 6) as most, case when most < 0.001 then 'silent' when most < 0.01 then 'warning' else 'ok' end as state, case when least_ < 0.001 then 'silent' when least_ < 0.01 then 'warning' else 'ok' end as least_state from (select label, max(e) as most, min(e) as least_ from (select label, sqrt(list_sum(list_transform(embedding, lambda x: (x::double / (vec_id % 4 * 200 + 1)) * (x::double / (vec_id % 4 * 200 + 1)))) / len(embedding)) as e from embeddings) group by 1)",
    "media_type": f"with {WORDS}, {FILES} select file_id, name, lower(regexp_extract(name, '\\.([^.]+)$', 1)) in ('mp4', 'avi', 'mov', 'mkv', 'webm', 'flv', 'm4v') as video from (select file_id, name from files union all select page_id, url from pages)",
    "media_totals": f"with {WORDS}, {FILES} select sum(duration)::bigint as duration, count(*) filter (is_video) as videos from files",
    "cache_key": "select page_id, substr(sha256(url), 1, 16) || '_' || list_extract(string_split(url, '/'), -1) as cache_key from pages",
    "model_choice": "select * from (values (0, 'large-v2'), (1, 'large'), (2, 'fast-ctc'), (3, 'fast'), (4, 'fast'), (5, 'fast')) v(id, model)",
    "model_status": f'with {_CATALOG} select choice, filename, min_size_gb, "exists", size_gb, valid from status',
    "load_decision": f"""with {_CATALOG} select choice, case when "exists" then 'local' else 'hub' end as load_from from status""",
    "model_totals": f'with {_CATALOG} select count(*) filter ("exists") as downloaded, sum(size_gb) as total_gb from status',
    "itn_word_chunks": r"select doc_id, i::int as no, array_to_string(ws[i * 50 + 1 : i * 50 + 50], ' ') as chunk from (select doc_id, ws, unnest(range((len(ws) + 49) // 50)) as i from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as ws from documents))",
    "sentence_split": r"select doc_id, unnest(range(len(ss)))::int as no, unnest(ss) as sentence from (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as ss from documents)",
    "itn_modes": "select mode, checked, mode in ('per_chunk', 'both') as long_chunk, mode in ('final_pass', 'both') as single_final, mode <> 'disabled' and checked as short_batch, false as long_batch_final, checked as header from (values ('per_chunk'), ('final_pass'), ('both'), ('disabled')) m(mode), (values (true), (false)) c(checked)",
    "retry_schedule": "select tries, 0.5::double as base, attempt, 0.5::double * attempt as wait, sum(0.5::double * attempt) over (partition by tries) as total from (values (6), (4)) p(tries), (values (1), (2), (3), (4), (5)) a(attempt) where attempt < tries",
    "error_category": "select id, message like '%WinError 32%' or message like '%being used by another process%' as lock, kind, case when kind = 'load_failed' then 'Loading failed' else 'Format not supported' end as title from (select *, case when message like '%Audio file%' or message like '%NoBackendError%' then 'load_failed' when message like '%Format%' or message like '%codec%' then 'unsupported_format' else 'load_failed' end as kind from (values (0, 'WinError 32: busy'), (1, 'it is being used by another process'), (2, 'disk full'), (3, 'Audio file Format wrong'), (4, 'NoBackendError'), (5, 'Format'), (6, 'bad codec')) v(id, message))",
}

_TALK_SRT, _TALK_CSV, _TALK_TXT = (ORACLE_SQL[x].split(_TALKS, 1)[1] for x in ("talk_srt", "talk_csv", "talk_txt"))
_RULE = "repeat('=', 60)"
_TITLE = "case when event_type = 'click' then 'Network Error' when event_type = 'view' then 'Transcription Error' when event_type = 'error' then 'Model Loading Failed: File Lock' when event_type = 'signup' then 'Output Validation Failed' else 'Unexpected Error' end"
_FENCE = "chr(10) || '```'"

ORACLE_SQL |= {
    "level_of_chunks": f"with {WORDS}, {FILES} select file_id, c as was_chunked, case when c and file_id % 2 = 0 then 'word' when c then 'segment' when file_id % 2 = 0 then 'char' else 'none' end as level from (select file_id, coalesce(duration > 60000, false) as c from files)",
    "paths_and_imports": f"with {WORDS}, {FILES} select count(*) as missing, 1::bigint as unusable, count(*) + 1 as failures from files where name not in (select name from files where duration is not null)",
    "csv_file": f"""with {WORDS} select distinct file_id, 0 as part, 0::bigint as pos, 'start_time,end_time,duration,text' as line from words union all select file_id, 1, pos, {_csv('"start"', '"end"', 'word')} from words""",
    "stamp_cues": f"""with {_TALKS} select file_id, cue_no, {_block('cue_no', '"start"', '"end"', 'text')} as cue from (select *, (row_number() over (partition by file_id order by pos))::int as cue_no from stamps)""",
    "batch_outputs": f"""with {_TALKS}, srts as (with {_TALKS}{_TALK_SRT}), csvs as (with {_TALKS}{_TALK_CSV}), txts as (with {_TALKS}{_TALK_TXT})
 select 'srt' as kind, cue as line from srts union all select 'csv', line from csvs union all select 'csv', 'file,start_time,end_time,duration,text' union all select 'txt', line from txts
 union all select 'txt', 'Batch Transcription - ' || count(*) || ' files' || chr(10) || 'Model: fast' || chr(10) || 'Total Duration: ' || {_xmys('coalesce(sum(duration), 0)')} || chr(10) || 'Processing Time: 1.50s' || chr(10) || 'ITN Applied: Yes' || chr(10) || chr(10) || {_RULE} from talks""",
    "single_outputs": f"""with {_TALKS}, good as (select * from talks where {_GOOD}),
 each as (select t.file_id, s.pos, coalesce(s.pos, 0) as no, coalesce(s."start", 0) as "start", case when s.pos is null then {_ESTIMATE} else s."end" end as "end", coalesce(s.text, t.text) as text,
  row_number() over (partition by t.file_id order by s.pos) as cue_no from good t left join stamps s on s.file_id = t.file_id)
 select 'srt' as kind, file_id, 1 as part, cue_no as pos, {_block('cue_no', '"start"', '"end"', 'text')} as line from each
 union all select 'csv', file_id, 0, 0, 'start_time,end_time,duration,text' from good union all select 'csv', file_id, 1, no, {_csv('"start"', '"end"', 'text')} from each
 union all select 'txt', file_id, 0, 0, 'Audio File: ' || name || chr(10) || 'Model: fast' || chr(10) || 'Duration: ' || {_xmys('duration')} || chr(10) || 'Processing Time: 1.50s' || chr(10) || 'ITN Applied: Yes' || chr(10) || chr(10) || {_RULE} || chr(10) || 'TRANSCRIPTION' || chr(10) || {_RULE} || chr(10) from good
 union all select 'txt', file_id, 1, no, case when pos is null then text else {_txt('"start"')} || ' ' || text end from each""",
    "single_status": f"""with {WORDS}, {FILES} select file_id, case when is_video then 'video, its audio was taken' || chr(10) else '' end || 'Model: fast' || chr(10) || 'Audio Duration: ' || {_xmys('coalesce(duration, 0)')} || chr(10)
 || printf('Real-Time Factor: %d.%dx', (t // 10)::bigint, (t % 10)::bigint) || chr(10) || 'Transcription Length: ' || length(coalesce(text, '')) || ' characters (' || {_COUNT.format("coalesce(text, '')")} || ' words)' || chr(10) || 'ITN: applied' || chr(10)
 || 'Timestamps: ' || case when file_id % 11 = 0 then 'disabled' when duration is null then 'requested, not available' else 'word-level' end as line
 from (select *, floor(case when file_id % 7000 > 0 then coalesce(duration, 0)::double * 10 / (file_id % 7000) else 0 end + 0.5)::bigint as t from files join (select doc_id as f, text from documents) on f = file_id)""",
    "finished_results": f"""with {WORDS}, {FILES}, {_RESULTS}, seen as (select file_id as f, count(*) as n from words group by 1)
 select file_id, name, ok, error, case when ok then lower(text) else text end as text, n_words, case when ok then coalesce(n, 0) else 0 end as n_stamps, case when ok and n is not null then 'word' else 'none' end as level from results left join seen on f = file_id""",
    "result_structure": """select event_id, case when event_type = 'signup' then 'Result is None' when event_type = 'view' then 'Result is dict, expected list' when size = 0 then 'Result is an empty list'
 when event_id % 3 >= size then 'Index ' || event_id % 3 || ' out of range (result has ' || size || ' items)' end as error from (select *, floor(value)::bigint % 4 as size from events)""",
    "hypothesis_text": """select doc_id, case when kind <> 'str' and attribute is null then 'Hypothesis has no .text attribute (type: ' || kind || ')' when kind <> 'str' and attribute <> 'str' then '.text is ' || attribute || ', expected string'
 when coalesce(text, '') = '' then 'Transcription is empty' end as error, coalesce(case when attribute = 'str' then text end, case when kind = 'str' then text end, '<' || lang || '>') as text
 from (select *, case when lang = 'en' then 'str' else 'Hypothesis' end as kind, case lang when 'fr' then 'str' when 'es' then 'NoneType' end as attribute from documents)""",
    "error_responses": f"select event_id, '### ❌ ' || {_TITLE} || chr(10) || chr(10) || case when event_type = 'view' then '```' || chr(10) || event_type || ' ' || event_id || {_FENCE} else event_type || ' ' || event_id end as response from events",
    "load_errors": "select page_id, '❌ MODEL FILE NOT FOUND!' || chr(10) || 'File path: ' || url || chr(10) || 'Model: fast' || chr(10) || case when page_id % 2 = 0 then 'Original error: no bytes at ' || url || chr(10) else '' end || 'It is not there.' || chr(10) || 'Download it.' as text from pages",
    "download_totals": "select count(*) as models, count(*) filter (ok) as downloaded from (select user_id, bool_or(coalesce(value > 50, false)) as ok from events group by 1)",
    "event_models": "select event_id, case when contains(event_type, 'view') then 'large' when contains(event_type, 'i') then 'fast-ctc' when contains(event_type, 'e') then 'large-v2' else 'fast' end as model from events",
    "page_status": f'with {_PAGES} select * from status',
    "page_load": f"""with {_PAGES} select page_id, case when "exists" then 'local' else 'hub' end as load_from from status""",
    "page_totals": f'with {_PAGES} select count(*) filter ("exists") as downloaded, coalesce(sum(size_gb), 0.0) as total_gb from status',
    "event_errors": """select event_id, event_type = 'error' as lock, case when event_type in ('click', 'signup') then 'unsupported_format' else 'load_failed' end as kind,
 case when event_type in ('click', 'signup') then 'Format not supported' else 'Loading failed' end as title from (select event_id, coalesce(event_type, '') as event_type from events)""",
    "stream_segments": rf"""with {WORDS}, sentences as (select *, coalesce(sum(regexp_matches(word, '[.?!。？！]\s*$')::int) over (partition by file_id order by pos rows between unbounded preceding and 1 preceding), 0) as no from words),
 counted as (select *, (row_number() over (partition by file_id, no order by pos) - 1) // 13 as part from sentences),
 closed as (select file_id, min(pos) as a, max(pos) as b, count(*)::int as n_words, string_agg(word, ' ' order by pos) as text from counted group by file_id, no, part)
 select file_id, (row_number() over (partition by file_id order by a) - 1)::int as seg_no, case when a = 0 then 0 else 400 * a - 50 end::double as "start", (400 * b + 350)::double as "end", n_words, text from closed""",
}
ORACLE_SQL["segments_pieces"] = ORACLE_SQL["segments_final"]

_LOOKS = """looks as (select user_id as file_id, event_id, place as "start", place + floor(case when event_type = 'purchase' then value * 1000 else value * 20 end)::bigint as "end" from (select *, epoch_us(ts) // 1000 % 300000 as place from events))"""
_SHARE = """case when a."start" >= b."start" then a."start" < b."end" or (a."start" = b."start" and b."start" = b."end") else b."start" < a."end" end"""

ORACLE_SQL |= {
    "words_in_windows": f"with {WORDS}, {_LOOKS} select a.file_id, event_id, count(*) as n_words, min(pos) as first_pos, max(pos) as last_pos from words a join looks b on a.file_id = b.file_id and ({_SHARE}) group by all",
    "windows_in_windows": f"""with {_LOOKS} select a.event_id, count(*) as n_others, sum(least(a."end", b."end") - greatest(a."start", b."start"))::bigint as shared, max(b.event_id) as last_other
 from looks a join looks b on a.file_id = b.file_id and a.event_id < b.event_id and ({_SHARE}) group by a.event_id""",
}

_ARRIVED = """ends as (select min(ts) as first, max(ts) as last from events), known as (select max(ts) as known from events, ends where ts < first + (last - first) / 3 * 2),
told as (select e.*, event_type = 'error' and ts + interval 6 hours <= known - interval 1 day as late, last from events e, known, ends),
kept as (select * from told where not late)"""

ORACLE_SQL |= {
    "event_sessions": f"""with {_ARRIVED}, cut as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 6 hours, true)::int as begins from kept),
 numbered as (select *, sum(begins) over (partition by user_id order by ts, event_id) as no from cut)
 select user_id, min(ts) as "start", max(ts) + interval 6 hours as "end", count(*) as n_events, round(sum(value), 3) as value from numbered group by user_id, no having max(ts) + interval 6 hours <= any_value(last) - interval 1 day""",
    "event_windows": f"""with {_ARRIVED}, spans as (select *, time_bucket(interval 90 minutes, ts, timestamp '1970-01-01') - k * interval 90 minutes as "start" from kept, range(4) r(k))
 select user_id, "start", "start" + interval 6 hours as "end", count(*) as n_events, round(sum(value), 3) as value from spans group by user_id, "start" having "start" + interval 6 hours <= any_value(last) - interval 1 day""",
    "late_events": f"with {_ARRIVED} select event_id, user_id, ts from told where late",
}

_OPENING, _CLOSING, _QUOTE = r"""["''(\[{«“‘]""", r"""["'')\]}»”’,;:]""", r"""["'')\]}»”’]"""
_LEARNED = rf"""said as (select unnest(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) as w from documents),
bare as (select regexp_replace(regexp_replace(lower(w), '^{_OPENING}+', ''), '{_CLOSING}+$', '') as w from said),
stems as (select regexp_replace(w, '\.$', '') as stem, ends_with(w, '.') as dotted from bare where regexp_matches(w, '\p{{L}}') and not ends_with(w, '..')),
counts as (select stem, count(*) filter (dotted) as n_dotted, count(*) filter (not dotted) as n_plain from stems group by stem),
chances as (select sum(n_dotted) / sum(n_dotted + n_plain) as p from counts),
scored as (select *, length(regexp_replace(stem, '[^.]', '', 'g')) as inside from counts, chances where n_dotted > 0),
abbreviations as (select stem, n_dotted, n_plain, 2 * (n_dotted * ln(0.99::double / p) + n_plain * ln((1 - 0.99::double) / (1 - p))) * exp(inside - length(stem)) * (inside + 1) * pow((length(stem) - inside)::double, -n_plain::double) as score from scored)"""

ORACLE_SQL |= {
    "learned_abbreviations": f"with {_LEARNED} select stem, n_dotted, n_plain, round(score, 6) as score from abbreviations where score >= 0.3",
    "learned_sentences": rf"""with {_LEARNED}, known as (select stem from abbreviations where score >= 0.3),
 words as (select doc_id, unnest(ws) as w, unnest(seps) as sep, unnest(range(len(ws))) as i from (select doc_id, regexp_extract_all(t, '\S+') as ws, list_append(regexp_extract_all(t, '\s+'), '') as seps from (select doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') as t from documents) where t <> '')),
 marked as (select doc_id, i, w, case when sep <> '' and regexp_matches(w, '[.!?]{_QUOTE}{{0,2}}$') and not (ends_with(w, '.') and (k.stem is not null or l.stem is not null)) then chr(1) else sep end as sep
  from words left join known k on k.stem || '.' = lower(w) left join known l on l.stem || '.' = regexp_replace(lower(w), '^.*{_OPENING}', '')),
 whole as (select doc_id, string_split(string_agg(w || sep, '' order by i), chr(1)) as ss from marked group by doc_id)
 select doc_id, unnest(range(len(ss)))::int as no, unnest(ss) as sentence from whole""",
}

ORACLE_SQL |= {
    "files_read_back": f"""with {_TALKS}, good as (select * from talks where {_GOOD}),
 each as (select t.file_id, name, s.pos, coalesce(s."start", 0) as "start", case when s.pos is null then {_ESTIMATE} else s."end" end as "end", case when s.pos is null then duration else s."end" end as till, coalesce(s.text, t.text) as text,
  row_number() over (partition by t.file_id order by s.pos) as no from good t left join stamps s on s.file_id = t.file_id),
 batch as (select file_id, -1 as no, 0 as "start", 2000 as "end", '[FILE: ' || name || ']' as text from good union all select file_id, no, "start", "end", text from each)
 select replace(name, '.wav', '') || '_transcription.' || kind as output, null as file, no::int as no, "start", "end", text from each, (values ('srt'), ('csv')) k(kind)
 union all select 'all.csv', name, (row_number() over (order by file_id, no))::int, "start", till, text from each
 union all select 'all.srt', null, (row_number() over (order by file_id, no))::int, "start", "end", text from batch""",
}

ORACLE_SQL |= {
    "shifted_results": f"""with {WORDS}, {FILES}, said as (select d.doc_id, text, row_number() over (order by d.doc_id) as no from documents d join labels l on l.doc_id = d.doc_id where quality = 1 and text <> ''),
 named as (select *, row_number() over (order by file_id) as no from files)
 select file_id, doc_id is not null as ok, case when doc_id is null then 'no result' end as error, doc_id as said_of, case when doc_id is null then 0 else {_COUNT.format("coalesce(text, '')")} end::bigint as n_words from named left join said using (no)""",
    "changed_files": """with counts as (select conv_id, count(*) as n, count(*) filter (role = 'user') as users from conversations group by 1),
 contents as (select conv_id, string_agg(text || chr(10), '' order by turn) as all_, string_agg(text || chr(10), '' order by turn) filter (role = 'user') as users from conversations group by 1)
 select 'talk_' || conv_id || '.txt' as name, strlen(said)::bigint as length, sha256(said) as sha256, state from (
  select conv_id, case when n % 2 = 0 then t.all_ else t.users end as said, case when n % 2 = 1 then 'same' when c.users = 0 then 'new' when c.users = n then 'touched' else 'changed' end as state
  from counts c join contents t using (conv_id)) where said is not null""",
}

ORACLE_SQL |= {
    "sketched_statistics": r"""select source, count(*) as n_words, min(length(w)) as shortest, max(length(w)) as longest, count(distinct lower(w)) as n_distinct, true as distinct_holds, true as median_holds
 from (select source, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as w from documents) group by source""",
}
