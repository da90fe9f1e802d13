"""The registered queries as DuckDB SQL over the same tables, written apart from the DataFrame code."""

from __future__ import annotations

import re

from tanpura.sources import catalog


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


def filled(kind: str, **columns: str) -> str:
    """A message's template with its fields replaced by SQL expressions."""
    template = next(m[2] for m in catalog.MESSAGES if m[0] == kind)
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(columns[p] if i % 2 else literal(p) for i, p in enumerate(parts) if p)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def ordinal(rows: list[tuple]) -> list[tuple]:
    return [(i, *r) for i, r in enumerate(rows)]


COMMON = {
    "dim_raga": values("dim_raga", "ordinal, id, name, time, mood, description, notes", ordinal(catalog.RAGAS)),
    "dim_tala": values("dim_tala", "ordinal, id, name, beats, description, pattern", ordinal(catalog.TALAS)),
    "dim_style": values("dim_style", "ordinal, id, name, description", ordinal(catalog.STYLES)),
    "dim_file_rule": values("dim_file_rule", "priority, pattern, raga_id, tala_id, tempo, confidence, notes", ordinal(catalog.FILE_RULES)),
    "dim_message": values("dim_message", "kind, title, text_template, severity", catalog.MESSAGES),
    "recordings": """recordings as (
      select event_id as recording_id, user_id as session_id, ts as uploaded_at,
        (case event_id % 5 when 0 then 'bhairavi_' when 1 then 'yaman_' when 2 then 'Bhairavi_' when 3 then 'yaman_bhairavi_' else 'take_' end)
        || cast(event_id as varchar) || (case event_id % 4 when 0 then '.mp3' when 1 then '.wav' when 2 then '.flac' else '.txt' end) as file_name from events)""",
    "requests": """requests as (
      select o_orderkey as request_id, o_custkey as session_id, o_orderdate as requested_at,
        ['bhairavi','yaman','desh','malkauns','bageshri','durga','todi','kafi','unknown'][o_orderkey % 9 + 1] as raga,
        ['teental','jhaptaal','ektaal','rupak','dadra','keherwa',''][o_custkey % 7 + 1] as tala,
        ['dhrupad','khayal','thumri','ghazal','tarana','instrumental',null][(o_orderkey // 9) % 7 + 1] as style,
        cast(30 + o_custkey % 181 as int) as tempo, cast(15 * (1 + o_orderkey % 22) as int) as duration, cast(o_orderkey % 111 - 5 as int) as creativity from orders)""",
    "session_events": """session_events as (
      select event_id, user_id as session_id, ts, case event_type when 'view' then 'SELECT_FILE' when 'click' then 'ANALYZE_OK' when 'purchase' then 'GENERATE_OK'
        when 'signup' then 'RESET_ANALYSIS' else 'ANALYZE_ERR' end as action from events)""",
    "notification_events": """notification_events as (
      select event_id, session_id, ts, action, case when action = 'ADD' then event_id when event_id % 10 = 0 then null
        else max(case when action = 'ADD' then event_id end) over (partition by session_id order by ts rows between unbounded preceding and current row) end as toast_id, payload
      from (select event_id, user_id as session_id, ts, props as payload, case event_type when 'view' then 'ADD' when 'click' then 'ADD' when 'purchase' then 'UPDATE'
        when 'signup' then 'DISMISS' else 'REMOVE' end as action from events) x)""",
    "note_observations": """note_observations as (
      select l_orderkey as recording_id, l_linenumber as position,
        ['Sa','Sa','Komal Re','Re Komal','Re','Re','Komal Ga','Ga Komal','Ga','Ga','Ma','Ma','Tivra Ma','Ma Tivra','Pa','Pa','Komal Dha','Dha Komal','Dha','Dha','Komal Ni','Ni Komal','Ni','Ni']
        [2 * (l_partkey % 12) + l_linenumber % 2 + 1] as note from lineitem)""",
    "onsets": """onsets as (
      select p_partkey as recording_id, k, k * (60000 // (40 + p_partkey % 161)) + (p_partkey * 31 + k * 17) % 11 as onset_ms from part, unnest(range(0, 32)) as t(k))""",
    "analysis_calls": """analysis_calls as (
      select event_id as recording_id, user_id as session_id, ts as requested_at,
        case when event_id % 10 = 9 then null else ts + to_hours(cast(1 + event_id % 13 as int)) end as completed_at from events where event_type = 'click')""",
    "settings_edits": """settings_edits as (
      select event_id, user_id as session_id, ts, case event_id % 6 when 0 then 'raga' when 1 then 'tala' when 2 then 'style' when 3 then 'tempo' when 4 then 'duration' else 'creativity' end as setting,
        'v' || cast(event_id % 97 as varchar) as value from events)""",
    "playback": """playback as (
      select event_id, value as position_s, case when event_id % 10 = 0 then 0.0::double when event_id % 10 = 1 then null else value * 2 end as duration_s from events)""",
}
#: Views that build on others.
COMMON |= {
    "classified": """classified as (
      select *, case when contains(file_name, 'bhairavi') then 0 when contains(file_name, 'yaman') then 1 end as rule from recordings)""",
    "drawn": """drawn as (
      select *, cast('0x' || substr(md5('raga' || file_name), 1, 8) as ubigint) % 8 as d_raga, cast('0x' || substr(md5('tala' || file_name), 1, 8) as ubigint) % 6 as d_tala,
        60 + cast('0x' || substr(md5('tempo' || file_name), 1, 8) as ubigint) % 40 as d_tempo,
        cast(0.4 as double) + cast(cast('0x' || substr(md5('confidence' || file_name), 1, 8) as ubigint) % 1000 as double) / cast(2000 as double) as d_confidence from classified)""",
    "analyses": """analyses as (
      select d.recording_id, d.session_id, d.file_name, d.rule, r.id as raga_id, r.name as raga_name, r.time as raga_time, r.mood as raga_mood,
        t.id as tala_id, t.name as tala_name, t.beats, t.pattern as tala_pattern, cast(coalesce(f.tempo, d.d_tempo) as int) as tempo,
        coalesce(cast(f.confidence as double), d.d_confidence) as confidence, coalesce(f.notes, ['Sa','Re','Ga','Ma','Pa','Dha','Ni']) as notes
      from drawn d left join dim_file_rule f on f.priority = d.rule
      left join dim_raga r on case when f.priority is null then r.ordinal = d.d_raga else r.id = f.raga_id end
      left join dim_tala t on case when f.priority is null then t.ordinal = d.d_tala else t.id = f.tala_id end)""",
    "resolved": """resolved as (
      select q.*, r.name as raga_name, t.name as tala_name, t.beats, s.name as style_name
      from requests q left join dim_raga r on r.id = q.raga left join dim_tala t on t.id = q.tala left join dim_style s on s.id = q.style)""",
    "compositions": f"""compositions as (
      select request_id, session_id, 'comp_' || cast(epoch_us(requested_at) // 1000 as varchar) as id, raga as raga_id, raga_name, tala as tala_id, tala_name, beats, style as style_id, style_name,
        tempo, duration, creativity, {literal(catalog.AUDIO_BASE)} || raga || '_' || tala || '_' || cast(tempo as varchar) || 'bpm.mp3' as audio_url,
        epoch_us(requested_at) // 1000 as generated_ms
      from resolved where raga_name is not null and tala_name is not null and style_name is not null)""",
    "finals": """finals as (
      select session_id, file_event, case when cleared is null or analysed > cleared then analysed end as analysis_event, composition_event from (
        select session_id, max(event_id) filter (action = 'SELECT_FILE') as file_event, max(event_id) filter (action = 'ANALYZE_OK') as analysed,
          max(event_id) filter (action in ('SELECT_FILE', 'RESET_ANALYSIS')) as cleared, max(event_id) filter (action = 'GENERATE_OK') as composition_event
        from session_events group by session_id) x)""",
    "touched": """touched as (
      select s.session_id, s.toast, s.first_payload, e.ts, e.action, e.payload
      from (select session_id, arg_max(event_id, ts) as toast, arg_max(payload, ts) as first_payload, max(ts) as shown_at from notification_events where action = 'ADD' group by session_id) s
      left join notification_events e on e.session_id = s.session_id and e.ts > s.shown_at and e.action <> 'ADD'
        and (e.toast_id = s.toast or (e.toast_id is null and e.action in ('DISMISS', 'REMOVE'))))""",
    "canonical": """canonical as (
      select distinct recording_id, regexp_replace(note, '^(Komal|Tivra) (Sa|Re|Ga|Ma|Pa|Dha|Ni)$', '\\2 \\1') as note from note_observations)""",
    "raga_notes": """raga_notes as (
      select distinct id, ordinal, regexp_replace(note, '^(Komal|Tivra) (Sa|Re|Ga|Ma|Pa|Dha|Ni)$', '\\2 \\1') as note from (select id, ordinal, unnest(notes) as note from dim_raga) x)""",
    "scores": """scores as (
      select s.recording_id, s.id as raga_id, s.ordinal, cast(s.shared as double) / cast(o.n + z.n - s.shared as double) as score
      from (select c.recording_id, r.id, r.ordinal, count(*) as shared from canonical c join raga_notes r on r.note = c.note group by all) s
      join (select recording_id, count(*) as n from canonical group by 1) o on o.recording_id = s.recording_id
      join (select id, count(*) as n from raga_notes group by 1) z on z.id = s.id)""",
    "ranked": """ranked as (
      select *, row_number() over (partition by recording_id order by score desc, ordinal) as rank from scores)""",
    "tempos": """tempos as (
      select recording_id, cast(floor(60000 / nullif(median(gap), 0) + 0.5) as int) as tempo
      from (select recording_id, onset_ms - lag(onset_ms) over (partition by recording_id order by onset_ms, k) as gap from onsets) x group by recording_id)""",
    "tala_beats": """tala_beats as (
      select id, beats, section - 1 as section, row_number() over (partition by id order by section, place) - 1 as beat, syllable
      from (select id, beats, section, unnest(string_split(part, ' ')) as syllable, generate_subscripts(string_split(part, ' '), 1) as place
        from (select id, beats, unnest(string_split(pattern, ' | ')) as part, generate_subscripts(string_split(pattern, ' | '), 1) as section from dim_tala) x) y)""",
    "timeline": """timeline as (
      select c.request_id, c.tala_id, b, b // c.beats as cycle, b % c.beats as beat, t.syllable, (b * 60000) // c.tempo as offset_ms
      from (select request_id, tala_id, beats, tempo, unnest(range(0, duration * tempo // 60)) as b from compositions) c
      join tala_beats t on t.id = c.tala_id and t.beat = b % c.beats)""",
    "tala_found": """tala_found as (
      select x.request_id, k.id as tala_id
      from (select request_id, string_agg(syllable, ' ' order by beat) as key from timeline where cycle = 0 group by request_id) x
      join (select id, string_agg(syllable, ' ' order by beat) as key from tala_beats group by id) k on k.key = x.key)""",
    "content": """content as (
      select coalesce(m.recording_id, t.recording_id) as recording_id, case when m.score >= 0.5 then m.raga_id end as raga_id, m.score as confidence, t.tempo, f.tala_id
      from (select * from ranked where rank = 1) m full join tempos t on t.recording_id = m.recording_id
      left join tala_found f on f.request_id = coalesce(m.recording_id, t.recording_id))""",
}

FIRST = [literal(table[0][0]) for table in (catalog.RAGAS, catalog.TALAS, catalog.STYLES)]
LEVEL = "case when floor(confidence * 100 + 0.5) >= 80 then 'high' when floor(confidence * 100 + 0.5) >= 60 then 'medium' else 'low' end"
MINUTES = "cast(cast(floor(floor({0}) / 60) as bigint) as varchar) || ':' || lpad(cast(cast(floor({0}) as bigint) % 60 as varchar), 2, '0')"


def catalog_sql(dim: str, key: str, columns: str) -> str:
    return f"select {columns}, count(q.request_id) as n_requests from {dim} d left join requests q on q.{key} = d.id group by all order by d.ordinal"


def lookup_sql(dim: str, key: str) -> str:
    return f"select q.request_id, q.{key} as id, d.name, d.description from requests q left join {dim} d on d.id = q.{key}"


BODIES = {
    "catalog_ragas": catalog_sql("dim_raga", "raga", "d.ordinal, d.id, d.name, d.time, d.mood, d.description, array_to_string(d.notes, ',') as notes"),
    "catalog_talas": catalog_sql("dim_tala", "tala", "d.ordinal, d.id, d.name, d.beats, d.description, d.pattern"),
    "catalog_styles": catalog_sql("dim_style", "style", "d.ordinal, d.id, d.name, d.description"),
    "known_analyses": "select f.priority, f.pattern, r.name as raga_name, t.name as tala_name, f.tempo, cast(f.confidence as double) as confidence, array_to_string(f.notes, ',') as notes, (select count(*) from classified c where c.rule = f.priority) as n_recordings from dim_file_rule f join dim_raga r on r.id = f.raga_id join dim_tala t on t.id = f.tala_id",
    "audio_recordings": "select recording_id, session_id, file_name from recordings where regexp_matches(file_name, '\\.(mp3|wav|flac)$')",
    "composition_export": "select request_id, id, raga_id, tala_id, style_id, audio_url from compositions",
    "raga_labels": "select q.request_id, r.name || ' - ' || r.mood as label from requests q left join dim_raga r on r.id = q.raga",
    "tala_labels": "select request_id, tala_name || ' (' || cast(beats as varchar) || ' beats)' as tala_label, style_name as style_label from resolved",
    "raga_by_id": lookup_sql("dim_raga", "raga"),
    "tala_by_id": lookup_sql("dim_tala", "tala"),
    "style_by_id": lookup_sql("dim_style", "style"),
    "catalog_defaults": f"select request_id, coalesce(nullif(raga, ''), {FIRST[0]}) as raga, coalesce(nullif(tala, ''), {FIRST[1]}) as tala, coalesce(nullif(style, ''), {FIRST[2]}) as style from requests",
    "mood_tokens": "select q.request_id, cast(m.place - 1 as int) as place, m.mood from requests q join (select id, unnest(string_split(mood, ', ')) as mood, generate_subscripts(string_split(mood, ', '), 1) as place from dim_raga) m on m.id = q.raga",
    "tala_beats": "select b.id, cast(b.section as int) as section, cast(b.beat as int) as beat, b.syllable, (select count(*) from requests q where q.tala = b.id) as n_requests from tala_beats b",
    "raga_categories": """select kind, category, string_agg(id, ',' order by ordinal) as members, cast(sum(n) as bigint) as n_requests from (
        select 'time' as kind, time as category, ordinal, id from dim_raga union all select 'mood', unnest(string_split(mood, ', ')), ordinal, id from dim_raga) c
      join (select d.id as raga, count(q.request_id) as n from dim_raga d left join requests q on q.raga = d.id group by d.id) k on k.raga = c.id group by kind, category""",
    "confidence_levels": f"select recording_id, cast(floor(confidence * 100 + 0.5) as bigint) as pct, {LEVEL} as level from analyses",
    "creativity_bands": "select request_id, creativity, case when creativity < 33 then 'Conservative' when creativity < 66 then 'Balanced' else 'Experimental' end as band from requests",
    "duration_format": f"select request_id, {MINUTES.format('duration')} as text from requests",
    "position_format": f"select event_id, {MINUTES.format('position_s')} as position, {MINUTES.format('duration_s')} as duration from playback",
    "playback_progress": "select event_id, case when duration_s is null or isnan(duration_s) or duration_s = 0 then 0.0::double else position_s / duration_s * 100 end as progress from playback",
    "analysis_messages": f"select recording_id, case when raga_name is null then {literal(catalog.UNDETECTED_MESSAGE)} else {filled("analysis_ok", name="raga_name", pct="cast(cast(floor(confidence * 100 + 0.5) as bigint) as varchar)")} end as message from analyses",
    "composition_messages": f"select request_id, {filled('generation_ok', duration='cast(duration as varchar)', name='raga_name')} as message from compositions",
    "notification_texts": "select e.event_id, m.kind, m.title, m.text_template, m.severity from session_events e join dim_message m on m.kind = case e.action when 'ANALYZE_OK' then 'analysis_ok' when 'ANALYZE_ERR' then 'analysis_failed' when 'GENERATE_OK' then 'generation_ok' end",
    "message_catalogue": """select m.kind, m.title, m.text_template, m.severity, case m.kind
        when 'analysis_ok' then (select count(*) from session_events where action = 'ANALYZE_OK') when 'analysis_failed' then (select count(*) from session_events where action = 'ANALYZE_ERR')
        when 'generation_ok' then (select count(*) from session_events where action = 'GENERATE_OK')
        when 'generation_failed' then (select count(*) from resolved where raga_name is null or tala_name is null or style_name is null)
        when 'no_file' then (select count(*) from recordings where not regexp_matches(file_name, '\\.(mp3|wav|flac)$')) end as n_shown from dim_message m""",
    "analysis_cards": f"select recording_id, cast(floor(confidence * 100 + 0.5) as bigint) as pct, {LEVEL} as level, raga_name, raga_time, raga_mood, tala_name || ' (' || cast(beats as varchar) || ' beats)' as tala_label, tala_pattern, cast(nullif(tempo, 0) as varchar) || ' BPM' as tempo_text, cast(null as varchar) as undetected_text from analyses",
    "composition_cards": "select request_id, raga_name, tala_name || ' (' || cast(beats as varchar) || ' beats)' as tala_label, style_name, cast(tempo as varchar) || ' BPM' as tempo_text from compositions",
    "analysis_notes": "select recording_id, cast(place - 1 as int) as place, note from (select recording_id, unnest(notes) as note, generate_subscripts(notes, 1) as place from analyses) x",
    "settings_from_edits": "select session_id, " + ", ".join(f"arg_max(value, event_id) filter (setting = '{k}') as {k}" for k in ("raga", "tala", "style", "tempo", "duration", "creativity")) + " from settings_edits group by session_id",
    "canonical_notes": "select c.note, o.n, count(*) as n_recordings from canonical c join (select regexp_replace(note, '^(Komal|Tivra) (Sa|Re|Ga|Ma|Pa|Dha|Ni)$', '\\2 \\1') as note, count(*) as n from note_observations group by 1) o on o.note = c.note group by all",
    "submit_gate": "select request_id, coalesce(raga, '') <> '' and coalesce(tala, '') <> '' and coalesce(style, '') <> '' as can_submit from requests",
    "rejected_requests": "select request_id, concat_ws(',', case when raga_name is null then 'raga' end, case when tala_name is null then 'tala' end, case when style_name is null then 'style' end) as missing from resolved where raga_name is null or tala_name is null or style_name is null",
    "domain_violations": "select request_id, concat_ws(',', case when tempo not between 40 and 200 then 'tempo' end, case when duration not between 30 and 300 or duration % 30 <> 0 then 'duration' end, case when creativity not between 0 and 100 then 'creativity' end) as violations from requests",
    "undetected_recordings": "select recording_id, confidence from content where raga_id is null",
    "resolved_requests": "select request_id, raga_name, tala_name, style_name from resolved",
    "classify_recordings": "select recording_id, cast(rule as int) as rule from classified",
    "compose": "select request_id, session_id, id, raga_id, raga_name, tala_id, beats, style_id, tempo, duration, creativity, audio_url, generated_ms from compositions",
    "analyze": "select recording_id, session_id, file_name, cast(rule as int) as rule, raga_id, raga_name, tala_id, tempo, confidence, array_to_string(notes, ',') as notes from analyses",
    "default_assignment": "select recording_id, cast(d_raga as int) as raga_ordinal, cast(d_tala as int) as tala_ordinal, cast(d_tempo as int) as tempo, d_confidence as confidence from drawn where rule is null",
    "prefilled_settings": f"select f.session_id, coalesce(nullif(a.raga_id, ''), {FIRST[0]}) as raga, coalesce(nullif(a.tala_id, ''), {FIRST[1]}) as tala, {FIRST[2]} as style, cast(coalesce(nullif(a.tempo, 0), {catalog.DEFAULT_TEMPO}) as int) as tempo, {catalog.DEFAULT_DURATION} as duration, {catalog.DEFAULT_CREATIVITY} as creativity from finals f left join analyses a on a.recording_id = f.analysis_event",
    "latest_notifications": "select session_id, cast(rank as int) as rank, toast_id, payload from (select session_id, event_id as toast_id, payload, row_number() over (partition by session_id order by ts desc) as rank from notification_events where action = 'ADD') x where rank <= 3",
    "session_state": """select event_id, session_id, file_event, case when cleared is null or analysed > cleared then analysed end as analysis_event, composition_event, file_event is not null as can_analyze, composition_event is not null as can_play from (
        select event_id, session_id, max(case when action = 'SELECT_FILE' then event_id end) over w as file_event, max(case when action = 'ANALYZE_OK' then event_id end) over w as analysed,
          max(case when action in ('SELECT_FILE', 'RESET_ANALYSIS') then event_id end) over w as cleared, max(case when action = 'GENERATE_OK' then event_id end) over w as composition_event
        from session_events window w as (partition by session_id order by ts rows between unbounded preceding and current row)) x""",
    "session_final_state": "select session_id, file_event, analysis_event, composition_event from finals",
    "stale_results": "select c.recording_id, c.session_id from analysis_calls c where exists (select 1 from session_events e where e.session_id = c.session_id and e.action = 'SELECT_FILE' and e.ts > c.requested_at and e.ts <= c.completed_at)",
    "notification_state": "select session_id, toast as toast_id, coalesce(arg_max(payload, ts) filter (action = 'UPDATE'), first_payload) as payload, not coalesce(bool_or(action = 'DISMISS'), false) as open from touched group by session_id, toast, first_payload having not coalesce(bool_or(action = 'REMOVE'), false)",
    "notification_expiry": "select session_id, toast_id, expires_ms, expires_ms > (select max(epoch_us(ts) // 1000) from notification_events) as alive from (select session_id, toast as toast_id, min(epoch_us(ts) // 1000) filter (action = 'DISMISS') + 1000000 as expires_ms from touched group by session_id, toast) x where expires_ms is not null",
    "notification_sequence": "select event_id, session_id, cast(row_number() over (partition by session_id order by ts) as varchar) as toast_number from notification_events where action = 'ADD'",
    "raga_match": "select recording_id, raga_id, score as confidence from ranked where rank = 1",
    "raga_candidates": "select recording_id, cast(rank as int) as rank, raga_id, score from ranked where rank <= 3",
    "tempo_estimate": "select recording_id, tempo from tempos",
    "tala_match": "select request_id, tala_id from tala_found",
    "content_analysis": "select recording_id, raga_id, confidence, tempo, tala_id from content",
    "composition_timeline": "select request_id, cast(beat as int) as beat, syllable, count(*) as n, min(offset_ms) as first_ms, max(offset_ms) as last_ms, cast(sum(offset_ms) as bigint) as sum_ms, cast(max(cycle) as int) as last_cycle from timeline group by request_id, beat, syllable",
    "pending_calls": "select recording_id, session_id from analysis_calls where completed_at is null",
    "accepted_calls": """select c.recording_id, c.session_id, a.recording_id is not null as accepted from analysis_calls c left join (
        with recursive n as (select *, row_number() over (partition by session_id order by requested_at, recording_id) as i from analysis_calls),
        fold as (select session_id, i, recording_id, requested_at as last, true as accepted from n where i = 1
          union all select n.session_id, n.i, n.recording_id, case when n.requested_at >= f.last + interval 6 hours then n.requested_at else f.last end, n.requested_at >= f.last + interval 6 hours
          from fold f join n on n.session_id = f.session_id and n.i = f.i + 1)
        select recording_id from fold where accepted) a on a.recording_id = c.recording_id""",
    "stream_analyze": "select recording_id, raga_id, tala_id, tempo, confidence from analyses",
    "stream_compose": """select request_id, true as accepted, audio_url as detail from compositions union all
      select request_id, false, concat_ws(',', case when raga_name is null then 'raga' end, case when tala_name is null then 'tala' end, case when style_name is null then 'style' end) from resolved where raga_name is null or tala_name is null or style_name is null""",
    "stream_session_state": "select session_id, file_event, analysis_event, composition_event from finals",
    "stream_distinct_requests": "select request_id, session_id from requests",
}
BODIES["stream_in_flight"] = BODIES["accepted_calls"]
BODIES["stream_pending"] = BODIES["pending_calls"]
BODIES["stream_expiry"] = """select session_id, toast_id, dismissed + 1000000 as expires_ms from (
    select a.session_id, a.event_id as toast_id, a.next_ms, min(epoch_us(e.ts) // 1000) as dismissed
    from (select session_id, event_id, ts, lead(ts) over w as next, lead(epoch_us(ts) // 1000) over w as next_ms from notification_events where action = 'ADD' window w as (partition by session_id order by ts)) a
    join notification_events e on e.session_id = a.session_id and e.action = 'DISMISS' and e.ts > a.ts and (a.next is null or e.ts < a.next)
    group by a.session_id, a.event_id, a.next_ms) x
  where next_ms is null or dismissed + 1000000 <= next_ms"""


def needed(text: str) -> list[str]:
    """The views that a text names, each after those that it builds on."""
    found: list[str] = []

    def visit(part: str) -> None:
        for name in COMMON:
            if name not in found and re.search(rf"(?:from|join)\s+{name}\b", part):
                visit(COMMON[name])
                found.append(name)

    visit(text)
    return found


def oracle_sql() -> dict[str, str]:
    made = {}
    for name, body in BODIES.items():
        views = [COMMON[v] for v in needed(body)]
        made[name] = (f"with {', '.join(views)}\n" if views else "") + body
    return made
