"""DuckDB SQL with the rows of each catalogue query, written from the definitions, not from the Spark code."""

from __future__ import annotations

AUDIT = """
raw as (select event_id as id, user_id as insured_id, ts as created_at, event_type as action, cast(json_extract(props, '$.k') as int) as k, value from events),
audit as (
  select id, insured_id, created_at, action, action as type, case when action = 'error' then 'KO' else 'OK' end as status,
    'D' || (k % 3) as device, '10.0.0.' || (k % 7) as ip, ['FR', 'BE', 'DE', 'ES', 'IT'][k % 5 + 1] as country_code, '/r' || (k % 4) as route,
    cast(action = 'purchase' as int) as is_download_action, case k % 10 when 0 then 'geo_jump' when 1 then 'skip_login' else 'normal' end as anomaly_type,
    cast(k % 10 < 2 as int) as is_anomaly, k
  from raw
)"""
SESSIONS = AUDIT + """,
gapped as (
  select *, case when epoch_us(created_at) - lag(epoch_us(created_at)) over (partition by insured_id order by created_at, id) >= 86400000000 then 1 else 0 end as opens from audit
),
sess as (select * exclude opens, insured_id || '-' || sum(opens) over (partition by insured_id order by created_at, id) as session_id, epoch_us(created_at) as us from gapped)"""
ENRICHED = SESSIONS + """,
step1 as (
  select *, row_number() over w as rn, coalesce(lag(action) over w, '') as prev_action, coalesce(lead(action) over w, '') as next_action,
    greatest(0, floor((max(us) over s - min(us) over s) / 1e6)) as session_duration_seconds, coalesce(floor((us - lag(us) over w) / 1e6), 0) as delta,
    cast(ip <> first(ip) over w as int) as is_ip_changed, cast(device <> first(device) over w as int) as is_device_changed,
    len(list_distinct(list(ip) over w)) as unique_ips, len(list_distinct(list(device) over w)) as unique_devices,
    sum(cast(status = 'KO' as int)) over w as cumulative_kos,
    coalesce(max(cast(action = 'signup' as int)) over (w rows between unbounded preceding and 1 preceding), 0) as has_logged_in,
    sum(is_download_action) over w as downloads,
    len(list_filter(list(us) filter (where is_download_action = 1) over w, lambda x: floor((us - x) / 1e6) <= 43200)) as recent,
    cast(coalesce(action = lag(action, 2) over w and action <> lag(action) over w, false) as int) as pong,
    sum(cast(status <> 'KO' as int)) over w as island
  from sess window w as (partition by session_id order by created_at, id), s as (partition by session_id)
),
step2 as (
  select *, coalesce(recent, 0) as downloads_recent, sum(pong) over w as ping_pong,
    case when status = 'KO' then sum(cast(status = 'KO' as int)) over (partition by session_id, island order by created_at, id) else 0 end as streak
  from step1 window w as (partition by session_id order by created_at, id)
),
enriched as (
  select *, max(streak) over (partition by session_id order by created_at, id) as longest_ko_streak,
    least(100, 30 * is_ip_changed + 10 * cast(status = 'KO' as int) + 25 * is_device_changed + 15 * cast(hour(created_at) between 2 and 4 as int)
      + 15 * cast(delta between 1 and 3600 as int) + 15 * cast(cumulative_kos >= 3 as int) + 20 * cast(downloads_recent >= 10 as int)
      + 15 * cast(ping_pong >= 2 as int) + 10 * cast(anomaly_type = 'geo_jump' as int) + 15 * cast(anomaly_type = 'skip_login' and has_logged_in = 0 as int)) as risk
  from step2
)"""
SUMMARY = ENRICHED + """,
kinds as (
  select session_id, arg_min(anomaly_type, (-n, first_at, first_id)) as primary_type from (
    select session_id, anomaly_type, count(*) as n, min(created_at) as first_at, arg_min(id, (created_at, id)) as first_id from enriched where anomaly_type <> 'normal' group by all
  ) group by session_id
),
summary as (
  select e.insured_id, e.session_id, count(*) as total_events, count(distinct action) as unique_actions, count(distinct route) as unique_routes,
    count(distinct ip) as unique_ips_used, count(distinct device) as unique_devices_used, count(*) filter (where status = 'KO') as total_kos,
    count(*) filter (where status = 'OK') as total_oks, max(longest_ko_streak) as longest_ko_streak, max(cast(action = 'signup' as int)) as has_login,
    max(cast(action = 'error' as int)) as has_logout, max(is_ip_changed) as ip_changed, max(is_device_changed) as device_changed,
    sum(is_download_action) as total_download_actions, max(downloads_recent) as max_downloads_in_2_minutes, max(ping_pong) as ping_pong_count,
    max(risk) as risk_score_max, avg(risk) as risk_score_avg, sum(is_anomaly) as anomaly_event_count, min(created_at) as session_start, max(created_at) as session_end,
    arg_min(action, (created_at, id)) as first_action, arg_max(action, (created_at, id)) as last_action, arg_min(route, (created_at, id)) as first_route,
    arg_max(route, (created_at, id)) as last_route, max(session_duration_seconds) as total_duration_seconds,
    coalesce(avg(delta) filter (where rn > 1), 0) as avg_inter_action_seconds, coalesce(min(delta) filter (where rn > 1), 0) as min_inter_action_seconds,
    coalesce(max(delta) filter (where rn > 1), 0) as max_inter_action_seconds,
    cast(max(cast(action = 'error' as int)) = 0 and count(*) >= 3 as int) as ended_abruptly,
    string_agg(action, ' > ' order by created_at, id) as action_signature, string_agg(route, ' > ' order by created_at, id) as route_signature,
    list(anomaly_type order by created_at, id) filter (where anomaly_type <> 'normal') as type_list
  from enriched e group by e.insured_id, e.session_id
),
summed as (select s.*, coalesce(primary_type, 'normal') as primary_anomaly_type from summary s left join kinds using (session_id))"""
FLAGS = SUMMARY + """,
fails as (
  select session_id, max(n) as run from (
    select session_id, island, count(*) as n from step1 where status = 'KO' and type = 'error' group by all
  ) group by session_id
),
firsts as (select session_id, arg_min(country_code, (created_at, id)) as country from sess group by session_id),
moves as (
  select session_id, floor((us - lag(us, 2) over w) / 1e6) as span, floor((us - lag(us) over w) / 1e6) as pause from sess window w as (partition by session_id order by created_at, id)
),
flags as (
  select s.insured_id, s.session_id,
    exists(select 1 from sess x where x.session_id = s.session_id and hour(x.created_at) between 2 and 4) as unusual_hour,
    s.first_action not in ('signup', 'view') as skip_login, coalesce(f.run >= 2, false) as repeated_fail,
    coalesce((select min(span) <= 43200 from moves m where m.session_id = s.session_id), false) as rapid_fire,
    exists(select 1 from sess x join firsts using (session_id) where x.session_id = s.session_id and x.country_code <> firsts.country) as geo_jump,
    s.device_changed = 1 as device_switch, s.max_downloads_in_2_minutes >= 3 as download_spike, s.ping_pong_count >= 2 as api_scraping,
    coalesce((select max(pause) > 43200 from moves m where m.session_id = s.session_id), false) as session_timeout
  from summed s left join fails f using (session_id)
)"""
RULED = FLAGS + """,
points as (
  select s.*, f.* exclude (insured_id, session_id),
    25.0 * unusual_hour::int + 30.0 * skip_login::int + 35.0 * repeated_fail::int + 30.0 * rapid_fire::int + 40.0 * geo_jump::int + 35.0 * device_switch::int
      + 40.0 * download_spike::int + 35.0 * api_scraping::int + 20.0 * session_timeout::int as own,
    s.device_changed = 1 and not device_switch as x1, s.ip_changed = 1 and not geo_jump as x2, s.total_kos >= 3 and not repeated_fail as x3,
    s.max_downloads_in_2_minutes >= 10 and not download_spike as x4, s.ping_pong_count >= 2 and not api_scraping as x5
  from summed s join flags f using (session_id)
),
ruled as (
  select *, least(100.0, own + 25.0 * x1::int + 25.0 * x2::int + 20.0 * x3::int + 30.0 * x4::int + 20.0 * x5::int) as rule_score,
    list_filter([case when unusual_hour then 'OFF_HOURS_ACCESS' end, case when skip_login then 'SKIP_LOGIN' end, case when repeated_fail then 'STATUS_CODE_BURST' end,
      case when rapid_fire then 'RAPID_FIRE_EVENTS' end, case when geo_jump then 'COUNTRY_SWITCH' end, case when device_switch then 'DEVICE_SWITCH' end,
      case when download_spike then 'LARGE_DOWNLOAD' end, case when api_scraping then 'API_SCRAPING_PATTERN' end, case when session_timeout then 'SESSION_TIMEOUT' end,
      case when x1 then 'DEVICE_SWITCH' end, case when x2 then 'COUNTRY_SWITCH' end, case when x3 then 'STATUS_CODE_BURST' end, case when x4 then 'LARGE_DOWNLOAD' end,
      case when x5 then 'API_SCRAPING_PATTERN' end], lambda x: x is not null) as rule_codes,
    least(30.0, 10.0 * cast(not (hour(session_end) >= 8 and hour(session_end) < 19) as int) + 5.0 * ended_abruptly) as business_context_score
  from points
),
boosted as (
  select *, least(10.0, 5.0 * cast(len(rule_codes) >= 3 as int) + 3.0 * cast(list_contains(rule_codes, 'STATUS_CODE_BURST') and list_contains(rule_codes, 'RAPID_FIRE_EVENTS') as int)) as boost
  from ruled
)"""
FUSED = RULED + """,
scores as (
  select *, total_events as n,
    case when total_events % 5 <> 0 then cast((total_events * 7 + total_kos * 13) % 101 as double) end as xgb,
    case when total_kos % 4 <> 3 then cast((total_events * 11 + ping_pong_count * 17) % 101 as double) end as lgbm,
    case when unique_routes <> 2 then cast((total_events * 5 + total_download_actions * 19) % 101 as double) end as tra,
    case when total_events % 3 <> 0 then cast((total_events * 3 + unique_ips_used * 23) % 101 as double) end as tcn,
    cast((total_events * 29) % 101 as double) as cat, cast((total_events * 31 + total_kos) % 101 as double) as svm
  from boosted
),
weights as (
  select *, 0.30 * (xgb is not null)::int + 0.25 * (lgbm is not null)::int + 0.20 * (tra is not null)::int + 0.10 * (tcn is not null)::int as have from scores
),
shared as (
  select *, case when have > 0 then 0.85 / have end as f, coalesce(xgb, 0) as x, coalesce(lgbm, 0) as l, coalesce(tra, 0) as t, coalesce(tcn, 0) as c from weights
),
fused as (
  select *, greatest(0, least(100, case when have = 0 then rule_score + boost else f * (0.30 * x + 0.25 * l + 0.20 * t + 0.10 * c) + 0.15 * rule_score + boost end)) as final,
    case when have = 0 then 'RULES_ONLY' when xgb is not null and lgbm is not null and tra is not null and tcn is not null then 'FULL_HYBRID'
      when tra is null and tcn is null then 'TABULAR_RULES' when xgb is null and lgbm is null then 'SEQUENCE_RULES' else 'PARTIAL_HYBRID' end as mode,
    greatest(x, l, t, c) as ai, greatest(t, c) as seq
  from shared
),
leveled as (
  select *, case when final >= 80 then 'CRITICAL' when final >= 60 then 'HIGH' when final >= 35 then 'MEDIUM' else 'LOW' end as level,
    case when x >= 60 and list_contains(rule_codes, 'API_SCRAPING_PATTERN') and ping_pong_count >= 2 then 1
      when (list_contains(rule_codes, 'STATUS_CODE_BURST') or total_kos >= 3) and n % 2 = 0 and seq >= 50 then 2
      when list_contains(rule_codes, 'LARGE_DOWNLOAD') and n % 2 = 1 and (x >= 55 or cat >= 55) then 3
      when list_contains(rule_codes, 'OFF_HOURS_ACCESS') and (list_contains(rule_codes, 'COUNTRY_SWITCH') or list_contains(rule_codes, 'DEVICE_SWITCH') or svm >= 55) then 4
      when (list_contains(rule_codes, 'COUNTRY_SWITCH') or list_contains(rule_codes, 'DEVICE_SWITCH')) and seq >= 55 then 5
      when seq >= 60 and rule_score < 35 then 6 when final >= 60 then 7 else 8 end as kind
  from fused
),
typed as (
  select *, ['api_scraping', 'credential_stuffing', 'data_exfiltration', 'off_hours_compromise', 'session_hijacking', 'behavioral_sequence_anomaly', 'unknown_suspicious_behavior', 'unknown_suspicious_behavior'][kind] as attributed,
    [0.82, 0.80, 0.82, 0.78, 0.76, 0.68, 0.55, 0.45][kind] as sure, final >= 35 as is_anomaly, final >= 35 or final >= 60 or ai >= 60 as eligible
  from leveled
),
analysis as (
  select *, session_end as end_time, hour(session_start) as start_hour, hour(session_end) as end_hour,
    case when n % 7 <> 0 then ((n * 37) % 100) / 100.0 end as churn, case when n % 5 <> 4 then n % 5 end as cluster
  from typed
)"""
ALERTS = ENRICHED + """,
base as (
  select id as event_id, insured_id, session_id, created_at as timestamp, created_at, risk, case when risk >= 80 then 'CRITICAL' when risk >= 60 then 'HIGH' else 'MEDIUM' end as risk_level,
    anomaly_type, action as event_action, case when k % 2 = 0 then device end as device, case when k % 4 < 2 then country_code end as country, 0 as position, device as full_device, country_code as full_country
  from enriched where risk >= 35
),
alerts as (
  select * from base union all
  select event_id, insured_id, session_id, timestamp, created_at, risk, risk_level, anomaly_type, '', null, country, 1, full_device, full_country from base where event_id % 3 = 0
)"""
STEPS = SESSIONS + """,
pairs as (select session_id, action as a, lead(action) over (partition by session_id order by created_at, id) as b from sess),
counted as (select a, b, count(*) as n from pairs where b is not null group by all),
matrix as (select a, b, n, n / sum(n) over (partition by a) as p from counted)"""
DAYS = AUDIT + """,
spine as (select cast(unnest(generate_series(min(cast(created_at as date)), max(cast(created_at as date)), interval 1 day)) as date) as ds from audit),
days as (
  select ds, count(id) as total_events, coalesce(sum(is_anomaly), 0) as anomaly_events, coalesce(sum(is_download_action), 0) as download_events
  from spine left join audit on cast(created_at as date) = ds group by ds
),
rates as (select *, case when total_events > 0 then anomaly_events / total_events else 0 end as anomaly_rate from days)"""
_LAGS = ", ".join(f"coalesce(lag(cast({c} as double), {n}) over w, 0) as {c}_lag_{n}" for c in ("total_events", "anomaly_rate") for n in (1, 2, 3, 7, 14))
_ROLLS = ", ".join(
    f"coalesce(sum({c}) over v, 0) / 7 as {c}_roll_mean_7, sqrt(greatest(0, coalesce(sum(cast({c} as double) * {c}) over v, 0) / 7 - power(coalesce(sum({c}) over v, 0) / 7, 2))) as {c}_roll_std_7"
    for c in ("total_events", "anomaly_rate")
)
LAGGED = DAYS + f""",
lagged as (select ds, total_events, anomaly_rate, {_LAGS}, {_ROLLS} from rates window w as (order by ds), v as (order by ds rows between 7 preceding and 1 preceding))"""


def _sql(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body.strip()}"


def whole(*names: str) -> str:
    return ", ".join(f"cast({n.split(' as ')[0]} as bigint) as {n.split(' as ')[-1]}" for n in names)


def real(*names: str) -> str:
    return ", ".join(f"round(cast({n.split(' as ')[0]} as double), 6) as {n.split(' as ')[-1]}" for n in names)


_RANGE = "timestamp '2024-01-25 00:00:00'"
_KEY = "insured_id, session_id"
_ANOMALY = "risk_level, anomaly_type"

SQL: dict[str, str] = {
    "enrich_prev_next": _sql(ENRICHED, "select id, prev_action, next_action from enriched"),
    "enrich_time_delta": _sql(ENRICHED, f"select id, {whole('delta as time_delta_since_last_action', 'session_duration_seconds')} from enriched"),
    "enrich_ip_device_change": _sql(ENRICHED, f"select id, {whole('is_ip_changed', 'is_device_changed')} from enriched"),
    "enrich_cumulative_distinct": _sql(ENRICHED, f"select id, {whole('unique_ips as unique_ips_in_session', 'unique_devices as unique_devices_in_session')} from enriched"),
    "enrich_ko_cumulative": _sql(ENRICHED, f"select id, {whole('cumulative_kos')} from enriched"),
    "enrich_ko_streak": _sql(ENRICHED, f"select id, {whole('longest_ko_streak')} from enriched"),
    "enrich_logged_in_before": _sql(ENRICHED, f"select id, {whole('has_logged_in')} from enriched"),
    "enrich_downloads_trailing": _sql(ENRICHED, f"select id, {whole('downloads_recent as downloads_last_2_minutes', 'downloads as download_actions_in_session')} from enriched"),
    "enrich_ping_pong": _sql(ENRICHED, f"select id, {whole('ping_pong as ping_pong_count')} from enriched"),
    "enrich_event_risk": _sql(ENRICHED, f"select id, {real('risk as session_risk_score')} from enriched"),
    "time_parts": _sql(AUDIT, f"select id, {whole('hour(created_at) as hour', 'isodow(created_at) - 1 as dow', '(isodow(created_at) > 5)::int as is_weekend')} from audit"),
    "cyclic_time": _sql(AUDIT, f"select id, {real('sin(2 * pi() * hour(created_at) / 24) as hour_sin', 'cos(2 * pi() * hour(created_at) / 24) as hour_cos', 'sin(2 * pi() * (isodow(created_at) - 1) / 7) as dow_sin', 'cos(2 * pi() * (isodow(created_at) - 1) / 7) as dow_cos')} from audit"),
    "business_hours_both": _sql(AUDIT, f"select id, {whole('(hour(created_at) between 8 and 18)::int as encoder', '(hour(created_at) between 9 and 18)::int as running')} from audit"),
    "field_fallback": _sql(AUDIT, "select id, case when k % 2 = 0 then 'p' || k else route end as place from audit"),
    "text_key": "select item_id, trim(lower(replace(strip_accents(trim(text)), '’', ''''))) as text_key from benchmark",
    "idempotency_key": _sql(AUDIT, "select id, case when k % 2 = 0 then cast(id as varchar) else sha256(insured_id || '|' || action || '|' || case when k % 3 = 0 then device else '' end || '|' || k) end as event_key from audit"),
    "download_hint": _sql(AUDIT, "select id, is_download_action = 1 or k % 5 = 0 as is_download from audit"),
    "score_scales": _sql(AUDIT, f"select id, {real('1 / (1 + exp(-(k / 10 - 5))) as sigmoid', '100 * (1 - exp(-(k / 10) / 5.0)) as saturated')}, case when k >= 80 then 'CRITICAL' when k >= 60 then 'HIGH' when k >= 35 then 'MEDIUM' else 'LOW' end as level from audit"),
    "event_dedup": _sql(AUDIT, "select insured_id, count(*) as events from audit group by insured_id"),
    "status_normalized": _sql(AUDIT, "select id, case k % 3 when 0 then 'OK' when 1 then 'KO' else status end as status from audit"),
    "session_boundaries": _sql(SESSIONS, f"select {_KEY}, min(us) as start_time, max(us) as end_time, count(*) as events from sess group by all"),
    "session_max_duration": "with recursive " + SESSIONS.strip() + """,
numbered as (select insured_id, session_id, us, row_number() over (partition by session_id order by created_at, id) as rn from sess),
walk as (
  select insured_id, session_id, us, rn, 0 as part, us as started from numbered where rn = 1
  union all
  select n.insured_id, n.session_id, n.us, n.rn, case when n.us - w.started >= 172800000000 then w.part + 1 else w.part end, case when n.us - w.started >= 172800000000 then n.us else w.started end
  from walk w join numbered n on n.session_id = w.session_id and n.rn = w.rn + 1
)
select insured_id, session_id, cast(part as bigint) as part, min(us) as start_time, count(*) as events from walk group by all""",
    "session_summary": _sql(SUMMARY, f"""select {_KEY}, {whole('total_events', 'unique_actions', 'unique_routes', 'unique_ips_used', 'unique_devices_used', 'total_kos', 'total_oks', 'longest_ko_streak', 'has_login', 'has_logout', 'ip_changed', 'device_changed', 'total_download_actions', 'max_downloads_in_2_minutes', 'ping_pong_count', 'anomaly_event_count', 'total_duration_seconds', 'ended_abruptly')},
        {real('risk_score_max', 'risk_score_avg', 'avg_inter_action_seconds', 'min_inter_action_seconds', 'max_inter_action_seconds')},
        epoch_us(session_start) as session_start, epoch_us(session_end) as session_end, first_action, last_action, first_route, last_route, primary_anomaly_type,
        action_signature as action_sequence_signature, route_signature as route_sequence_signature from summed"""),
    "session_sequences": _sql(SUMMARY, f"""select {_KEY}, action_signature as action_sequence_signature, route_signature as route_sequence_signature,
        coalesce(case when type_list[1] is null then '' when len(list_distinct(type_list)) = 1 then type_list[1]
          when type_list[1] = 'geo_jump' then 'geo_jump,skip_login' else 'skip_login,geo_jump' end, '') as anomaly_types from summed"""),
    "session_action_histogram": _sql(SESSIONS, f"select {_KEY}, action, count(*) as n from sess group by all"),
    "session_primary_type": _sql(SUMMARY, f"select {_KEY}, primary_anomaly_type, {whole('anomaly_event_count')} from summed"),
    "running_summary": _sql(ENRICHED, f"""select insured_id, id, {whole('rn as events_so_far', 'cumulative_kos as kos_so_far')}, first(action) over w as first_action, action as last_action,
        {real('case when rn > 1 then sum(delta) over w / (rn - 1) else 0 end as avg_pause_so_far', 'max(risk) over w as risk_max_so_far')}
        from enriched window w as (partition by session_id order by created_at, id)"""),
    "session_rapid_fire": _sql(FLAGS, f"select {_KEY}, rapid_fire from flags"),
    "session_timeout_gap": _sql(FLAGS, f"select {_KEY}, session_timeout from flags"),
    "session_geo_jump": _sql(FLAGS, f"select {_KEY}, geo_jump from flags"),
    "session_repeated_fail": _sql(FLAGS, f"select {_KEY}, repeated_fail from flags"),
    "session_flags": _sql(FLAGS, "select * from flags"),
    "session_rules": _sql(FLAGS, f"""select {_KEY}, array_to_string(list_filter([case when unusual_hour then 'unusual_hour' end, case when skip_login then 'skip_login' end,
        case when repeated_fail then 'repeated_fail' end, case when rapid_fire then 'rapid_fire' end, case when geo_jump then 'geo_jump' end, case when device_switch then 'device_switch' end,
        case when download_spike then 'download_spike' end, case when api_scraping then 'api_scraping' end, case when session_timeout then 'session_timeout' end], lambda x: x is not null), ',') as triggered_rules from flags"""),
    "explicit_ends": _sql(AUDIT, "select id, action = 'view' as ends_session, case when action = 'view' then 'explicit_logout' end as end_reason from audit"),
    "rule_score": _sql(RULED, f"select {_KEY}, {real('rule_score')}, array_to_string(rule_codes, ',') as rule_codes, case when rule_score >= 40 then 'HIGH' when rule_score >= 25 then 'MEDIUM' else 'LOW' end as severity from boosted"),
    "business_context": _sql(RULED, f"select {_KEY}, {real('business_context_score')} from boosted"),
    "aggregation_boost": _sql(RULED, f"select {_KEY}, {real('boost as aggregation_boost')} from boosted"),
    "fusion_renormalized": _sql(FUSED, f"""select {_KEY}, {real('final as final_risk_score')}, level as risk_level, mode as fallback_mode,
        {real('coalesce(0.30 * f * x, 0) as xgboost_contribution', 'coalesce(0.25 * f * l, 0) as lightgbm_contribution', 'coalesce(0.20 * f * t, 0) as transformer_contribution', 'coalesce(0.10 * f * c, 0) as tcn_contribution', '0.15 * rule_score as rule_contribution')} from leveled"""),
    "fusion_full": _sql(FUSED, f"select {_KEY}, {real('0.30 * xgb + 0.25 * lgbm + 0.20 * tra + 0.10 * tcn + 0.15 * rule_score + boost as final_risk_score')}, level as risk_level from leveled where xgb is not null and lgbm is not null and tra is not null and tcn is not null"),
    "fusion_rules_only": _sql(RULED, f"select {_KEY}, {real('rule_score as final_risk_score')}, case when rule_score >= 80 then 'CRITICAL' when rule_score >= 60 then 'HIGH' when rule_score >= 35 then 'MEDIUM' else 'LOW' end as risk_level, 'RULES_ONLY' as fallback_mode from boosted"),
    "attribution": _sql(FUSED, f"select {_KEY}, attributed as anomaly_type_attributed, {real('sure as anomaly_type_confidence')} from typed"),
    "alert_decision": _sql(FUSED, f"""select {_KEY}, {real('ai as ai_risk_score')}, is_anomaly, ai >= 35 as binary_anomaly, eligible as alert_eligible,
        case when not eligible then 'BELOW_THRESHOLD' when is_anomaly and len(rule_codes) > 0 then 'RULE_AND_RISK' when is_anomaly then 'ANOMALY_THRESHOLD'
          when final >= 60 then 'FINAL_RISK_THRESHOLD' when len(rule_codes) > 0 then 'RULE_TRIGGER' else 'UNKNOWN' end as alert_reason from typed"""),
    "load_shedding": _sql(AUDIT, "select id, case when k * 300 >= 20000 then 'RULES_ONLY' when k * 300 >= 5000 then 'TCN' else 'TRANSFORMER' end as mode from audit"),
    "offline_ensemble": _sql(SUMMARY, f"""select {_KEY}, {real('''least(100, 30 * ip_changed + 25 * device_changed + 15 * (total_kos >= 3)::int + 15 * (total_download_actions >= 10)::int
        + 15 * (ping_pong_count >= 2)::int + 40 * (total_events % 10) / 10 + 15 * (total_kos % 4) / 4) as score''')} from summed"""),
    "session_risk_summary": _sql(RULED, f"""select {_KEY}, {whole('total_events', 'total_kos', 'longest_ko_streak')}, {real('risk_score_max', 'rule_score')}, array_to_string(rule_codes, ',') as rule_codes,
        case when rule_score >= 80 then 'CRITICAL' when rule_score >= 60 then 'HIGH' when rule_score >= 35 then 'MEDIUM' else 'LOW' end as risk_level
        from boosted order by rule_score desc, risk_score_max desc, session_id limit 20"""),
    "alert_search": _sql(ALERTS, f"select event_id, {whole('position')}, {real('risk as final_risk_score')} from alerts where risk_level = 'MEDIUM' and anomaly_type = 'geo_jump' and timestamp between '2024-01-05' and '2024-01-20'"),
    "alert_filter_lenient": _sql(ALERTS, f"select event_id, {whole('position')} from alerts where risk_level = 'MEDIUM' and (event_id % 5 = 0 or timestamp >= '2024-01-20')"),
    "alert_page": _sql(ALERTS, "select event_id, epoch_us(timestamp) as timestamp, risk_level from base order by base.timestamp desc, event_id desc limit 25 offset 30"),
    "alert_page_snapped": _sql(ALERTS, "select event_id, epoch_us(timestamp) as timestamp, risk_level from base order by base.timestamp desc, event_id desc limit 25 offset 25"),
    "alert_dedup_richness": _sql(ALERTS, f"select event_id, {whole('0 as position', '10 + 10 + 8 + 5 + 5 + 5 * (country is not null)::int + 5 * (device is not null)::int as richness')} from base"),
    "alert_merge_critical": _sql(ALERTS, f"select event_id, {whole('case when event_id % 2 = 0 then 9 else 0 end as position')} from base"),
    "alert_hydrate_left": _sql(ALERTS, "select event_id, full_device as device, full_country as country, '' as event_action from base where event_id % 3 = 0"),
    "alert_first_per_session": _sql(ALERTS, f"select {_KEY}, arg_min(event_id, (timestamp, event_id)) as event_id from base where risk >= 40 group by all"),
    "alert_new_rows": _sql(ALERTS, "select event_id, risk_level from base where event_id % 4 <> 0"),
    "latest_per_key": _sql(ALERTS, "select insured_id, arg_max(event_id, (timestamp, event_id)) as event_id, arg_max(risk_level, (timestamp, event_id)) as risk_level from base group by insured_id"),
    "upsert_latest": _sql(ALERTS, "select insured_id, arg_max(event_id, (timestamp, event_id % 2)) as event_id from base group by insured_id"),
    "user_risk_profile": _sql(FUSED, f"""
, month as (select * from analysis where end_time > {_RANGE} - interval 30 day and end_time <= {_RANGE}),
acts as (select insured_id, action, count(*) as n from sess join (select session_id from month) using (session_id) group by all),
tops as (select insured_id, arg_min(action, (-n, action)) as action from acts group by insured_id),
agg as (
  select insured_id, count(*) as s30, count(*) filter (where end_time > {_RANGE} - interval 7 day) as s7, count(*) filter (where final >= 35) as a30,
    count(*) filter (where final >= 35 and end_time > {_RANGE} - interval 7 day) as a7, avg(final) as avg_risk, max(final) as max_risk,
    arg_max(attributed, (end_time, session_id)) filter (where final >= 35) as last_type, avg(total_duration_seconds) as dur
  from month group by insured_id
)
select insured_id, {whole('s30 as sessions_30d', 's7 as sessions_7d', 'a30 as anomaly_count_30d', 'a7 as anomaly_count_7d')}, {real('avg_risk', 'max_risk', 'dur as avg_session_duration_30d', 'a30 / s30 as anomaly_rate_30d')},
  last_type as last_anomaly_type, tops.action as most_frequent_action_30d,
  case when max_risk >= 80 or a30 / s30 >= 0.2 or avg_risk >= 60 then 'HIGH' when a30 / s30 >= 0.05 or avg_risk >= 35 then 'MEDIUM' else 'LOW' end as risk_tier
from agg join tops using (insured_id)""".replace("\n, month", ", month")),
    "clean_streak": _sql(FUSED, """
, r as (select insured_id, final, row_number() over (partition by insured_id order by end_time desc, session_id desc) as rn from analysis)
select insured_id, cast(coalesce(min(rn) filter (where final >= 35) - 1, count(*)) as bigint) as consecutive_clean_sessions from r where rn <= 200 group by insured_id"""),
    "user_360": _sql(FUSED, f"""
, s as (select insured_id, avg(final) as avg_risk, count(*) as n from (select * from analysis qualify row_number() over (partition by insured_id order by end_time desc, session_id desc) <= 10) group by insured_id),
a as (select insured_id, count(*) as n, count(*) filter (where risk >= 80) as c from (select * from enriched where risk >= 35 qualify row_number() over (partition by insured_id order by created_at desc, id desc) <= 10) group by insured_id)
select coalesce(s.insured_id, a.insured_id) as insured_id, {real('avg_risk')}, {whole('coalesce(s.n, 0) as recent_sessions', 'coalesce(a.n, 0) as alerts', 'coalesce(a.c, 0) as critical_alerts')} from s full join a on s.insured_id = a.insured_id"""),
    "active_hours": _sql(FUSED, f"""
, h as (select insured_id, start_hour as hour from analysis union all select insured_id, end_hour from analysis union all select insured_id, hour(created_at) from audit),
n as (select insured_id, hour, count(*) as n from h group by all)
select insured_id, {whole('row_number() over (partition by insured_id order by n desc, hour) as rank', 'hour', 'n')} from n qualify row_number() over (partition by insured_id order by n desc, hour) <= 3"""),
    "top_api_families": _sql(AUDIT, """
, n as (select insured_id, 'r' || (k % 4) as family, count(*) as n from audit where k % 4 <> 3 group by all)
select insured_id, row_number() over (partition by insured_id order by n desc, family) as rank, family, n from n"""),
    "churn_distribution": _sql(FUSED, f"select {whole('count(*) filter (where churn >= 0.7) as high', 'count(*) filter (where churn >= 0.3 and churn < 0.7) as medium', 'count(*) filter (where churn < 0.3) as low')}, {real('avg(churn) as avg_probability')}, count(distinct insured_id) as users from analysis where churn is not null"),
    "churn_user_winner": _sql(FUSED, f"""select {_KEY}, {real('churn as churn_probability')}, case when churn >= 0.7 then 'HIGH' when churn >= 0.3 then 'MEDIUM' else 'LOW' end as churn_risk_level
        from analysis where churn is not null qualify row_number() over (partition by insured_id order by end_time desc, churn desc, session_id desc) = 1"""),
    "churn_features": _sql(AUDIT, f"""
, n as (select insured_id, device, count(*) as n from audit group by all)
select insured_id, {real("avg((status = 'KO')::int) as failure_rate", "avg((hour(created_at) between 8 and 18)::int) as business_hours_ratio", "avg((country_code = 'FR')::int) as fr_ratio", 'avg(is_download_action) as download_ratio')},
  (select arg_min(n.device, (-n.n, n.device)) from n where n.insured_id = audit.insured_id) as primary_device from audit group by insured_id"""),
    "minute_counters": _sql(AUDIT, f"select epoch_us(date_trunc('minute', created_at)) as minute, count(*) as events, {whole('sum((status = $$KO$$)::int) as kos', 'sum(is_download_action) as downloads')} from audit group by 1"),
    "day_counters": _sql(AUDIT, f"select cast(cast(created_at as date) as varchar) as day, count(*) as events, {whole('sum((status = $$KO$$)::int) as kos', 'sum(is_download_action) as downloads')} from audit group by 1"),
    "minute_country_counters": _sql(AUDIT, "select epoch_us(date_trunc('minute', created_at)) as minute, case when k % 6 <> 0 then country_code else 'UNKNOWN' end as country_code, count(*) as events from audit group by all"),
    "live_stats_snapshot": _sql(ALERTS, f"""
, recent as (select * from audit where created_at > {_RANGE} - interval 1440 minute and created_at <= {_RANGE}),
c as (select count(*) filter (where created_at > {_RANGE} - interval 1 minute) as m, count(*) as l, count(*) filter (where created_at > {_RANGE} - interval 1440 minute) as s,
  count(*) filter (where created_at > {_RANGE} - interval 1440 minute and status = 'KO') as ko from audit where created_at > {_RANGE} - interval 2880 minute and created_at <= {_RANGE}),
a as (select count(*) as n from base where timestamp > {_RANGE} - interval 2880 minute and timestamp <= {_RANGE}),
ta as (select coalesce(string_agg(action, ',' order by n desc, action), '') as v from (select action, count(*) as n from recent group by 1 order by 2 desc, 1 limit 5)),
tc as (select coalesce(string_agg(country_code, ',' order by n desc, country_code), '') as v from (select country_code, count(*) as n from recent group by 1 order by 2 desc, 1 limit 3)),
r as (select *, case when l > 0 then n / l else 0 end as ar, case when s > 0 then ko / s else 0 end as kr, ta.v as va, tc.v as vc from c, a, ta, tc)
select {whole('m as events_last_minute', 'l as events_long', 's as events_short', 'ko as kos_short', 'n as alerts')}, va as top_action, vc as top_country_code, {real('ar as alert_rate', 'kr as ko_rate')},
  case when n >= 3 or ar >= 0.2 or kr >= 0.2 then 'HIGH' when n >= 1 or ar >= 0.05 or kr >= 0.1 then 'MEDIUM' else 'LOW' end as global_risk_level from r"""),
    "security_overview": _sql(FUSED, f"""
, l as (select * from analysis order by end_time desc, session_id desc limit 50),
e as (select count(*) as n from audit where cast(created_at as date) = date '2024-01-24'),
a as (select * from enriched where risk >= 35 and cast(created_at + interval 1 second as date) = date '2024-01-24'),
k as (select anomaly_type as v, count(*) as n from a group by 1),
r as (select rule as v, count(*) as n from (select unnest(rule_codes) as rule from l) group by 1)
select (select n from e) as total_events, (select count(*) from a) as alerts, cast(count(*) as bigint) as sessions, cast(count(*) filter (where final >= 80) as bigint) as critical,
  cast(count(*) filter (where final >= 60 and final < 80) as bigint) as high, {real('avg(final) as avg_risk')}, count(distinct insured_id) as active_users,
  (select string_agg(v, ',' order by n desc, v) from (select * from k order by n desc, v limit 10)) as top_types,
  (select string_agg(v, ',' order by n desc, v) from (select * from r order by n desc, v limit 5)) as top_rules,
  {real('(select count(*) from a) / (select n from e) as anomaly_rate')} from l"""),
    "rule_histogram": _sql(RULED, ", u as (select unnest(rule_codes) as rule from boosted) select rule, count(*) as n from u group by rule order by n desc, rule limit 5"),
    "type_counts": _sql(FUSED, "select attributed as anomaly_type, count(*) as n from typed group by 1"),
    "cluster_share": _sql(FUSED, f"select {whole('cluster')}, count(*) as n, {real('count(*) / sum(count(*)) over () as share')} from analysis where cluster is not null group by cluster"),
    "top_risky_sessions": _sql(FUSED, f"select {_KEY}, {real('final as final_risk_score')} from analysis order by final desc, end_time desc, session_id limit 20"),
    "latency_percentile": _sql(AUDIT, ", r as (select k, row_number() over (order by k) as rn, count(*) over () as n from audit) select " + ", ".join(f"cast(max(k) filter (where rn = cast(ceil({p} * n / 100.0) as bigint)) as bigint) as p{p}" for p in (50, 95, 99)) + ", count(*) as n from r"),
    "field_coverage": _sql(AUDIT, f"""
, v as (select 'action' as field, action as value, action in ('view', 'click', 'purchase') as ok from audit union all select 'device', device, true from audit union all select 'country_code', country_code, country_code = 'FR' from audit),
u as (select field, string_agg(value, ',' order by n desc, value) as top from (select field, value, count(*) as n from v where not ok group by field, value qualify row_number() over (partition by field order by count(*) desc, value) <= 5) group by field),
c as (select field, count(*) filter (where ok) as known, count(*) filter (where not ok) as unknown from v group by field)
select field, known, unknown, coalesce(top, '') as most_frequent_unknown, {real('unknown / (known + unknown) as unknown_ratio')}, unknown / (known + unknown) > 0.3 as warn from c left join u using (field)"""),
    "traffic_anomaly": _sql(AUDIT, """
, n as (select cast(created_at as date) as d, count(*) as n, day(cast(created_at as date)) % 24 as h from audit group by 1)
select cast(d as varchar) as day, case when h < 4 and n < 300 * 1.35 / 2 then false else n / greatest(1, h) * 24 > 300 * 1.35 end as unusual from n"""),
    "transition_matrix": _sql(STEPS, f"select a as from_action, b as to_action, n, {real('p as probability')} from matrix"),
    "conversation_transitions": f"""with p as (select role as a, lead(role) over (partition by conv_id order by turn) as b from conversations), c as (select a, b, count(*) as n from p where b is not null and a is not null group by all)
select a as from_action, b as to_action, n, {real('n / sum(n) over (partition by a) as probability')} from c""",
    "rare_paths": _sql(STEPS, f"select a as from_action, b as to_action, n, {real('p as probability')} from matrix where p < 0.195"),
    "path_flags": _sql(STEPS, f"""
, s as (select insured_id, session_id, lag(action) over (partition by session_id order by created_at, id) as a, action as b from sess)
select {_KEY}, bool_or(p < 0.19) as impossible_seq, bool_or(p < 0.2) as path_deviation, count(*) filter (where p < 0.2) as rare_steps from s join matrix using (a, b) group by all"""),
    "next_action_hits": _sql(STEPS, f"""
, r as (select a, b, row_number() over (partition by a order by p desc, n desc, b) as rank from matrix)
select count(*) as steps, {real('avg((rank = 1)::int) as top1', 'avg((rank <= 3)::int) as top3')} from pairs join r using (a, b)"""),
    "dropoff_actions": _sql(SUMMARY, "select last_action, count(*) as n from summed where ended_abruptly = 1 group by last_action"),
    "vocab_encode": _sql(AUDIT, f"select id, {whole('coalesce(list_position([$$view$$, $$click$$, $$purchase$$], action), 0) as action_id', 'case device when $$D0$$ then 1 when $$D1$$ then 2 else 0 end as device_id')} from audit"),
    "window10_features": _sql(SESSIONS, f"""
, e as (select *, coalesce(list_position(['view', 'click', 'purchase'], action), 0) as a from sess)
select id, {real('least(1, count(*) over w / 10) as window_length_ratio', 'avg(k) over w as k_mean', 'k as k_last', 'stddev_pop(k) over w as k_std', 'a / 3 as action_id_last', 'coalesce(len(list_distinct(list(a) filter (where a > 0) over w)), 0) / 3 as action_id_distinct')}
from e window w as (partition by session_id order by created_at, id rows between 10 preceding and current row)"""),
    "padded_window": _sql(SESSIONS, """
, e as (select id, coalesce(list(k) over w, []) as l from sess window w as (partition by session_id order by created_at, id rows between 5 preceding and 1 preceding))
select id, array_to_string(list_transform(range(5), lambda i: case when i >= 5 - len(l) then l[i - 5 + len(l) + 1] else 0 end), ',') as window,
  array_to_string(list_transform(range(5), lambda i: cast(i >= 5 - len(l) as int)), ',') as mask from e"""),
    "softmax_surprise": _sql(AUDIT, f"select id, {real('exp(k % 3) / (exp(k % 7) + exp(k % 3) + exp(k % 5)) as p1', 'ln(exp(k % 7) + exp(k % 3) + exp(k % 5)) - [k % 7, k % 3, k % 5][k % 3 + 1] as surprise')} from audit"),
    "next_event_predictions": _sql(AUDIT, f"""
, p as (select id, action, [exp(k % 7), exp(k % 3 + 0.5), exp(k % 5 + 0.25)] as e from audit),
q as (select id, action, unnest(['view', 'click', 'UNK_2']) as value, unnest(range(3)) as i, unnest(list_transform(e, lambda x: x / list_sum(e))) as p from p),
r as (select *, row_number() over (partition by id order by p desc, i) as rank from q),
d as (select id, coalesce(max(p) filter (where rank <= 2 and value = action), 0.1 * min(p) filter (where rank <= 2)) as hit from r group by id)
select id, rank, value, {real('p as probability', '1 - hit as deviation')} from r join d using (id) where rank <= 2"""),
    "daily_series": _sql(DAYS, f"select cast(ds as varchar) as ds, {whole('total_events', 'anomaly_events', 'download_events')} from days"),
    "daily_lag_rolling": _sql(LAGGED, "select cast(ds as varchar) as ds, total_events, " + real("anomaly_rate", *(f"{c}_{x}" for c in ("total_events", "anomaly_rate") for x in ("lag_1", "lag_2", "lag_3", "lag_7", "lag_14", "roll_mean_7", "roll_std_7"))) + " from lagged"),
    "calendar_features": _sql(DAYS, f"select cast(ds as varchar) as ds, {whole('isodow(ds) - 1 as dow', 'month(ds) as month', 'week(ds) as week', '(isodow(ds) > 5)::int as is_weekend')}, {real('sin(2 * pi() * dayofyear(ds) / 365) as day_sin', 'cos(2 * pi() * dayofyear(ds) / 365) as day_cos', 'sin(2 * pi() * (isodow(ds) - 1) / 7) as dow_sin', 'cos(2 * pi() * (isodow(ds) - 1) / 7) as dow_cos')} from days"),
    "ridge_forecast": _sql(LAGGED, f"""
, p as (select ds, case when total_events_lag_7 > 0 then total_events_lag_7 else total_events_roll_mean_7 end as e,
  greatest(0, least(1, 0.05 + 0.01 * (total_events_lag_1 - 300) / 50 - 0.02 * (total_events_roll_mean_7 - 310) / 40 + 0.3 * (anomaly_rate_lag_7 - 0.2) / 0.1 + 0.005 * (isodow(ds) - 1 - 3) / 2)) as r from lagged)
select cast(ds as varchar) as ds, {real('e as predicted_total_events', 'r as predicted_anomaly_rate', 'e * r as expected_alerts')} from p"""),
}
SQL = {k: v.replace(")\n, ", "),\n", 1) if "\n, " in v else v for k, v in SQL.items()}
