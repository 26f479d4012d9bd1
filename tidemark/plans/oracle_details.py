"""DuckDB SQL for lists, details, features and sequences beside the core, written from the definitions."""

from __future__ import annotations

from .oracle import _KEY, _sql, ALERTS, AUDIT, ENRICHED, FUSED, LAGGED, SESSIONS, SUMMARY, real, whole

_DETAIL = ALERTS + """,
own as (select *, case when event_id % 4 = 0 then event_id when event_id % 4 = 1 then event_id + 1 when event_id % 8 = 2 then -9 end as about from base),
led as (select session_id, min(event_id) as e from base group by all),
joined as (select o.*, case when e % 3 <> 0 then e end as session_about from own o join led using (session_id)),
sourced as (
  select event_id, case when about = event_id then 'sql-payload' when about is not null then 'sql' when session_about = event_id then 'sql-payload' else 'sql' end as source,
    case when coalesce(about, session_about) <> event_id then 'sql_payload_event_mismatch' end as warning
  from joined
)"""
_LIST = ALERTS + """,
merged as (select * from base where event_id % 2 = 0 union all select * from base where event_id % 2 <> 0)"""
_PRIMARY = """
values_ as (select session_id, rn, 'device' as f, lower(device) as v from enriched union all select session_id, rn, 'browser', 'b-' || (k % 2) from enriched where k % 3 <> 0),
usual as (select session_id, f, v, count(*) as n, min(rn) as first from values_ group by all),
best as (select session_id, arg_min(v, (-n, first)) filter (where f = 'device') as device, arg_min(v, (-n, first)) filter (where f = 'browser') as browser from usual group by session_id)"""

SQL: dict[str, str] = {
    "alert_details": _sql(_DETAIL, "select event_id, source, warning, case when source <> 'sql' then cast(event_id as varchar) end as shown_event from sourced"),
    "alert_by_ids": _sql(ALERTS, f"select event_id, {whole('position')} from alerts where event_id % 5 = 0"),
    "alert_list_live": _sql(_LIST, """
, f as (select * from merged where timestamp >= '2024-01-03' and anomaly_type = 'geo_jump')
select event_id, epoch_us(timestamp) as timestamp, risk_level, (select count(*) from f) as total, (select count(*) from f) > 90 as has_more from f order by f.timestamp desc, event_id desc limit 30 offset 60"""),
    "alert_list_critical": _sql(_LIST, f"""
, f as (select * from merged where risk_level = 'HIGH')
select event_id, {real('risk as final_risk_score')}, (select count(*) from f) as total, (select count(*) from f) > 20 as has_more from f order by f.timestamp desc, event_id desc limit 20"""),
    "alert_evidence": _sql(FUSED, f"""select {_KEY}, session_id as of_session, cast(n * 1000 + total_kos as varchar) as event, {real('xgb as xgboost', 'rule_score as rules')}, 'MEDIUM' as churn, true as own from typed"""),
    "alert_view": _sql(ALERTS, """select event_id, epoch_us(case when event_id % 2 = 0 then timestamp else timestamp + interval 1 second end) as timestamp, case when event_id % 5 <> 0 then risk_level else 'T' end as risk_level,
        case when event_id % 3 <> 0 then cast(event_id as varchar) end as api_template, case when event_id % 3 <> 0 then full_country end as country, case when event_id % 3 <> 0 then 'GET' end as http_method, 'OPEN' as alert_status from base"""),
    "risky_of_both": _sql(ALERTS, f"""
, b as (select * from base where event_id % 2 = 0 union all select * from base)
select event_id, {real('risk as final_risk_score')} from b order by risk desc, b.timestamp desc, event_id desc limit 40"""),
    "alert_cache_trim": _sql(ALERTS, "select event_id, risk_level from base qualify count(*) over () <= 400 or row_number() over (order by event_id desc) <= 250"),
    "alert_duplicates": _sql(ALERTS, """
, r as (select event_id, risk >= 40 as ok, row_number() over (partition by session_id, risk >= 40 order by timestamp, event_id) as n from base)
select event_id, ok and n = 1 as alert_eligible, case when ok and n > 1 then 'DUPLICATE_SKIPPED' else 'ANOMALY_THRESHOLD' end as alert_reason from r"""),
    "session_summary_offline": _sql(SUMMARY, f"select {_KEY}, {whole('total_events', 'has_logout', '1 - has_logout as ended_abruptly')}, last_action from summed"),
    "forecast_without_models": _sql(LAGGED, f"""
, p as (select ds, case when total_events_lag_7 > 0 then total_events_lag_7 else total_events_roll_mean_7 end as e, case when anomaly_rate_lag_7 > 0 then anomaly_rate_lag_7 else anomaly_rate_roll_mean_7 end as r from lagged)
select cast(ds as varchar) as ds, {real('e as predicted_total_events', 'r as predicted_anomaly_rate', 'e * r as expected_alerts')} from p"""),
    "previous_prediction": _sql(SESSIONS, f"""
, p as (select id, action, lag(k) over (partition by session_id order by created_at, id) as k from sess),
q as (select id, action, exp(k % 7) as a, exp(k % 3 + 0.5) as b from p where k is not null)
select id, case when a >= b then 'view' else 'click' end as expected, {real("1 - case action when 'view' then a when 'click' then b else 0.1 * least(a, b) end / (a + b) as deviation")} from q"""),
    "buffer_dedup": _sql(SESSIONS, "select session_id, count(distinct id) filter (where k % 10 <> 0) + max((k % 10 = 0)::int) as events, cast(max((k % 10 = 0)::int) as bigint) as without_id from sess group by session_id"),
    "half_open_range": _sql(ALERTS, "select event_id, risk_level from base where timestamp >= '2024-01-05' and timestamp < '2024-01-06'"),
    "recent_events": _sql(SESSIONS, "select id, row_number() over (partition by session_id order by created_at desc, id desc) as from_last from sess qualify from_last <= 5"),
    "live_summary": _sql(ENRICHED, f"""
, r as (select *, row_number() over (partition by session_id order by created_at desc, id desc) as back from enriched)
select {_KEY}, {whole('count(*) as events', "count(*) filter (where status = 'KO') as kos")}, {real('max(risk) as risk_max', 'coalesce(avg(delta) filter (where rn > 1), 0) as avg_pause')},
  arg_min(action, rn) as first_action, arg_max(action, rn) as last_action, {whole('count(*) filter (where back <= 5) as recent_events', "count(*) filter (where back <= 5 and status = 'KO') as recent_kos",
  'count(distinct action) filter (where back <= 5) as recent_actions', 'count(distinct ip) filter (where back <= 5) as recent_ips', 'sum(is_download_action) filter (where back <= 5) as recent_downloads',
  'max(ping_pong) filter (where back <= 5) as recent_ping_pongs')} from r group by all"""),
    "request_template": _sql(AUDIT, """select id, case when k % 5 = 0 then case when k % 4 in (0, 3) then '/users' else 'UNTRACKED' end
        else case k % 4 when 0 then '/users' when 1 then '/users/{id}' when 2 then 'UNTRACKED' else '/users' end end as template from audit"""),
    "text_helpers": _sql(AUDIT, "select id, k % 3 <> 2 as same, k % 3 <> 2 as download, 'bank_data' as family, case when k % 2 = 0 then 'SUCCESS' else 'FAILURE' end as status from audit"),
    "churn_dashboard": _sql(FUSED, f"""
, l as (select * from analysis order by end_time desc, session_id desc limit 50)
select {whole('count(*) filter (where churn >= 0.7) as high', 'count(*) filter (where churn >= 0.3 and churn < 0.7) as medium', 'count(*) filter (where churn < 0.3) as low')}, {real('avg(churn) as avg_probability')},
  count(distinct insured_id) as users, (select string_agg(session_id, ',' order by coalesce(churn, 0) desc, session_id) from (select * from l order by coalesce(churn, 0) desc, session_id limit 10)) as top_sessions from l"""),
    "churn_top_users": _sql(FUSED, f"""
, u as (select * from analysis where churn is not null qualify row_number() over (partition by insured_id order by end_time desc, churn desc, session_id desc) = 1)
select {_KEY}, {real('churn as churn_probability')}, case when churn >= 0.7 then 'HIGH' when churn >= 0.3 then 'MEDIUM' else 'LOW' end as churn_risk_level from u order by churn desc, insured_id limit 50"""),
    "churn_session_features": _sql(SUMMARY, f"""
, {_PRIMARY.strip()},
e as (select session_id, avg((hour(created_at) between 8 and 18)::int) as bh, avg((country_code = 'FR')::int) as fr from enriched group by session_id)
select {_KEY}, {whole('total_events as total_actions')}, 1.0::double as total_sessions, 1.0::double as days_active, 0.0::double as days_active_ratio,
  {real('total_duration_seconds * 1000 as avg_session_duration_ms')}, {whole('total_events as avg_actions_per_session')}, 0.0::double as sessions_per_week, {real('avg_inter_action_seconds * 1000 as avg_inter_action_ms')},
  {whole('unique_routes as pages_visited')}, {real('total_kos / total_events as failure_rate', '(isodow(session_start) > 5)::int as weekend_ratio')}, {whole('unique_devices_used as unique_devices', 'unique_ips_used as unique_countries')},
  0.0::double as is_anomalous_user, {real('anomaly_event_count', 'anomaly_event_count / total_events as anomaly_ratio')}, 0.0::double as is_confuser,
  0.0::double as pct_logging_actions, 0.0::double as pct_contact_actions, 0.0::double as pct_document_actions, 0.0::double as pct_banking_actions, 0.0::double as pct_insured_actions, 0.0::double as pct_open_actions,
  0.0::double as mobile_ratio, 0.0::double as desktop_ratio, 0.0::double as tablet_ratio, {real('bh as business_hours_ratio', 'fr as fr_events_ratio')},
  best.device as primary_device, best.browser as primary_browser, 'ux' as primary_os, cast(null as varchar) as primary_region
from summed join best using (session_id) join e using (session_id)"""),
    "tabular_coverage": _sql(AUDIT, """
, x as (select 'size' as feature, k % 5 as c, case when k % 5 = 3 then 0 when k % 5 = 4 then k end as v, 0 as d, k % 5 = 0 as missing, k % 5 = 1 as wrong, k % 5 = 2 as endless from audit
  union all select 'hours', 0, case when k % 2 = 0 then k end, 4, k % 2 <> 0, false, false from audit)
select feature, count(*) as values, count(*) filter (where missing) as missing, count(*) filter (where wrong) as mismatched, count(*) filter (where endless) as non_finite,
  count(*) filter (where missing or wrong or endless) as defaulted, count(*) filter (where v = d) as at_default from x group by feature"""),
    "time_since_previous": _sql(SESSIONS, """
, p as (select id, k, us // 1000 - lag(us // 1000) over (partition by session_id order by created_at, id) as ms from sess)
select id, coalesce(greatest(0, ms), 0) as ms_since_previous, k % 3 = 0 and abs(k * 1000000 - coalesce(greatest(0, ms), 0)) > 1000 as ms_mismatch from p"""),
    "status_encoded": _sql(AUDIT, "select id, cast(case when k % 3 = 0 then 1 when k % 3 = 1 then 2 when status = 'OK' then 1 else 0 end as bigint) as status_id from audit"),
    "top_surprise_fields": _sql(AUDIT, """
, c as (select id, unnest(['action', 'device', 'route', 'hour', 'ip', 'country']) as f, unnest([k % 7, k % 3, k % 5, k % 11, k % 2, k % 13]) as v from audit),
r as (select *, row_number() over (partition by id order by v desc, f) as rank from c)
select id, string_agg(f, ',' order by rank) as fields from r where rank <= 5 group by id"""),
    "train_test_events": _sql(SESSIONS, "select case when insured_id % 5 = 0 then 'test' else 'train' end as part, action, count(*) as n, count(distinct session_id) as sessions from sess group by all"),
    "session_numbering": _sql(SESSIONS, "select id, row_number() over (partition by session_id order by created_at, id) as number, count(*) over (partition by session_id) as length from sess"),
    "imputed_matrix": _sql(AUDIT, f"""
, m as (select quantile_cont(k, 0.5) filter (where k % 7 <> 0) as m from audit where id % 5 <> 0 and device <> 'D2')
select id, {real("case when k % 7 <> 0 then k else (select m from m) end as x", "(device = 'D0')::int as device_D0", "(device = 'D1')::int as device_D1")} from audit"""),
    "payload_items": _sql(AUDIT, """
, p as (select id, k, k % 7 as form from audit where k % 7 < 4),
i as (select *, unnest(case when form = 3 then [0] else [0, 1] end) as place from p)
select id, case form when 0 then 'array' when 1 then 'items' when 2 then 'data' else 'object' end as shape, cast(place as bigint) as place, cast(k + place as bigint) as item_id,
  cast((k + place) / 4 as double) as score from i"""),
    "request_template_table": _sql(AUDIT, """
select id, case when k % 5 = 0 then case when k % 6 in (1, 5) then '/users/*' else 'UNTRACKED' end
  else case k % 6 when 0 then route_of when 1 then '/users/{id}' when 2 then '/users/{id}/file-*.pdf' when 3 then 'UNTRACKED' when 4 then '/users/{id}/{part}' else '/users/me' end end as template
from (select *, '/r' || (k % 4) as route_of from audit)"""),
    "live_session_summary": _sql(ENRICHED, f"""
, r as (select *, row_number() over (partition by session_id order by created_at desc, id desc) as back from enriched),
whole_ as (
  select insured_id, session_id, count(*) as n, arg_min(country_code, (created_at, id)) as country_code, min(created_at) as s, max(created_at) as e, arg_min(action, (created_at, id)) as first_action,
    arg_max(action, (created_at, id)) as last_action, avg(delta) as pause, max(unique_ips) as ips, max(unique_devices) as devices, count(*) filter (where status = 'KO') as kos, max(longest_ko_streak) as streak,
    max(cast(action = 'signup' as int)) as login, max(cast(action = 'error' as int)) as logout, max(is_ip_changed) as ip, max(is_device_changed) as device, sum(is_download_action) as downloads,
    max(downloads_recent) as most_downloads, max(ping_pong) as pongs, max(risk) as risk_max, avg(risk) as risk_avg, sum(is_anomaly) as anomalies, max(cast(isodow(created_at) > 5 as int)) as weekend
  from r group by all
),
seen as (
  select session_id, count(distinct action) as actions, count(distinct route) as routes, arg_max(route, back) as first_route, arg_min(route, back) as last_route, string_agg(action, ' > ' order by back desc) as signature,
    string_agg(action, ',' order by back desc) as listed from r where back <= 5 group by all
),
firsts as (select session_id, route, max(back) as b from r where back <= 5 group by all),
ways as (select session_id, string_agg(route, ' > ' order by b desc) as signature, string_agg(route, ',' order by b desc) as listed from firsts group by all),
kinds as (select session_id, anomaly_type, max(back) as b from r where back <= 5 and anomaly_type <> 'normal' group by all),
named as (select session_id, string_agg(anomaly_type, ',' order by b desc) as listed, arg_max(anomaly_type, b) as first from kinds group by all)
select w.insured_id, w.session_id, country_code, epoch_us(s) as session_start, epoch_us(e) as session_end, {whole('hour(s) as start_hour', 'hour(e) as end_hour', 'isodow(s) - 1 as day_of_week', 'weekend as is_weekend')},
  first_action, last_action, first_route, last_route, {whole('n as total_events', 'floor((epoch_us(e) - epoch_us(s)) / 1e6) as total_duration_seconds')}, {real('pause as avg_inter_action_seconds')},
  0.0::double as min_inter_action_seconds, 0.0::double as max_inter_action_seconds, {whole('actions as unique_actions', 'routes as unique_routes', 'ips as unique_ips_used', 'devices as unique_devices_used', 'kos as total_kos',
  'n - kos as total_oks', 'streak as longest_ko_streak', 'login as has_login', 'logout as has_logout', 'ip as ip_changed', 'device as device_changed', 'downloads as total_download_actions',
  'most_downloads as max_downloads_in_2_minutes', 'pongs as ping_pong_count')}, {real('risk_max as risk_score_max', 'risk_avg as risk_score_avg')},
  {whole('logout = 0 and n >= 3 as ended_abruptly', 'anomalies as anomaly_event_count')}, seen.signature as action_sequence_signature, ways.signature as route_sequence_signature,
  coalesce(named.first, 'normal') as primary_anomaly_type, coalesce(named.listed, '') as anomaly_types, seen.listed as action_sequence, ways.listed as route_sequence
from whole_ w join seen using (session_id) join ways using (session_id) left join named using (session_id)"""),
    "running_states": _sql(ENRICHED, f"""
, f as (select *, case when status = 'KO' then row_number() over (partition by session_id, island, status order by created_at, id) else 0 end as fails from enriched)
select cast(id as varchar) as id, {whole('count(*) over w as events', "count(*) filter (where status = 'OK') over w as oks", 'cumulative_kos as kos', 'sum(delta) over w as pause_sum', 'count(*) over w as pause_count',
  'downloads', 'max(unique_ips) over w as unique_ips', 'max(unique_devices) over w as unique_devices', 'max(is_ip_changed) over w as ip_changed', 'max(downloads_recent) over w as max_downloads',
  'max(ping_pong) over w as ping_pongs', "max((action = 'signup')::int) over w as has_login", "max((action = 'error')::int) over w as has_logout", 'cumulative_kos',
  'sum(is_anomaly) over w as anomaly_events', 'sum((isodow(created_at) > 5)::int) over w as weekend_events', 'fails as failures_in_a_row', 'max(fails) over w as most_failures_in_a_row')},
  {real('sum(risk) over w as risk_sum', 'max(risk) over w as risk_max')}, first(action) over w as first_action, ip as last_ip
from f window w as (partition by session_id order by created_at, id)"""),
    "live_session_totals": _sql(ENRICHED, f"""
, w as (select insured_id, session_id, count(*) as n, max(unique_ips) as ips, arg_min(action, (created_at, id)) as a, arg_max(action, (created_at, id)) as b from enriched group by all)
select {_KEY}, {whole('n as total_events', '1 as unique_actions', 'greatest(1, ips) as unique_ips_used')}, null::varchar as first_route, a || ',' || b as action_sequence, case when a = b then a else a || ',' || b end as counted,
  'normal' as primary_anomaly_type from w"""),
    "latency_of_latest": _sql(AUDIT, f"""
, last as (select k from audit where k is not null order by created_at desc, id desc limit 1000), placed as (select k, row_number() over (order by k) as r, count(*) over () as n from last)
select {whole('max(k) filter (where r = ceil(n * 50 / 100)) as p50', 'max(k) filter (where r = ceil(n * 95 / 100)) as p95', 'max(k) as greatest', 'count(*) as n')} from placed"""),
    "vector_coverage": _sql(AUDIT, f"""
select {whole('count(*) filter (where k % 3 = 0) as missing_features', 'count(*) filter (where k % 4 = 0) as defaulted_features', 'count(*) filter (where k % 4 = 0) as non_finite_replacements',
  'count(*) filter (where k % 5 = 0) as contract_mismatches', 'count(*) filter (where k % 6 = 0) as length_mismatches')}, {real('count(*) filter (where k % 3 = 2) / sum(k % 4) as unknown_categorical_ratio')} from audit"""),
    "prediction_as_of": _sql(SESSIONS, f"""
, made as (
  select session_id, id as c, k, case when k % 3 = 0 then created_at else created_at + interval 30 minutes end as made_at from sess where id % 2 = 0
), both_ as (select * from made union all select session_id, c, k, made_at + interval 2 hours from made where k % 4 = 0),
found as (
  select e.id, e.action, e.device, arg_max(p, (p.made_at, p.c)) as p from sess e left join both_ p on p.session_id = e.session_id and p.made_at <= e.created_at and p.c <> e.id group by all
),
parts as (
  select *, (p.k % 7) / 20 as v, (p.k % 7 + 1) / 20 as c_, (p.k % 5) / 20 as d0, (p.k % 5 + 1) / 20 as d1 from found
),
chances as (
  select *, case when action = 'view' and v > 0 then v when action = 'click' then c_ when v > 0 then v * 0.1 else 0.001 end as pa,
    case when p.k % 4 = 0 then null when device = 'D0' and d0 > 0 then d0 when device = 'D1' then d1 when d0 > 0 then d0 * 0.1 else 0.001 end as pd from parts
)
select id, coalesce(epoch_us(p.made_at), -1) as predicted_at, coalesce(p.c, -1) as predicted_for, case when p.c is not null then round(cast(case when pd is null then 1 - pa else (2 - pa - pd) / 2 end as double), 6) else -1 end as deviation,
  p.c is not null and action in ('view', 'click') as action_matched from chances"""),
    "alert_view_full": _sql(ALERTS, f"""
, x as (select *, event_id % 3 as m, event_id % 2 = 0 as paid, event_id % 5 < 3 as told from base)
select event_id, {real('risk as final_risk_score', 'case when paid then 0.95 else event_id % 10 / 10 end as anomaly_type_confidence')}, case when m = 0 then 'A,B' when paid then 'R' else '' end as triggered_rule_codes,
  case when m = 1 then 'own' when paid then 'paid' when told then 'told' else '-' end as event_action, case when m = 0 then '/e' when m = 2 and (paid or told) then '/p' || event_id else '-' end as api_template,
  case when m = 1 then 'x' else '-' end as os, 'persona_disabled' as persona_label, told as llm_evidence_available from x"""),
    "churn_view": _sql(SESSIONS, f"""
, own as (select insured_id, session_id, max(created_at) as e, count(*) as n, max(k) as k from sess group by insured_id, session_id),
scored as (select *, case when n % 3 <> 0 then (n * 37 + k * 11) % 997 / 1000 end as churn, case when n % 5 <> 0 then n * 7 % 101 end as risk from own),
recent as (select * from scored order by e desc, session_id desc limit 50),
deciding as (select * from recent where churn is not null qualify row_number() over (partition by insured_id order by e desc, churn desc, session_id desc) = 1),
chosen as (select * from deciding order by churn desc, insured_id limit 10),
ten as (select insured_id, avg(risk) as r from (select * from scored qualify row_number() over (partition by insured_id order by e desc, session_id desc) <= 10) group by insured_id),
odd as (select insured_id, count(*) filter (where k % 2 = 0) as a, count(*) filter (where k % 5 = 0) as c
  from (select * from audit where is_anomaly = 1 qualify row_number() over (partition by insured_id order by created_at desc, id desc) <= 10) group by insured_id)
select insured_id, session_id, {real('churn as churn_probability', 'coalesce(risk, -1) as latest_final_risk_score', 'coalesce(r, -1) as average_risk')}, case when n % 2 = 0 then 'LOW' else 'UNKNOWN' end as churn_risk_level,
  {whole('coalesce(a, 0) as alert_count', 'coalesce(c, 0) as critical_alert_count')} from chosen left join ten using (insured_id) left join odd using (insured_id)"""),
    "best_predictions": _sql(SESSIONS, """
, made as (select insured_id, session_id, created_at as t, case when k % 2 = 0 then action end as a from sess where id % 3 = 0),
s as (select session_id, max(t) as t, arg_max(coalesce(a, ''), t) as a from made group by all), u as (select insured_id, max(t) as t, arg_max(coalesce(a, ''), t) as a from made group by all),
x as (select distinct insured_id, session_id from sess)
select insured_id, session_id, case when s.a <> '' then epoch_us(s.t) when u.a <> '' then epoch_us(u.t) else -1 end as predicted_at, case when s.a <> '' then s.a when u.a <> '' then u.a else '' end as action,
  case when s.a <> '' then '' when u.a <> '' then 'fallback_to_insured_prediction' else 'next_event_prediction_not_available' end as note
from x left join s using (session_id) left join u using (insured_id)"""),
    "forecast_history": _sql(AUDIT, f"""
, d as (select cast(created_at as date) as ds, count(*) as n, sum(is_anomaly) as a from audit where day(created_at) % 4 <> 0 and created_at >= '2024-01-13' and created_at < '2024-01-20' group by all)
select cast(ds as varchar) as date, {whole('n as events')}, {real('a / n as rate')}, 'forecast_history_partial' as warning from d"""),
    "user_view": _sql(SESSIONS, f"""
, own as (
  select insured_id, session_id, min(created_at) as s, max(created_at) as e, count(*) as n, min(country_code) as c, row_number() over (partition by insured_id order by max(created_at) desc, session_id desc) as p
  from sess group by insured_id, session_id qualify p <= 10
),
odd as (select *, row_number() over (partition by insured_id order by created_at desc, id desc) as p from audit where is_anomaly = 1 qualify p <= 10),
users as (select insured_id from own union select insured_id from odd),
by_sessions as (
  select insured_id, first((n * 37 % 100) / 100 order by p) filter (where n % 3 <> 0) as churn, avg(n * 7 % 101) filter (where n % 5 <> 0) as risk, count(*) filter (where n % 2 = 0) as low,
    first(c order by p) filter (where n % 4 <> 0) as country, string_agg(session_id, ',' order by p) as sessions from own group by all
),
by_anomalies as (
  select insured_id, count(*) filter (where k % 2 = 0) as alerts, count(*) filter (where k % 5 = 0) as critical, first('D' || (k % 3) order by p) filter (where k % 4 = 0) as device,
    string_agg(id || ':' || case when k % 3 = 0 then 'HIGH' when k % 7 = 0 then 'none' when k * 3 % 101 >= 80 then 'CRITICAL' when k * 3 % 101 >= 60 then 'HIGH' when k * 3 % 101 >= 35 then 'MEDIUM' else 'LOW' end, ',' order by p) as timeline
  from odd group by all
),
seen as (
  select insured_id, hour(s) as h, p * 2 as place from own union all select insured_id, hour(e), p * 2 + 1 from own union all select insured_id, hour(created_at), 100 + p from odd
),
hours as (select insured_id, h, row_number() over (partition by insured_id order by count(*) desc, min(place)) as r from seen group by insured_id, h qualify r <= 3),
met as (
  select insured_id, case when k % 3 = 0 then 'auth' when k % 3 = 2 and k % 2 = 0 then 'pay' end as f, p as place from odd
  union all select insured_id, case when n % 3 = 0 then 'refunds' end, 100 + p * 3 from own
  union all select insured_id, 'auth', 101 + p * 3 from own where n % 2 = 0 union all select insured_id, 'documents', 102 + p * 3 from own where n % 2 = 0
),
families as (select insured_id, f, row_number() over (partition by insured_id order by count(*) desc, min(place)) as r from met where f is not null group by insured_id, f qualify r <= 5)
select insured_id, {real('coalesce(churn, 0) as churn_probability')}, case when low > 0 then 'LOW' else 'UNKNOWN' end as churn_risk_level, {real('coalesce(risk, -1) as average_risk')},
  {whole('coalesce(alerts, 0) as alert_count', 'coalesce(critical, 0) as critical_alert_count')}, coalesce(country, '') as usual_country, coalesce(device, '') as usual_device,
  coalesce((select string_agg(h, ',' order by r) from hours x where x.insured_id = u.insured_id), '') as usual_active_hours,
  coalesce((select string_agg(f, ',' order by r) from families x where x.insured_id = u.insured_id), '') as top_api_families, coalesce(sessions, '') as sessions, coalesce(timeline, '') as timeline
from users u left join by_sessions using (insured_id) left join by_anomalies using (insured_id)"""),
    "alert_list_hydrated": _sql(ALERTS, """
, f as (select event_id, case when event_id % 7 <> 0 then timestamp end as t, created_at, full_device as device, coalesce(country, full_country) as country from alerts
  where position = 1 and risk_level = 'MEDIUM' and (event_id % 7 = 0 or timestamp >= '2024-01-15'))
select event_id, coalesce(epoch_us(t), -1) as timestamp, device, country, (select count(*) from f) as total, (select count(*) from f) > 60 as has_more
from f order by t desc nulls last, created_at desc, event_id desc limit 40 offset 20"""),
}
SQL = {k: v.replace(")\n, ", "),\n", 1) if "\n, " in v else v for k, v in SQL.items()}
