"""DuckDB SQL for the correctness oracle.

The SQL recomputes each registered query from the raw test tables with plain joins,
windows and GROUP BYs (no arrays, no maps), a formulation independent of the Spark
plans. Views ``events``, ``lineitem``, … are registered by the caller.
"""

from __future__ import annotations

import datetime as dt
import re

from histshift.config import RunConfig

# Stated here anew, so that a wrong value in the engine cannot agree with itself.
EVENT_PROBES = ("hist_click", "hist_error", "hist_purchase", "hist_signup", "hist_view")
QUANTILES = {"relds_05": 0.05, "relds_1": 0.1, "relds_25": 0.25, "relds_5": 0.5, "relds_75": 0.75,
             "relds_9": 0.9, "relds_95": 0.95}
# ceil(P(X <= k) * 2**32) of a Poisson(1) variable, k = 0, 1, ...
POISSON1 = (1580030169, 3160060338, 3950075422, 4213413784, 4279248374, 4292415292,
            4294609778, 4294923277, 4294962464, 4294966818, 4294967253, 4294967293)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[str], col: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + lit(r) + ')' for r in rows)}) t({col}))"


def event_ping_ctes() -> str:
    """Adapter A in long form: pings (one row per user-hour) and ping_bins."""
    probes = ", ".join(lit(p) for p in EVENT_PROBES)
    return f"""
ev AS (
  SELECT user_id,
         strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') AS app_build_id,
         'hist_' || event_type AS probe,
         CAST(floor(value / 5) * 5 AS INTEGER) AS metric,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
pings AS (
  SELECT CAST(user_id AS VARCHAR) AS client_id, app_build_id,
         CASE WHEN user_id % 50 = 49 THEN 'other' ELSE 'app' END AS app_name,
         CASE WHEN max(k) % 10 < 9 THEN 'nightly' ELSE 'beta' END AS normalized_channel,
         CAST(user_id % 100 AS VARCHAR) AS sample_id
  FROM ev GROUP BY user_id, app_build_id),
ping_bins AS (
  SELECT CAST(user_id AS VARCHAR) AS client_id, app_build_id, probe, metric, count(*) AS value
  FROM ev WHERE probe IN ({probes}) GROUP BY user_id, app_build_id, probe, metric)"""


def sample_sql(cfg: RunConfig) -> str:
    if cfg.debug:
        return "sample_id = '42'"
    if cfg.sample == "all":
        return "true"
    cut = "70" if cfg.channel == "nightly" else "25"
    return f"TRY_CAST(sample_id AS INTEGER) < {cut}" if cfg.sample == "numeric" else f"sample_id < '{cut}'"


def uniform_sql(client: str, build: str, rep: str) -> str:
    """First 8 hex digits of md5('client|build|rep') as an integer."""
    return f"('0x' || substr(md5({client} || '|' || {build} || '|' || CAST({rep} AS VARCHAR)), 1, 8))::BIGINT"


def poisson_sql(u: str) -> str:
    whens = " ".join(f"WHEN {u} < {t} THEN {k}" for k, t in enumerate(POISSON1))
    return f"CASE {whens} ELSE {len(POISSON1)} END"


def run_ctes(cfg: RunConfig, s: str = "", pings: str = "pings", bins: str = "ping_bins") -> str:
    """Every intermediate of one comparison run as CTEs named ``<name><s>`` over the
    ping CTEs ``pings`` / ``bins`` (no leading WITH, so several runs can be combined)."""
    start, end = (f"{d:%Y%m%d}" for d in (cfg.final_date - dt.timedelta(days=cfg.num_days), cfg.final_date))
    est = " + 0.5" if cfg.estimator else ""
    u = uniform_sql("c.client_id", "c.app_build_id", "r.rep")
    zv = f"CAST({float(cfg.zero_val)!r} AS DOUBLE)"
    upper = (f"substr(app_build_id, 1, 8) <= {lit(end)}" if cfg.inclusive_end
             else f"app_build_id <= {lit(end)}")
    qn = list(QUANTILES)
    sql = f"""
sel__ AS (
  SELECT client_id, app_build_id, sample_id FROM {pings}
  WHERE app_build_id >= {lit(start)} AND {upper}
    AND app_name = {lit(cfg.app)} AND normalized_channel = {lit(cfg.channel)}
    AND {sample_sql(cfg)}),
cbp__ AS (
  SELECT client_id, substr(app_build_id, 1, 8) AS app_build_id, count(*) AS num_client_pings
  FROM sel__ GROUP BY 1, 2),
cb__ AS (
  SELECT x.client_id, substr(x.app_build_id, 1, 8) AS app_build_id, b.probe, b.metric,
         CAST(sum(b.value) AS DOUBLE){est} AS cnt
  FROM sel__ x JOIN {bins} b ON b.client_id = x.client_id AND b.app_build_id = x.app_build_id
  GROUP BY 1, 2, 3, 4),
dens__ AS (
  SELECT client_id, app_build_id, probe, metric,
         cnt / sum(cnt) OVER (PARTITION BY client_id, app_build_id, probe) AS measure
  FROM cb__),
stats__ AS (
  SELECT app_build_id, count(*) AS num_profiles, CAST(sum(num_client_pings) AS BIGINT) AS build_pings
  FROM cbp__ GROUP BY 1),
reps__ AS (SELECT CAST(range AS INTEGER) AS rep FROM range(0, {cfg.num_reps + 1})),
wts__ AS (
  SELECT c.client_id, c.app_build_id, r.rep,
         CASE WHEN r.rep = 0 THEN 1 ELSE {poisson_sql(u)} END AS w
  FROM cbp__ c, reps__ r),
rh_raw__ AS (
  SELECT w.rep, w.app_build_id, d.probe, d.metric, sum(w.w * d.measure) AS wsum
  FROM wts__ w JOIN dens__ d ON d.client_id = w.client_id AND d.app_build_id = w.app_build_id
  WHERE w.w > 0 GROUP BY 1, 2, 3, 4),
rh__ AS (
  SELECT rep, app_build_id, probe, metric,
         wsum / sum(wsum) OVER (PARTITION BY rep, app_build_id, probe) AS p
  FROM rh_raw__),
sizes__ AS (SELECT rep, app_build_id, CAST(sum(w) AS BIGINT) AS n FROM wts__ WHERE w > 0 GROUP BY 1, 2),
cal__ AS (
  SELECT app_build_id, control_build FROM (
    SELECT app_build_id, lag(app_build_id) OVER (ORDER BY app_build_id) AS control_build
    FROM (SELECT DISTINCT app_build_id FROM cbp__))
  WHERE control_build IS NOT NULL),
probes__ AS {values(list(cfg.probes), 'probe')},
pairs_rep__ AS (
  SELECT st.rep, cal.app_build_id, cal.control_build, st.n AS n_test, sc.n AS n_control
  FROM cal__ cal JOIN sizes__ st ON st.app_build_id = cal.app_build_id
  JOIN sizes__ sc ON sc.app_build_id = cal.control_build AND sc.rep = st.rep),
spine__ AS (SELECT x.*, pr.probe FROM pairs_rep__ x CROSS JOIN probes__ pr),
pairs__ AS (
  SELECT sp.rep, sp.app_build_id, sp.probe, c.p AS p_c, coalesce(t.p, 0.0) AS p_t
  FROM spine__ sp
  JOIN rh__ c ON c.rep = sp.rep AND c.app_build_id = sp.control_build AND c.probe = sp.probe
  LEFT JOIN rh__ t ON t.rep = sp.rep AND t.app_build_id = sp.app_build_id
                  AND t.probe = sp.probe AND t.metric = c.metric),
relds_sum__ AS (
  SELECT rep, app_build_id, probe,
         sum(CASE WHEN p_c = 0 THEN (CASE WHEN p_t = 0 THEN 0.0 ELSE {zv} END)
                  ELSE abs(p_c - p_t) END) AS s
  FROM pairs__ GROUP BY 1, 2, 3),
relds__ AS (
  SELECT sp.rep, sp.app_build_id, sp.probe, coalesce(x.s, 0.0) AS relds
  FROM spine__ sp LEFT JOIN relds_sum__ x
    ON x.rep = sp.rep AND x.app_build_id = sp.app_build_id AND x.probe = sp.probe),
relds_q__ AS (
  SELECT q.probe, q.app_build_id, st.num_profiles, st.build_pings AS num_pings,
         {', '.join(f'q.{n}' for n in qn)}
  FROM (SELECT app_build_id, probe,
               {', '.join(f'quantile_cont(relds, {q!r}) AS {n}' for n, q in QUANTILES.items())}
        FROM relds__ WHERE rep <> {cfg.measured_rep} GROUP BY 1, 2) q
  JOIN stats__ st ON st.app_build_id = q.app_build_id),
pmeans__ AS (
  SELECT client_id, app_build_id, probe, sum(metric * measure) / sum(measure) AS mean
  FROM dens__ GROUP BY 1, 2, 3),
means__ AS (
  SELECT c.client_id, c.app_build_id,
         {', '.join(f"max(CASE WHEN m.probe = {lit(p)} THEN m.mean END) AS {p}" for p in cfg.probes)}
  FROM cbp__ c LEFT JOIN pmeans__ m ON m.client_id = c.client_id AND m.app_build_id = c.app_build_id
  GROUP BY 1, 2),
hists__ AS (
  SELECT app_build_id, probe, metric, p AS measure FROM rh__ WHERE rep = {cfg.measured_rep})"""
    return re.sub(r"__\b", s, sql)


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


def r6(expr: str, alias: str | None = None) -> str:
    return f"ROUND({expr}, 6) AS {alias or expr.split('.')[-1]}"
