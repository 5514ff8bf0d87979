"""DuckDB SQL per registered key (same names, same columns as histshift.plans.catalog)."""

from __future__ import annotations

import math

import datetime as dt

from histshift.functions.naming import percent_names
from histshift.plans import catalog as C
from histshift.testing.oracle import EVENT_PROBES, QUANTILES, event_ping_ctes, lit, run_ctes, values, with_ctes

# Stated here anew, not read from the engine.
CLIENT_MEAN_QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
BOX_COEF, VIOLIN_GRID = 1.5, 512
Q = list(QUANTILES)


def R(expr: str, alias: str) -> str:
    return f"ROUND(({expr}) + {C.TIE_NUDGE!r}, 6) AS {alias}"


def base(cfg=C.CFG, s="") -> str:
    return with_ctes(event_ping_ctes(), run_ctes(cfg, s))


def hist_base(days=C.HISTORY) -> str:
    """A history of runs (2024-01-15, -16, -17) with creation dates."""
    SFX = [f"_{chr(97 + k)}" for k in range(len(days))]
    runs = [run_ctes(C.CFG.with_(final_date=d), s) for d, s in zip(days, SFX)]
    u_relds = " UNION ALL ".join(
        f"SELECT *, {lit(d.isoformat())} AS creation_date FROM relds_q{s}" for d, s in zip(days, SFX))
    u_means = " UNION ALL ".join(
        f"SELECT *, {lit(d.isoformat())} AS creation_date FROM means{s}" for d, s in zip(days, SFX))
    u_hists = " UNION ALL ".join(
        f"SELECT *, {lit(d.isoformat())} AS creation_date FROM hists{s}" for d, s in zip(days, SFX))
    return with_ctes(event_ping_ctes(), *runs, f"h_relds AS ({u_relds})",
                     f"h_means AS ({u_means})", f"h_hists AS ({u_hists})")


def latest(src: str, keys: str) -> str:
    return (f"(SELECT * EXCLUDE (_mx) FROM (SELECT *, max(creation_date) OVER (PARTITION BY {keys}) AS _mx "
            f"FROM {src}) WHERE creation_date = _mx)")


def cdf(src: str, recompute: bool = False) -> str:
    run = ("sum(measure) OVER (PARTITION BY app_build_id, probe ORDER BY metric, creation_date, measure "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    if recompute:
        run = f"{run} / sum(measure) OVER (PARTITION BY app_build_id, probe)"
    return f"(SELECT *, {run} AS cum_sum FROM {src})"


RELDS_COLS = "probe, app_build_id, num_profiles, num_pings, " + ", ".join(R(n, n) for n in Q)
MEANS_COLS = "client_id, app_build_id, " + ", ".join(R(p, p) for p in EVENT_PROBES)
HIST1 = f"(SELECT *, {lit(C.FINAL.isoformat())} AS creation_date FROM hists)"
BUILD_DATE = "strptime(app_build_id, '%Y%m%d')::DATE"
IN_BUILDS = ", ".join(lit(b) for b in C.VIEW_BUILDS)


def means_values(log10=False, y_range=None) -> str:
    v = f"log10({C.MEANS_PROBE})" if log10 else C.MEANS_PROBE
    cond = [f"{C.MEANS_PROBE} IS NOT NULL"]
    if log10:
        cond.append(f"{C.MEANS_PROBE} > 0")
    if y_range:
        cond.append(f"{v} BETWEEN {float(y_range[0])!r} AND {float(y_range[1])!r}")
    return f"(SELECT app_build_id, {v} AS value FROM means WHERE {' AND '.join(cond)})"


def box_sql(vals: str) -> str:
    c = float(BOX_COEF)
    return f"""
, bq AS (SELECT app_build_id, quantile_cont(value, 0.25) AS lower, quantile_cont(value, 0.5) AS middle,
                quantile_cont(value, 0.75) AS upper FROM {vals} GROUP BY 1),
bj AS (SELECT v.app_build_id, v.value, q.lower, q.middle, q.upper,
              v.value >= q.lower - {c!r} * (q.upper - q.lower) AND v.value <= q.upper + {c!r} * (q.upper - q.lower) AS inside
       FROM {vals} v JOIN bq q ON q.app_build_id = v.app_build_id)
SELECT app_build_id, {R('first(lower)', 'lower')}, {R('first(middle)', 'middle')}, {R('first(upper)', 'upper')},
       count(*) AS n, {R('min(CASE WHEN inside THEN value END)', 'ymin')},
       {R('max(CASE WHEN inside THEN value END)', 'ymax')},
       count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
FROM bj GROUP BY app_build_id"""


def violin_sql(vals: str, g: int = VIOLIN_GRID) -> str:
    """R's density(): linear binning on [min - 4 bw, max + 4 bw], convolution at steps of
    2 L / (2 g - 1), linear interpolation at g points from min to max."""
    return f"""
, vmom AS (SELECT app_build_id, count(*) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx,
                  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {vals} GROUP BY 1),
vbw AS (SELECT *, 0.9 * (CASE WHEN mx = mn THEN (CASE WHEN mn <> 0 THEN abs(mn) ELSE 1.0 END)
                               WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                               ELSE sd END) * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM vmom),
vpar AS (SELECT *, mn - 4 * bw AS lo, mx + 4 * bw - (mn - 4 * bw) AS len FROM vbw),
vlb AS (SELECT v.app_build_id, (v.value - p.lo) / (p.len / {g - 1}) AS pos,
               CAST(floor((v.value - p.lo) / (p.len / {g - 1})) AS INTEGER) AS k0
        FROM {vals} v JOIN vpar p ON p.app_build_id = v.app_build_id WHERE p.mx > p.mn),
vbins AS (SELECT app_build_id, k, sum(c) AS c FROM (
            SELECT app_build_id, k0 AS k, 1 - (pos - k0) AS c FROM vlb
            UNION ALL SELECT app_build_id, k0 + 1 AS k, pos - k0 AS c FROM vlb) GROUP BY 1, 2),
vconv AS (SELECT p.app_build_id, j.j, sum(b.c / p.n * exp(-0.5 * pow((j.j - b.k) * (2 * p.len / {2 * g - 1}) / p.bw, 2)))
                   / (p.bw * {math.sqrt(2 * math.pi)!r}) AS d
          FROM vpar p CROSS JOIN (SELECT CAST(range AS INTEGER) AS j FROM range(0, {g})) j
          JOIN vbins b ON b.app_build_id = p.app_build_id GROUP BY p.app_build_id, j.j, p.bw),
vpts AS (SELECT p.app_build_id, CASE WHEN t.t = {g - 1} THEN p.mx ELSE p.mn + t.t * ((p.mx - p.mn) / {g - 1}) END AS y,
                p.lo, p.len FROM vpar p CROSS JOIN (SELECT range AS t FROM range(0, {g})) t WHERE p.mx > p.mn),
vx AS (SELECT *, (y - lo) / (len / {g - 1}) AS x FROM vpts),
vdens AS (SELECT v.app_build_id, v.y, a.d + (v.x - a.j) * (b.d - a.d) AS density
          FROM vx v JOIN vconv a ON a.app_build_id = v.app_build_id AND a.j = least(floor(v.x), {g - 2})
          JOIN vconv b ON b.app_build_id = v.app_build_id AND b.j = a.j + 1
          UNION ALL SELECT app_build_id, mn, 1 / (bw * {math.sqrt(2 * math.pi)!r}) FROM vpar WHERE mx = mn)"""


def trend_sql(vals: str) -> str:
    """The band takes Student's t by bisection: the density is integrated by Simpson's rule over
    the angle atan(t / sqrt(v)), in which it is c cos(angle)^(v - 1)."""
    steps = 400
    simpson = (f"list_sum(list_transform(range(0, {steps + 1}), lambda k: (CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 "
               f"ELSE 2 END) * pow(cos((lo + hi) / 2 * k / {steps}), v - 1))) * (lo + hi) / 2 / {steps} / 3 * c")
    return f"""
, tv AS (SELECT CAST(date_diff('day', DATE '1970-01-01', {BUILD_DATE}) AS DOUBLE) AS x, value FROM {vals}),
fit AS (SELECT regr_slope(value, x - m) AS slope, regr_intercept(value, x - m) - regr_slope(value, x - m) * first(m) AS intercept,
               regr_r2(value, x - m) AS r2, CAST(regr_count(value, x) AS BIGINT) AS n, regr_sxx(value, x - m) AS sxx,
               regr_syy(value, x) AS syy, first(m) AS avgx FROM tv CROSS JOIN (SELECT avg(x) AS m FROM tv)),
bis AS (SELECT 0 AS i, CAST(n - 2 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS lo, least(atan(700 / sqrt(n - 2)), pi() / 2) AS hi,
               exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) AS c FROM fit
        UNION ALL
        SELECT i + 1, v, CASE WHEN {simpson} < 0.475 THEN (lo + hi) / 2 ELSE lo END,
               CASE WHEN {simpson} < 0.475 THEN hi ELSE (lo + hi) / 2 END, c FROM bis WHERE i < 60),
tq AS (SELECT sqrt(v) * tan(lo) AS t FROM bis WHERE i = 60)
SELECT x, {R('slope', 'slope')}, {R('intercept', 'intercept')}, {R('r2', 'r2')}, n,
       {R('intercept + slope * x', 'fit')},
       {R('intercept + slope * x - t * sqrt(syy * (1 - r2) / (n - 2) * (1.0 / n + pow(x - avgx, 2) / sxx))', 'lower')},
       {R('intercept + slope * x + t * sqrt(syy * (1 - r2) / (n - 2) * (1.0 / n + pow(x - avgx, 2) / sxx))', 'upper')}
FROM (SELECT DISTINCT x FROM tv) CROSS JOIN fit CROSS JOIN tq"""


def lineitem_ctes() -> str:
    parts = {
        "hist_quantity": "CAST(floor(l_quantity / 5) * 5 AS INTEGER)",
        "hist_price": "CAST(floor(l_extendedprice / 5000) * 5000 AS INTEGER)",
        "hist_discount": "CAST(round(l_discount * 100) AS INTEGER)",
        "hist_tax": "CAST(round(l_tax * 100) AS INTEGER)",
    }
    u = " UNION ALL ".join(f"SELECT cust, app_build_id, {lit(p)} AS probe, {e} AS metric FROM li"
                           for p, e in parts.items())
    return f"""
li AS (SELECT o.o_custkey AS cust, strftime(date_trunc('month', l.l_shipdate), '%Y%m%d') || '120000' AS app_build_id,
              l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
pings_li AS (SELECT DISTINCT CAST(cust AS VARCHAR) AS client_id, app_build_id, 'app' AS app_name,
                    'nightly' AS normalized_channel, CAST(cust % 100 AS VARCHAR) AS sample_id FROM li),
bins_li AS (SELECT CAST(cust AS VARCHAR) AS client_id, app_build_id, probe, metric, count(*) AS value
            FROM ({u}) GROUP BY 1, 2, 3, 4)"""


def zero_bins_cte() -> str:
    return """
ping_bins_z AS (
  SELECT * FROM ping_bins
  UNION ALL
  SELECT DISTINCT client_id, app_build_id, probe, -1 AS metric,
         CASE WHEN CAST(substr(app_build_id, 7, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE 0 END AS value
  FROM ping_bins)"""


def sample(cfg) -> str:
    return base(cfg) + "SELECT client_id, app_build_id, sample_id FROM sel"


ORACLE: dict[str, str] = {
    "scan_pings": base() + """SELECT p.client_id, p.app_build_id, p.app_name, p.normalized_channel, p.sample_id,
        b.probe, b.metric, b.value FROM pings p JOIN ping_bins b
        ON b.client_id = p.client_id AND b.app_build_id = p.app_build_id""",
    "client_build_pings": base() + "SELECT * FROM cbp",
    "csv_roundtrip": hist_base() + f"SELECT {RELDS_COLS}, creation_date FROM h_relds",
    "json_hist": base() + "SELECT app_build_id, probe, metric, " + R("measure", "measure") + " FROM hists",
    "snapshot_read": hist_base() + f"SELECT {RELDS_COLS}, creation_date FROM {latest('h_relds', 'app_build_id, probe')}",
    "measured_sink": base() + "SELECT app_build_id, rep, " + ", ".join(
        R(f"max(CASE WHEN probe = {lit(p)} THEN relds END)", p) for p in EVENT_PROBES)
        + f", {lit(C.FINAL.isoformat())} AS creation_date FROM relds WHERE rep = 0 GROUP BY 1, 2",
    "means_sink": base() + f"SELECT {MEANS_COLS}, {lit(C.FINAL.isoformat())} AS creation_date FROM means",
    "hist_sink_overwrite": hist_base() + "SELECT app_build_id, probe, metric, " + R("measure", "measure")
        + ", creation_date FROM h_hists WHERE creation_date IN ('2024-01-15', '2024-01-16')",
    "build_day": base() + "SELECT client_id, app_build_id, substr(app_build_id, 1, 8) AS build_day FROM pings",
    "build_window": base() + "SELECT client_id, app_build_id FROM pings WHERE app_build_id >= '20240108' AND app_build_id <= '20240115'",
    "channel_filter": base() + "SELECT client_id, app_build_id, app_name, normalized_channel FROM pings WHERE app_name = 'app' AND normalized_channel = 'nightly'",
    "sample_lexical": sample(C.CFG.with_(sample="lexical")),
    "sample_numeric": sample(C.CFG.with_(sample="numeric")),
    "sample_debug": sample(C.CFG.with_(debug=True)),
    "struct_roundtrip": base() + f"SELECT {MEANS_COLS} FROM means",
    "build_date": base() + f"SELECT DISTINCT app_build_id, strftime({BUILD_DATE}, '%Y-%m-%d') AS build_date FROM cbp",
    "build_detail": base() + "SELECT app_build_id, num_profiles, num_pings, " + ", ".join(
        R(n, n) for n in ("relds_05", "relds_25", "relds_5", "relds_75", "relds_95")) + f" FROM relds_q WHERE probe = {lit(C.PROBE)}",
    "hist_view": base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date, {R('cum_sum', 'cum_sum')} FROM {cdf(HIST1)} WHERE app_build_id IN ({IN_BUILDS}) AND probe = {lit(C.PROBE)}",
    "hist_view_range": base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date, {R('cum_sum', 'cum_sum')} FROM {cdf(f'(SELECT * FROM {HIST1} WHERE app_build_id IN ({IN_BUILDS}) AND probe = {lit(C.PROBE)} AND metric BETWEEN {C.METRIC_RANGE[0]} AND {C.METRIC_RANGE[1]})', True)}",
    "relds_series": base() + f"SELECT app_build_id, {R('relds_5', 'relds_5')}, {R('relds_25', 'relds_25')}, {R('relds_95', 'relds_95')}, num_profiles, relds_95 >= 0.1 AS thresh FROM relds_q WHERE probe = {lit(C.PROBE)} AND app_build_id BETWEEN '20240109' AND '20240113'",
    "box_range": base().rstrip() + box_sql(means_values(y_range=(0.0, 100.0))),
    "means_quantiles": base().rstrip() + f"""
, mq AS (SELECT app_build_id, {C.PROBE} AS value FROM means WHERE app_build_id = '20240110')
SELECT app_build_id, count(*) AS num_clients, """ + ", ".join(
        R(f"quantile_cont(value, {q!r})", n) for q, n in zip(CLIENT_MEAN_QUANTILES, percent_names(CLIENT_MEAN_QUANTILES)))
        + " FROM mq GROUP BY 1",
    "regression_flags": base() + f"SELECT probe, app_build_id, {R('relds_95', 'relds_95')}, relds_95 >= 0.1 AS thresh FROM relds_q",
    "default_window": base() + "SELECT min(app_build_id) AS min_build, max(app_build_id) AS max_build, strftime(strptime(max(app_build_id), '%Y%m%d') - INTERVAL 28 DAY, '%Y%m%d') AS start_build FROM relds_q",
    "hist_since": base() + f"SELECT app_build_id, {R('measure', 'measure')}, metric, {R('cum_sum', 'cum_sum')} FROM {cdf(HIST1)} WHERE app_build_id > '20240110' AND probe = {lit(C.PROBE)}",
    "relds_measured": base() + f"SELECT rep, app_build_id, probe, {R('relds', 'relds')} FROM relds WHERE rep = 0",
    "relds_bootstrap": base() + f"SELECT rep, app_build_id, probe, {R('relds', 'relds')} FROM relds WHERE rep <> 0",
    "box_log10": base().rstrip() + box_sql(means_values(log10=True)),
    "comparison_pairs": base() + "SELECT rep, app_build_id, control_build, n_test, n_control FROM pairs_rep",
    "probe_labels": base() + f"SELECT l.label, q.probe, q.app_build_id, {R('q.relds_5', 'relds_5')} FROM relds_q q JOIN "
        + "(SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in C.EVENT_LABELS.items())
        + ") t(label, probe)) l ON l.probe = q.probe",
    "bootstrap_weights": base() + "SELECT client_id, app_build_id, rep, w FROM wts WHERE w > 0",
    "nearest_builds": base() + "SELECT app_build_id, num_profiles, num_pings, " + ", ".join(
        R(n, n) for n in ("relds_05", "relds_25", "relds_5", "relds_75", "relds_95"))
        + f" FROM relds_q WHERE probe = {lit(C.PROBE)} ORDER BY abs(date_diff('day', DATE '2024-01-11', {BUILD_DATE})), abs(relds_5 - 0.5), app_build_id LIMIT 3",
    "client_hists": base() + f"SELECT client_id, app_build_id, probe, metric, {R('measure', 'measure')} FROM dens",
    "client_hists_estimator": base(C.CFG.with_(estimator=True)) + f"SELECT client_id, app_build_id, probe, metric, {R('measure', 'measure')} FROM dens",
    "build_stats": base() + "SELECT * FROM stats",
    "rep_hists": base() + f"SELECT rep, app_build_id, probe, metric, {R('p', 'measure')} FROM rh",
    "rep_sizes": base() + "SELECT rep, app_build_id, n FROM sizes",
    "relds_zero_val": with_ctes(event_ping_ctes(), zero_bins_cte(), run_ctes(C.CFG, "", bins="ping_bins_z"))
        + f"SELECT rep, app_build_id, probe, {R('relds', 'relds')} FROM relds",
    "relds_quantiles": base() + f"SELECT {RELDS_COLS} FROM relds_q",
    "relds_quantiles_all": base(C.CFG.with_(num_days=60, final_date=dt.date(2024, 2, 15))) + f"SELECT {RELDS_COLS} FROM relds_q",
    "relds_quantiles_sampled": base(C.CFG.with_(sample="lexical")) + f"SELECT {RELDS_COLS} FROM relds_q",
    "relds_quantiles_lineitem": with_ctes(lineitem_ctes(), run_ctes(C.LINEITEM_CFG, "", pings="pings_li", bins="bins_li"))
        + f"SELECT {RELDS_COLS} FROM relds_q",
    "distinct_builds": base() + "SELECT DISTINCT app_build_id FROM hists",
    "box_stats": base().rstrip() + box_sql(means_values()),
    "box_outliers": base().rstrip() + f"""
, oq AS (SELECT app_build_id, quantile_cont(value, 0.25) AS lower, quantile_cont(value, 0.75) AS upper
         FROM {means_values()} GROUP BY 1)
SELECT v.app_build_id, {R('v.value', 'value')} FROM {means_values()} v JOIN oq q ON q.app_build_id = v.app_build_id
WHERE v.value < q.lower - {float(BOX_COEF)!r} * (q.upper - q.lower) OR v.value > q.upper + {float(BOX_COEF)!r} * (q.upper - q.lower)""",
    "violin_density": base().rstrip() + violin_sql(means_values()) + f"\nSELECT app_build_id, {R('y', 'y')}, {R('density', 'density')} FROM vdens",
    "violin_quantiles": base().rstrip() + violin_sql(means_values()) + f"""
, vc AS (SELECT app_build_id, y, sum(density) OVER (PARTITION BY app_build_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                / sum(density) OVER (PARTITION BY app_build_id) AS cd FROM vdens),
vl AS (SELECT *, coalesce(lag(cd) OVER (PARTITION BY app_build_id ORDER BY y), 0) AS pcd, coalesce(lag(y) OVER (PARTITION BY app_build_id ORDER BY y), y) AS py FROM vc)
SELECT app_build_id, q, {R('py + (q - pcd) * (y - py) / (cd - pcd)', 'y')}
FROM vl CROSS JOIN (SELECT * FROM (VALUES (0.25), (0.5), (0.75)) t(q)) qs WHERE pcd < q AND cd >= q""",
    "means_trend": base().replace("WITH", "WITH RECURSIVE", 1).rstrip() + trend_sql(means_values()),
    "alerts_by_build": base() + "SELECT app_build_id, count(*) AS num_flagged, string_agg(probe, ',' ORDER BY probe) AS flagged_probes FROM relds_q WHERE relds_95 >= 0.1 GROUP BY 1",
    "latest_relds": hist_base() + f"SELECT {RELDS_COLS}, creation_date FROM {latest('h_relds', 'app_build_id, probe')}",
    "latest_means": hist_base() + f"SELECT {MEANS_COLS}, creation_date, strftime({BUILD_DATE}, '%Y-%m-%d') AS date FROM {latest('h_means', 'app_build_id')}",
    "latest_hists": hist_base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date FROM {latest('h_hists', 'app_build_id, metric')}",
    "latest_hists_by_probe": hist_base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date FROM {latest('h_hists', 'app_build_id, probe')}",
    "build_calendar": base() + "SELECT app_build_id, control_build FROM cal",
    "hist_cdf": hist_base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date, {R('cum_sum', 'cum_sum')} FROM {cdf(latest('h_hists', 'app_build_id, metric'))}",
    "hist_cdf_recomputed": base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date, {R('cum_sum', 'cum_sum')} FROM {cdf(f'(SELECT * FROM {HIST1} WHERE metric BETWEEN {C.METRIC_RANGE[0]} AND {C.METRIC_RANGE[1]})', True)}",
    "union_strict": hist_base() + f"SELECT {RELDS_COLS}, creation_date FROM h_relds",
    "union_loose": hist_base() + f"SELECT client_id, app_build_id, " + ", ".join(
        R(f"CASE WHEN creation_date = '2024-01-15' THEN NULL ELSE {p} END", p) if p == C.MEANS_PROBE else R(p, p)
        for p in EVENT_PROBES) + ", creation_date FROM h_means",
    "latest_incremental": hist_base([C.FINAL + dt.timedelta(days=k) for k in range(10)]) + f"SELECT {RELDS_COLS}, creation_date FROM {latest('h_relds', 'app_build_id, probe')}",
    "client_means": base() + f"SELECT {MEANS_COLS} FROM means",
    "hist_merge": base() + f"""SELECT app_build_id, probe, metric, {R('sum(measure)', 'measure')} FROM (
        SELECT c.app_build_id, o.probe, o.metric, o.measure FROM cal c JOIN hists o ON o.app_build_id = c.control_build
        UNION ALL
        SELECT n.app_build_id, n.probe, n.metric, n.measure FROM cal c JOIN hists n ON n.app_build_id = c.app_build_id
        WHERE EXISTS (SELECT 1 FROM hists o WHERE o.app_build_id = c.control_build AND o.probe = n.probe)) GROUP BY 1, 2, 3""",
    "hist_json_export": base() + "SELECT app_build_id, probe, metric, ROUND(measure, 6) AS measure FROM hists",
    "read_pings": base() + "SELECT * FROM cbp",
    "rank_quantiles": base() + f"SELECT app_build_id, count(*) AS num_clients, " + ", ".join(
        R(f"quantile_cont({C.PROBE}, {q!r})", n) for q, n in zip(CLIENT_MEAN_QUANTILES, percent_names(CLIENT_MEAN_QUANTILES)))
        + " FROM means GROUP BY 1",
    "pruned_pings": base() + "SELECT * FROM cbp",
    "incremental_run": base() + f"SELECT {RELDS_COLS} FROM relds_q",
    "live_folded": hist_base([C.FINAL + dt.timedelta(days=k) for k in range(10)]) + f"SELECT {RELDS_COLS}, creation_date FROM {latest('h_relds', 'app_build_id, probe')}",
    "published_after_failure": hist_base(C.HISTORY[:2]) + f"SELECT {MEANS_COLS}, creation_date, strftime({BUILD_DATE}, '%Y-%m-%d') AS date FROM {latest('h_means', 'app_build_id')}",
    "daily_job_outputs": hist_base() + f"SELECT {MEANS_COLS}, creation_date FROM h_means",
    "snapshots_from_csv": hist_base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')}, creation_date, {R('cum_sum', 'cum_sum')} FROM {cdf(latest('h_hists', 'app_build_id, metric'))}",
    "csv_drift_loose": hist_base() + "SELECT client_id, app_build_id, " + ", ".join(
        R(f"CASE WHEN creation_date = '2024-01-15' THEN NULL ELSE {p} END", p) if p == C.MEANS_PROBE else R(p, p)
        for p in EVENT_PROBES) + ", creation_date FROM h_means",
    "csv_drift_in_run": base() + "SELECT client_id, app_build_id, " + ", ".join(
        R(f"CASE WHEN right(client_id, 1) BETWEEN '3' AND '5' THEN NULL ELSE {p} END", p) if p == C.MEANS_PROBE else R(p, p)
        for p in EVENT_PROBES) + f", '{C.FINAL}' AS creation_date FROM means",
    "build_hists": base() + f"SELECT app_build_id, probe, metric, {R('measure', 'measure')} FROM hists",
    "relds_wide": base() + "SELECT app_build_id, rep, " + ", ".join(
        R(f"max(CASE WHEN probe = {lit(p)} THEN relds END)", p) for p in EVENT_PROBES) + " FROM relds GROUP BY 1, 2",
    "ridge_series": base() + f"SELECT app_build_id, metric, {R('measure', 'measure')}, {R('cum_sum', 'cum_sum')} FROM {cdf(HIST1)} WHERE app_build_id IN ({IN_BUILDS}) AND probe = {lit(C.PROBE)}",
    "cdf_series": base() + f"SELECT app_build_id, metric, {R('cum_sum', 'cum_sum')} FROM {cdf(HIST1)} WHERE app_build_id IN ({IN_BUILDS}) AND probe = {lit(C.PROBE)}",
}
ORACLE |= {"rank_box": ORACLE["box_stats"], "rank_outliers": ORACLE["box_outliers"]}
