"""DuckDB SQL over the same tables, written from the metrics' definitions."""

from __future__ import annotations


def _daily(key: str, source: str) -> str:
    day = "date_diff('day', DATE '1995-01-01', ts::DATE)"
    return f"""raw AS (SELECT {key} AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, round(sum(l_quantity), 4) AS obs, floor(((sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2))) * 10000)::BIGINT + 750) / 1500) / 10000 AS sim FROM {source} GROUP BY ALL),
series AS (SELECT series_id, ts, CASE WHEN {day} % 37 <> 0 THEN obs END AS obs, CASE WHEN {day} % 53 <> 0 THEN sim END AS sim FROM raw)"""


FLAG = _daily("l_returnflag", "lineitem")
SUPPLIER = _daily("'supplier ' || l_suppkey", "lineitem")
BRAND = _daily("p_brand", "lineitem JOIN part ON l_partkey = p_partkey")
MESSY = """messy AS (SELECT 'part ' || l_partkey AS series_id, CASE WHEN l_partkey % 5 <> 0 OR l_linenumber <> 7 THEN date_trunc('day', l_shipdate)::TIMESTAMP END AS ts,
  CASE WHEN l_partkey % 11 <> 0 OR l_orderkey % 3 = 0 THEN CASE WHEN l_partkey % 13 = 0 THEN -l_quantity ELSE l_quantity END END AS obs, CASE WHEN l_partkey % 17 <> 0 THEN l_quantity + l_linenumber END AS sim FROM lineitem)"""
HOURLY = "series AS (SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS obs, count(*) * 10.0::DOUBLE AS sim FROM events GROUP BY ALL)"


RECORD = f"""{FLAG}, days AS (SELECT DISTINCT ts FROM series), record AS (SELECT r.run AS series_id, d.ts, o.obs, s.sim FROM days d, (VALUES ('A'), ('N'), ('R')) r(run) LEFT JOIN series o ON o.ts = d.ts AND o.series_id = 'R' LEFT JOIN series s ON s.ts = d.ts AND s.series_id = r.run)"""


def pairs(series: str = FLAG, policy: str = "pairwise", transform: str = "none") -> str:
    values = {
        "pairwise": "obs, sim",
        "zero": "coalesce(obs, 0) AS obs, coalesce(sim, 0) AS sim",
        "mean": "coalesce(obs, avg(obs) OVER (PARTITION BY series_id), 0) AS obs, coalesce(sim, avg(sim) OVER (PARTITION BY series_id), 0) AS sim",
    }[policy]
    f = {"none": "{0}", "log": "ln({0} + eps)", "sqrt": "sqrt({0})", "inverse": "1 / ({0} + eps)"}[transform]
    return f"""{series},
filled AS (SELECT series_id, ts, {values} FROM series),
plain AS (SELECT series_id, ts, obs, sim, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS k FROM filled WHERE obs IS NOT NULL AND sim IS NOT NULL),
eps AS (SELECT *, 0.01 * avg(obs) OVER (PARTITION BY series_id) AS eps FROM plain),
pairs AS (SELECT series_id, ts, k, {f.format("obs")} AS obs, {f.format("sim")} AS sim FROM eps)"""


# Metrics from sums; each line is a metric and its SQL over the CTEs of panel().
METRICS = {
    "me": "me", "mae": "mae", "mdae": "mdae", "mse": "mse", "rmse": "sqrt(mse)", "rsr": "sqrt(mse) / nullif(so, 0)", "nrmse_mean": "sqrt(mse) / nullif(mo, 0)", "nrmse_range": "sqrt(mse) / nullif(hi - lo, 0)", "nrmse_iqr": "sqrt(mse) / nullif(q75 - q25, 0)",
    "mape": "CASE WHEN zero_o = 0 THEN mape END", "smape": "smape", "maape": "CASE WHEN zero_both = 0 THEN maape END", "mapd": "100 * sae / nullif(abs_o, 0)", "msle": "CASE WHEN least_any > 0 THEN msle END", "mle": "CASE WHEN least_any > 0 THEN mle END", "male": "CASE WHEN least_any > 0 THEN male END",
    "rmsle": "CASE WHEN least_any > 0 THEN sqrt(msle) END", "mde": "mde", "mdse": "mdse", "mase": "mae / nullif(stepsize, 0)",
    "r": "r", "r2": "r * r", "wr2": "CASE WHEN abs(cov / vo) <= 1 THEN abs(cov / vo) * r * r ELSE r * r / abs(cov / vo) END", "spearman": "rank_cov / sqrt(rank_vo * rank_vs)", "d": "1 - see / nullif(reach2, 0)", "d1": "1 - sae / nullif(reach1, 0)",
    "dr": "CASE WHEN sae <= 2 * dev_o THEN 1 - sae / nullif(2 * dev_o, 0) ELSE 2 * dev_o / sae - 1 END", "drel": "CASE WHEN zero_o = 0 THEN 1 - rel2 / nullif(reach_rel, 0) END", "lm_index": "1 - sae / nullif(dev_o, 0)",
    "nse": "1 - see / nullif(vo, 0)", "nse_mod": "1 - sae / nullif(dev_o, 0)", "nse_rel": "CASE WHEN zero_o = 0 THEN 1 - rel2 / nullif(dev_rel, 0) END", "lognse": "1 - log_see / nullif(log_vo, 0)",
    "kge2009": "1 - sqrt(power(r - 1, 2) + power(ss / so - 1, 2) + power(ms / mo - 1, 2))", "kge2012": "1 - sqrt(power(r - 1, 2) + power((ss / ms) / (so / mo) - 1, 2) + power(ms / mo - 1, 2))", "kge2021": "1 - sqrt(power(r - 1, 2) + power(ss / so - 1, 2) + power((ms - mo) / so, 2))",
    "kgenp": "1 - sqrt(power(rank_cov / sqrt(rank_vo * rank_vs) - 1, 2) + power(0.5 * fdc_l1, 2) + power(ms / mo - 1, 2))", "ve": "1 - sae / nullif(sum_o, 0)", "pbias": "100 * (sum_o - sum_s) / nullif(sum_o, 0)", "beta_nse": "(ms - mo) / nullif(so, 0)", "alpha": "ss / nullif(so, 0)",
    "fhv": "100 * top_e / nullif(top_o, 0)", "flv": "-100 * (low_s - low_o) / nullif(low_o, 0)", "fms": "100 * ((ln(s80 + eps) - ln(s30 + eps)) - (ln(o80 + eps) - ln(o30 + eps))) / nullif(ln(o80 + eps) - ln(o30 + eps), 0)", "fmm": "100 * (ln(meds + eps) - ln(medo + eps)) / nullif(ln(medo + eps), 0)",
}


def panel(source: str) -> str:
    """CTEs up to ``panel``: one row a series with every sum a metric needs, from ``pairs``."""
    return f"""{source},
st AS (SELECT series_id, count(*) AS n, avg(obs) AS mo, avg(sim) AS ms, stddev_pop(obs) AS so, stddev_pop(sim) AS ss, min(obs) AS lo, max(obs) AS hi, min(least(obs, sim)) AS least_any, max((obs = 0)::INT) AS zero_o, max((obs = 0 AND sim = 0)::INT) AS zero_both,
  quantile_cont(obs, 0.25) AS q25, quantile_cont(obs, 0.75) AS q75, quantile_cont(obs, 0.8) AS o80, quantile_cont(obs, 0.30000000000000004) AS o30, median(obs) AS medo, quantile_cont(sim, 0.8) AS s80, quantile_cont(sim, 0.30000000000000004) AS s30, median(sim) AS meds,
  median(abs(sim - obs)) AS mdae, median(sim - obs) AS mde, median(power(sim - obs, 2)) AS mdse, 0.01 * avg(obs) AS eps FROM pairs GROUP BY series_id),
x AS (SELECT p.*, mo, ms, eps, sim - obs AS e, lag(obs) OVER (PARTITION BY series_id ORDER BY k) AS before FROM pairs p JOIN st USING (series_id)),
lx AS (SELECT series_id, CASE WHEN obs + eps > 0 THEN ln(obs + eps) END AS lo_, CASE WHEN sim + eps > 0 THEN ln(sim + eps) END AS ls_ FROM x),
lg AS (SELECT series_id, CASE WHEN max((lo_ IS NULL OR ls_ IS NULL)::INT) = 0 THEN sum(power(lo_ - ls_, 2)) END AS log_see, var_pop(lo_) * count(*) AS log_vo FROM lx GROUP BY series_id),
sums AS (SELECT series_id, avg(e) AS me, avg(abs(e)) AS mae, avg(e * e) AS mse, sum(e * e) AS see, sum(abs(e)) AS sae, sum(obs) AS sum_o, sum(sim) AS sum_s, sum(abs(obs)) AS abs_o, sum((obs - mo) * (sim - ms)) AS cov, sum(power(obs - mo, 2)) AS vo, sum(power(sim - ms, 2)) AS vs, sum(abs(obs - mo)) AS dev_o,
  sum(power(abs(sim - mo) + abs(obs - mo), 2)) AS reach2, sum(abs(sim - mo) + abs(obs - mo)) AS reach1, sum(power((abs(sim - mo) + abs(obs - mo)) / mo, 2)) AS reach_rel, sum(power(e / nullif(obs, 0), 2)) AS rel2, sum(power((obs - mo) / mo, 2)) AS dev_rel,
  avg(CASE WHEN obs > 0 AND sim > 0 THEN ln(sim / obs) END) AS mle, avg(CASE WHEN obs > 0 AND sim > 0 THEN abs(ln(sim / obs)) END) AS male, avg(CASE WHEN obs > 0 AND sim > 0 THEN power(ln(sim / obs), 2) END) AS msle,
  100 * avg(abs(e / nullif(obs, 0))) AS mape, 100 * avg(coalesce(abs(e) / nullif((abs(obs) + abs(sim)) / 2, 0), 0)) AS smape, avg(CASE WHEN obs = 0 THEN pi() / 2 ELSE atan(abs(e / nullif(obs, 0))) END) AS maape, avg(abs(obs - before)) AS stepsize FROM x GROUP BY series_id),
rk AS (SELECT series_id, rank() OVER (PARTITION BY series_id ORDER BY obs) + (count(*) OVER (PARTITION BY series_id, obs) - 1) / 2.0 AS ro, rank() OVER (PARTITION BY series_id ORDER BY sim) + (count(*) OVER (PARTITION BY series_id, sim) - 1) / 2.0 AS rs FROM pairs),
rks AS (SELECT series_id, sum((ro - (n + 1) / 2.0) * (rs - (n + 1) / 2.0)) AS rank_cov, sum(power(ro - (n + 1) / 2.0, 2)) AS rank_vo, sum(power(rs - (n + 1) / 2.0, 2)) AS rank_vs FROM rk JOIN st USING (series_id) GROUP BY series_id),
fo AS (SELECT series_id, obs AS o, row_number() OVER (PARTITION BY series_id ORDER BY obs DESC) - 1 AS i FROM pairs), fs AS (SELECT series_id, sim AS s, row_number() OVER (PARTITION BY series_id ORDER BY sim DESC) - 1 AS i FROM pairs),
fd AS (SELECT *, i >= floor(0.7 * n) AS tail FROM fo JOIN fs USING (series_id, i) JOIN st USING (series_id)),
fds AS (SELECT series_id, sum(abs(s / (n * ms) - o / (n * mo))) AS fdc_l1, sum(CASE WHEN i < greatest(1, floor(0.02 * n + 0.5)) THEN s - o END) AS top_e, sum(CASE WHEN i < greatest(1, floor(0.02 * n + 0.5)) THEN o END) AS top_o,
  sum(CASE WHEN tail THEN ln(o + eps) END) - count_if(tail) * min(CASE WHEN tail THEN ln(o + eps) END) AS low_o, sum(CASE WHEN tail THEN ln(s + eps) END) - count_if(tail) * min(CASE WHEN tail THEN ln(s + eps) END) AS low_s FROM fd GROUP BY series_id),
panel AS (SELECT *, cov / sqrt(vo * vs) AS r FROM st JOIN sums USING (series_id) JOIN lg USING (series_id) JOIN rks USING (series_id) JOIN fds USING (series_id))"""


def wide(ids: list[str], source: str | None = None, digits: int = 6) -> str:
    return f"WITH {panel(source or pairs())} SELECT series_id, {', '.join(f'round({METRICS[i]}, {digits}) AS {i}' for i in ids)} FROM panel"


def long(ids: list[str], source: str | None = None) -> str:
    return f"WITH {panel(source or pairs())}, " + "long AS (" + " UNION ALL ".join(f"SELECT series_id, '{i}' AS metric_id, {METRICS[i]} AS value FROM panel" for i in ids) + ")"


LOW_NSE = "1 - sum(power(sim - obs, 2)) / nullif(sum(power(obs - mo, 2)), 0)"

def _events(c: str = "obs", x: str = "") -> str:
    """CTEs up to ``events_`` of one side; x ends their names."""
    return f"""hit{x} AS (SELECT series_id, k, {c} AS q FROM pairs JOIN thr USING (series_id) WHERE {c} > threshold),
run{x} AS (SELECT *, k - row_number() OVER (PARTITION BY series_id ORDER BY k) AS g FROM hit{x}),
runs{x} AS (SELECT series_id, g, min(k) AS s, max(k) AS e FROM run{x} GROUP BY ALL),
far{x} AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY series_id ORDER BY s) < 5 THEN 0 ELSE 1 END AS new FROM runs{x}),
num{x} AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY s) - 1 AS event_no FROM far{x}),
span{x} AS (SELECT series_id, event_no, min(s) AS start_k, max(e) AS end_k FROM num{x} GROUP BY ALL),
top{x} AS (SELECT series_id, event_no, start_k, end_k, k AS peak_k, q AS peak_q, row_number() OVER (PARTITION BY series_id, event_no ORDER BY q DESC, k) AS place FROM span{x} JOIN hit{x} USING (series_id) WHERE k BETWEEN start_k AND end_k),
events_{x} AS (SELECT series_id, event_no::BIGINT AS event_no, start_k, end_k, peak_k, peak_q FROM top{x} WHERE place = 1)"""


EVENTS = f"""WITH {pairs()},
thr AS (SELECT series_id, quantile_cont(obs, 0.9) AS threshold FROM pairs GROUP BY series_id),
{_events()}"""


def _matches(order: str) -> str:
    """CTEs up to ``matched`` (series_id, pairs of event numbers): in order, each observed event takes its first free overlapping one."""
    return f"""{EVENTS.replace("WITH", "WITH RECURSIVE", 1)}, {_events("sim", "_sim")},
asks AS MATERIALIZED (SELECT a.series_id, a.event_no, coalesce(list(b.event_no ORDER BY {order}, b.event_no) FILTER (WHERE b.event_no IS NOT NULL), []) AS others FROM events_ a LEFT JOIN events__sim b ON b.series_id = a.series_id AND a.start_k - 3 <= b.end_k AND b.start_k - 3 <= a.end_k GROUP BY ALL),
m AS (SELECT series_id, -1::BIGINT AS event_no, []::BIGINT[] AS used, []::BIGINT[] AS askers FROM thr
  UNION ALL SELECT series_id, event_no, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END, CASE WHEN len(free) > 0 THEN list_append(askers, event_no) ELSE askers END
  FROM (SELECT m.series_id, a.event_no, used, askers, list_filter(others, lambda o: NOT list_contains(used, o)) AS free FROM m JOIN asks a ON a.series_id = m.series_id AND a.event_no = m.event_no + 1)),
matched AS (SELECT series_id, used, askers FROM m QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY event_no DESC) = 1),
total AS (SELECT series_id, (SELECT count(*) FROM events_ e WHERE e.series_id = thr.series_id) AS a, (SELECT count(*) FROM events__sim e WHERE e.series_id = thr.series_id) AS b FROM thr)"""


THREAT = f"""{_matches("b.event_no")} SELECT series_id, len(used)::BIGINT AS hits, (a - len(used))::BIGINT AS misses, (b - len(used))::BIGINT AS false_alarms, round(len(used) / nullif(a + b - len(used), 0), 6) AS event_threat FROM matched JOIN total USING (series_id)"""
DISTANCE = f"""{_matches("abs(b.peak_k - a.peak_k)")},
both_ AS (SELECT series_id, unnest(askers) AS event_no, unnest(used) AS other FROM matched),
limbs AS (SELECT b.series_id, unnest([{{'x': a.start_k, 'x1': a.peak_k, 'y': s.start_k, 'y1': s.peak_k}}, {{'x': a.peak_k, 'x1': a.end_k, 'y': s.peak_k, 'y1': s.end_k}}]) AS l FROM both_ b JOIN events_ a USING (series_id, event_no) JOIN events__sim s ON s.series_id = b.series_id AND s.event_no = b.other),
u AS (SELECT series_id, l.x + i / 20.0::DOUBLE * (l.x1 - l.x) AS t, l.y + i / 20.0::DOUBLE * (l.y1 - l.y) AS v FROM limbs, (SELECT unnest(range(21)) AS i)),
w AS (SELECT u.series_id, v - t AS late, o.obs + (t - o.k) * coalesce(p.obs - o.obs, 0) AS q, s.sim + (v - s.k) * coalesce(r.sim - s.sim, 0) AS z FROM u JOIN pairs o ON o.series_id = u.series_id AND o.k = floor(t) LEFT JOIN pairs p ON p.series_id = u.series_id AND p.k = floor(t) + 1
  JOIN pairs s ON s.series_id = u.series_id AND s.k = floor(v) LEFT JOIN pairs r ON r.series_id = u.series_id AND r.k = floor(v) + 1)
SELECT series_id, round(any_value(len(used) / nullif(a + b - len(used), 0)), 6) AS sd_occ, round(avg(CASE WHEN q <> 0 THEN 100 * (z - q) / q END), 6) AS sd_amp, round(avg(late), 6) AS sd_time, round(avg(abs(late)), 6) AS sd_abs_time FROM matched JOIN total USING (series_id) LEFT JOIN w USING (series_id) GROUP BY series_id"""

PEAKS = f"""WITH RECURSIVE {pairs()},
dev AS (SELECT series_id, stddev_pop(obs) AS least, count(*) AS n FROM pairs GROUP BY series_id),
side AS (SELECT *, lag(obs) OVER w AS obs_before, lead(obs) OVER w AS obs_after, lag(sim) OVER w AS sim_before, lead(sim) OVER w AS sim_after FROM pairs WINDOW w AS (PARTITION BY series_id ORDER BY k)),
mid AS (SELECT series_id, k, obs FROM side WHERE obs > obs_before AND obs >= obs_after),
lim AS (SELECT m.series_id, m.k, m.obs, coalesce(max(CASE WHEN p.k < m.k THEN p.k END), -1) AS lo, coalesce(min(CASE WHEN p.k > m.k THEN p.k END), 1000000000) AS hi FROM mid m LEFT JOIN pairs p ON p.series_id = m.series_id AND p.obs > m.obs GROUP BY ALL),
prom AS (SELECT l.series_id, l.k, l.obs, l.obs - greatest(min(CASE WHEN p.k <= l.k THEN p.obs END), min(CASE WHEN p.k >= l.k THEN p.obs END)) AS prominence FROM lim l JOIN pairs p ON p.series_id = l.series_id AND p.k > lo AND p.k < hi GROUP BY l.series_id, l.k, l.obs),
high AS MATERIALIZED (SELECT series_id, k, row_number() OVER (PARTITION BY series_id ORDER BY obs DESC, k) AS place FROM prom JOIN dev USING (series_id) WHERE prominence > least),
pick AS (SELECT series_id, 0::BIGINT AS place, []::BIGINT[] AS kept FROM dev UNION ALL SELECT p.series_id, h.place, CASE WHEN len(list_filter(kept, lambda q: abs(q - h.k) < 5)) = 0 THEN list_append(kept, h.k) ELSE kept END FROM pick p JOIN high h ON h.series_id = p.series_id AND h.place = p.place + 1),
kept AS (SELECT series_id, unnest(kept) AS t FROM (SELECT * FROM pick QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY place DESC) = 1)),
near AS (SELECT x.series_id, t, s.k AS m, sim, sim_before, sim_after, row_number() OVER (PARTITION BY x.series_id, t ORDER BY sim DESC, s.k) AS place FROM kept x JOIN side s ON s.series_id = x.series_id AND s.k BETWEEN t - 3 AND t + 3),
found AS (SELECT series_id, t, m, sim, NOT ((m = greatest(0, t - 3) AND coalesce(sim_before > sim, false)) OR (m = least(n - 1, t + 3) AND coalesce(sim_after > sim, false))) AS resolved FROM near JOIN dev USING (series_id) WHERE place = 1),
peaks AS (SELECT f.series_id, t AS obs_k, m AS sim_k, CASE WHEN resolved THEN m - t END::DOUBLE AS lag, p.obs AS obs_q, f.sim AS sim_q, resolved FROM found f JOIN pairs p ON p.series_id = f.series_id AND p.k = t)"""

# Warping cell by cell along anti-diagonals: each step keeps the last two; of equal ways the diagonal goes first, then the step in obs.
DTW = f"""WITH RECURSIVE {pairs("%s").replace("%s", f"{FLAG.replace('series AS', 'daily AS')}, series AS (SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS ts, avg(obs) AS obs, avg(sim) AS sim FROM daily GROUP BY ALL)")},
p AS MATERIALIZED (SELECT series_id, k, obs, sim FROM pairs), size AS MATERIALIZED (SELECT series_id, count(*) AS n, greatest(1, ceil(0.1 * count(*)))::BIGINT AS band FROM p GROUP BY series_id),
cell AS (SELECT series_id, 0::BIGINT AS d, 0::BIGINT AS i, 0::BIGINT AS j, abs(obs - sim) AS c, 1::BIGINT AS steps, 0::BIGINT AS warp, true AS new FROM p WHERE k = 0
UNION ALL SELECT * FROM (
  WITH child AS (SELECT series_id, i + di AS i, j + dj AS j, c, steps, warp, way FROM cell, (VALUES (1, 1, 0, false), (1, 0, 1, true), (0, 1, 2, true)) v(di, dj, way, of_new) WHERE new = of_new),
  best AS (SELECT series_id, i, j, arg_min({{'c': c, 'steps': steps, 'warp': warp}}, {{'c': c, 'way': way}}) AS b FROM child GROUP BY ALL)
  SELECT x.series_id, i + j, i, j, b.c + abs(a.obs - z.sim), b.steps + 1, b.warp + abs(i - j), true FROM best x JOIN size USING (series_id) JOIN p a ON a.series_id = x.series_id AND a.k = i JOIN p z ON z.series_id = x.series_id AND z.k = j WHERE abs(i - j) <= band
  UNION ALL SELECT series_id, d, i, j, c, steps, warp, false FROM cell WHERE new))
SELECT series_id, round(c, 6) AS distance, steps AS path_length, round(c / steps, 6) AS dtw_dist, round(warp / steps, 6) AS dtw_warp FROM cell JOIN size USING (series_id) WHERE new AND i = n - 1 AND j = n - 1"""

ERRORS = f"""{EVENTS},
near AS (SELECT v.*, p.k, p.sim, p.obs, row_number() OVER (PARTITION BY v.series_id, event_no ORDER BY sim DESC, k) AS place, sum(CASE WHEN k BETWEEN start_k AND end_k THEN obs END) OVER (PARTITION BY v.series_id, event_no) AS vo, sum(CASE WHEN k BETWEEN start_k AND end_k THEN sim END) OVER (PARTITION BY v.series_id, event_no) AS vs
  FROM events_ v JOIN pairs p ON p.series_id = v.series_id AND p.k BETWEEN start_k - 3 AND end_k + 3),
errors AS (SELECT series_id, event_no, k - peak_k AS peak_lag, 100 * (sim - peak_q) / peak_q AS peak_mag_err_pct, 100 * (vs - vo) / vo AS volume_err_pct FROM near WHERE place = 1)"""

SWEEP = f"""WITH {pairs()},
j AS (SELECT a.series_id, lag, a.k, a.obs, b.sim FROM pairs a, (SELECT unnest(range(-30, 31)) AS lag) JOIN pairs b ON b.series_id = a.series_id AND b.k = a.k + lag),
m AS (SELECT series_id, lag, avg(obs) AS mo, avg(sim) AS ms, sum(obs) AS too, sum(sim) AS tos, max(k) AS last FROM j GROUP BY ALL),
c AS (SELECT j.*, mo, ms, last, abs(sum(obs / too) OVER w - sum(sim / tos) OVER w) AS gap FROM j JOIN m USING (series_id, lag) WINDOW w AS (PARTITION BY series_id, lag ORDER BY k)),
sweep AS (SELECT series_id, lag::INT AS lag, {LOW_NSE} AS nse, sum((obs - mo) * (sim - ms)) / sqrt(sum(power(obs - mo, 2)) * sum(power(sim - ms, 2))) AS r,
  sqrt(sum(power(sim - ms, 2)) / sum(power(obs - mo, 2))) AS a, max(ms) / max(mo) AS b, sum(CASE WHEN k < last THEN gap ELSE 0 END) AS w1 FROM c GROUP BY ALL)"""

MASS = f"""WITH {pairs()},
f AS (SELECT series_id, k, sum(obs / t) OVER w AS fo, sum(sim / u) OVER w AS fs FROM (SELECT *, sum(obs) OVER (PARTITION BY series_id) AS t, sum(sim) OVER (PARTITION BY series_id) AS u FROM pairs) WINDOW w AS (PARTITION BY series_id ORDER BY k))"""


def _weights(i: str, n: str) -> str:
    return f"""CASE WHEN {n} < 2 THEN 0 WHEN {n} = 2 THEN 0.5 ELSE
  (CASE WHEN {i} >= {n} - ({n} + 1) % 2 THEN 0 WHEN {i} = 0 OR {i} = {n} - ({n} + 1) % 2 - 1 THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END) / 3.0::DOUBLE
  + CASE WHEN {n} % 2 = 1 THEN 0 WHEN {i} = {n} - 1 THEN 5 / 12.0::DOUBLE WHEN {i} = {n} - 2 THEN 2 / 3.0::DOUBLE WHEN {i} = {n} - 3 THEN -1 / 12.0::DOUBLE ELSE 0 END END"""


DE = f"""WITH {panel(pairs())},
b AS (SELECT series_id, i, CASE WHEN s = o THEN 0 ELSE (s - o) / nullif(o, 0) END AS b FROM fd),
z AS (SELECT series_id, b - avg(b) OVER (PARTITION BY series_id) AS res, b, row_number() OVER (PARTITION BY series_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY series_id) AS m FROM b WHERE b IS NOT NULL),
h AS (SELECT *, m // 2 AS mid FROM z),
g AS (SELECT series_id, avg(b) AS raw, sum(abs(res) * ({_weights("j", "m")}) / (m - 1)) AS area, sum(CASE WHEN j < mid THEN res * ({_weights("j", "mid")}) * 0.5 / (mid - 1) END) AS high, sum(CASE WHEN j >= mid THEN res * ({_weights("(j - mid)", "(m - mid)")}) * 0.5 / (m - mid - 1) END) AS low FROM h GROUP BY series_id),
q AS (SELECT series_id, CASE WHEN abs(raw) < 0.001 THEN 0 ELSE raw END AS c, CASE WHEN abs(area) < 0.001 THEN 0 ELSE area END AS d, CASE WHEN (high > 0 AND low < 0) OR (high = 0 AND low < 0) OR (high > 0 AND low = 0) THEN -1 WHEN (high < 0 AND low > 0) OR (high = 0 AND low > 0) OR (high < 0 AND low = 0) THEN 1 ELSE 0 END AS way FROM g)
SELECT series_id, round(sqrt(c * c + d * d + power(r - 1, 2)), 6) AS de, round(c, 6) AS de_const, round(d, 6) AS de_dyn, round(least(CASE WHEN abs(atan2(c, d * way)) < 0.001 THEN 0 ELSE atan2(c, d * way) END, 3.1414), 6) AS phi,
  round(least(CASE WHEN abs(atan2(c, d)) < 0.001 THEN 0 ELSE atan2(c, d) END, 3.1414), 6) AS phi_fdc, lo <= 0 AS non_perennial FROM q JOIN panel USING (series_id)"""


def draw(k: str, seed: int) -> str:
    """The generator's draw number k, with 128-bit products."""
    mul = lambda a, b: f"(({a})::HUGEINT * ({b})::HUGEINT % 4294967296)::BIGINT"
    a = f"((({k})::HUGEINT + 1) * 1831565813 + {seed}) % 4294967296"
    t1 = lambda c: mul(f"xor({c}, {c} >> 15)", f"{c} | 1")
    return f"(SELECT xor(t2, t2 >> 14) / 4294967296.0::DOUBLE FROM (SELECT xor((t1 + {mul('xor(t1, t1 >> 7)', 't1 | 61')}) % 4294967296, t1) AS t2 FROM (SELECT {t1('a0')} AS t1 FROM (SELECT ({a})::BIGINT AS a0))))"


def steps(source: str) -> str:
    """CTEs up to ``steps_`` (series_id, step_ms, irregular, monthly) from the gaps between the dates of a CTE."""
    return f"""g AS (SELECT series_id, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM {source} WHERE ts IS NOT NULL), c AS (SELECT series_id, gap, count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY ALL),
t AS (SELECT series_id, arg_max(gap, c * 1e12 - gap) AS mode, max(c) AS mode_n, sum(c) AS n, sum(CASE WHEN gap BETWEEN 28 * 86400000::BIGINT AND 31 * 86400000::BIGINT THEN c ELSE 0 END) AS months FROM c GROUP BY series_id),
o AS (SELECT series_id, any_value(mode) AS mode, any_value(mode_n) AS mode_n, any_value(n) AS n, any_value(months) AS months, sum(CASE WHEN gap <> mode AND (mode = 0 OR gap % mode <> 0) THEN c ELSE 0 END) AS off FROM c JOIN t USING (series_id) GROUP BY series_id),
steps_ AS (SELECT series_id, CASE WHEN months > 0.9 * n THEN 30 * 86400000::BIGINT ELSE mode END::BIGINT AS step_ms, months <= 0.9 * n AND (off > 0.05 * n OR n - mode_n > 0.5 * n) AS irregular, months > 0.9 * n AS monthly FROM o)"""


_RULES = [
    ("error", "undated > 0", "dates that can''t be read"), ("error", "overlap < 2", "fewer than two complete pairs"), ("warning", "dups > 0", "repeated dates"), ("warning", "irregular", "irregular time step"),
    ("warning", "obs_missing > 0.5 * n", "more than half of the observations are missing"), ("warning", "negative > 0", "negative values"), ("warning", "overlap >= 2 AND (overlap < 30 OR overlap < 0.1 * n)", "little overlap"),
]
CHECKS = f"""WITH {FLAG}, {MESSY}, every_ AS (SELECT series_id, ts, obs, sim FROM series UNION ALL SELECT * FROM messy), {steps("every_")},
f AS (SELECT series_id, count(*) AS n, count_if(ts IS NULL) AS undated, count(ts) - count(DISTINCT ts) AS dups, count_if(obs IS NULL) AS obs_missing, count_if(obs < 0 OR sim < 0) AS negative, count_if(obs IS NOT NULL AND sim IS NOT NULL) AS overlap FROM every_ GROUP BY series_id),
x AS (SELECT f.*, coalesce(irregular, false) AS irregular FROM f LEFT JOIN steps_ USING (series_id))
""" + " UNION ALL ".join(f"SELECT series_id, '{level}' AS level, '{text}' AS message FROM x WHERE {rule}" for level, rule, text in _RULES)


def normals(seed: int) -> str:
    """CTE ``z`` (j, z): normal draws by the polar method, as many as the longest series needs."""
    return f"""tries AS (SELECT m, 2 * {draw('2 * m', seed)} - 1 AS x, 2 * {draw('2 * m + 1', seed)} - 1 AS y FROM (SELECT unnest(range(2 * (SELECT max(k) + 1 FROM pairs) + 32)) AS m)),
good AS (SELECT x, y, sqrt(-2 * ln(x * x + y * y) / (x * x + y * y)) AS f, row_number() OVER (ORDER BY m) - 1 AS place FROM tries WHERE x * x + y * y > 0 AND x * x + y * y < 1),
z AS (SELECT 2 * place AS j, x * f AS z FROM good UNION ALL SELECT 2 * place + 1, y * f FROM good)"""


def resampled_pairs(b: int, seed: int) -> str:
    """CTE ``pairs`` of moving-block replicates: series_id is the series and the replicate."""
    return f"""{pairs().replace("pairs AS (", "base AS (")}, size AS (SELECT series_id, count(*) AS n, greatest(3, floor(cbrt(count(*)) + 0.5))::BIGINT AS len FROM base GROUP BY series_id),
blocks AS (SELECT *, unnest(range(blocks)) AS blk FROM (SELECT *, ceil(n / len)::BIGINT AS blocks, unnest(range({b})) AS b FROM size)), starts AS (SELECT *, floor({draw("b * blocks + blk", seed)} * n)::BIGINT AS start FROM blocks),
places AS (SELECT *, unnest(range(len)) AS j FROM starts),
pairs AS (SELECT i.series_id || '#' || b AS series_id, p.ts, blk * len + j AS k, obs, sim FROM places i JOIN base p ON p.series_id = i.series_id AND p.k = (start + j) % n WHERE blk * len + j < n)"""


def skills() -> str:
    """NSE and KGE of the model and of the climatology, each from its own panel."""
    bench = pairs().replace("pairs AS (", "base AS (") + ", pairs AS (SELECT series_id, ts, k, obs, avg(obs) OVER (PARTITION BY series_id, month(ts)) AS sim FROM base)"
    of = lambda source, x: f"(WITH {panel(source)} SELECT series_id, {METRICS['nse']} AS nse{x}, {METRICS['kge2009']} AS kge{x} FROM panel)"
    return f"SELECT series_id, round(least(1, (nse - nse_b) / (1 - nse_b)), 6) AS nse_skill, round(least(1, (kge - kge_b) / (1 - kge_b)), 6) AS kge_skill FROM {of(pairs(), '')} JOIN {of(bench, '_b')} USING (series_id)"
