"""DuckDB SQL that must give the same rows as the queries of ``catalog``."""

from __future__ import annotations


def r6(x: str) -> str:
    """Half-up rounding to six places by the same double arithmetic as ``functions.scalars.r6``."""
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6 + 0.0)"


def r9(x: str) -> str:
    """Nine significant digits as ``functions.scalars.r9`` has them."""
    size = f"pow(10.0, floor(log10(abs({x}))))"
    return f"(CASE WHEN ({x}) = 0 THEN 0.0 WHEN abs({x}) < 'inf'::DOUBLE THEN floor(({x}) / {size} * 1e8 + 0.5) / 1e8 * {size} END)"


def ceil_ts(width: str, ts: str = "ts") -> str:
    us = width_us(width)
    return f"make_timestamp(CAST(((epoch_us({ts}) + {us - 1}) // {us}) * {us} AS BIGINT))"


def floor_ts(width: str, ts: str = "ts") -> str:
    us = width_us(width)
    return f"make_timestamp(CAST((epoch_us({ts}) // {us}) * {us} AS BIGINT))"


def width_us(width: str) -> int:
    return int(width[:-1]) * {"m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}[width[-1]]


LAST = "arg_max({}, {{'t': epoch_us(ts), 'i': event_id}})"


def last(col: str) -> str:
    return LAST.format(col)


HOURLY = f"""SELECT event_type AS symbol, {floor_ts("6h")} AS ts, avg(value) AS value FROM events GROUP BY ALL"""
HOURLY_1 = f"""SELECT event_type AS symbol, {floor_ts("1h")} AS ts, avg(value) AS value FROM events GROUP BY ALL"""
#: The 1 h means of every time that occurs and every symbol, what is missing filled with the symbol's mean over times.
FILLED = """
times AS (SELECT DISTINCT ts FROM h), names AS (SELECT DISTINCT symbol FROM h), means AS (SELECT symbol, avg(value) AS m FROM h GROUP BY symbol),
filled AS (SELECT ts, symbol, coalesce(value, m) AS value FROM times CROSS JOIN names JOIN means USING (symbol) LEFT JOIN h USING (ts, symbol))"""


def dense(width: str) -> str:
    """Mean value of every type and bucket from the first to the last midnight, null where there is none."""
    return f"""
kinds AS (SELECT DISTINCT event_type FROM events),
span AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL {width_us(width) // 60_000_000} MINUTE)) AS ts),
means AS (SELECT event_type, {floor_ts(width)} AS ts, avg(value) AS value FROM events GROUP BY ALL),
dense AS (SELECT event_type, ts, value FROM kinds CROSS JOIN span LEFT JOIN means USING (event_type, ts))"""


#: Days from the first to the last, for every type.
DAILY = f"""
kinds AS (SELECT DISTINCT event_type FROM events),
span AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS ts),
means AS (SELECT event_type, {floor_ts("1d")} AS ts, avg(value) AS value FROM events GROUP BY ALL),
daily AS (SELECT event_type, ts, value FROM kinds CROSS JOIN span LEFT JOIN means USING (event_type, ts))"""


def stumps(rounds: int, bins: int, rate: float, least: int) -> str:
    """Rounds of the best single split over histogram sums of whole numbers, for rows f(event_type, ts, value, x1, x2, x3)."""
    parts = [
        "wide AS (SELECT row_number() OVER (ORDER BY event_type, ts) AS id, * FROM f)",
        "long AS (SELECT id, unnest([1, 2, 3]) AS feat, unnest([x1, x2, x3]) AS x FROM wide)",
        "ranked AS (SELECT feat, x, row_number() OVER (PARTITION BY feat ORDER BY x) AS r, count(*) OVER (PARTITION BY feat) AS n FROM long)",
        f"cuts AS (SELECT DISTINCT feat, x AS cut FROM ranked JOIN (SELECT unnest(range(1, {bins})) AS k) ON r = CAST(ceil(n * (k / {float(bins)})) AS BIGINT))",
        "binned AS (SELECT id, l.feat, 1 + count(cut) AS bin FROM long l LEFT JOIN cuts c ON c.feat = l.feat AND c.cut < l.x GROUP BY id, l.feat)",
        "unit AS (SELECT pow(2, ceil(log2(max(abs(value)))) - 30) AS grain FROM wide)",
        "p0 AS (SELECT id, value, grain, CAST(sum(CAST(floor(value / grain + 0.5) AS BIGINT)) OVER () AS DOUBLE) / count(*) OVER () * grain AS pred FROM wide CROSS JOIN unit)",
    ]
    for k in range(rounds):
        parts += [
            f"g{k} AS (SELECT id, CAST(floor((pred - value) / grain + 0.5) AS BIGINT) AS g FROM p{k})",
            f"h{k} AS (SELECT feat, bin, sum(g) AS g, count(*) AS n FROM binned JOIN g{k} USING (id) GROUP BY ALL)",
            f"c{k} AS (SELECT feat, bin, CAST(sum(g) OVER w AS DOUBLE) AS g, sum(n) OVER w AS n, CAST(sum(g) OVER (PARTITION BY feat) AS DOUBLE) AS t, sum(n) OVER (PARTITION BY feat) AS m FROM h{k} WINDOW w AS (PARTITION BY feat ORDER BY bin))",
            f"s{k} AS (SELECT * FROM c{k} WHERE n >= {least} AND m - n >= {least} ORDER BY g * g / (n + 1.0) + (t - g) * (t - g) / (m - n + 1.0) DESC, feat, bin LIMIT 1)",
            f"p{k + 1} AS (SELECT p.id, value, grain, pred + CASE WHEN b.bin <= s.bin THEN -{rate} * grain * s.g / (s.n + 1.0) ELSE -{rate} * grain * (s.t - s.g) / (s.m - s.n + 1.0) END AS pred FROM p{k} p CROSS JOIN s{k} s JOIN binned b ON b.id = p.id AND b.feat = s.feat)",
        ]
    return ", ".join(parts)


PARTS = f"""
h AS ({HOURLY}),
train AS (SELECT * FROM h WHERE ts < TIMESTAMP '2024-01-22'), query AS (SELECT * FROM h WHERE ts >= TIMESTAMP '2024-01-22'),
tm AS (SELECT symbol, avg(value) AS m FROM train GROUP BY 1), qm AS (SELECT symbol, avg(value) AS m FROM query GROUP BY 1),
tf AS (SELECT ts, symbol, coalesce(value, m) AS value FROM (SELECT DISTINCT ts FROM train) CROSS JOIN tm LEFT JOIN train USING (ts, symbol)),
qf AS (SELECT ts, symbol, coalesce(value, m) AS value FROM (SELECT DISTINCT ts FROM query) CROSS JOIN qm LEFT JOIN query USING (ts, symbol))"""
SQUARES = "sum((q.value - t.value) * (q.value - t.value))"


#: Mahalanobis distances of three coordinates, times the covariance's determinant: by its cofactors.
WHITE = """
tw AS (SELECT ts, max(value) FILTER (symbol = 'click') AS x, max(value) FILTER (symbol = 'purchase') AS y, max(value) FILTER (symbol = 'view') AS z FROM tf GROUP BY 1),
qw AS (SELECT ts, max(value) FILTER (symbol = 'click') AS x, max(value) FILTER (symbol = 'purchase') AS y, max(value) FILTER (symbol = 'view') AS z FROM qf GROUP BY 1),
v AS (SELECT covar_samp(x, x) AS a, covar_samp(x, y) AS b, covar_samp(x, z) AS e, covar_samp(y, y) AS d, covar_samp(y, z) AS f, covar_samp(z, z) AS g FROM tw),
apart AS (SELECT q.ts AS ts, t.ts AS near, (d * g - f * f) * pow(q.x - t.x, 2) + (a * g - e * e) * pow(q.y - t.y, 2) + (a * d - b * b) * pow(q.z - t.z, 2)
  + 2 * ((e * f - b * g) * (q.x - t.x) * (q.y - t.y) + (b * f - d * e) * (q.x - t.x) * (q.z - t.z) + (b * e - a * f) * (q.y - t.y) * (q.z - t.z)) AS d
  FROM qw q CROSS JOIN tw t CROSS JOIN v)"""


def time_ranks(apart: str, pairs: str = "") -> str:
    pairs = pairs or f"""
apart AS (SELECT q.ts AS ts, t.ts AS near, {apart} AS d FROM qf q JOIN tf t ON q.symbol = t.symbol
  WHERE q.symbol IN ('click', 'purchase', 'view') GROUP BY 1, 2)"""
    return f"""{pairs},
ranked AS (SELECT ts, near, row_number() OVER (PARTITION BY ts ORDER BY d, near) AS k FROM apart),
by_time AS (SELECT r.ts, t.symbol, avg(value) FILTER (k <= 3) AS n3, avg(value) FILTER (k <= 5) AS n5, (sum(value) - min(value) - max(value)) / (count(*) - 2) AS trimmed FROM ranked r JOIN tf t ON t.ts = r.near WHERE k <= 5 GROUP BY 1, 2)"""


def symbol_ranks(apart: str) -> str:
    return f"""
paths AS (SELECT a.symbol, b.symbol AS base, {apart} AS d FROM tf a JOIN tf b USING (ts)
  WHERE b.symbol IN ('click', 'purchase', 'view') AND a.symbol <> b.symbol GROUP BY 1, 2),
close AS (SELECT symbol, base, row_number() OVER (PARTITION BY symbol ORDER BY d, base) AS j FROM paths),
by_symbol AS (SELECT q.ts, c.symbol, avg(value) FILTER (j <= 1) AS n1, avg(value) FILTER (j <= 2) AS n2, avg(value) FILTER (j <= 3) AS n3
  FROM close c JOIN qf q ON q.symbol = c.base GROUP BY 1, 2)"""


TIME_RANKS, SYMBOL_RANKS = time_ranks(SQUARES), symbol_ranks("sum((a.value - b.value) * (a.value - b.value))")
FORECAST = "SELECT event_id, ts, event_type, value AS y_true, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y_pred FROM events"


def ready(day: str) -> str:
    """A day's rows of three types with their neighbours' means out of the week before it."""
    return f"""
WITH {dense("3h")}, e AS (SELECT event_type AS symbol, ts, coalesce(value, 0) AS value FROM dense WHERE event_type IN ('click', 'purchase', 'view')),
tf AS (SELECT symbol, {floor_ts("6h")} AS ts, avg(value) AS value FROM e WHERE ts >= TIMESTAMP '{day}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{day}' GROUP BY ALL),
qf AS (SELECT * FROM e WHERE ts >= TIMESTAMP '{day}' AND ts < TIMESTAMP '{day}' + INTERVAL 1 DAY),
apart AS (SELECT q.ts AS ts, t.ts AS near, {SQUARES} AS d FROM qf q JOIN tf t ON q.symbol = t.symbol GROUP BY 1, 2),
ranked AS (SELECT ts, near, row_number() OVER (PARTITION BY ts ORDER BY d, near) AS k FROM apart),
by_time AS (SELECT r.ts, t.symbol, avg(value) AS n2 FROM ranked r JOIN tf t ON t.ts = r.near WHERE k <= 2 GROUP BY 1, 2), {SYMBOL_RANKS}
SELECT q.ts, q.symbol, {r6("q.value * 2")} AS y, {r6("q.value")} AS value, {r6("t.n2")} AS value_time_nn2_mean, {r6("s.n2")} AS value_symbol_nn2_mean
FROM qf q LEFT JOIN by_time t USING (ts, symbol) LEFT JOIN by_symbol s USING (ts, symbol)"""


def qlike(y: str, p: str, eps: str = "1e-12") -> str:
    r = f"(greatest({y} * {y}, {eps}) / greatest({p} * {p}, {eps}))"
    return f"{r} - ln({r}) - 1"


SCORES = f"""count(*) AS n, {r6("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))")} AS rmse, {r6("avg(abs(y_true - y_pred))")} AS mae,
  {r6("covar_pop(y_true, y_pred) / nullif(stddev_pop(y_true) * stddev_pop(y_pred), 0)")} AS corr"""
IMPORTANCES = "SELECT p_brand AS feature, CAST(year(l_shipdate) AS VARCHAR) AS block_name, l_extendedprice AS gain, CAST(l_quantity AS BIGINT) AS split FROM lineitem JOIN part ON p_partkey = l_partkey"
TOP = "top AS (SELECT feature FROM imp GROUP BY feature ORDER BY avg(gain) DESC, feature LIMIT 8)"
CELLS = """cells AS (SELECT feature, block_name, coalesce(sum(gain), 0) AS value FROM top CROSS JOIN (SELECT DISTINCT block_name FROM imp JOIN top USING (feature)) LEFT JOIN imp USING (feature, block_name) GROUP BY 1, 2)"""
DAYS = "days AS (SELECT ts::DATE AS date, row_number() OVER (ORDER BY ts::DATE) - 1 AS k FROM events GROUP BY 1)"


def _book() -> str:
    cols, sides = [], {"a": "O", "b": "F"}
    for side, status in sides.items():
        for k in range(1, 8):
            own = f"FILTER (l_linestatus = '{status}' AND l_linenumber = {k})"
            cols += [f"sum(l_quantity) {own} AS {side}q{k}", f"sum(l_extendedprice) {own} / sum(l_quantity) {own} AS {side}p{k}"]
    ask, bid = (" + ".join(f"coalesce({s}q{k}, 0)" for k in range(1, 8)) for s in "ab")
    paid = " + ".join(f"coalesce({s}p{k} * {s}q{k}, 0)" for s in "ab" for k in range(1, 8))
    return f"""
WITH book AS (SELECT l_orderkey, {", ".join(cols)} FROM lineitem GROUP BY 1),
f AS (SELECT o_custkey, l_orderkey, ({paid}) / nullif(({ask}) + ({bid}), 0) AS vwap, (({ask}) - ({bid})) / nullif(({ask}) + ({bid}), 0) AS imbalance,
  ap1 - bp1 AS spread, (ap1 + bp1) / 2 AS mid FROM book JOIN orders ON o_orderkey = l_orderkey)
SELECT o_custkey, l_orderkey, {r6("vwap")} AS vwap, {r6("imbalance")} AS imbalance, {r6("spread")} AS spread, {r6("mid")} AS mid,
  {r6("ln(mid) - lag(ln(mid)) OVER (PARTITION BY o_custkey ORDER BY l_orderkey)")} AS log_return FROM f"""


_PLAN = f"""{r6(last("value"))} AS value_last, {r6("avg(value)")} AS value_mean, {r6("coalesce(stddev_samp(value), 0)")} AS value_std, {last("user_id")} AS user_id_last"""

ORACLE_SQL = {
    "downsample_right_closed": f"SELECT event_type, {ceil_ts('6h')} AS ts, {_PLAN} FROM events GROUP BY event_type, {ceil_ts('6h')}",
    "downsample_left_mean": f"SELECT event_type, {floor_ts('6h')} AS ts, {r6('avg(value)')} AS value FROM events GROUP BY event_type, {floor_ts('6h')}",
    "rolling_trailing": f"""
SELECT event_id, event_type, ts, {r6("vl")} AS value_last, {r6("vm")} AS value_mean, {r6("coalesce(vs, 0)")} AS value_std, ul AS user_id_last FROM (
  SELECT event_id, event_type, ts, {last("value")} OVER w AS vl, avg(value) OVER w AS vm, stddev_samp(value) OVER w AS vs, {last("user_id")} OVER w AS ul
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))""",
    "asof_backward": """
WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS matched_ts, arg_max(event_id, event_id) AS view_id, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT l.*, matched_ts, view_id, view_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.matched_ts""",
    "grid_locf": f"""
WITH ends AS (SELECT event_type, {floor_ts("6h", "min(ts)")} AS a, {ceil_ts("6h", "max(ts)")} AS b FROM events GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS ts FROM ends),
r AS (SELECT event_type, ts AS matched_ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT g.event_type, g.ts, matched_ts, event_id, value FROM g ASOF LEFT JOIN r ON g.event_type = r.event_type AND g.ts >= r.matched_ts""",
    "dedup_last_by_ts": "SELECT o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_custkey, o_orderkey) AS o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
    "bucket_last_ceil": f"SELECT event_type, {ceil_ts('1d')} AS ts_grid, {last('event_id')} AS event_id, max(ts) AS ts, {last('user_id')} AS user_id, {last('value')} AS value FROM events GROUP BY event_type, {ceil_ts('1d')}",
    "first_by_bucket": f"SELECT event_type, {floor_ts('1d')} AS bucket, arg_min(value, ts) FILTER (value > 5) AS value FROM events GROUP BY event_type, {floor_ts('1d')}",
    "book_factors": _book(),
    "derived_factors": f"""
WITH l AS (SELECT event_id, value AS v, {", ".join(f"lag(value, {k}) OVER w AS l{k}" for k in range(1, 6))} FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, CASE WHEN l1 <> 0 THEN {r9("(v - l2) / l1")} END AS spread_pct, CASE WHEN l1 <> 0 THEN {r9("(v - l1) / l1")} END AS vwap_mid_diff, {r6("(l1 + 10) / ((l2 + 10) + 1e-9)")} AS vol_ratio_1_5, {r6("(l2 + 10) / ((l3 + 10) + 1e-9)")} AS vol_ratio_5_30,
  {r6("(l2 + 10) / ((l4 + 10) + 1e-9)")} AS vol_ratio_5_60, {r6("(l3 + 10) / ((l5 + 10) + 1e-9)")} AS vol_ratio_30_120, {r6("((v - l2) / 100) * ((v - l2) / 100)")} AS imbalance_sq,
  {r6("abs((v - l2) / 100)")} AS abs_imbalance, {r6("(v - l3) * (v - l3)")} AS lr_sq, {r6("abs(v - l3)")} AS lr_abs
FROM l WHERE l5 IS NOT NULL""",
    "time_of_day": f"""
SELECT event_id, ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, {r6("sin((hour(ts) * 60 + minute(ts)) * (2 * pi() / 1440))")} AS tod_sin,
  {r6("cos((hour(ts) * 60 + minute(ts)) * (2 * pi() / 1440))")} AS tod_cos FROM events""",
    "trim_leading": "SELECT event_id, ts FROM events WHERE hour(ts) * 60 + minute(ts) >= 15",
    "time_range_filter": "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'",
    "clip_to_range": """
WITH r AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, event_id, ts FROM events JOIN r USING (user_id) WHERE ts BETWEEN a AND b""",
    "log_return": f"""
SELECT event_id, event_type, ts::DATE AS date, {r6("ln(value + 1) - lag(ln(value + 1)) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)")} AS log_return FROM events""",
    "forward_label": f"WITH {DAILY} SELECT event_type, ts, {r6('value')} AS value, {r6('lead(value, 2) OVER (PARTITION BY event_type ORDER BY ts)')} AS y_value FROM daily",
    "forward_label_by_time": f"WITH {DAILY} SELECT a.event_type, a.ts, {r6('a.value')} AS value, {r6('b.value')} AS y_value FROM daily a LEFT JOIN daily b ON a.event_type = b.event_type AND b.ts = a.ts + INTERVAL 2 DAY",
    "lag_features": f"""
WITH {DAILY} SELECT event_type, ts, {r6("value")} AS value, {r6("lag(value, 1) OVER w")} AS value_lag1d, {r6("lag(value, 7) OVER w")} AS value_lag7d FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY ts)""",
    "feature_join": f"""
WITH {DAILY}, vol AS (SELECT event_type, {ceil_ts("1d")} AS ts, coalesce(stddev_samp(value), 0) AS s, avg(value) AS m FROM events GROUP BY event_type, {ceil_ts("1d")})
SELECT event_type, ts, {r6("value")} AS value, {r6("s")} AS vol_5m_lag0, {r6("m")} AS vol_1m_lag0 FROM daily LEFT JOIN vol USING (event_type, ts)""",
    "label_join": f"WITH {DAILY} SELECT event_type, ts, {r6('value')} AS value, {r6('lead(coalesce(value, 0), 3) OVER (PARTITION BY event_type ORDER BY ts)')} AS y_vol_5m FROM daily",
    "symbol_code_map": """
WITH c AS (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS symbol_code FROM (SELECT DISTINCT n_name FROM nation))
SELECT n_name AS symbol, c_custkey, symbol_code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN c USING (n_name)""",
    "pivot_fill_mean": f"""
WITH h AS ({HOURLY_1}), {FILLED}
SELECT ts, {", ".join(f"max({r6('value')}) FILTER (symbol = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view"))} FROM filled GROUP BY ts""",
    "unpivot_long": f"WITH h AS ({HOURLY_1}), {FILLED} SELECT symbol, ts, {r6('value')} AS value FROM filled",
    "time_neighbors": f"WITH {PARTS}, {TIME_RANKS} SELECT ts, symbol, {r6('n3')} AS value_time_nn3_mean, {r6('n5')} AS value_time_nn5_mean FROM by_time",
    "symbol_neighbors": f"WITH {PARTS}, {SYMBOL_RANKS} SELECT ts, symbol, {r6('n1')} AS value_symbol_nn1_mean, {r6('n2')} AS value_symbol_nn2_mean FROM by_symbol",
    "neighbor_block": f"""
WITH {PARTS}, {TIME_RANKS}, {SYMBOL_RANKS}
SELECT q.ts, q.symbol, {r6("q.value")} AS value, {r6("t.n3")} AS value_time_nn3_mean, {r6("s.n3")} AS value_symbol_nn3_mean
FROM query q LEFT JOIN by_time t USING (ts, symbol) LEFT JOIN by_symbol s USING (ts, symbol)""",
    "metrics_overall": f"SELECT {SCORES}, {r9('avg(' + qlike('y_true', 'y_pred') + ')')} AS qlike FROM ({FORECAST}) WHERE y_pred IS NOT NULL",
    "metrics_by_symbol": f"SELECT event_type, {SCORES}, {r9('avg(' + qlike('y_true', 'y_pred') + ')')} AS qlike FROM ({FORECAST}) WHERE y_pred IS NOT NULL GROUP BY 1",
    "metrics_merged": f"SELECT event_type, {SCORES}, {r9('avg(' + qlike('y_true', 'y_pred') + ')')} AS qlike FROM ({FORECAST}) WHERE y_pred IS NOT NULL GROUP BY 1",
    "metrics_models": f"""
WITH f AS (SELECT event_type AS symbol, value, lag(value) OVER w AS lag1, lag(value, 2) OVER w AS lag2 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
m AS (SELECT symbol, 'lag1' AS model, value, lag1 AS p FROM f WHERE lag2 IS NOT NULL UNION ALL SELECT symbol, 'lag2', value, lag2 FROM f WHERE lag2 IS NOT NULL),
a AS (SELECT * FROM m UNION ALL SELECT 'ALL', model, value, p FROM m)
SELECT symbol, model, count(*) AS n, {r6("sqrt(avg((value - p) * (value - p)))")} AS rmse, {r6("avg(abs(value - p))")} AS mae FROM a GROUP BY 1, 2""",
    "metrics_bucketed": f"""
WITH f AS (SELECT event_type, {floor_ts("1d")} AS bucket, y_true, y_pred, y_true / (y_pred + 1e-12) AS ratio FROM ({FORECAST}) WHERE y_pred IS NOT NULL)
SELECT event_type, bucket, {SCORES}, {r6("avg((y_true - y_pred) * (y_true - y_pred))")} AS mse,
  {r9("avg(ratio - ln(ratio + 1e-12) - 1)")} AS qlike FROM f GROUP BY 1, 2""",
    "prediction_errors": f"SELECT event_id, {r6('y_pred - y_true')} AS error, {r6('abs(y_pred - y_true)')} AS abs_error FROM ({FORECAST})",
    "lag_baseline": f"SELECT event_id, event_type, y_true, y_pred FROM ({FORECAST})",
    "truth_check": "SELECT event_id, value AS y_left, value + 1 AS y_right FROM events WHERE value > 100",
    "importance_mean": f"SELECT feature, {r6('avg(gain)')} AS mean_gain, {r6('avg(split)')} AS mean_split FROM ({IMPORTANCES}) GROUP BY 1",
    "importance_topk": f"SELECT feature, {r6('avg(gain)')} AS mean_gain, {r6('avg(split)')} AS mean_split FROM ({IMPORTANCES}) GROUP BY 1 ORDER BY avg(gain) DESC, feature LIMIT 10",
    "importance_heatmap": f"""
WITH imp AS ({IMPORTANCES}), {TOP}, {CELLS}
SELECT feature, block_name, {r6("CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END")} AS value FROM cells WINDOW w AS (PARTITION BY feature)""",
    "importance_matrix": f"""
WITH imp AS ({IMPORTANCES}), {TOP}, {CELLS}
SELECT feature, {", ".join(f"{r6(f'coalesce(max(value) FILTER (block_name = {chr(39)}{y}{chr(39)}), 0)')} AS y{y}" for y in range(1995, 2002))} FROM cells GROUP BY 1""",
    "rolling_day_splits": f"""
WITH {DAYS}, w AS (SELECT unnest(generate_series(0, (SELECT max(k) FROM days) - 22)) AS i),
m AS (SELECT i, date, CASE WHEN k < i + 21 THEN 'train' WHEN k < i + 22 THEN 'val' ELSE 'test' END AS split FROM w JOIN days ON k BETWEEN i AND i + 22)
SELECT CAST(m.i AS INTEGER) AS window_id, printf('window_%03d_%s', m.i, strftime(t.date, '%Y-%m-%d')) AS window_name, split, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM m JOIN days t ON t.k = m.i + 22 JOIN events e ON e.ts::DATE = m.date GROUP BY ALL""",
    "rolling_block_splits": """
WITH e AS (SELECT (epoch_us(ts) - min(epoch_us(ts)) OVER ()) // 172800000000 AS b, min(epoch_us(ts)) OVER () AS o FROM events),
d AS (SELECT b, make_timestamp(CAST(any_value(o) + b * 172800000000 AS BIGINT)) AS block, count(*) AS n, row_number() OVER (ORDER BY b) - 1 AS k FROM e GROUP BY b),
w AS (SELECT unnest(generate_series(0, (SELECT max(k) FROM d) - 6)) AS i)
SELECT CAST(i AS INTEGER) AS window_id, CASE WHEN k < i + 6 THEN 'train' ELSE 'test' END AS split, CAST(sum(n) AS BIGINT) AS n, min(block) AS first_block, max(block) AS last_block
FROM w JOIN d ON k BETWEEN i AND i + 6 GROUP BY ALL""",
    "block_cut": "SELECT event_id, make_timestamp(CAST(o + ((epoch_us(ts) - o) // 129600000000) * 129600000000 AS BIGINT)) AS block_start FROM (SELECT *, min(epoch_us(ts)) OVER () AS o FROM events)",
    "block_starts": "SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 36 HOUR)) AS block_start FROM events",
    "freq_fanout": " UNION ALL ".join(
        f"SELECT event_type, {ceil_ts(f)} AS ts, {r6(last('value'))} AS value, {last('user_id')} AS user_id_last, '{f}' AS freq FROM events GROUP BY event_type, {ceil_ts(f)}" for f in ("3h", "6h", "1d")
    ),
    "training_sample": f"""
WITH {DAYS}, w AS (SELECT unnest(generate_series(0, (SELECT max(k) FROM days) - 22)) AS i),
e AS (SELECT events.*, CAST(i AS INTEGER) AS window_id, CASE WHEN k = i + 22 THEN 'test' WHEN k < i + 21 THEN 'train' ELSE 'val' END AS split FROM events JOIN days ON date = ts::DATE JOIN w ON k BETWEEN i AND i + 22)
SELECT window_id, split, event_type, {ceil_ts("6h")} AS ts, {r6(last("value"))} AS value, {last("user_id")} AS user_id_last FROM e WHERE split = 'train' GROUP BY window_id, split, event_type, {ceil_ts("6h")}
UNION ALL
SELECT window_id, split, event_type, ts, {r6("v")}, u FROM (SELECT window_id, split, event_type, ts, {last("value")} OVER w AS v, {last("user_id")} OVER w AS u FROM e WHERE split <> 'train'
  WINDOW w AS (PARTITION BY window_id, split, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW))""",
    "carried_windows": f"""
WITH {DAYS}, w AS (SELECT unnest(generate_series(0, (SELECT max(k) FROM days) - 22)) AS i),
e AS (SELECT events.*, CAST(i AS INTEGER) AS window_id, CASE WHEN k = i + 22 THEN 'test' WHEN k < i + 20 THEN 'train' ELSE 'val' END AS split FROM events JOIN days ON date = ts::DATE JOIN w ON k BETWEEN i AND i + 22)
SELECT window_id, split, event_type, {ceil_ts("6h")} AS ts, {_PLAN} FROM e WHERE split = 'train' GROUP BY window_id, split, event_type, {ceil_ts("6h")}
UNION ALL
SELECT window_id, split, event_type, ts, {r6("vl")}, {r6("vm")}, {r6("coalesce(vs, 0)")}, ul FROM (
  SELECT window_id, split, event_type, ts, {last("value")} OVER w AS vl, avg(value) OVER w AS vm, stddev_samp(value) OVER w AS vs, {last("user_id")} OVER w AS ul FROM e WHERE split <> 'train'
  WINDOW w AS (PARTITION BY window_id, split, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW))""",
    "window_cache": f"""
SELECT {floor_ts("6h")} AS ts, event_type AS symbol, {r6("avg(value)")} AS value, 'train' AS role FROM events
WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20' GROUP BY {floor_ts("6h")}, event_type
UNION ALL SELECT ts, event_type, {r6("value")}, 'query' FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21'""",
    "history_slice": "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20'",
    "base_slice": """
WITH n AS (SELECT ts, event_type FROM events WHERE event_type = 'click' AND value > 20)
SELECT event_id, event_type AS symbol, ts FROM events WHERE ts BETWEEN (SELECT min(ts) FROM n) AND (SELECT max(ts) FROM n) AND event_type IN (SELECT event_type FROM n)""",
    "union_dedup": "SELECT user_id, event_type FROM events UNION SELECT user_id, event_type FROM events WHERE event_type IN ('click', 'view')",
    "null_safe_drop": "SELECT event_id, value < 10 AS is_nan FROM events WHERE value > 50 OR value < 10",
    "alignment_check": f"""
WITH h AS ({HOURLY_1}), s AS (SELECT symbol, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM h)
SELECT symbol, count(*) AS n_rows, count(*) FILTER (step <> 3600000000) AS n_uneven, CAST(coalesce(sum(greatest(step // 3600000000 - 1, 0)), 0) AS BIGINT) AS n_missing FROM s GROUP BY 1""",
    "even_counts": f"""
WITH {DAILY}, x AS (SELECT 'hourly' AS grid, symbol AS g, ts, 3600000000 AS width FROM ({HOURLY_1}) UNION ALL SELECT 'daily', event_type, ts, 86400000000 FROM daily),
s AS (SELECT grid, g, width, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY grid, g ORDER BY ts) AS step FROM x)
SELECT grid, count(*) AS n_rows, count(DISTINCT g) AS n_groups, count(*) FILTER (step <> width) AS n_off FROM s GROUP BY grid""",
    "step_counts": f"""
WITH h AS ({HOURLY_1}), s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS step FROM h) SELECT step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1""",
    "grid_points": f"SELECT event_id, {ceil_ts('15m')} AS grid_up, {floor_ts('15m')} AS grid_down, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 1 DAY AS earlier FROM events",
    "npz_arrays": "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-06'",
    "stride_sample": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k % 10 = 0",
    "hash_sample": "SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 100",
    "linear_baseline": f"""
WITH {dense("3h")}, l AS (SELECT *, lag(value) OVER w AS x, lag(value, 2) OVER w AS y, lag(value, 8) OVER w AS z FROM dense WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
r AS (SELECT * FROM l WHERE value IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
v AS (SELECT covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS e, covar_pop(y, y) AS d, covar_pop(y, z) AS f, covar_pop(z, z) AS g, covar_pop(x, value) AS p, covar_pop(y, value) AS q,
  covar_pop(z, value) AS s, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(value) AS m FROM r WHERE ts < TIMESTAMP '2024-01-22'),
c AS (SELECT *, a * (d * g - f * f) + b * (e * f - b * g) + e * (b * f - d * e) AS det FROM v),
w AS (SELECT ((d * g - f * f) * p + (e * f - b * g) * q + (b * f - d * e) * s) / det AS wx, ((e * f - b * g) * p + (a * g - e * e) * q + (b * e - a * f) * s) / det AS wy,
  ((b * f - d * e) * p + (b * e - a * f) * q + (a * d - b * b) * s) / det AS wz, mx, my, mz, m FROM c)
SELECT ts, event_type, {r6("value")} AS y_true, {r6("m + wx * (x - mx) + wy * (y - my) + wz * (z - mz)")} AS y_pred FROM r CROSS JOIN w WHERE ts >= TIMESTAMP '2024-01-22'""",
    "boost_stumps": f"""
WITH {dense("3h")}, l AS (SELECT *, lag(value) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 8) OVER w AS x3 FROM dense WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
f AS (SELECT * FROM l WHERE value IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL), {stumps(2, 16, 0.5, 20)}
SELECT event_type, ts, {r6("pred")} AS y_pred FROM p2 JOIN wide USING (id)""",
    "time_neighbors_manhattan": f"WITH {PARTS}, {time_ranks('sum(abs(q.value - t.value))')} SELECT ts, symbol, {r6('n3')} AS value_time_nn3_mean FROM by_time",
    "time_neighbors_chebyshev": f"WITH {PARTS}, {time_ranks('max(abs(q.value - t.value))')} SELECT ts, symbol, {r6('n3')} AS value_time_nn3_mean FROM by_time",
    "time_neighbors_weighted": f"""
WITH {PARTS}, {time_ranks("sum(CASE q.symbol WHEN 'click' THEN 4 WHEN 'purchase' THEN 1 ELSE 0.25 END * (q.value - t.value) * (q.value - t.value))")}
SELECT ts, symbol, {r6("n3")} AS value_time_nn3_mean FROM by_time""",
    "time_neighbors_mahalanobis": f"WITH {PARTS}, {time_ranks('', WHITE)} SELECT ts, symbol, {r6('n3')} AS value_time_nn3_mean FROM by_time",
    "time_neighbors_correlation": f"WITH {PARTS}, {time_ranks('-corr(q.value, t.value)')} SELECT ts, symbol, {r6('n3')} AS value_time_nn3_mean FROM by_time",
    "time_neighbors_canberra": f"WITH {PARTS}, {time_ranks('sum(abs(q.value - t.value) / (abs(q.value) + abs(t.value)))')} SELECT ts, symbol, {r6('n3')} AS value_time_nn3_mean FROM by_time",
    "time_neighbors_trimmed": f"WITH {PARTS}, {time_ranks(SQUARES)} SELECT ts, symbol, {r6('trimmed')} AS value_time_nn5_trimmed FROM by_time",
    "symbol_neighbors_chebyshev": f"WITH {PARTS}, {symbol_ranks('max(abs(a.value - b.value))')} SELECT ts, symbol, {r6('n2')} AS value_symbol_nn2_mean FROM by_symbol",
    "symbol_neighbors_cosine": f"WITH {PARTS}, {symbol_ranks('-sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))')} SELECT ts, symbol, {r6('n2')} AS value_symbol_nn2_mean FROM by_symbol",
    "symbol_neighbors_weighted": f"WITH {PARTS}, {symbol_ranks('sum(day(ts) * (a.value - b.value) * (a.value - b.value))')} SELECT ts, symbol, {r6('n2')} AS value_symbol_nn2_mean FROM by_symbol",
    "symbol_neighbors_manhattan": f"WITH {PARTS}, {symbol_ranks('sum(abs(a.value - b.value))')} SELECT ts, symbol, {r6('n2')} AS value_symbol_nn2_mean FROM by_symbol",
    "importance_heatmap_split": f"""
WITH imp AS ({IMPORTANCES.replace("l_extendedprice AS gain, CAST(l_quantity AS BIGINT) AS split", "CAST(l_quantity AS BIGINT) AS gain")}), {TOP}, {CELLS}
SELECT feature, block_name, {r6("CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END")} AS value FROM cells WINDOW w AS (PARTITION BY feature)""",
    "volatility_grid": """
WITH v AS (SELECT event_type, event_id, epoch_us(ts) * 1000 + event_id % 1000 AS timestamp, value AS vol_5m FROM events),
g AS (SELECT *, ((timestamp + 21599999999999) // 21600000000000) * 21600000000 AS us FROM v)
SELECT event_type, make_timestamp(us) AS ts_grid, max(timestamp) AS timestamp, arg_max(event_id, timestamp) AS event_id, arg_max(vol_5m, timestamp) AS vol_5m FROM g GROUP BY event_type, us""",
    "snapshot_files": f"""
SELECT l_orderkey AS timestamp, make_timestamp(l_orderkey) AS ts, vwap, imbalance, spread, mid FROM ({_book()})""",
    "table_sinks": """
SELECT event_id, event_type AS symbol, ts::DATE AS date, CASE WHEN event_type = 'view' THEN -1.0 ELSE value END AS value FROM events
WHERE event_type IN ('click', 'signup', 'view') AND ts::DATE IN (DATE '2024-01-05', DATE '2024-01-06')""",
    "result_files": f"SELECT event_type AS symbol, {SCORES}, {r9('avg(' + qlike('y_true', 'y_pred') + ')')} AS qlike FROM ({FORECAST}) WHERE y_pred IS NOT NULL GROUP BY 1",
    "aligned_table": f"""
WITH {dense("1h")}, h AS (SELECT event_type AS symbol, ts, ts::DATE AS date, coalesce(value, 0) + 1 AS v, hour(ts) + 1.0 AS aq FROM dense),
f AS (SELECT *, ((v + 1) * aq + v * 2) / (aq + 2) AS vwap, (aq - 2) / (aq + 2) AS imbalance, v + 0.5 AS mid, lead(v * 2, 2) OVER w AS y FROM h WINDOW w AS (PARTITION BY symbol, date ORDER BY ts))
SELECT symbol, date, ts, {r6("vwap")} AS vwap, {r6("imbalance")} AS imbalance, {r6("log_return")} AS log_return, {r6("1 / mid")} AS spread_pct,
  {r6("(v * 3) / (v * 5 + 1e-9)")} AS vol_ratio_30_120, {r6("v * 2")} AS vol_5m_lag0, {r6("y")} AS y_vol_5m
FROM (SELECT *, ln((v + 1 + v) / 2) - lag(ln((v + 1 + v) / 2)) OVER (PARTITION BY symbol, date ORDER BY ts) AS log_return FROM f) WHERE hour(ts) > 0""",
    "ready_block": ready("2024-01-20"),
    "ready_block_stored": f"SELECT * FROM ({ready('2024-01-20')}) UNION ALL SELECT * FROM ({ready('2024-01-21')})",
    "stream_downsample": f"SELECT event_type, {ceil_ts('6h')} AS ts, {_PLAN} FROM events GROUP BY event_type, {ceil_ts('6h')}",
    "vector_neighbors": f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum([(a.x[i] - b.x[i]) * (a.x[i] - b.x[i]) for i in generate_series(1, len(a.x))]) AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, {r6("distance")} AS distance FROM r WHERE rank <= 5""",
}
ORACLE_SQL["stream_trailing"] = ORACLE_SQL["rolling_trailing"]
ORACLE_SQL["stream_asof"] = """
WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS matched_ts, arg_max(event_id, event_id) AS view_id, arg_max(value, event_id) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
m AS (SELECT l.*, matched_ts, view_id, view_value, matched_ts >= ts - INTERVAL 5 DAY AS near FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.matched_ts)
SELECT event_id, user_id, ts, value, CASE WHEN near THEN matched_ts END AS matched_ts, CASE WHEN near THEN view_id END AS view_id, CASE WHEN near THEN view_value END AS view_value FROM m"""
ORACLE_SQL |= {
    "symbol_readiness": """
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT ts::DATE) AS n_days, min(ts) <= TIMESTAMP '2024-01-03' AS full_history, count(DISTINCT ts::DATE) >= 8 AS enough_days FROM events GROUP BY 1""",
    "typed_times": "SELECT event_id, ts AS from_ns, CASE WHEN event_type <> 'click' THEN ts END AS from_text, ts::DATE::TIMESTAMP AS from_date FROM events",
    "stored_tails": """
WITH b AS (SELECT DISTINCT ts::DATE AS date, make_timestamp(CAST(o + ((epoch_us(ts) - o) // 21600000000) * 21600000000 AS BIGINT)) AS block_start FROM (SELECT ts, min(epoch_us(ts)) OVER () AS o FROM events)),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY block_start DESC) AS k FROM b)
SELECT d.date, r.block_start FROM (SELECT DISTINCT date FROM b WHERE date <= DATE '2024-01-10') d JOIN r ON r.date = d.date - 1 AND k <= 2""",
    "feature_tables": "SELECT event_id, ts, 2 AS n_features, value, user_id FROM events",
    "prediction_blocks": f"SELECT event_id, event_type AS block_name, y_true, y_pred, {r6('abs(y_pred - y_true)')} AS abs_error FROM ({FORECAST}) WHERE event_type IN ('click', 'view')",
    "run_summary": f"""
WITH f AS (SELECT * FROM ({FORECAST}) WHERE y_pred IS NOT NULL), o AS (SELECT {SCORES} FROM f), i AS (SELECT feature, {r6("avg(gain)")} AS mean_gain FROM ({IMPORTANCES}) GROUP BY 1)
SELECT feature, mean_gain, n, rmse, mae, corr, '6h' AS freq, (SELECT count(DISTINCT event_type) FROM f) AS n_windows FROM i CROSS JOIN o""",
    "prepared_block": f"""
WITH {dense("3h")}, l AS (SELECT event_type AS symbol, ts, value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 8) OVER w AS c FROM dense WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
k AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS code FROM (SELECT DISTINCT symbol FROM l WHERE value + a + b + c IS NOT NULL))
SELECT ts, symbol, {r6("CAST(value AS FLOAT)::DOUBLE")} AS label, {r6("CAST(a AS FLOAT)::DOUBLE")} AS lag3h, {r6("CAST(c AS FLOAT)::DOUBLE")} AS lag1d, CAST(code AS DOUBLE) AS code
FROM l JOIN k USING (symbol) WHERE value + a + b + c IS NOT NULL""",
    "report_frames": f"""
WITH f AS (SELECT * FROM ({FORECAST}) WHERE y_pred IS NOT NULL), s AS (SELECT 'all' AS item, {SCORES} FROM f UNION ALL SELECT event_type, {SCORES} FROM f GROUP BY 1)
SELECT item, n, rmse, mae, NULL::DOUBLE AS mean_gain FROM s
UNION ALL SELECT * FROM (SELECT feature, NULL, NULL, NULL, {r6("avg(gain)")} FROM ({IMPORTANCES}) GROUP BY 1 ORDER BY avg(gain) DESC, feature LIMIT 5)""",
}
