"""DuckDB SQL for the queries that SQL can express: the same series and windows as common table expressions."""

from __future__ import annotations

import re

from ..functions.kernels import DB4


def series_sql(table: str, key: str, bucket: str, value: str) -> str:
    return f"""
        filled AS (SELECT CAST({key} AS VARCHAR) AS series_id, {bucket} AS bucket, CAST(sum({value}) AS DOUBLE) AS y FROM {table}
                   WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1, 2),
        ends AS (SELECT series_id, min(bucket) AS lo, max(bucket) AS hi FROM filled GROUP BY 1),
        grid AS (SELECT series_id, lo, unnest(range(lo, hi + 1)) AS bucket FROM ends),
        series AS (SELECT g.series_id, CAST(g.bucket - g.lo AS INTEGER) AS t, coalesce(f.y, 0.0) AS y
                   FROM grid g LEFT JOIN filled f ON f.series_id = g.series_id AND f.bucket = g.bucket)"""


HOURLY = series_sql("events", "event_type", "CAST(floor(epoch(ts) / 3600) AS BIGINT)", "value")
DAILY = series_sql("orders", "o_orderpriority", "CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT)", "o_totalprice")
NATION = series_sql(
    "(SELECT n_name, o_orderdate, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "n_name", "CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT)", "o_totalprice",
)


def windows_sql(context: int = 512, horizon: int = 96, stride: int = 96) -> str:
    size = context + horizon
    return f"""
        starts AS (SELECT series_id, unnest(range(0, CAST(max(t) + 2 - {size} AS BIGINT), {stride})) AS s FROM series GROUP BY series_id HAVING max(t) + 1 >= {size}),
        win AS (SELECT x.series_id, CAST(w.s AS INTEGER) AS window_start, CAST(x.t - w.s AS INTEGER) AS i, x.y
                FROM series x JOIN starts w ON w.series_id = x.series_id AND x.t >= w.s AND x.t < w.s + {size}),
        ctx AS (SELECT * FROM win WHERE i < {context}), act AS (SELECT series_id, window_start, i - {context} AS h, y AS actual FROM win WHERE i >= {context})"""


def query(body: str, *parts: str) -> str:
    return f"WITH {', '.join(parts or (HOURLY,))} {body}"


W = windows_sql()
KEY = "series_id, window_start"
LINE = f"line AS (SELECT {KEY}, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept FROM ctx GROUP BY ALL), rest AS (SELECT c.{KEY.replace(', ', ', c.')}, c.i, c.y, slope, intercept, c.y - (slope * c.i + intercept) AS rest FROM ctx c JOIN line USING ({KEY}))"
NAIVE = f"pred AS (SELECT a.series_id, a.window_start, a.h, a.actual, l.y AS predicted FROM act a JOIN (SELECT {KEY}, y FROM ctx WHERE i = 511) l USING ({KEY}))"
#: The power of each bin by its defining sum over detrended windows.
POWER = f"""
    bins AS (SELECT r.series_id, r.window_start, k.k, (sum(r.rest * cos(2 * pi() * ((k.k * r.i) % 512) / 512)) ** 2 + sum(r.rest * sin(2 * pi() * ((k.k * r.i) % 512) / 512)) ** 2) AS power
             FROM rest r, (SELECT unnest(range(2, 257)) AS k) k GROUP BY ALL)"""
WEIGHTED = f"wx AS (SELECT {KEY}, i, y, exp(-ln(2) / 256.0 * (511 - i)) / (SELECT sum(exp(-ln(2) / 256.0 * (511 - u))) / 512 FROM range(0, 512) r(u)) AS w, i / 255.5 - 1 AS u FROM ctx)"
COV = f"""
    local AS (SELECT {KEY}, i - 256 AS i, y, exp(-ln(2) / (256 / 3.0) * (511 - i)) AS w FROM ctx WHERE i >= 256),
    mean AS (SELECT {KEY}, sum(w * y) / sum(w) AS m FROM local GROUP BY ALL),
    cen AS (SELECT l.series_id, l.window_start, i, w, y, m, y - m AS c FROM local l JOIN mean USING ({KEY})),
    cov AS (SELECT a.series_id, a.window_start, CAST(a.i - b.i AS INTEGER) AS lag, sum(a.w * a.c * b.c) / sum(a.w) AS cov FROM cen a JOIN cen b ON a.series_id = b.series_id AND a.window_start = b.window_start AND a.i - b.i BETWEEN 0 AND 12 GROUP BY ALL)"""
AR1 = f"ar AS (SELECT c.series_id, c.window_start, c1.cov / c.cov AS a, m * (1 - c1.cov / c.cov) AS intercept FROM cov c JOIN cov c1 USING ({KEY}) JOIN mean USING ({KEY}) WHERE c.lag = 0 AND c1.lag = 1)"


def ar_orders(most: int = 12) -> str:
    """Each AR order's AIC by the Levinson-Durbin recursion: one table for each order."""
    steps = [f"l0 AS (SELECT {KEY}, list(cov ORDER BY lag) AS r, []::DOUBLE[] AS a, max(cov) FILTER (lag = 0) AS v FROM cov GROUP BY ALL)"]
    for p in range(1, most + 1):
        matched = " + ".join(["0.0", *(f"a[{j}] * r[{p + 1 - j}]" for j in range(1, p))])
        coefs = ", ".join([*(f"a[{j}] - k * a[{p - j}]" for j in range(1, p)), "k"])
        steps.append(f"l{p} AS (SELECT {KEY}, r, [{coefs}] AS a, v * (1 - k * k) AS v FROM (SELECT *, (r[{p + 1}] - ({matched})) / v AS k FROM l{p - 1}))")
    every = " UNION ALL ".join(f"SELECT {KEY}, {p} AS p, 256 * ln(greatest(v, 1e-30)) + 2 * {p + 1} AS aic FROM l{p}" for p in range(most + 1))
    return f"{', '.join(steps)}, orders AS ({every})"


def plain_workers(parts: str = "") -> str:
    """Forecasts and hold-out confidences of the last value, the last day and the mean."""
    return f"""
        stat AS (SELECT {KEY}, var_pop(y) AS variance, stddev_pop(y) AS signal_std FROM ctx GROUP BY ALL),
        hpred AS (
            SELECT h.series_id, h.window_start, 'Naive' AS worker, 0 AS ord, h.y AS actual, l.y AS value FROM ctx h JOIN ctx l USING ({KEY}) WHERE h.i BETWEEN 384 AND 407 AND l.i = 383
            UNION ALL SELECT h.series_id, h.window_start, 'Seasonal', 1, h.y, l.y FROM ctx h JOIN ctx l USING ({KEY}) WHERE h.i BETWEEN 384 AND 407 AND l.i = h.i - 24
            UNION ALL SELECT h.series_id, h.window_start, 'Mean', 2, h.y, m.y FROM ctx h JOIN (SELECT {KEY}, avg(y) AS y FROM ctx WHERE i < 384 GROUP BY ALL) m USING ({KEY}) WHERE h.i BETWEEN 384 AND 407),
        conf AS (SELECT p.series_id, p.window_start, worker, ord, avg((actual - value) ** 2) AS mse, count(*) AS errors, exp(-avg((actual - value) ** 2) / greatest(any_value(variance), 1e-10)) ** 2 AS confidence FROM hpred p JOIN stat USING ({KEY}) GROUP BY ALL),
        fc AS (
            SELECT a.series_id, a.window_start, 'Naive' AS worker, a.h, l.y AS value FROM act a JOIN ctx l USING ({KEY}) WHERE l.i = 511
            UNION ALL SELECT a.series_id, a.window_start, 'Seasonal', a.h, l.y FROM act a JOIN ctx l USING ({KEY}) WHERE l.i = 488 + a.h % 24
            UNION ALL SELECT a.series_id, a.window_start, 'Mean', a.h, m.y FROM act a JOIN (SELECT {KEY}, avg(y) AS y FROM ctx GROUP BY ALL) m USING ({KEY})),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY confidence DESC, ord) AS rk FROM conf WHERE confidence > 0),
        top AS (SELECT {KEY}, max(confidence) FILTER (rk = 1) AS best, max(confidence) FILTER (rk = 2) AS second, sum(confidence) AS total FROM ranked GROUP BY ALL),
        weight AS (SELECT r.series_id, r.window_start, r.worker, CASE WHEN second IS NULL OR best / second > 2 THEN CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END ELSE confidence / total END AS p FROM ranked r JOIN top USING ({KEY})),
        step AS (SELECT f.series_id, f.window_start, f.h, sum(p * value) AS value FROM fc f JOIN weight w ON f.series_id = w.series_id AND f.window_start = w.window_start AND f.worker = w.worker GROUP BY ALL),
        spread AS (SELECT f.series_id, f.window_start, f.h, sqrt(sum(p * (f.value - s.value) ** 2)) AS d FROM fc f JOIN weight w ON f.series_id = w.series_id AND f.window_start = w.window_start AND f.worker = w.worker JOIN step s ON s.series_id = f.series_id AND s.window_start = f.window_start AND s.h = f.h GROUP BY ALL),
        md AS (SELECT {KEY}, avg(d) AS md FROM spread GROUP BY ALL){parts}"""


SHIFTS = """
    n AS (SELECT series_id, max(t) + 1 AS n FROM series GROUP BY 1),
    steps AS (SELECT series_id, t, lead(y) OVER (PARTITION BY series_id ORDER BY t) - y AS step FROM series),
    ok AS (SELECT s.* FROM steps s JOIN n USING (series_id) WHERE step IS NOT NULL AND n >= 42),
    mid AS (SELECT series_id, median(step) AS middle, greatest(kurtosis_pop(step), 0) AS kurt, stddev_pop(step) AS sd FROM ok GROUP BY 1),
    noise AS (SELECT o.series_id, least(3 + sqrt(any_value(kurt)), 10) * CASE WHEN median(abs(step - middle)) < 1e-10 THEN any_value(sd) * 0.6745 ELSE median(abs(step - middle)) END / 0.6745 AS threshold FROM ok o JOIN mid USING (series_id) GROUP BY 1),
    over AS (SELECT o.series_id, threshold, list(t ORDER BY t) AS places FROM ok o JOIN noise USING (series_id) WHERE abs(step) > threshold GROUP BY 1, 2),
    kept AS (SELECT series_id, threshold, unnest(list_reduce(list_prepend(CAST([] AS INTEGER[]), list_transform(places, lambda p: [p])),
             lambda a, b: CASE WHEN len(a) = 0 OR b[1] - a[len(a)] >= 10 THEN list_concat(a, b) ELSE a END)) AS cp FROM over),
    cand AS (SELECT k.*, least(21, cp, n - cp - 1) AS win FROM kept k JOIN n USING (series_id)),
    med AS (SELECT c.series_id, cp, threshold, median(y) FILTER (t < cp) AS before, median(y) FILTER (t > cp) AS after FROM cand c JOIN series s ON s.series_id = c.series_id AND s.t BETWEEN cp - win AND cp + win AND s.t <> cp WHERE win >= 3 GROUP BY ALL),
    iqr AS (SELECT series_id, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr FROM series GROUP BY 1)"""

#: Monthly totals of each priority, held until the next month's.
HELD = series_sql("orders", "o_orderpriority", "CAST(floor(epoch(date_trunc('month', o_orderdate)) / 86400) AS BIGINT)", "o_totalprice").replace("coalesce(f.y, 0.0)", "f.y").replace("series AS (", "months AS (")
HELD += ", series AS (SELECT series_id, t, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t) AS y FROM months)"
#: The same with a window of 7, so gaps of 3, and a threshold of one robust deviation.
NARROW = SHIFTS.replace("n >= 42", "n >= 14").replace("least(3 + sqrt(any_value(kurt)), 10) *", "1.0 *").replace(">= 10 THEN", ">= 3 THEN").replace("least(21,", "least(7,")
FOUND = "found AS (SELECT m.series_id, CAST(cp + 1 AS INTEGER) AS t, after - before AS magnitude FROM med m JOIN iqr USING (series_id) WHERE abs(after - before) >= greatest(threshold, iqr))"

SHOCK = f"""
    sd AS (SELECT {KEY}, stddev_pop(rest) AS noise FROM rest GROUP BY ALL),
    x AS (SELECT r.series_id, r.window_start, r.i, rest AS d, 2 * greatest(noise, 1e-10) AS thr FROM rest r JOIN sd USING ({KEY})),
    ons AS (SELECT {KEY}, min(i) FILTER (i >= 512 - 128 AND abs(d) > thr) AS onset FROM x GROUP BY ALL HAVING max(CASE WHEN i >= 512 - 128 THEN abs(d) END) >= any_value(thr)),
    z AS (SELECT x.series_id, x.window_start, x.i, d, onset, CAST(x.i - onset AS DOUBLE) AS dt, max(CASE WHEN x.i = onset THEN d END) OVER (PARTITION BY {KEY.replace('series_id', 'x.series_id').replace('window_start', 'x.window_start')}) AS first FROM x JOIN ons USING ({KEY})),
    fit AS (SELECT {KEY}, onset, any_value(first) AS first, avg(d) FILTER (dt >= 0) AS step, count(*) FILTER (dt >= 0) AS n_active, count(*) FILTER (dt >= 0 AND sign(first) * d > abs(first) * 0.01) AS n_same,
            regr_slope(d, dt) FILTER (dt >= 0) AS slope, regr_intercept(d, dt) FILTER (dt >= 0) AS level,
            regr_slope(ln(greatest(abs(d), 1e-30)), dt) FILTER (dt >= 0 AND sign(first) * d > abs(first) * 0.01) AS ls, regr_intercept(ln(greatest(abs(d), 1e-30)), dt) FILTER (dt >= 0 AND sign(first) * d > abs(first) * 0.01) AS ll
            FROM z GROUP BY ALL),
    f2 AS (SELECT *, CASE WHEN abs(first) >= 1e-10 AND n_same >= 3 AND ls < 0 THEN sign(first) * exp(ll) END AS spike FROM fit),
    rss AS (SELECT z.series_id, z.window_start, z.onset, any_value(step) AS step, any_value(slope) AS slope, any_value(level) AS level, any_value(spike) AS spike, any_value(ls) AS ls, any_value(n_active) AS n_active,
            sum((d - CASE WHEN dt >= 0 THEN step ELSE 0 END) ** 2) AS r0, sum((d - CASE WHEN dt >= 0 THEN spike * exp(ls * dt) ELSE 0 END) ** 2) AS r1, sum((d - CASE WHEN dt >= 0 THEN level + slope * dt ELSE 0 END) ** 2) AS r2
            FROM z JOIN f2 USING ({KEY}) GROUP BY ALL),
    opt AS (SELECT {KEY}, onset, 0 AS ord, 'step' AS shape, step AS magnitude, 0.0 AS rate, 512 * ln(r0 / 512) + 4 AS aic FROM rss
            UNION ALL SELECT {KEY}, onset, 1, 'spike_decay', spike, -ls, 512 * ln(r1 / 512) + 6 FROM rss WHERE spike IS NOT NULL AND n_active >= 3
            UNION ALL SELECT {KEY}, onset, 2, 'ramp', level, slope, 512 * ln(r2 / 512) + 6 FROM rss WHERE n_active >= 3)"""

TRENDS = f"""
    m AS (SELECT {KEY}, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2, sum(w*u**3) AS s3, sum(w*u**4) AS s4, sum(w*y) AS v0, sum(w*u*y) AS v1, sum(w*u*u*y) AS v2 FROM wx GROUP BY ALL),
    c AS (SELECT *, v0/s0 AS lev, (s0*v1 - s1*v0)/(s0*s2 - s1*s1) AS l1, (s2*v0 - s1*v1)/(s0*s2 - s1*s1) AS l0, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2) AS dd FROM m),
    q AS (SELECT *, (v0*(s2*s4 - s3*s3) - s1*(v1*s4 - s3*v2) + s2*(v1*s3 - s2*v2))/dd AS q0, (s0*(v1*s4 - s3*v2) - v0*(s1*s4 - s3*s2) + s2*(s1*v2 - v1*s2))/dd AS q1, (s0*(s2*v2 - v1*s3) - s1*(s1*v2 - v1*s2) + v0*(s1*s3 - s2*s2))/dd AS q2 FROM c),
    r AS (SELECT x.series_id, x.window_start, any_value(l0) AS l0, any_value(l1) AS l1, any_value(q0) AS q0, any_value(q1) AS q1, any_value(q2) AS q2,
          sum(w*(y - lev)**2) AS r0, sum(w*(y - l0 - l1*u)**2) AS r1, sum(w*(y - q0 - q1*u - q2*u*u)**2) AS r2 FROM wx x JOIN q USING ({KEY}) GROUP BY ALL),
    opt AS (SELECT {KEY}, 'none' AS trend_type, 0 AS ord, 0.0 AS a, 0.0 AS b, 0.0 AS c, r0 AS rss, 512*ln(r0/512) + ln(512) AS bic FROM r
            UNION ALL SELECT {KEY}, 'linear', 1, l1/255.5, l0 - l1, 0.0, r1, 512*ln(r1/512) + 2*ln(512) FROM r
            UNION ALL SELECT {KEY}, 'quadratic', 2, q2/255.5**2, (q1 - 2*q2)/255.5, q0 - q1 + q2, r2, 512*ln(r2/512) + 3*ln(512) FROM r)"""

def wavelet_energy(n: int = 64, levels: int = 3) -> str:
    """Sums of products with the filters of each level, whose ends are mirrored; the coarsest scale comes first."""
    low = DB4.tolist()
    taps = ", ".join(f"({j}, {low[j]!r}, {(-1) ** (j + 1) * low[7 - j]!r})" for j in range(8))
    steps = [f"taps(j, low, high) AS (VALUES {taps})", "x0 AS (SELECT CAST(vec_id AS VARCHAR) AS series_id, u.i, CAST(embedding[u.i + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i) u)"]
    for k in range(1, levels + 1):
        size = (n + 7) // 2
        mirrored = f"CASE WHEN 2*o.i + j < 6 THEN 5 - 2*o.i - j WHEN 2*o.i + j - 6 >= {n} THEN {2 * n + 5} - 2*o.i - j ELSE 2*o.i + j - 6 END"
        steps.append(f"x{k} AS (SELECT series_id, o.i, sum(low * v) AS v, sum(high * v) AS d FROM (SELECT unnest(range(0, {size})) AS i) o, taps, x{k - 1} WHERE x{k - 1}.i = {mirrored} GROUP BY series_id, o.i)")
        n = size
    scales = [f"SELECT series_id, 0 AS scale, sum(v * v) AS e FROM x{levels} GROUP BY 1"]
    scales += [f"SELECT series_id, {levels + 1 - k}, sum(d * d) FROM x{k} GROUP BY 1" for k in range(levels, 0, -1)]
    steps += [f"energy AS ({' UNION ALL '.join(scales)})", "whole AS (SELECT series_id, sum(v * v) AS total FROM x0 GROUP BY 1)"]
    return f"WITH {', '.join(steps)} SELECT series_id, CAST(scale AS INTEGER) AS scale, round(e / CASE WHEN total = 0 THEN 1.0 ELSE total END, 7) AS energy_fraction FROM energy JOIN whole USING (series_id)"


def exponential(n: int = 512) -> str:
    """The exponential candidate by the same grids of rates, as the tables ex, b0 to b2 and ropt."""
    steps = [f"ex AS MATERIALIZED (SELECT {KEY}, i / {n - 1}.0 AS x, w, y, sum(w * y) OVER k / sum(w) OVER k AS middle, y - sum(w * y) OVER k / sum(w) OVER k AS d FROM wx WINDOW k AS (PARTITION BY {KEY}))"]
    steps.append(f"n0 AS (SELECT DISTINCT {KEY}, k * 0.5::DOUBLE - 10 AS rate FROM ex, (SELECT unnest(range(0, 41)) AS k))")
    step = 0.5
    for r in range(3):
        if r:
            step /= 50
            steps.append(f"n{r} AS (SELECT DISTINCT {KEY}, least(greatest(rate + k * {step!r}::DOUBLE, -10.0), 10.0) AS rate FROM b{r - 1}, (SELECT unnest(range(-50, 51)) AS k))")
        steps.append(f"""
            q{r} AS (SELECT {KEY}, rate, sum(w) AS s, sum(w * g) AS g1, sum(w * g * g) AS g2, sum(w * d) AS d1, sum(w * d * d) AS d2, sum(w * g * d) AS gd
                     FROM (SELECT *, CASE WHEN abs(rate) > 1e-9 THEN (exp(rate * x) - 1) / rate ELSE x END AS g FROM ex JOIN n{r} USING ({KEY})) GROUP BY ALL),
            s{r} AS (SELECT {KEY}, rate, (gd - g1 * d1 / s) / (g2 - g1 * g1 / s) AS slope, (d1 - (gd - g1 * d1 / s) / (g2 - g1 * g1 / s) * g1) / s AS level, d2 - d1 * d1 / s - (gd - g1 * d1 / s) ** 2 / (g2 - g1 * g1 / s) AS left_over FROM q{r}),
            b{r} AS MATERIALIZED (SELECT {KEY}, rate, slope, level FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY left_over, abs(rate), rate) AS rk FROM s{r}) WHERE rk = 1)""")
    steps.append(f"""
        ropt AS (SELECT {KEY}, any_value(rate) AS rate, any_value(slope) AS slope, any_value(level + middle) AS level, sum(w * (d - level - slope * CASE WHEN abs(rate) > 1e-9 THEN (exp(rate * x) - 1) / rate ELSE x END) ** 2) AS rss FROM ex JOIN b2 USING ({KEY}) GROUP BY ALL),
        eopt AS (SELECT {KEY}, 'exponential' AS trend_type, 3 AS ord, slope / v AS a, v / {n - 1} AS b, level - slope / v AS c, rss, {n} * ln(rss / {n}) + 3 * ln({n}) AS bic FROM (SELECT *, CASE WHEN abs(rate) > 1e-9 THEN rate ELSE 1e-9 END AS v FROM ropt))""")
    return ", ".join(steps)


BEST_OF_FOUR = f"SELECT {KEY}, trend_type, round(bic, {{}}) AS bic FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY bic, ord) AS rk FROM (FROM opt UNION ALL FROM eopt)) WHERE rk = 1"
#: z-scores of the hourly series over their first 70 %, and what is made of their running sums.
SCORES = HOURLY.replace("series AS (", "base AS (") + """,
    stat AS (SELECT series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM base JOIN (SELECT series_id, floor((max(t) + 1) * CAST(0.7 AS DOUBLE)) AS e FROM base GROUP BY 1) USING (series_id) WHERE t < e GROUP BY 1),
    score AS (SELECT b.series_id, b.t, (y - mu) / CASE WHEN sd < 1e-10 THEN 1.0 ELSE sd END AS z FROM base b JOIN stat USING (series_id))"""
GROWN = SCORES + ", series AS (SELECT series_id, t, exp(sum(z / 24) OVER (PARTITION BY series_id ORDER BY t)) AS y FROM score)"
WALK = SCORES + ", walk AS (SELECT series_id, t, sum(z) OVER (PARTITION BY series_id ORDER BY t) AS y FROM score)"


def sinusoids_sql(most: int = 4) -> str:
    """`most` sinusoids of each walk less its line: power by the defining sums, Goertzel sums over the same grids of frequencies."""
    steps = [WALK, """
        line AS (SELECT series_id, regr_slope(y, t) AS slope, regr_intercept(y, t) AS level, count(*) AS n FROM walk GROUP BY 1),
        r0 AS MATERIALIZED (SELECT w.series_id, t, n, y - (slope * t + level) AS rest FROM walk w JOIN line USING (series_id)),
        e0 AS (SELECT DISTINCT series_id, NULL::DOUBLE AS error FROM r0)"""]
    power = """
        p{c} AS MATERIALIZED (SELECT series_id, n, k, sum(rest * cos(2 * pi() * ((k * t) % n) / n)) ** 2 + sum(rest * sin(2 * pi() * ((k * t) % n) / n)) ** 2 AS power
                 FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM r{c}) GROUP BY ALL)"""
    steps.append(power.format(c=0))
    for c in range(most):
        steps.append(f"""
        c{c} AS MATERIALIZED (SELECT *, top / greatest(low, 1e-30) AS snr, least(2 + greatest(1, ceil(2 / sqrt(greatest(top / greatest(low, 1e-30), 0.01)))), (n // 2 + 1) // 4) AS width
                FROM (SELECT series_id, n, median(power) AS low, count(*) AS bins, max(power) AS top, arg_max(k, power) AS k FROM p{c} WHERE k >= 2 GROUP BY ALL) JOIN e{c} USING (series_id)
                WHERE top >= 2 * low * (1 + ln(bins)) AND (error IS NULL OR top >= 0.5 * error)),
        a{c}_0 AS (SELECT *, greatest((k - 2)::DOUBLE / n, 0.5::DOUBLE / n) AS lo, (k + 2)::DOUBLE / n AS hi FROM c{c}),
        g{c}_0 AS (SELECT series_id, lo + i * ((hi - lo) / 32) AS f FROM a{c}_0, (SELECT unnest(range(0, 33)) AS i))""")
        for r in range(5):
            if r:
                near = f"least(greatest(f + i * ((hi - lo) / 32 * {8.0**-r!r}::DOUBLE), lo), hi)"
                steps.append(f"g{c}_{r} AS (SELECT DISTINCT b.series_id, {near} AS f FROM b{c}_{r - 1} b JOIN a{c}_0 USING (series_id), (SELECT unnest(range(-8, 9)) AS i))")
            steps.append(f"""
            s{c}_{r} AS (SELECT series_id, f, sum(co * co) AS cc, sum(si * si) AS ss, sum(co * si) AS cs, sum(co * rest) AS cy, sum(si * rest) AS sy
                         FROM (SELECT *, cos(2 * pi() * f * t) AS co, sin(2 * pi() * f * t) AS si FROM r{c} JOIN g{c}_{r} USING (series_id)) GROUP BY ALL),
            b{c}_{r} AS MATERIALIZED (SELECT series_id, f, a, b FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY a * cy + b * sy DESC, f) AS rk
                         FROM (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS a, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b FROM s{c}_{r})) WHERE rk = 1)""")
        steps.append(f"r{c + 1} AS MATERIALIZED (SELECT series_id, t, n, rest - a * cos(2 * pi() * f * t) - b * sin(2 * pi() * f * t) AS rest FROM r{c} JOIN b{c}_4 USING (series_id))")
        steps.append(power.format(c=c + 1))
        steps.append(f"""
        e{c + 1} AS (SELECT x.series_id, coalesce(any_value(x.error), 0) + greatest(0, sum(p.power - q.power) - (any_value(a) ** 2 + any_value(b) ** 2) * any_value(x.n) ** 2 / 4) AS error
                     FROM c{c} x JOIN b{c}_4 USING (series_id) JOIN p{c} p ON p.series_id = x.series_id AND p.k >= greatest(1, x.k - width) AND p.k <= x.k + width JOIN p{c + 1} q ON q.series_id = p.series_id AND q.k = p.k GROUP BY 1)""")
    every = " UNION ALL ".join(f"SELECT series_id, {c} AS rank, f AS frequency, sqrt(a * a + b * b) AS amplitude, atan2(-b, a) AS phase, snr FROM c{c} JOIN b{c}_4 USING (series_id)" for c in range(most))
    return query(f"SELECT series_id, CAST(rank AS INTEGER) AS rank, round(frequency, 6) AS frequency, round(amplitude, 3) AS amplitude, round(phase, 2) AS phase, round(snr, 2) AS snr FROM ({every})", *steps)


def shock_passes_sql(most: int = 3) -> str:
    """SHOCK on what each pass leaves, with tables numbered by pass."""
    steps, every = [], []
    for c in range(most):
        body = re.sub(r"\b(x|ons|z|fit|f2|rss|opt)\b", rf"\g<1>_{c}", SHOCK)
        if c:
            body = body[body.index("x_") :].replace("FROM rest r JOIN sd", f"FROM left_{c} r JOIN sd")
        gone = "CASE WHEN r.i >= onset THEN CASE shape WHEN 'spike_decay' THEN magnitude * exp(-rate * (r.i - onset)) WHEN 'ramp' THEN magnitude + rate * (r.i - onset) ELSE magnitude END ELSE 0 END"
        steps += [body, f"best_{c} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY aic, ord) AS rk FROM opt_{c}) WHERE rk = 1)"]
        steps.append(f"left_{c + 1} AS MATERIALIZED (SELECT r.series_id, r.window_start, r.i, r.rest - coalesce({gone}, 0) AS rest FROM {'left_' + str(c) if c else 'rest'} r LEFT JOIN best_{c} USING ({KEY}))")
        every.append(f"SELECT {KEY}, {c} AS rank, onset, shape, magnitude, rate, aic FROM best_{c}")
    return query(f"SELECT {KEY}, CAST(rank AS INTEGER) AS rank, CAST(onset AS INTEGER) AS onset, shape, round(magnitude, 5) AS magnitude, round(rate, 7) AS rate, round(aic, 5) AS aic FROM ({' UNION ALL '.join(every)})", HOURLY, W, LINE, *steps)


def least_squares_sql(p: int = 24) -> str:
    """AR(p) of each nation's series: the normal equations of centred values, eliminated one unknown at a time."""
    lags = ", ".join(f"lag(y, {k}) OVER o" for k in range(1, p + 1))
    steps = [NATION, f"""
        mid AS (SELECT series_id, avg(y) AS mean FROM series GROUP BY 1),
        cen AS (SELECT series_id, t, y - mean AS y FROM series JOIN mid USING (series_id)),
        lagged AS (SELECT * FROM (SELECT series_id, t, [1.0, {lags}, y] AS x FROM cen WINDOW o AS (PARTITION BY series_id ORDER BY t)) WHERE t >= {p}),
        m0 AS MATERIALIZED (SELECT series_id, a.i, b.j, sum(x[a.i + 1] * x[b.j + 1]) AS v FROM lagged, (SELECT unnest(range(0, {p + 1})) AS i) a, (SELECT unnest(range(0, {p + 2})) AS j) b GROUP BY ALL)"""]
    for k in range(p + 1):
        steps.append(f"""m{k + 1} AS MATERIALIZED (SELECT r.series_id, r.i, r.j, CASE WHEN r.i = {k} THEN r.v / d.v ELSE r.v - c.v * q.v / d.v END AS v
            FROM m{k} r JOIN m{k} d ON d.series_id = r.series_id AND d.i = {k} AND d.j = {k} JOIN m{k} c ON c.series_id = r.series_id AND c.i = r.i AND c.j = {k} JOIN m{k} q ON q.series_id = r.series_id AND q.i = {k} AND q.j = r.j)""")
    steps.append(f"coefs AS (SELECT series_id, i, v, sum(CASE WHEN i > 0 THEN v ELSE 0 END) OVER (PARTITION BY series_id) AS total FROM m{p + 1} WHERE j = {p + 1})")
    return query("SELECT c.series_id, CAST(i AS INTEGER) AS lag, round(CASE WHEN i = 0 THEN (v + mean * (1 - total)) / 1e6 ELSE v END, 6) AS coef FROM coefs c JOIN mid USING (series_id)", *steps)


def series_wavelet_sql(levels: int = 8) -> str:
    """wavelet_energy for series of any length: ends are mirrored by each series' own length."""
    low = DB4.tolist()
    taps = ", ".join(f"({j}, {low[j]!r}, {(-1) ** (j + 1) * low[7 - j]!r})" for j in range(8))
    steps = [DAILY, f"taps(j, low, high) AS (VALUES {taps})", "x0 AS (SELECT series_id, t AS i, y AS v, count(*) OVER (PARTITION BY series_id) AS n FROM series)"]
    for k in range(1, levels + 1):
        place = "2 * o + j - 6"
        steps.append(f"""
            o{k} AS (SELECT DISTINCT series_id, n, unnest(range(0, (n + 7) // 2)) AS o FROM x{k - 1}),
            x{k} AS MATERIALIZED (SELECT a.series_id, a.o AS i, (a.n + 7) // 2 AS n, sum(low * v) AS v, sum(high * v) AS d FROM o{k} a, taps JOIN x{k - 1} b
                    ON b.series_id = a.series_id AND b.i = CASE WHEN {place} < 0 THEN -1 - ({place}) WHEN {place} >= a.n THEN 2 * a.n - 1 - ({place}) ELSE {place} END GROUP BY ALL)""")
    every = " UNION ALL ".join([f"SELECT series_id, 0 AS scale, sum(v * v) AS e FROM x{levels} GROUP BY 1", *(f"SELECT series_id, {levels + 1 - k}, sum(d * d) FROM x{k} GROUP BY 1" for k in range(levels, 0, -1))])
    steps.append("whole AS (SELECT series_id, sum(y * y) AS total FROM series GROUP BY 1)")
    return query(f"SELECT series_id, CAST(scale AS INTEGER) AS scale, round(e / total, 7) AS energy_fraction FROM ({every}) JOIN whole USING (series_id)", *steps)


ORACLES: dict[str, str] = {
    "hourly_series": query("SELECT series_id, t, round(y, 6) AS y FROM series"),
    "daily_series": query("SELECT series_id, t, round(y, 4) AS y FROM series", DAILY),
    "nation_series": query("SELECT series_id, t, round(y, 4) AS y FROM series", NATION),
    "forward_filled_series": query("SELECT series_id, t, round(last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t), 6) AS y FROM series", HOURLY.replace("coalesce(f.y, 0.0)", "f.y")),
    "embedding_series": "SELECT CAST(vec_id AS VARCHAR) AS series_id, CAST(u.i - 1 AS INTEGER) AS t, CAST(embedding[u.i] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u",
    "csv_round_trip": query("SELECT series_id, count(*) AS n, round(sum(y), 4) AS total, max(t) AS last_t FROM series GROUP BY 1", DAILY),
    "first_series": query("SELECT series_id, t, round(y, 4) AS y FROM series WHERE series_id = (SELECT min(series_id) FROM series)", DAILY),
    "tail_context": query("SELECT s.series_id, CAST(t - (n - 168) AS INTEGER) AS t, round(y, 6) AS y FROM series s JOIN (SELECT series_id, max(t) + 1 AS n FROM series GROUP BY 1) USING (series_id) WHERE t >= n - 168"),
    "rolling_windows": query(f"SELECT {KEY}, count(*) AS n, round(sum(y), 4) AS total, round(min(y), 6) AS low, round(max(y), 6) AS high FROM win GROUP BY ALL", HOURLY, W),
    "split_counts": query("SELECT series_id, CASE WHEN t < CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) THEN 'train' WHEN t < CAST(floor(n * (CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE))) AS BIGINT) THEN 'val' ELSE 'test' END AS part, count(*) AS n, round(avg(y), 4) AS mean FROM series JOIN (SELECT series_id, max(t) + 1 AS n FROM series GROUP BY 1) USING (series_id) GROUP BY ALL", DAILY),
    "train_zscore": query("SELECT s.series_id, t, round((y - mu) / CASE WHEN sd < 1e-10 THEN 1.0 ELSE sd END, 6) AS y FROM series s JOIN (SELECT series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM series JOIN (SELECT series_id, floor((max(t) + 1) * CAST(0.7 AS DOUBLE)) AS e FROM series GROUP BY 1) USING (series_id) WHERE t < e GROUP BY 1) USING (series_id)"),
    "finite_counts": query("SELECT series_id, count(*) AS n, count(*) FILTER (isfinite(y)) AS n_finite, count(*) >= 64 AS long_enough FROM series GROUP BY 1"),
    "range_clamp": query(f"SELECT {KEY}, round(min(least(greatest(actual, lo - sd), hi + sd)), 6) AS low, round(max(least(greatest(actual, lo - sd), hi + sd)), 6) AS high, count(*) FILTER (actual < lo - sd OR actual > hi + sd) AS n_clamped FROM act JOIN (SELECT {KEY}, min(y) AS lo, max(y) AS hi, stddev_pop(y) AS sd FROM ctx GROUP BY ALL) USING ({KEY}) GROUP BY ALL", HOURLY, W),
    "ols_detrend": query(f"SELECT {KEY}, round(any_value(slope), 8) AS slope, round(any_value(intercept), 6) AS intercept, round(sum(rest * rest), 3) AS rss FROM rest GROUP BY ALL", HOURLY, W, LINE),
    "lag1_autocorr": query(f"SELECT {KEY}, round(corr(rest, before), 8) AS ac1 FROM (SELECT *, lag(rest) OVER (PARTITION BY {KEY} ORDER BY i) AS before FROM rest) GROUP BY ALL", HOURLY, W, LINE),
    "residual_quantiles": query(f"SELECT {KEY}, round(quantile_cont(rest, 0.1), 6) AS q_lo, round(quantile_cont(rest, 0.9), 6) AS q_hi, round(stddev_pop(rest), 6) AS noise_std FROM rest GROUP BY ALL", HOURLY, W, LINE),
    "robust_noise": query("SELECT d.series_id, round(middle, 6) AS middle, round(median(abs(step - middle)), 6) AS mad, round(any_value(kurt), 6) AS excess_kurtosis FROM ok d JOIN mid USING (series_id) GROUP BY 1, 2", HOURLY, SHIFTS),
    "naive_backtest": query(f"SELECT {KEY}, round(avg((actual - predicted) ** 2), 4) AS mse, round(avg(abs(actual - predicted)), 6) AS mae, count(*) AS n FROM pred GROUP BY ALL", HOURLY, W, NAIVE),
    "forecast_metrics": query("SELECT series_id, round(avg((actual - predicted) ** 2), 4) AS mse, round(avg(abs(actual - predicted)), 6) AS mae, round(avg(abs((actual - predicted) / actual)) FILTER (abs(actual) > 1e-10), 5) AS mape, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, count(*) AS n FROM pred GROUP BY ALL", HOURLY, W, NAIVE),
    "bounded_forecast": query(f"SELECT {KEY}, h, round(p, 5) AS point, round(p + q_lo * sqrt(1 + h / 512.0), 5) AS lower, round(p + q_hi * sqrt(1 + h / 512.0), 5) AS upper FROM (SELECT {KEY}, h, least(greatest(slope * (h + 512) + intercept, lo), hi) AS p, q_lo, q_hi FROM (SELECT {KEY}, any_value(slope) AS slope, any_value(intercept) AS intercept, min(y) - stddev_pop(y) AS lo, max(y) + stddev_pop(y) AS hi, quantile_cont(rest, 0.1) AS q_lo, quantile_cont(rest, 0.9) AS q_hi FROM rest GROUP BY ALL), (SELECT CAST(unnest(range(0, 96)) AS INTEGER) AS h))", HOURLY, W, LINE),
    "evenly_spaced_windows": query(f"SELECT {KEY}, round(mse / 1e6, 1) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY window_start) - 1 AS place, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT {KEY}, avg((actual - predicted) ** 2) AS mse FROM pred GROUP BY ALL)) WHERE place IN (0, n // 3, 2 * n // 3)", DAILY, W, NAIVE),
    "first_windows": query(f"SELECT {KEY}, round(mse / 1e6, 1) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY window_start) AS rk FROM (SELECT {KEY}, avg((actual - predicted) ** 2) AS mse FROM pred GROUP BY ALL)) WHERE rk <= 3", DAILY, W, NAIVE),
    "window_mse_spread": query(f"SELECT series_id, count(*) AS n_windows, round(avg(mse) / 1e6, 1) AS mean_mse, round(stddev_pop(mse) / 1e6, 1) AS std_mse, round(avg(least(mse, p95)) / 1e6, 1) AS clipped_mean, round(any_value(p95) / 1e6, 1) AS p95 FROM (SELECT *, quantile_cont(mse, 0.95) OVER (PARTITION BY series_id) AS p95 FROM (SELECT {KEY}, avg((actual - predicted) ** 2) AS mse FROM pred GROUP BY ALL)) GROUP BY 1", DAILY, W, NAIVE),
    "worst_windows": query(f"SELECT {KEY}, CAST(rk AS INTEGER) AS rank, round(mse / 1e6, 1) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mse DESC, window_start) AS rk FROM (SELECT {KEY}, avg((actual - predicted) ** 2) AS mse FROM pred GROUP BY ALL)) WHERE rk <= 5", DAILY, W, NAIVE),
    "periodogram": query(f"SELECT {KEY}, CAST(k AS INTEGER) AS k, round(power, 2) AS power FROM bins", HOURLY, W, LINE, POWER),
    "peak_significance": query(f"SELECT {KEY}, CAST(arg_max(k, power) AS INTEGER) AS k, round(max(power), 2) AS peak, round(median(power), 2) AS noise_floor, round(max(power) / median(power), 6) AS snr, max(power) >= 2 * median(power) * (1 + ln(count(*))) AS significant, CAST(least(2 + greatest(1, ceil(2 / sqrt(greatest(max(power) / median(power), 0.01)))), 64) AS INTEGER) AS footprint FROM bins GROUP BY ALL", HOURLY, W, LINE, POWER),
    "dominant_period": query(f"SELECT {KEY}, CAST(least(greatest(4, round_even(512.0 / arg_max(k, power), 0)), 128) AS INTEGER) AS period FROM bins WHERE k < 128 GROUP BY ALL", HOURLY, W, LINE, POWER),
    "amplitude_damping": query(f"SELECT {KEY}, CAST(h AS INTEGER) AS h, round(exp(-0.5 * (2 * h / (512 * sqrt(greatest(2 * snr / 3, 1e-10)))) ** 2), 7) AS damping FROM (SELECT {KEY}, max(power) / median(power) AS snr FROM bins GROUP BY ALL), (SELECT unnest(range(1, 97)) AS h)", HOURLY, W, LINE, POWER),
    "spectral_profile": query(f"SELECT {KEY}, round(sum(p) FILTER (rk <= 5), 6) AS top5_share, round(sum(p) FILTER (rk <= 10), 6) AS top10_share, round(sum(p) FILTER (rk <= 20), 6) AS top20_share, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy, round(max(power) / median(power), 5) AS peak_ratio FROM (SELECT *, power / sum(power) OVER (PARTITION BY {KEY}) AS p, row_number() OVER (PARTITION BY {KEY} ORDER BY power DESC, k) AS rk FROM bins) GROUP BY ALL", HOURLY, W, LINE, POWER),
    "trend_candidates": query(f"SELECT {KEY}, trend_type, round(a, 8) AS a, round(b, 6) AS b, round(c, 5) AS c, round(rss, 2) AS rss, round(bic, 5) AS bic FROM opt", HOURLY, W, WEIGHTED, TRENDS),
    "weighted_trend_bic": query(BEST_OF_FOUR.format(5), HOURLY, W, WEIGHTED, TRENDS, exponential()),
    "curved_trend_bic": query(BEST_OF_FOUR.format(4), GROWN, W, WEIGHTED, TRENDS, exponential()),
    "trend_exponential": query(f"SELECT {KEY}, round(a, 6) AS a, round(b, 8) AS b, round(c, 5) AS c, round(rss, 2) AS rss FROM eopt", HOURLY, W, WEIGHTED, exponential()),
    "shock_passes": shock_passes_sql(),
    "strongest_sinusoids": sinusoids_sql(),
    "nation_ar24": least_squares_sql(),
    "series_wavelet_energy": series_wavelet_sql(),
    "streaming_series": query("SELECT series_id, t, round(y, 6) AS y FROM series"),
    "damped_trend": query(f"SELECT {KEY}, h, round(exp(-ln(2) / 128 * (h + 1)) * (a*(512+h)**2 + b*(512+h) + c) + (1 - exp(-ln(2) / 128 * (h + 1))) * ((a*511**2 + b*511 + c) + (((a*511.5**2 + b*511.5 + c) - (a*510.5**2 + b*510.5 + c))) * (h + 1)), 4) AS trend FROM opt, (SELECT CAST(unnest(range(0, 96)) AS INTEGER) AS h) WHERE trend_type = 'quadratic'", HOURLY, W, WEIGHTED, TRENDS),
    "moving_average": query("SELECT series_id, t, CASE WHEN count(*) OVER f = 25 THEN round(avg(y) OVER f, 6) END AS trend FROM series WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"),
    "seasonal_profile": query("SELECT series_id, CAST(t % 24 AS INTEGER) AS phase, round(avg(y), 6) AS seasonal FROM series GROUP BY ALL"),
    "classical_decomposition": query("SELECT series_id, t, round(filled, 6) AS filled, round(seasonal, 6) AS seasonal, round(y - filled - seasonal, 6) AS rest FROM (SELECT *, avg(y - filled) OVER (PARTITION BY series_id, t % 24) AS seasonal FROM (SELECT *, coalesce(last_value(trend IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t), first_value(trend IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM (SELECT series_id, t, y, CASE WHEN count(*) OVER f = 25 THEN avg(y) OVER f END AS trend FROM series WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))))"),
    "trend_tail": query("SELECT series_id, round(regr_slope(trend, t), 6) AS slope, round(regr_intercept(trend, t), 3) AS intercept, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS rk, count(*) OVER (PARTITION BY series_id) AS m FROM (SELECT series_id, t, CASE WHEN count(*) OVER f = 25 THEN avg(y) OVER f END AS trend FROM series WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) WHERE trend IS NOT NULL) WHERE rk <= greatest(20, m // 4) GROUP BY 1"),
    "level_shift_candidates": query("SELECT m.series_id, CAST(cp + 1 AS INTEGER) AS index, round(after - before, 4) AS magnitude, round(threshold, 4) AS threshold, round(iqr, 4) AS iqr FROM med m JOIN iqr USING (series_id)", NATION, SHIFTS),
    "level_shifts": query("SELECT m.series_id, CAST(cp + 1 AS INTEGER) AS index, round(after - before, 2) AS magnitude FROM med m JOIN iqr USING (series_id) WHERE abs(after - before) >= greatest(threshold, iqr)", HELD, SHIFTS),
    "csv_modes": query("""
        SELECT 'checked mixed' AS part, count(*) AS n, CAST(sum(t) AS DOUBLE) AS total, CAST(max(k) AS INTEGER) AS last_t FROM placed
        UNION ALL SELECT 'tolerant mixed', count(*), CAST(sum(t) AS DOUBLE), CAST(max(k) AS INTEGER) FROM placed
        UNION ALL SELECT 'tolerant missing', 0, 0.0::DOUBLE, -1 UNION ALL SELECT 'strict clean', count(*), CAST(sum(t) AS DOUBLE), max(t) FROM series""", DAILY,
        "placed AS (SELECT t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS k FROM series WHERE t % 10 <> 3)"),
    "narrow_level_shifts": query("SELECT series_id, t AS index, round(magnitude, 4) AS magnitude FROM found", HOURLY, NARROW, FOUND),
    "shift_free_series": query("SELECT series_id, t, round(y, 4) AS y, round(shift, 4) AS shift, round(y - shift, 4) AS cleaned FROM (SELECT s.*, sum(coalesce(magnitude, 0)) OVER (PARTITION BY s.series_id ORDER BY s.t) AS shift FROM series s LEFT JOIN found USING (series_id, t))", HOURLY, NARROW, FOUND),
    "shock_select": query(f"SELECT {KEY}, CAST(onset AS INTEGER) AS onset, shape, round(magnitude, 5) AS magnitude, round(rate, 7) AS rate, round(aic, 5) AS aic FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY aic, ord) AS rk FROM opt) WHERE rk = 1", HOURLY, W, LINE, SHOCK),
    "weighted_autocov": query(f"SELECT {KEY}, lag, round(cov, 4) AS cov FROM cov", HOURLY, W, COV),
    "unweighted_autocov": query(f"SELECT a.series_id, a.window_start, CAST(a.i - b.i AS INTEGER) AS lag, round(sum((a.y - m) * (b.y - m)) / 256, 4) AS cov FROM local a JOIN local b ON a.series_id = b.series_id AND a.window_start = b.window_start AND a.i - b.i BETWEEN 0 AND 12 JOIN (SELECT {KEY}, avg(y) AS m FROM local GROUP BY ALL) c ON c.series_id = a.series_id AND c.window_start = a.window_start GROUP BY ALL", HOURLY, W, COV),
    "ar1_yule_walker": query(f"SELECT {KEY}, round(a, 8) AS coef, round(intercept, 6) AS intercept FROM ar", HOURLY, W, COV, AR1),
    "ar_fitted": query(f"SELECT c.series_id, c.window_start, c.i, round(coalesce(intercept + a * lag(c.y) OVER (PARTITION BY c.series_id, c.window_start ORDER BY c.i), 0), 5) AS fitted FROM cen c JOIN ar USING ({KEY})", HOURLY, W, COV, AR1),
    "ar_recursive_forecast": query(f"SELECT r.series_id, r.window_start, h, round(intercept * (1 - a ** (h + 1)) / (1 - a) + a ** (h + 1) * y, 5) AS value FROM ar r JOIN (SELECT {KEY}, y FROM ctx WHERE i = 511) USING ({KEY}), (SELECT CAST(unnest(range(0, 96)) AS INTEGER) AS h)", HOURLY, W, COV, AR1),
    "ar_order_histogram": query(f"SELECT p, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM (SELECT CAST(arg_min(p, aic) AS INTEGER) AS p FROM orders GROUP BY {KEY}) GROUP BY p", HOURLY, W, COV, ar_orders()),
    "ewma_error": query("SELECT series_id, round(list_reduce(list(abs(y - before) ORDER BY t), lambda e, x: 0.1 * x + 0.9 * e, 0.0::DOUBLE), 6) AS ewma FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS before FROM series) WHERE before IS NOT NULL GROUP BY 1"),
    "recent_errors": query("SELECT series_id, t, round(sqrt(avg((y - before) ** 2) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)), 5) AS rmse50 FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS before FROM series) WHERE before IS NOT NULL"),
    "confidence_weights": query(f"SELECT c.series_id, c.window_start, c.worker, round(mse, 3) AS mse, errors, round(confidence, 8) AS confidence, round(coalesce(p, 0), 8) AS weight FROM conf c LEFT JOIN weight w ON c.series_id = w.series_id AND c.window_start = w.window_start AND c.worker = w.worker", HOURLY, W, plain_workers()),
    "ensemble_blend": query(f"""SELECT s.series_id, s.window_start, s.h, round(s.value, 5) AS value, round(s.value - b, 5) AS lower, round(s.value + b, 5) AS upper, round(best / (1 + md / signal_std), 8) AS confidence, round(1 / (1 + md / signal_std), 8) AS agreement
        FROM (SELECT *, greatest((d + 0.5 * md) * sqrt(1 + h / 512.0) * 1.28, 0.05 * signal_std * sqrt(1 + h / 512.0)) AS b FROM step JOIN spread USING ({KEY}, h) JOIN md USING ({KEY}) JOIN stat USING ({KEY}) JOIN top USING ({KEY})) s""", HOURLY, W, plain_workers()),
    "collapse_rate": query("SELECT series_id, count(*) AS n_windows, round(avg(CASE WHEN second IS NULL OR best / second > 2 THEN 1.0 ELSE 0.0 END), 6) AS collapse_rate FROM top GROUP BY 1", DAILY, W, plain_workers()),
    "forecast_report": query(f"SELECT {KEY}, printf('t+%3d: %.2f [%.2f, %.2f]', h, round(l.y, 6), round(l.y - sd, 6), round(l.y + sd, 6)) AS line FROM (SELECT {KEY}, h, any_value(predicted) AS y FROM pred GROUP BY ALL) l JOIN (SELECT {KEY}, stddev_pop(y) AS sd FROM ctx GROUP BY ALL) USING ({KEY}) WHERE h < 24", HOURLY, W, NAIVE),
    "wavelet_energy": wavelet_energy(),
}
