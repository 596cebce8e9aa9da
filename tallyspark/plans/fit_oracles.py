"""SQL for the fitted models: k-means in full, and regressions small enough for closed forms.

A k-means fit is written out as SQL: category columns, selection and scaling, the draws of the
starts from hashes of the keys, and the moves of all restarts as one recursive query.
"""

from __future__ import annotations

from tallyspark.config import AnomalyConfig, ProfilerConfig
from tallyspark.operators.clustering import SUMMARY_COLUMNS
from tallyspark.operators.kmeans import PRIME, TOLERANCE, multipliers
from tallyspark.operators.weekly import category_columns, weekly_columns

KEY = 'entity, "YearWeek"'
#: The categories of the order ledger, as its part brands are named.
BRANDS = sorted(f"brand#{i}" for i in range(1, 26))


def wide_weeks(source: str) -> str:
    """``wide``: the weeks of ``source`` with a pair of columns for each category."""
    sums = ", ".join(
        f"coalesce(sum(amount) FILTER (category = '{b}'), 0) AS \"cat_{b}_amount\", "
        f"coalesce(sum(ratio) FILTER (category = '{b}'), 0) AS \"cat_{b}_ratio\"" for b in BRANDS
    )
    return f"""cats AS (SELECT {KEY}, {sums} FROM long GROUP BY ALL),
wide AS (SELECT w.*, c.* EXCLUDE ({KEY}) FROM {source} w JOIN cats c USING ({KEY}))"""


def category_stats_sql(weeks: str, rnd) -> str:
    """Statistics of the category columns, zeros included, and their places by kind and category."""
    known = ", ".join(f"('cat_{b}_{k}', '{k}', '{b}')" for b in BRANDS for k in ("amount", "ratio"))
    columns = ", ".join(f'"cat_{b}_{k}"' for b in BRANDS for k in ("amount", "ratio"))
    return f"""WITH {weeks}, {wide_weeks("weekly")},
cells AS (UNPIVOT (SELECT {columns} FROM wide) ON {columns} INTO NAME feature VALUE x),
known(feature, kind, category) AS (VALUES {known}),
stats AS (SELECT feature, kind, category, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM cells JOIN known USING (feature) GROUP BY ALL),
places AS (SELECT feature, row_number() OVER (ORDER BY kind, category) - 1 AS place FROM stats WHERE v > 0.01)
SELECT feature, kind, category, n, {rnd("m", 4)} AS mean, {rnd("sqrt(v)", 4)} AS deviation, place FROM stats LEFT JOIN places USING (feature)"""


def points(variant: str, threshold: float) -> str:
    """``pts``: id, key, hash of the key, and the selected, scaled features as a list."""
    names = weekly_columns(variant, BRANDS)
    assert set(category_columns(BRANDS, "ratio")) < set(names)
    casts = ", ".join(f'CAST("{n}" AS DOUBLE) AS "{n}"' for n in names)
    order = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return f"""cells AS (UNPIVOT (SELECT {KEY}, {casts} FROM wide) ON {", ".join(f'"{n}"' for n in names)} INTO NAME feature VALUE x),
places(feature, place) AS (VALUES {order}),
stats AS (SELECT feature, avg(x) AS m, var_pop(x) AS v FROM cells GROUP BY feature HAVING var_pop(x) > {threshold}),
pts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {KEY}) AS id, {KEY},
  ('0x' || substr(md5(entity || '|' || "YearWeek"), 1, 12))::BIGINT % {PRIME} AS h,
  list((x - m) / sqrt(v) ORDER BY place) AS z
 FROM cells JOIN stats USING (feature) JOIN places USING (feature) GROUP BY {KEY}),
flat AS MATERIALIZED (SELECT id, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM pts)"""


def starts(k: int, n_init: int, seed: int) -> str:
    """``start0`` .. : the centre that each restart draws at each step, (r, id, z)."""
    parts = []
    for step in range(k):
        rows = ", ".join(f"({r}, {a}, {b})" for r in range(n_init) for a, b in [multipliers(seed, r, step)])
        u = f"(((h * a + b) % {PRIME}) + 0.5::DOUBLE) / {PRIME}"
        if step:
            near = "least(" + ", ".join(f"list_distance(p.z, s{j}.z)" for j in range(step)) + ", 1e300)"
            joins = " ".join(f"JOIN start{j} s{j} ON s{j}.r = d.r" for j in range(step))
            weight = f"pow({near}, 2)"
        else:
            joins, weight = "", "1.0::DOUBLE"
        parts.append(f"""draw{step}(r, a, b) AS (VALUES {rows}),
odds{step} AS (SELECT d.r, p.id, {weight} AS w, {u} AS u FROM draw{step} d {joins}, pts p),
start{step} AS MATERIALIZED (SELECT r, arg_min(id, -ln(u) / w) AS id, arg_min(z, -ln(u) / w) AS z
 FROM odds{step} JOIN pts USING (id) WHERE w > 0 GROUP BY r)""")
    return ",\n".join(parts)


def walk(begin: str, max_iter: int, limit: str) -> str:
    """``walk``: all moves of the runs of ``begin`` (r, c, z); ``ended``: where each run stands still."""
    return f"""walk AS (
 SELECT r, c, z, 0 AS it, 1e300::DOUBLE AS moved FROM ({begin})
 UNION ALL
 (WITH now AS (SELECT * FROM walk WHERE moved > {limit} AND it < {max_iter}),
  near AS (SELECT r, p.id, arg_min(c, (list_distance(p.z, now.z), c)) AS c FROM now, pts p GROUP BY r, p.id),
  means AS (SELECT r, c, i, avg(v) AS v FROM near JOIN flat USING (id) GROUP BY r, c, i),
  fresh AS (SELECT r, c, list(v ORDER BY i) AS z FROM means GROUP BY r, c),
  stepped AS (SELECT now.r, now.c, coalesce(fresh.z, now.z) AS z, now.it + 1 AS it, pow(list_distance(now.z, coalesce(fresh.z, now.z)), 2) AS gap
   FROM now LEFT JOIN fresh ON now.r = fresh.r AND now.c = fresh.c)
  SELECT r, c, z, it, sum(gap) OVER (PARTITION BY r) AS moved FROM stepped)),
ended AS MATERIALIZED (SELECT * FROM walk QUALIFY it = max(it) OVER (PARTITION BY r)),
costs AS (SELECT r, max(it) AS iterations, sum(d) AS cost FROM (
  SELECT r, any_value(it) AS it, min(pow(list_distance(p.z, e.z), 2)) AS d FROM ended e, pts p GROUP BY r, p.id) GROUP BY r)"""


LIMIT = f"(SELECT {TOLERANCE} * avg(s) FROM (SELECT var_pop(v) AS s FROM flat GROUP BY i))"


def best(ks: tuple[int, ...], n_init: int) -> str:
    """``centers``: of each k the run of least cost, its centres numbered in order."""
    return f"""chosen AS (SELECT r // {n_init} AS g, arg_min(r, (round(cost, 6), r)) AS r FROM costs GROUP BY g),
centers AS MATERIALIZED (SELECT CASE g {" ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(ks))} END AS k,
  row_number() OVER (PARTITION BY g ORDER BY z) - 1 AS c, z FROM chosen JOIN ended USING (r)),
placed AS MATERIALIZED (SELECT k, p.id, any_value({KEY.split(", ")[0]}) AS entity, any_value("YearWeek") AS "YearWeek",
  CAST(arg_min(c, (list_distance(p.z, centers.z), c)) AS INTEGER) AS cluster_label, min(list_distance(p.z, centers.z)) AS d
 FROM centers, pts p GROUP BY k, p.id)"""


def fitted(source: str, variant: str, threshold: float, ks: tuple[int, ...], n_init: int, max_iter: int, seed: int) -> str:
    begin = " UNION ALL ".join(
        f"SELECT {g * n_init} + r AS r, {j} AS c, z FROM start{j}" for g, k in enumerate(ks) for j in range(k)
    )
    return ",\n".join((
        wide_weeks(source), points(variant, threshold), starts(max(ks), n_init, seed), walk(begin, max_iter, LIMIT), best(ks, n_init)
    ))


def anomaly_sql(weeks: str, rnd, config: AnomalyConfig = AnomalyConfig()) -> str:
    fit = fitted("weekly", "anomaly", config.variance_threshold, (config.n_clusters,), config.n_init, config.max_iter, config.seed)
    cut = ", ".join(
        f"quantile_cont(d, {p / 100.0}) OVER () AS {n}"
        for n, p in (("low", config.anomaly_percentile), ("high", config.severe_percentile))
    )
    return f"""WITH RECURSIVE {weeks}, {fit},
flagged AS (SELECT *, {cut} FROM placed)
SELECT {KEY}, {rnd("d")} AS anomaly_score, cluster_label, d > low AS is_anomaly, d > high AS is_severe_anomaly FROM flagged"""


def _kept(config: ProfilerConfig, robust: str, votes: str) -> str:
    return f"""{robust}, {votes},
kept AS (SELECT weekly.* FROM weekly JOIN votes USING ({KEY}) WHERE outlier_feature_count < {config.outlier_min_features})"""


def _profiler(weeks: str, robust: str, votes: str, config: ProfilerConfig) -> str:
    fit = fitted(
        "kept", "profile", config.variance_threshold, config.candidate_ks, config.n_init, config.max_iter, config.seed
    )
    least = config.min_cluster_ratio
    return f"""WITH RECURSIVE {weeks}, {_kept(config, robust, votes)}, {fit},
far AS (SELECT k, a.id, a.cluster_label AS g, b.cluster_label AS other, sum(list_distance(p.z, q.z)) AS d, count(*) AS n
 FROM placed a JOIN placed b USING (k) JOIN pts p ON p.id = a.id JOIN pts q ON q.id = b.id GROUP BY ALL),
ab AS (SELECT k, id, max(d / nullif(n - 1, 0)) FILTER (g = other) AS a, min(d / n) FILTER (g <> other) AS b FROM far GROUP BY k, id),
sil AS (SELECT k, avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS silhouette, count(*) AS silhouette_rows FROM ab GROUP BY k),
mean_cells AS (SELECT k, cluster_label AS g, i, avg(v) AS v FROM placed JOIN flat USING (id) GROUP BY ALL),
mid AS (SELECT k, g, list(v ORDER BY i) AS z FROM mean_cells GROUP BY k, g),
scatter AS (SELECT k, g, any_value(mid.z) AS z, avg(list_distance(p.z, mid.z)) AS s, count(*) AS n
 FROM placed JOIN pts p USING (id) JOIN mid USING (k) WHERE g = cluster_label GROUP BY k, g),
pairs AS (SELECT a.k, a.g, max((a.s + b.s) / list_distance(a.z, b.z)) AS v FROM scatter a JOIN scatter b ON a.k = b.k AND a.g <> b.g GROUP BY ALL),
db AS (SELECT k, avg(v) AS davies_bouldin FROM pairs GROUP BY k),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY k) AS share FROM scatter),
bal AS (SELECT k, CAST(sum(n) AS BIGINT) AS n_rows, greatest(0, 1 - sum(abs(share - 1.0::DOUBLE / k))) AS balance_score,
  min(share) AS min_cluster_fraction FROM shares GROUP BY k),
quality AS (SELECT *, 0.40::DOUBLE * silhouette + 0.30::DOUBLE * balance_score + 0.20::DOUBLE * min_cluster_fraction
  - 0.10::DOUBLE * davies_bouldin - CASE WHEN min_cluster_fraction < {least} THEN 0.25 ELSE 0 END AS composite_score
 FROM sil JOIN db USING (k) JOIN bal USING (k)),
winner AS (SELECT k FROM quality ORDER BY composite_score DESC, balance_score DESC, silhouette DESC LIMIT 1)"""


def evaluation_sql(weeks: str, robust: str, votes: str, rnd, config: ProfilerConfig = ProfilerConfig()) -> str:
    numbers = ("silhouette", "davies_bouldin", "balance_score", "min_cluster_fraction", "composite_score")
    return f"""{_profiler(weeks, robust, votes, config)}
SELECT CAST(k AS INTEGER) AS k, n_rows, silhouette_rows, {", ".join(f"{rnd(n)} AS {n}" for n in numbers)},
 k = (SELECT k FROM winner) AS chosen FROM quality"""


def profiler_sql(weeks: str, robust: str, votes: str, rnd, rules: str, config: ProfilerConfig = ProfilerConfig()) -> str:
    """The summary of the chosen clusters and the scope of the training."""
    means = ", ".join(f'avg("{c}") AS "{c}", median("{c}") AS "med_{c}"' for c in SUMMARY_COLUMNS)
    shown = ", ".join(
        f'{rnd(name, 4)} AS "{c}_{kind}"' for c in SUMMARY_COLUMNS for name, kind in ((f'"{c}"', "mean"), (f'"med_{c}"', "median"))
    )
    share = rules.replace("cluster_size / 40", "cluster_size / sum(cluster_size) OVER ()")
    return f"""{_profiler(weeks, robust, votes, config)},
labelled AS (SELECT kept.*, cluster_label FROM kept JOIN placed USING ({KEY}) WHERE k = (SELECT k FROM winner)),
g AS (SELECT cluster_label, {means}, count(*) AS cluster_size FROM labelled GROUP BY cluster_label)
SELECT cluster_label, {shown}, cluster_size, {share} AS profile_label,
 (SELECT count(*) FROM weekly) AS original_weekly_count,
 (SELECT count(*) FROM weekly) - (SELECT count(*) FROM kept) AS removed_outlier_week_count,
 (SELECT count(*) FROM kept) AS final_training_weekly_count FROM g"""


def given_starts_sql(scored: str, dim: int, given, max_iter: int, limit: float, rnd) -> str:
    """Runs from given starts over the scaled features f0.. of ``scored``."""
    rows = ", ".join(
        f"({r}, {c}, [{', '.join(f'({v!r})::DOUBLE' for v in center)}])" for r, run in enumerate(given) for c, center in enumerate(run)
    )
    z = ", ".join(f"f{i}" for i in range(dim))
    return f"""WITH RECURSIVE {scored},
pts AS MATERIALIZED (SELECT row_number() OVER () AS id, [{z}] AS z FROM scored),
flat AS MATERIALIZED (SELECT id, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM pts),
given(r, c, z) AS (VALUES {rows}),
{walk("SELECT * FROM given", max_iter, repr(limit))}
SELECT r AS run, c AS cluster, i AS feature, {rnd("v")} AS value, iterations, {rnd("cost", 4)} AS cost
FROM (SELECT r, c, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM ended) JOIN costs USING (r)"""


def forecast_sql(split: str, target: str, baseline: str, features, alpha: float, elastic: float, l1_ratio: float, rnd) -> str:
    """Least squares, ridge and elastic net on two features by closed forms, over all ranges of months."""
    x1, x2 = features
    l1, l2 = elastic * l1_ratio, elastic * (1 - l1_ratio)
    scores = f"sqrt(avg(pow(p - y, 2))) AS rmse, avg(abs(p - y)) AS mae, 1 - sum(pow(p - y, 2)) / (var_pop(y) * count(*)) AS r2"
    return f"""WITH {split},
bounds AS (SELECT count(DISTINCT position) FILTER (split = 'train') AS m, count(DISTINCT position) FILTER (split <> 'test') AS v,
  count(DISTINCT position) AS n FROM placed),
ranges AS (SELECT 'fold ' || i AS name, m - (4 - i) * (m // 4) AS fit_end, m - (3 - i) * (m // 4) AS score_end FROM bounds, range(1, 4) r(i)
 UNION ALL SELECT 'valid', m, v FROM bounds UNION ALL SELECT 'test', v, n FROM bounds),
fit AS (SELECT name, {x1} AS x1, {x2} AS x2, {target} AS y FROM ranges JOIN placed ON position < fit_end),
means AS (SELECT name, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, avg(y) AS my, count(*) AS n FROM fit GROUP BY name),
sums AS (SELECT name, any_value(n)::DOUBLE AS n, sum((x1 - m1) / s1 * (x2 - m2) / s2) AS g, sum((x1 - m1) / s1 * (y - my)) AS b1,
  sum((x2 - m2) / s2 * (y - my)) AS b2 FROM fit JOIN means USING (name) GROUP BY name),
systems AS (SELECT name, 'baseline_linear' AS model, n AS d, g, b1, b2 FROM sums
 UNION ALL SELECT name, 'ridge', n + {alpha}, g, b1, b2 FROM sums
 UNION ALL SELECT name, 'elasticnet', 1 + {l2!r}::DOUBLE, g / n, b1 / n - {l1!r}::DOUBLE * sign(n * b1 - g * b2), b2 / n - {l1!r}::DOUBLE * sign(n * b2 - g * b1) FROM sums),
weights AS (SELECT name, model, (d * b1 - g * b2) / (d * d - g * g) AS w1, (d * b2 - g * b1) / (d * d - g * g) AS w2 FROM systems),
scored AS (SELECT name, model, {target} AS y, w1 * ({x1} - m1) / s1 + w2 * ({x2} - m2) / s2 + my AS p
 FROM ranges JOIN weights USING (name) JOIN means USING (name) JOIN placed ON position >= fit_end AND position < score_end),
scores AS (SELECT name, model, {scores} FROM scored GROUP BY name, model),
cv AS (SELECT model, avg(rmse) AS cv_rmse_mean, avg(mae) AS cv_mae_mean, avg(r2) AS cv_r2_mean FROM scores WHERE name LIKE 'fold%' GROUP BY model),
best AS (SELECT model FROM scores WHERE name = 'valid' ORDER BY rmse, CASE model WHEN 'baseline_linear' THEN 0 WHEN 'ridge' THEN 1 ELSE 2 END LIMIT 1),
plain AS ({baseline}),
rows AS (SELECT model, name AS split, {rnd("rmse", 2)} AS rmse, {rnd("mae", 2)} AS mae, {rnd("r2")} AS r2 FROM scores
  WHERE name = 'valid' OR name = 'test' AND model = (SELECT model FROM best)
 UNION ALL BY NAME SELECT * FROM plain)
SELECT rows.*, {rnd("cv_rmse_mean", 2)} AS cv_rmse_mean, {rnd("cv_mae_mean", 2)} AS cv_mae_mean, {rnd("cv_r2_mean")} AS cv_r2_mean,
 model = (SELECT model FROM best) AS chosen FROM rows LEFT JOIN cv USING (model)"""
