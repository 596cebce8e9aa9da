"""The SQL that says what each registered query must return."""

from __future__ import annotations

from tallyspark.operators.clustering import SUMMARY_COLUMNS
from tallyspark.operators.monthly import BASE_COLUMNS as MONTH_COLUMNS
from tallyspark.operators.monthly import FEATURE_COLUMNS, TARGET
from tallyspark.operators.outliers import OUTLIER_COLUMNS
from tallyspark.operators.risk import MESSAGES
from tallyspark.operators.weekly import (
    BASE_COLUMNS, CONCENTRATION_COLUMNS, RATIO_COLUMNS, ROLLING_COLUMNS, weekly_columns,
)
from tallyspark.plans import fit_oracles
from tallyspark.plans.queries import (
    CUSTOMER_PREP, DESCRIPTIONS, FIT_FORECAST, FIXED_CENTROIDS, FIXED_FORECAST, FIXED_PREP, FIXED_SEVERE, FIXED_THRESHOLD, FORECAST_WEIGHT_HISTORY,
    FORECAST_WEIGHT_SO_FAR, GIVEN_LIMIT, GIVEN_MOVES, GIVEN_STARTS, LABELS, NATION_PREP, NUDGE, SMALL_FEATURES, STAT_COLUMNS, digits,
)

INTEGER = {
    "total_transactions", "expense_transaction_count", "income_transaction_count", "active_days",
    "unique_categories", "zero_income_week", "Year", "Month", "snapshot_day", "expense_tx_count_so_far",
    "income_tx_count_so_far", "total_tx_so_far", "unique_categories_so_far", "MonthStartDate",
}


def rnd(expr: str, d: int = 6) -> str:
    nudge = f" + CAST({NUDGE[d]!r} AS DOUBLE)" if NUDGE[d] else ""
    return f"round({expr}{nudge}, {d})"


def pick(names, overrides=None) -> str:
    out = []
    for n in names:
        d = (overrides or {}).get(n) or digits(n)
        out.append(f'"{n}"' if n in INTEGER else f'{rnd(chr(34) + n + chr(34), d)} AS "{n}"')
    return ", ".join(out)


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE CAST(0 AS DOUBLE) END)"


# ledgers --------------------------------------------------------------------------------

LINES = """lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey"""


def order_raw(entity: str = "c_mktsegment") -> str:
    return f"""raw AS (
 SELECT {entity} AS entity, l_shipdate AS "Date", p_type AS "Description", l_extendedprice AS "Amount",
  CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS "Transaction Type",
  p_brand AS "Category", o_orderpriority AS "Account Name" FROM {LINES})"""


EVENT_RAW = """raw AS (
 SELECT user_id AS entity, ts AS "Date", props AS "Description", value AS "Amount",
  CASE WHEN event_type = 'signup' THEN 'credit' ELSE 'debit' END AS "Transaction Type",
  event_type AS "Category", CAST(NULL AS VARCHAR) AS "Account Name" FROM events)"""

_K = "(l_orderkey + l_linenumber)"
_KIND = "(CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END)"
_AMT = "printf('%.2f', l_extendedprice)"
_DAY = "strftime(l_shipdate, '%Y-%m-%d')"

DIRTY_RAW = f"""faulty AS (
 SELECT c_mktsegment AS entity,
  CASE WHEN {_K} % 41 = 1 THEN 'not a date' WHEN {_K} % 41 = 2 THEN ' ' || {_DAY} || ' ' ELSE {_DAY} END AS "Date",
  CASE WHEN {_K} % 37 = 1 THEN 'nan' WHEN {_K} % 37 = 2 THEN chr(9) || upper(p_type) || ' '
   WHEN {_K} % 37 = 3 THEN 'transfer' WHEN {_K} % 37 = 4 THEN 'None' ELSE p_type END AS "Description",
  CASE WHEN {_K} % 31 = 1 THEN 'abc' WHEN {_K} % 31 = 2 THEN '-' || {_AMT} WHEN {_K} % 31 = 3 THEN '0'
   WHEN {_K} % 31 = 4 THEN ' ' || {_AMT} || ' ' WHEN {_K} % 31 = 5 THEN 'NaN' WHEN {_K} % 31 = 6 THEN '1d'
   ELSE {_AMT} END AS "Amount",
  CASE WHEN {_K} % 29 = 1 THEN 'fee' WHEN {_K} % 29 = 2 THEN ' ' || upper({_KIND})
   WHEN {_K} % 29 = 3 THEN NULL ELSE {_KIND} END AS "Transaction Type",
  CASE WHEN {_K} % 23 = 1 THEN '' WHEN {_K} % 23 = 2 THEN '  ' || upper(p_brand) || chr(10)
   WHEN {_K} % 23 = 3 THEN 'NA' WHEN {_K} % 23 = 4 THEN ' NA ' WHEN {_K} % 23 = 5 THEN 'Internal Transfer'
   ELSE p_brand END AS "Category",
  CASE WHEN {_K} % 19 = 1 THEN 'None' ELSE o_orderpriority END AS "Account Name"
 FROM {LINES}),
doubled AS (SELECT * FROM faulty UNION ALL SELECT * FROM faulty WHERE "Account Name" = '1-URGENT')"""


def _word(c: str) -> str:
    trimmed = f"trim(\"{c}\", ' ' || chr(9) || chr(10) || chr(13))"
    return (
        f"CASE WHEN \"{c}\" IN ('', 'NA', 'nan', 'NaN', 'None', 'null') OR {trimmed} IN ('', 'nan', 'None')"
        f" THEN NULL ELSE lower({trimmed}) END AS \"{c}\""
    )


DIRTY_CLEAN = f"""{DIRTY_RAW},
typed AS (SELECT entity, CAST(try_strptime(trim("Date"), '%Y-%m-%d') AS TIMESTAMP) AS "Date",
  {_word("Description")}, abs(try_cast("Amount" AS DOUBLE)) AS "Amount", {_word("Transaction Type")},
  {_word("Category")}, {_word("Account Name")} FROM doubled),
clean AS (SELECT DISTINCT * FROM typed WHERE "Date" IS NOT NULL AND "Category" IS NOT NULL
  AND "Transaction Type" IN ('debit', 'credit') AND "Amount" > 0 AND NOT isnan("Amount"))"""

CLEAN = """clean AS (
 SELECT DISTINCT entity, "Date", lower("Description") AS "Description", abs("Amount") AS "Amount",
  "Transaction Type", lower("Category") AS "Category", lower("Account Name") AS "Account Name"
 FROM raw WHERE "Date" IS NOT NULL AND "Category" IS NOT NULL AND abs("Amount") > 0)"""

# weekly ---------------------------------------------------------------------------------

_ANY = "\"Transaction Type\" = 'debit'"
WEEKLY = f"""flows AS (
 SELECT entity, strftime("Date", '%G-W%V') AS "YearWeek", CAST("Date" AS DATE) AS day, "Category" AS category,
  isodow("Date") >= 6 AS weekend, CASE WHEN {_ANY} THEN "Amount" ELSE 0.0::DOUBLE END AS expense,
  CASE WHEN {_ANY} THEN 0.0::DOUBLE ELSE "Amount" END AS income FROM clean),
sums AS (SELECT entity, "YearWeek", count(*) AS total_transactions, sum(expense) AS total_expense,
  sum(income) AS total_income, coalesce(avg(expense) FILTER (expense > 0), 0) AS avg_expense,
  max(expense) AS max_expense, coalesce(min(expense) FILTER (expense > 0), 0) AS min_expense,
  coalesce(stddev_samp(expense) FILTER (expense > 0), 0) AS std_expense,
  count(*) FILTER (expense > 0) AS expense_transaction_count,
  count(*) FILTER (income > 0) AS income_transaction_count, count(DISTINCT day) AS active_days,
  count(DISTINCT category) AS unique_categories,
  coalesce(sum(expense) FILTER (weekend), 0) AS weekend_expense,
  coalesce(sum(expense) FILTER (NOT weekend), 0) AS weekday_expense FROM flows GROUP BY ALL),
long AS (SELECT f.entity, f."YearWeek", category, sum(expense) AS amount,
  {ratio("sum(expense)", "max(total_expense)")} AS ratio
 FROM flows f JOIN sums s ON f.entity IS NOT DISTINCT FROM s.entity AND f."YearWeek" = s."YearWeek"
 GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY entity, "YearWeek" ORDER BY amount DESC, category) AS rn
 FROM long),
mix AS (SELECT entity, "YearWeek", max(ratio) AS dominant_category_ratio,
  coalesce(-sum(CASE WHEN ratio > 0 THEN ratio * ln(ratio + 1e-12) END), 0) AS category_entropy,
  sum(ratio) FILTER (rn <= 2) AS top2_category_ratio_sum FROM ordered GROUP BY ALL),
joined AS (SELECT s.*, m.* EXCLUDE (entity, "YearWeek"),
  avg(total_expense) OVER four AS rolling_4w_expense_mean,
  avg(total_income) OVER four AS rolling_4w_income_mean
 FROM sums s JOIN mix m ON s.entity IS NOT DISTINCT FROM m.entity AND s."YearWeek" = m."YearWeek"
 WINDOW four AS (PARTITION BY s.entity ORDER BY s."YearWeek" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
weekly AS (SELECT *, total_income - total_expense AS net_cash_flow,
  {ratio("total_expense", "total_income")} AS expense_to_income_ratio,
  {ratio("weekend_expense", "total_expense")} AS weekend_expense_ratio,
  {ratio("weekday_expense", "total_expense")} AS weekday_expense_ratio,
  (total_expense + total_income) / total_transactions AS avg_transaction_value,
  expense_transaction_count / total_transactions AS expense_frequency_ratio,
  income_transaction_count / total_transactions AS income_presence_ratio,
  {ratio("std_expense", "avg_expense")} AS expense_volatility_ratio,
  active_days / 7.0::DOUBLE AS active_days_ratio, CAST(total_income <= 0 AS INTEGER) AS zero_income_week,
  {ratio("total_expense", "rolling_4w_expense_mean")} AS expense_vs_rolling_mean_ratio,
  {ratio("total_income", "rolling_4w_income_mean")} AS income_vs_rolling_mean_ratio FROM joined)"""

WEEKS = f"{order_raw()}, {CLEAN}, {WEEKLY}"
EVENT_WEEKS = f"{EVENT_RAW}, {CLEAN}, {WEEKLY}"
KEY = 'entity, "YearWeek"'
PROFILE = weekly_columns("profile")

_BRANDS = [f"brand#{i}" for i in range(1, 26)]
_PIVOT = ", ".join(
    f"round(coalesce(sum(amount) FILTER (category = '{b}'), 0), 2) AS \"cat_{b.replace('#', '')}_amount\", "
    f"{rnd(f'''coalesce(sum(ratio) FILTER (category = '{b}'), 0)''')} AS \"cat_{b.replace('#', '')}_ratio\""
    for b in _BRANDS
)

# outliers -------------------------------------------------------------------------------

_VOTERS = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in OUTLIER_COLUMNS)


def robust(by_entity: bool) -> str:
    group = "entity, feature" if by_entity else "feature"
    return f"""votes_in AS (UNPIVOT (SELECT {KEY}, {_VOTERS} FROM weekly)
  ON {", ".join(OUTLIER_COLUMNS)} INTO NAME feature VALUE x),
centred AS (SELECT *, median(x) OVER (PARTITION BY {group}) AS med FROM votes_in),
spread AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY {group}) AS mad FROM centred)"""


def votes(z: float) -> str:
    return f"""votes AS (SELECT {KEY}, CAST(count(*) FILTER (
  CASE WHEN mad <> 0 THEN abs(0.6745 * (x - med) / mad) ELSE 0 END > {z}) AS BIGINT) AS outlier_feature_count
 FROM spread GROUP BY ALL)"""


# fixed model ----------------------------------------------------------------------------

_DIM = len(FIXED_PREP.columns)


def _scaled(prep) -> str:
    return ", ".join(
        f"({c} - ({m!r})::DOUBLE) / ({s!r})::DOUBLE AS f{i}"
        for i, (c, m, s) in enumerate(zip(prep.columns, prep.mean, prep.scale, strict=True))
    )


def _dist(center) -> str:
    return "sqrt(" + " + ".join(f"pow(f{i} - ({v!r})::DOUBLE, 2)" for i, v in enumerate(center)) + ")"


_C = FIXED_CENTROIDS.centers


def _scored(prep) -> str:
    return f"""scaled AS (SELECT *, {_scaled(prep)} FROM weekly),
dists AS (SELECT *, {", ".join(f"{_dist(c)} AS d{i}" for i, c in enumerate(_C))} FROM scaled),
scored AS (SELECT *, least(d0, d1, d2) AS anomaly_score,
  CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INTEGER) AS cluster_label
 FROM dists)"""


SCORES = f"{WEEKS}, {_scored(FIXED_PREP)}"
NATIONS = f"{order_raw('c_nationkey')}, {CLEAN}, {WEEKLY}, {_scored(NATION_PREP)}"

_CENTER_OF = {
    i: "CASE cluster_label " + " ".join(f"WHEN {k} THEN ({c[i]!r})::DOUBLE" for k, c in enumerate(_C)) + " END"
    for i in range(_DIM)
}
_PARTS = " UNION ALL ".join(
    f"SELECT {KEY}, '{c}' AS feature, abs(f{i} - {_CENTER_OF[i]}) AS dev, f{i} AS x, {_CENTER_OF[i]} AS c FROM scored"
    for i, c in enumerate(FIXED_PREP.columns)
)
_SUM_SQ = " + ".join(f"pow(a.f{i} - b.f{i}, 2)" for i in range(_DIM))
_MEANS = ", ".join(f"avg(f{i}) AS m{i}" for i in range(_DIM))
_TO_MEAN = " + ".join(f"pow(f{i} - m{i}, 2)" for i in range(_DIM))
_MEAN_GAP = " + ".join(f"pow(a.m{i} - b.m{i}, 2)" for i in range(_DIM))

_LABEL_RULES = """CASE
  WHEN cluster_size / 40 < 0.05 THEN 'uc_davranis_grubu'
  WHEN expense_to_income_ratio < 0.45 AND expense_volatility_ratio < 0.50
   AND expense_vs_rolling_mean_ratio <= 1.05 THEN 'tasarruf_odakli'
  WHEN dominant_category_ratio > 0.55 OR (top2_category_ratio_sum > 0.75 AND category_entropy < 1.05)
   THEN 'kategori_yogun_harcama'
  WHEN weekend_expense_ratio > 0.42 THEN 'hafta_sonu_agirlikli'
  WHEN expense_to_income_ratio > 0.90 AND expense_volatility_ratio > 0.70
   AND expense_vs_rolling_mean_ratio > 1.10 THEN 'dengesiz_yuksek_harcama'
  WHEN zero_income_week > 0.30 THEN 'gelirsiz_harcama_donemi'
  WHEN total_income > 0 AND expense_to_income_ratio <= 0.75 AND active_days_ratio >= 0.35
   THEN 'dengeli_harcama'
  ELSE 'genel_davranis_profili' END"""
_AVGS = ", ".join(f'avg("{c}") AS "{c}"' for c in SUMMARY_COLUMNS)
_MEDS = ", ".join(f'median("{c}") AS "med_{c}"' for c in SUMMARY_COLUMNS)
_SUMMARY = ", ".join(
    f'{rnd(name, 4)} AS "{c}_{kind}"'
    for c in SUMMARY_COLUMNS
    for name, kind in ((c, "mean"), (f"med_{c}", "median"))
)

# monthly --------------------------------------------------------------------------------

_INCOME = """"Transaction Type" = 'credit'
  AND "Category" NOT IN ('credit card payment', 'transfer', 'balance adjustment', 'internal transfer', 'payment')
  AND coalesce("Description" NOT IN ('credit card payment', 'transfer', 'payment'), TRUE)"""


def monthly(day: str) -> str:
    """``day`` is a number, or an expression over ``last_day`` of the month."""
    e = "FILTER (debit AND dom <= d)"
    return f"""mflows AS (SELECT entity, CAST(date_trunc('month', "Date") AS DATE) AS "MonthStartDate",
  CAST("Date" AS DATE) AS day, CAST(day("Date") AS INTEGER) AS dom, isodow("Date") >= 6 AS weekend,
  "Category" AS category, "Amount" AS amount, {_ANY} AS debit, ({_INCOME}) AS earned FROM clean),
mday AS (SELECT *, CAST({day.replace("last_day", 'max(dom) OVER (PARTITION BY entity, "MonthStartDate")')} AS INTEGER) AS d FROM mflows),
mcat AS (SELECT entity, "MonthStartDate", category, sum(amount) AS a FROM mday WHERE debit AND dom <= d GROUP BY ALL),
mratio AS (SELECT entity, "MonthStartDate", a / sum(a) OVER (PARTITION BY entity, "MonthStartDate") AS r FROM mcat),
mmix AS (SELECT entity, "MonthStartDate", max(r) AS dom_ratio, -sum(r * ln(r + 1e-12)) AS entropy
 FROM mratio GROUP BY ALL),
msum AS (SELECT entity, "MonthStartDate", CAST(year("MonthStartDate") AS INTEGER) AS "Year",
  CAST(month("MonthStartDate") AS INTEGER) AS "Month", strftime("MonthStartDate", '%Y-%m') AS "YearMonth",
  max(d) AS snapshot_day, coalesce(sum(amount) FILTER (debit), 0) AS month_total_expense,
  coalesce(sum(amount) FILTER (earned), 0) AS month_total_income, count(*) AS total_transactions,
  count(*) FILTER (debit) AS expense_transaction_count, count(*) FILTER (earned) AS income_transaction_count,
  count(DISTINCT day) AS active_days, count(*) FILTER (dom <= d) AS total_tx_so_far,
  count(*) {e} AS expense_tx_count_so_far, count(*) FILTER (earned AND dom <= d) AS income_tx_count_so_far,
  coalesce(sum(amount) {e}, 0) AS total_expense_so_far,
  coalesce(sum(amount) FILTER (earned AND dom <= d), 0) AS total_income_so_far,
  coalesce(avg(amount) {e}, 0) AS avg_expense_so_far, coalesce(max(amount) {e}, 0) AS max_expense_so_far,
  CASE WHEN count(*) {e} > 1 THEN stddev_pop(amount) {e} ELSE 0 END AS std_expense_so_far,
  coalesce(sum(amount) FILTER (debit AND dom <= d AND weekend), 0) AS weekend_so_far,
  count(DISTINCT day) FILTER (dom <= d) AS days_so_far, count(DISTINCT day) {e} AS expense_days_so_far,
  count(DISTINCT category) {e} AS unique_categories_so_far,
  coalesce(sum(amount) FILTER (debit AND dom <= d AND dom <= greatest(1, d // 2)), 0) AS early,
  coalesce(sum(amount) FILTER (debit AND dom <= d AND dom > greatest(1, d // 2)), 0) AS late
 FROM mday GROUP BY entity, "MonthStartDate"),
mlag AS (SELECT s.*, coalesce(dom_ratio, 0) AS dominant_category_ratio_so_far,
  coalesce(entropy, 0) AS category_entropy_so_far,
  lag(month_total_expense, 1) OVER line AS p1, lag(month_total_expense, 2) OVER line AS p2,
  coalesce(avg(month_total_expense) OVER last3, 0) AS rolling_3m_expense_mean,
  coalesce(stddev_samp(month_total_expense) OVER last3, 0) AS rolling_3m_expense_std,
  coalesce(avg(month_total_income) OVER last3, 0) AS rolling_3m_income_mean,
  lead(s."MonthStartDate") OVER line IS NULL AS is_latest
 FROM msum s LEFT JOIN mmix m ON s.entity = m.entity AND s."MonthStartDate" = m."MonthStartDate"
 WINDOW line AS (PARTITION BY s.entity ORDER BY s."MonthStartDate"),
  last3 AS (PARTITION BY s.entity ORDER BY s."MonthStartDate" ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
months AS (SELECT *, coalesce(p1, 0) AS prev_month_total_expense, coalesce(p2, 0) AS prev_2_month_total_expense,
  coalesce(p1 - p2, 0) AS expense_momentum,
  {ratio("month_total_expense", "p1")} AS expense_vs_prev_month_ratio,
  total_expense_so_far / snapshot_day AS avg_daily_expense_so_far,
  {ratio("total_expense_so_far", "total_income_so_far")} AS expense_to_income_ratio_so_far,
  {ratio("expense_tx_count_so_far", "total_tx_so_far")} AS expense_frequency_ratio_so_far,
  days_so_far / snapshot_day AS active_days_ratio_so_far,
  expense_days_so_far / snapshot_day AS expense_active_days_ratio_so_far,
  {ratio("weekend_so_far", "total_expense_so_far")} AS weekend_expense_ratio_so_far,
  late - early AS expense_trend_delta_so_far, {ratio("late", "early")} AS expense_trend_ratio_so_far,
  month_total_expense AS {TARGET}, expense_transaction_count > 0 AND total_tx_so_far > 0 AS has_snapshot
 FROM mlag)"""


ORDERS = f"{order_raw()}, {CLEAN}"
CUSTOMERS = f"{order_raw('o_custkey')}, {CLEAN}"
_LATEST = [c for c in FEATURE_COLUMNS if c != "snapshot_day"]
_LATEST_COLS = ", ".join(
    f'CASE WHEN has_snapshot THEN {p} END AS "{c}"'
    for c in _LATEST
    for p in [f'"{c}"' if c in INTEGER else rnd(f'"{c}"', digits(c))]
)
SPLIT = f"""{ORDERS}, {monthly("15")},
dataset AS (SELECT * FROM months WHERE has_snapshot AND total_transactions >= 5),
places AS (SELECT "MonthStartDate", CAST(row_number() OVER (ORDER BY "MonthStartDate") - 1 AS INTEGER) AS position,
  count(*) OVER () AS n FROM (SELECT DISTINCT "MonthStartDate" FROM dataset)),
placed AS (SELECT t.*, position, n, CASE WHEN position < floor(n * (0.7)::DOUBLE) THEN 'train'
  WHEN position < floor(n * (0.85)::DOUBLE) THEN 'valid' ELSE 'test' END AS split
 FROM dataset t JOIN places p ON t."MonthStartDate" = p."MonthStartDate")"""


def _metrics(y: str, p: str) -> str:
    return (
        f"{rnd(f'sqrt(avg(pow({p} - {y}, 2)))', 2)} AS rmse, {rnd(f'avg(abs({p} - {y}))', 2)} AS mae, "
        f"{rnd(f'1 - sum(pow({p} - {y}, 2)) / (var_pop({y}) * count(*))')} AS r2"
    )


_NAIVE = (
    f"({FORECAST_WEIGHT_SO_FAR!r}::DOUBLE * total_expense_so_far"
    f" + {FORECAST_WEIGHT_HISTORY!r}::DOUBLE * rolling_3m_expense_mean)"
)

_RAW_RISK = """0.10::DOUBLE * greatest(0, avg(expense_vs_rolling_mean_ratio) - 1)
  + 0.28::DOUBLE * avg(expense_to_income_ratio) + 0.20::DOUBLE * avg(expense_volatility_ratio)
  + 0.14::DOUBLE * avg(dominant_category_ratio) + 0.10::DOUBLE * avg(weekend_expense_ratio)
  + 0.18::DOUBLE * avg(zero_income_week)"""

_NORM = f"""CASE WHEN anomaly_score <= 0 THEN 0
  WHEN anomaly_score < {FIXED_THRESHOLD} THEN least(0.69, anomaly_score / {FIXED_THRESHOLD} * 0.69)
  WHEN anomaly_score >= {FIXED_SEVERE} THEN 1
  ELSE least(1, 0.70 + 0.30 * (anomaly_score - {FIXED_THRESHOLD}) / ({FIXED_SEVERE} - {FIXED_THRESHOLD})) END"""


def _text(x: str) -> str:
    """Plain digits, at least one decimal."""
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(38, 6)) AS VARCHAR), '(\\.\\d+?)0*$', '\\1')"


def _say(key: str, *args: str) -> str:
    return "printf('" + MESSAGES[key] + "', " + ", ".join(args) + ")"


_O = "CAST(o_orderkey AS BIGINT)"
RISK_ROWS = f"""signals AS (SELECT o_orderkey, o_orderkey % 3 AS cluster_id,
  o_orderkey * 7 % 101 / 100.0::DOUBLE AS p, o_orderkey * 11 % 101 / 100.0::DOUBLE AS a,
  CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey * 13 % 101 / 100.0::DOUBLE END AS f,
  round(o_totalprice / 1000, 6) AS score, o_totalprice / 1000 > 200.5 AS odd,
  o_totalprice / 1000 > 350.25 AS severe, o_totalprice AS predicted,
  CAST(o_orderkey % 4 * 1000 AS DOUBLE) AS budget, round(o_orderkey % 50 / 40.0::DOUBLE, 4) AS used,
  o_orderkey * 17 % 101 / 100.0::DOUBLE AS chance FROM orders),
fused AS (SELECT *, round((0.35::DOUBLE * p + 0.25::DOUBLE * a + 0.40::DOUBLE * f) * 100, 2) AS risk_score
 FROM signals),
levelled AS (SELECT *, CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 70 THEN 'MEDIUM'
  WHEN risk_score IS NOT NULL THEN 'HIGH' END AS risk_level FROM fused)"""


def _report(label_rules: str) -> str:
    """The whole report by fixed models; segments' clusters give the risk of a cluster.

    Scores often end between two rounded values, so they are rounded by their decimal digits.
    """
    pre, lin = FIXED_FORECAST.preprocess, FIXED_FORECAST.model
    terms = " + ".join(
        f"{w!r}::DOUBLE * (CASE WHEN has_snapshot THEN {c} ELSE {mid!r} END - {m!r}::DOUBLE) / {s!r}::DOUBLE"
        for c, w, mid, m, s in zip(pre.prep.columns, lin.coefficients, pre.medians, pre.prep.mean, pre.prep.scale, strict=True)
    )
    ok = "CASE WHEN has_snapshot THEN {} END".format
    return f"""WITH means AS (WITH {SCORES},
  g AS (SELECT cluster_label, {_AVGS}, {_RAW_RISK} AS r, count(*) AS cluster_size FROM scored GROUP BY cluster_label)
  SELECT cluster_label, r, {label_rules} AS profile_label FROM g),
ends AS (SELECT *, min(r) OVER () AS lo, max(r) OVER () AS hi, count(*) OVER () AS k FROM means),
risks AS (SELECT cluster_label, profile_label, CASE WHEN k = 1 THEN 0.5 ELSE 0.15 + 0.85 * (r - lo) / nullif(hi - lo, 0) END AS risk FROM ends),
{CUSTOMERS}, {WEEKLY},
last_week AS (SELECT * FROM weekly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "YearWeek" DESC) = 1),
seen AS (SELECT entity, "YearWeek", {_scaled(CUSTOMER_PREP)} FROM last_week),
near AS (SELECT *, {", ".join(f"{_dist(c)} AS d{i}" for i, c in enumerate(_C))} FROM seen),
labelled AS (SELECT entity, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS INTEGER) AS cluster_id FROM near),
odd AS (SELECT entity, "YearWeek", least(d0, d1, d2) AS anomaly_score FROM near),
signals AS (SELECT entity, "YearWeek" AS year_week, cluster_id, coalesce(profile_label, 'genel_davranis_profili') AS profile_label,
  coalesce(round(risk, 4), 0.5) AS profile_risk_norm,
  round(anomaly_score, 6) AS anomaly_score, anomaly_score > {FIXED_THRESHOLD} AS is_anomaly, anomaly_score > {FIXED_SEVERE} AS is_severe_anomaly,
  round({_NORM}, 4) AS anomaly_risk_norm FROM odd JOIN labelled USING (entity) LEFT JOIN risks ON cluster_id = cluster_label),
{monthly("least(15, last_day)")},
b AS (SELECT entity, "YearMonth" AS year_month, has_snapshot, CAST(snapshot_day AS INTEGER) AS effective_snapshot_day, total_expense_so_far AS spent,
  {lin.intercept!r}::DOUBLE + {terms} AS p, rolling_3m_expense_mean AS pace, greatest(coalesce(c_acctbal * 10, 0), 0) AS budget
 FROM months LEFT JOIN customer ON entity = c_custkey WHERE is_latest),
u AS (SELECT *, CASE WHEN budget >= 1 THEN p / budget ELSE 0 END AS used FROM b),
s AS (SELECT *, 1 / (1 + exp(-(used - 1) * 6)) AS chance FROM u),
money AS (SELECT entity, year_month, effective_snapshot_day, {ok("round(spent, 2)")} AS spent_so_far,
  {ok("round(p, 2)")} AS predicted_month_end_expense, round(budget, 2) AS budget,
  {ok("round(CASE WHEN budget >= 1 THEN budget - spent ELSE 0 END, 2)")} AS budget_remaining,
  {ok("round(used, 4)")} AS budget_usage_ratio,
  {ok("round(CASE WHEN budget >= 1 THEN greatest(0, p - budget) ELSE 0 END, 2)")} AS expected_overrun_amount,
  {ok("round(CASE WHEN budget >= 1 THEN chance ELSE 0 END, 4)")} AS budget_overrun_probability,
  {ok("round(CASE WHEN budget >= 1 THEN chance WHEN pace > 0 THEN least(1, greatest(0, p / pace)) ELSE 0.5 END, 4)")} AS forecast_risk_norm FROM s),
fused AS (SELECT *, CAST(round(CAST(CAST((0.35::DOUBLE * profile_risk_norm + 0.25::DOUBLE * anomaly_risk_norm
  + 0.40::DOUBLE * forecast_risk_norm) * 100 AS VARCHAR) AS DECIMAL(24, 18)), 2) AS DOUBLE) AS risk_score
 FROM signals JOIN money USING (entity))
SELECT *, CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 70 THEN 'MEDIUM' WHEN risk_score >= 70 THEN 'HIGH' END AS risk_level,
 CASE WHEN forecast_risk_norm IS NULL THEN NULL WHEN profile_risk_norm >= anomaly_risk_norm AND profile_risk_norm >= forecast_risk_norm THEN 'profile'
  WHEN anomaly_risk_norm >= forecast_risk_norm THEN 'anomaly' ELSE 'forecast' END AS dominant_driver,
 CASE WHEN forecast_risk_norm IS NULL THEN 'no snapshot in the latest month' ELSE 'ok' END AS status FROM fused"""


def all_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_ledger"] = f"""WITH {DIRTY_CLEAN} SELECT *, CASE WHEN {_ANY} THEN -"Amount" ELSE "Amount" END AS "Signed Amount" FROM clean"""
    q["true_income_split"] = f"""WITH {DIRTY_CLEAN} SELECT entity, "Category",
 round(coalesce(sum("Amount") FILTER ({_ANY}), 0), 2) AS total_expense,
 round(coalesce(sum("Amount") FILTER ({_INCOME}), 0), 2) AS true_income_amount,
 round(coalesce(sum("Amount") FILTER ("Transaction Type" = 'credit'), 0), 2) AS credit_amount,
 count(*) FILTER ({_INCOME}) AS income_rows FROM clean GROUP BY ALL"""
    d = "o_orderdate"
    q["calendar_columns"] = f"""SELECT o_orderkey, {d} AS "Date", CAST(year({d}) AS INTEGER) AS "Year",
 CAST(month({d}) AS INTEGER) AS "Month", CAST(day({d}) AS INTEGER) AS "Day", strftime({d}, '%Y-%m') AS "YearMonth",
 CAST(date_trunc('month', {d}) AS DATE) AS "MonthStartDate", CAST(isodow({d}) - 1 AS INTEGER) AS "DayOfWeek",
 CAST(isodow({d}) >= 6 AS INTEGER) AS "IsWeekend", strftime({d}, '%G-W%V') AS "YearWeek" FROM orders"""
    q["iso_week_key"] = """SELECT CAST(ts AS DATE) AS day, strftime(CAST(ts AS DATE), '%G-W%V') AS "YearWeek",
 isodow(CAST(ts AS DATE)) >= 6 AS weekend, count(*) AS n FROM events GROUP BY ALL"""
    q["weekly_base"] = f"WITH {WEEKS} SELECT {KEY}, {pick(BASE_COLUMNS)} FROM weekly"
    q["weekly_ratios"] = f"WITH {WEEKS} SELECT {KEY}, {pick(RATIO_COLUMNS)} FROM weekly"
    q["weekly_single_ledger"] = f"""WITH {order_raw("1")}, {CLEAN}, {WEEKLY} SELECT "YearWeek", {pick(PROFILE)} FROM weekly"""
    q["weekly_events_by_user"] = f"WITH {EVENT_WEEKS} SELECT {KEY}, {pick(PROFILE)} FROM weekly"
    q["weekly_anomaly_variant"] = f"""WITH {WEEKS} SELECT {KEY}, {pick(weekly_columns("anomaly"))} FROM weekly"""
    q["weekly_category_long"] = f"""WITH {WEEKS} SELECT {KEY}, category, round(amount, 2) AS amount,
 {rnd("ratio")} AS ratio FROM long"""
    q["weekly_category_pivot"] = f"WITH {WEEKS} SELECT {KEY}, {_PIVOT} FROM long GROUP BY ALL"
    q["weekly_concentration"] = f"WITH {WEEKS} SELECT {KEY}, {pick(CONCENTRATION_COLUMNS)} FROM weekly"
    q["weekly_rolling"] = f"WITH {WEEKS} SELECT {KEY}, {pick(ROLLING_COLUMNS)} FROM weekly"

    q["outlier_weeks_kept"] = f"""WITH {WEEKS}, {robust(True)}, {votes(3.5)}
 SELECT w.entity, w."YearWeek", round(total_expense, 2) AS total_expense, round(total_income, 2) AS total_income
 FROM weekly w JOIN votes v ON w.entity = v.entity AND w."YearWeek" = v."YearWeek" WHERE outlier_feature_count < 3"""
    q["outlier_weeks_removed"] = f"""WITH {WEEKS}, {robust(True)}, {votes(2.5)}
 SELECT * FROM votes WHERE outlier_feature_count >= 2"""
    q["outlier_weeks_pooled"] = f"""WITH {WEEKS}, {robust(False)}, {votes(2.5)}
 SELECT * FROM votes WHERE outlier_feature_count >= 2"""
    q["robust_stats"] = f"""WITH {WEEKS}, {robust(True)} SELECT entity, feature,
 {rnd("any_value(med)", 4)} AS med, {rnd("any_value(mad)", 4)} AS mad FROM spread GROUP BY entity, feature"""
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, {rnd(f'avg({c})')} AS mean, "
        f"{rnd(f'var_pop({c})')} AS variance, var_pop({c}) > 0.01 AS selected FROM weekly"
        for c in STAT_COLUMNS
    )
    q["feature_variance"] = f"WITH {WEEKS} {stats}"

    q["assign_fixed_centroids"] = f"WITH {SCORES} SELECT {KEY}, cluster_label FROM scored"
    q["anomaly_scores"] = f"WITH {SCORES} SELECT {KEY}, {rnd('anomaly_score')} AS anomaly_score FROM scored"
    q["anomaly_thresholds"] = f"""WITH {SCORES} SELECT
 {rnd("quantile_cont(anomaly_score, 0.95)")} AS anomaly_score_threshold,
 {rnd("quantile_cont(anomaly_score, 0.99)")} AS severe_anomaly_score_threshold FROM scored"""
    flags = f"anomaly_score > {FIXED_THRESHOLD} AS is_anomaly, anomaly_score > {FIXED_SEVERE} AS is_severe_anomaly"
    q["anomaly_flags"] = f"WITH {SCORES} SELECT {KEY}, {flags} FROM scored"
    q["anomaly_score_stats"] = f"""WITH {SCORES} SELECT {rnd("min(anomaly_score)")} AS score_min,
 {rnd("avg(anomaly_score)")} AS score_mean, {rnd("max(anomaly_score)")} AS score_max,
 count(*) FILTER (anomaly_score > {FIXED_THRESHOLD}) AS anomaly_count,
 count(*) FILTER (anomaly_score > {FIXED_SEVERE}) AS severe_anomaly_count,
 {rnd("median(anomaly_score)")} AS score_median FROM scored"""
    q["top_contributions"] = f"""WITH {SCORES}, parts AS ({_PARTS}),
 placed AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY dev DESC, feature) - 1 AS p FROM parts)
 SELECT {KEY}, CAST(p AS INTEGER) AS pos, feature, {rnd("dev")} AS absolute_deviation,
 {rnd("x")} AS sample_value_scaled, {rnd("c")} AS centroid_value_scaled FROM placed WHERE p < 3"""
    q["top_anomalies"] = f"""WITH {SCORES} SELECT {KEY}, {rnd('anomaly_score')} AS anomaly_score FROM scored
 ORDER BY scored.anomaly_score DESC, {KEY} LIMIT 10"""

    q["cluster_sizes"] = f"WITH {SCORES} SELECT cluster_label, count(*) AS cluster_size FROM scored GROUP BY ALL"
    share = _LABEL_RULES.replace("cluster_size / 40", "cluster_size / sum(cluster_size) OVER ()")
    q["cluster_summary"] = f"""WITH {SCORES},
g AS (SELECT cluster_label, {_AVGS}, {_MEDS}, count(*) AS cluster_size FROM scored GROUP BY cluster_label)
SELECT cluster_label, {_SUMMARY}, cluster_size, {share} AS profile_label FROM g"""
    q["cluster_quality"] = f"""WITH {SCORES},
pts AS MATERIALIZED (SELECT row_number() OVER () AS id, cluster_label AS g, {", ".join(f"f{i}" for i in range(_DIM))} FROM scored),
gaps AS (SELECT a.id, a.g, b.g AS other, sum(sqrt({_SUM_SQ})) AS d, count(*) AS n FROM pts a, pts b GROUP BY ALL),
ab AS (SELECT id, max(d / nullif(n - 1, 0)) FILTER (g = other) AS a, min(d / n) FILTER (g <> other) AS b
 FROM gaps GROUP BY id),
sil AS (SELECT avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)) AS v, count(*) AS n FROM ab),
mid AS (SELECT g, {_MEANS}, count(*) AS n FROM pts GROUP BY g),
sc AS (SELECT mid.g, avg(sqrt({_TO_MEAN})) AS s FROM pts JOIN mid ON pts.g = mid.g GROUP BY mid.g),
pairs AS (SELECT a.g, max((x.s + y.s) / sqrt({_MEAN_GAP})) AS v FROM mid a JOIN mid b ON a.g <> b.g
 JOIN sc x ON x.g = a.g JOIN sc y ON y.g = b.g GROUP BY a.g),
db AS (SELECT avg(v) AS v FROM pairs),
bal AS (SELECT CAST(count(*) AS INTEGER) AS k, CAST(sum(n) AS BIGINT) AS n_rows, min(n) / sum(n) AS frac,
 greatest(0, 1 - sum(abs(n / (SELECT sum(n) FROM mid) - 1.0::DOUBLE / (SELECT count(*) FROM mid)))) AS b FROM mid)
SELECT k, n_rows, {rnd("sil.v")} AS silhouette, sil.n AS silhouette_rows, {rnd("db.v")} AS davies_bouldin,
 {rnd("b")} AS balance_score, {rnd("frac")} AS min_cluster_fraction,
 {rnd("0.40::DOUBLE * sil.v + 0.30::DOUBLE * b + 0.20::DOUBLE * frac - 0.10::DOUBLE * db.v - CASE WHEN frac < 0.05 THEN 0.25 ELSE 0 END")} AS composite_score
FROM sil, db, bal"""
    one_pair = """sum(sqrt({s})) AS e, sum({s}) AS s, count(*) AS n""".format(s=_SUM_SQ)
    q["silhouette_nations"] = f"""WITH {NATIONS},
pts AS MATERIALIZED (SELECT row_number() OVER () AS id, cluster_label AS g, {", ".join(f"f{i}" for i in range(_DIM))} FROM scored),
gaps AS (SELECT a.id, a.g, b.g AS other, {one_pair} FROM pts a, pts b GROUP BY ALL),
long_gaps AS (UNPIVOT gaps ON e, s INTO NAME measure VALUE d),
ab AS (SELECT measure, id, max(d / nullif(n - 1, 0)) FILTER (g = other) AS a, min(d / n) FILTER (g <> other) AS b
 FROM long_gaps GROUP BY measure, id)
SELECT CASE measure WHEN 'e' THEN 'euclidean' ELSE 'squared' END AS measure,
 {rnd("avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0))")} AS silhouette, count(*) AS silhouette_rows FROM ab GROUP BY measure"""
    q["kmeans_restarts"] = fit_oracles.given_starts_sql(SCORES, _DIM, GIVEN_STARTS, GIVEN_MOVES, GIVEN_LIMIT, rnd)
    q["kmeans_anomaly"] = fit_oracles.anomaly_sql(WEEKS, rnd)
    q["category_feature_stats"] = fit_oracles.category_stats_sql(WEEKS, rnd)
    every = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in PROFILE)
    q["numeric_feature_stats"] = f"""WITH {WEEKS},
cells AS (UNPIVOT (SELECT {every} FROM weekly) ON {", ".join(f'"{c}"' for c in PROFILE)} INTO NAME feature VALUE x)
SELECT feature, count(x) AS n, {rnd("avg(x)", 4)} AS mean, {rnd("stddev_pop(x)", 4)} AS deviation FROM cells GROUP BY feature"""
    q["profiler_evaluation"] = fit_oracles.evaluation_sql(WEEKS, robust(True), votes(3.5), rnd)
    q["kmeans_profiler"] = fit_oracles.profiler_sql(WEEKS, robust(True), votes(3.5), rnd, _LABEL_RULES)
    q["profile_labels"] = f"""WITH {EVENT_WEEKS},
g AS (SELECT entity, count(*) AS cluster_size, {_AVGS} FROM weekly GROUP BY entity)
SELECT entity, {_LABEL_RULES} AS profile_label FROM g"""

    q["monthly_base"] = f"""WITH {ORDERS}, {monthly("15")} SELECT entity, "YearMonth", {pick(MONTH_COLUMNS)} FROM months"""
    q["monthly_base_dirty"] = f"""WITH {DIRTY_CLEAN}, {monthly("15")} SELECT entity, "YearMonth", {pick(MONTH_COLUMNS)} FROM months"""
    snap = pick(("MonthStartDate", *FEATURE_COLUMNS, TARGET))
    q["month_snapshot"] = f"""WITH {ORDERS}, {monthly("15")} SELECT entity, "YearMonth", {snap} FROM months WHERE has_snapshot"""
    q["forecast_dataset"] = f"""WITH {DIRTY_CLEAN}, {monthly("10")} SELECT entity, "YearMonth", {snap}
 FROM months WHERE has_snapshot AND total_transactions >= 60"""
    q["latest_month_snapshot"] = f"""WITH {CUSTOMERS}, {monthly("least(15, last_day)")}
 SELECT entity, "YearMonth", "MonthStartDate", snapshot_day, has_snapshot, {_LATEST_COLS} FROM months WHERE is_latest"""
    q["time_split"] = f"""WITH {SPLIT} SELECT entity, "YearMonth", position, split FROM placed"""
    q["cv_folds"] = f"""WITH {SPLIT}, train AS (SELECT *, (SELECT count(DISTINCT position) FROM placed WHERE split = 'train') AS m
 FROM placed WHERE split = 'train'),
cut AS (SELECT *, CAST(i + 1 AS INTEGER) AS fold, m - (3 - i) * (m // 4) AS s, m // 4 AS t FROM train, range(3) r(i))
SELECT entity, "YearMonth", fold, CASE WHEN position < s THEN 'fit' ELSE 'score' END AS role
FROM cut WHERE position < s + t"""
    q["baseline_metrics"] = f"""WITH {SPLIT},
m AS (SELECT avg({TARGET}) FILTER (split = 'train') AS v, avg({TARGET}) FILTER (split <> 'test') AS t FROM placed)
SELECT 'baseline_mean' AS model, split, {_metrics(TARGET, "v")} FROM placed, m WHERE split = 'valid' GROUP BY split
UNION ALL BY NAME
SELECT 'baseline_mean' AS model, split, {_metrics(TARGET, "t")} FROM placed, m WHERE split = 'test' GROUP BY split"""
    q["metrics_sink"] = q["baseline_metrics"]
    means = q["baseline_metrics"].split(f"WITH {SPLIT},\nm AS ")[1]
    q["forecast_small"] = fit_oracles.forecast_sql(
        SPLIT, TARGET, f"WITH m AS {means}", SMALL_FEATURES, FIT_FORECAST.ridge_alpha, FIT_FORECAST.elastic_alpha,
        FIT_FORECAST.elastic_l1_ratio, rnd,
    )
    q["regression_metrics"] = f"""WITH {ORDERS}, {monthly("15")},
p AS (SELECT {TARGET}, {_NAIVE} AS pred FROM months WHERE has_snapshot AND total_transactions >= 5)
SELECT {_metrics(TARGET, "pred")} FROM p"""

    q["cluster_risk_map"] = f"""WITH {SCORES},
raws AS (SELECT cluster_label, {_RAW_RISK} AS r FROM scored GROUP BY cluster_label),
ends AS (SELECT *, min(r) OVER () AS lo, max(r) OVER () AS hi, count(*) OVER () AS k FROM raws)
SELECT cluster_label, 'genel_davranis_profili' AS profile_label,
 {rnd("CASE WHEN k = 1 THEN 0.5 ELSE 0.15 + 0.85 * (r - lo) / nullif(hi - lo, 0) END")} AS cluster_risk FROM ends"""
    q["anomaly_norm"] = f"WITH {SCORES} SELECT {KEY}, {rnd(_NORM)} AS anomaly_risk_norm FROM scored"
    q["budget_risk"] = f"""WITH {CUSTOMERS}, {monthly("least(15, last_day)")},
b AS (SELECT entity, "YearMonth", has_snapshot, {_NAIVE} AS p, total_expense_so_far AS spent, rolling_3m_expense_mean AS pace,
 greatest(coalesce(c_acctbal * 10, 0), 0) AS budget
 FROM months LEFT JOIN customer ON entity = c_custkey WHERE is_latest),
u AS (SELECT *, CASE WHEN budget >= 1 THEN p / budget ELSE 0 END AS used FROM b),
s AS (SELECT *, 1 / (1 + exp(-(used - 1) * 6)) AS chance FROM u)
SELECT entity, "YearMonth", CASE WHEN has_snapshot THEN 'ok' ELSE 'no snapshot in the latest month' END AS status,
 CASE WHEN has_snapshot THEN round(budget, 2) END AS budget, CASE WHEN has_snapshot THEN {rnd("used", 4)} END AS budget_usage_ratio,
 CASE WHEN has_snapshot THEN round(CASE WHEN budget >= 1 THEN budget - spent ELSE 0 END, 2) END AS budget_remaining,
 CASE WHEN has_snapshot THEN {rnd("CASE WHEN budget >= 1 THEN greatest(0, p - budget) ELSE 0 END", 4)} END AS expected_overrun_amount,
 CASE WHEN has_snapshot THEN {rnd("CASE WHEN budget >= 1 THEN chance ELSE 0 END")} END AS budget_overrun_probability,
 CASE WHEN has_snapshot THEN {rnd("CASE WHEN budget >= 1 THEN chance WHEN pace > 0 THEN least(1, greatest(0, p / pace)) ELSE 0.5 END")} END AS forecast_risk
FROM s"""
    q["risk_report_fixed"] = _report(share)
    q["latest_week"] = f"""WITH {EVENT_WEEKS} SELECT {KEY}, {pick(("total_expense", "rolling_4w_expense_mean"))}
 FROM weekly QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "YearWeek" DESC) = 1"""
    week_line = (
        f"CASE WHEN severe THEN {_say('severe', _text('score'), _text('350.25'))}"
        f" WHEN odd THEN {_say('anomaly', _text('score'), _text('200.5'))} ELSE {_say('calm', _text('a'))} END"
    )
    money_line = (
        f"CASE WHEN budget > 0 THEN {_say('budget', _text('predicted'), _text('used'), _text('chance'))}"
        f" ELSE {_say('no_budget', _text('predicted'))} END"
    )
    known = "CASE WHEN f IS NOT NULL THEN {} END".format
    profile_line = _say("profile", "'genel_davranis_profili'", "CAST(cluster_id AS VARCHAR)", _text("p"))
    q["risk_fusion"] = f"""WITH {RISK_ROWS} SELECT o_orderkey, risk_score, risk_level,
 {known("CASE WHEN p >= a AND p >= f THEN 'profile' WHEN a >= f THEN 'anomaly' ELSE 'forecast' END")} AS dominant_driver,
 CASE WHEN f IS NOT NULL THEN 'ok' ELSE 'no snapshot in the latest month' END AS status,
 {known(profile_line)} AS line_1, {known(week_line)} AS line_2, {known(money_line)} AS line_3,
 {known(_say("level", "risk_level"))} AS line_4 FROM levelled"""

    def severity(x: str, low: str, high: str) -> str:
        return f"CASE WHEN {x} > {high} THEN 'severe_anomaly' WHEN {x} > {low} THEN 'anomaly' ELSE 'normal' END"

    def level(x: str, low: str, high: str) -> str:
        return f"CASE WHEN {x} < {low} THEN 'LOW' WHEN {x} < {high} THEN 'MEDIUM' ELSE 'HIGH' END"

    t, s = str(FIXED_THRESHOLD), str(FIXED_SEVERE)
    q["severity_labels"] = f"""WITH {SCORES} SELECT {KEY}, {severity("anomaly_score", t, s)} AS severity,
 {severity("anomaly_score", t, t)} AS severity_without_severe, {severity("anomaly_score", "0", "0")} AS severity_default
 FROM scored"""
    q["risk_levels"] = f"""SELECT o_orderkey, {level("o_orderkey % 101", "40", "70")} AS risk_level,
 {level("o_orderkey % 101", "25", "75")} AS risk_level_custom FROM orders"""
    when = lambda m: " ".join(f"WHEN {k} THEN '{v}'" for k, v in m.items())
    q["label_lookup"] = f"""WITH {SCORES} SELECT {KEY},
 CASE cluster_label {when(LABELS)} ELSE 'unknown_profile' END AS label,
 CASE cluster_label {when(DESCRIPTIONS)} ELSE 'No description available.' END AS description FROM scored"""
    q["registry_thresholds"] = f"""WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS lo,
 max(o_totalprice) * 0.9::DOUBLE AS hi FROM orders GROUP BY ALL)
SELECT o_orderkey, {severity("o_totalprice", "lo", "hi")} AS severity, {level("o_totalprice", "lo", "hi")} AS risk_level
FROM orders JOIN m USING (o_orderpriority)"""
    q["registry_scores"] = f"""WITH {SCORES},
cuts AS (SELECT round(avg(anomaly_score), 6) AS low, round(max(anomaly_score) * (0.8)::DOUBLE, 6) AS high FROM scored),
named AS (SELECT {KEY}, anomaly_score, CAST("YearWeek"[7:8] AS INTEGER) % 2 = 0 AS own, low, high FROM scored, cuts)
SELECT {KEY}, CASE WHEN own THEN 'anomaly' ELSE 'risk' END AS name,
 CASE WHEN own THEN {severity("anomaly_score", "low", "high")} ELSE {severity("anomaly_score", "0", "0")} END AS severity,
 CASE WHEN NOT own THEN 'thresholds' END AS missing FROM named"""
    q["feature_frame"] = """SELECT c_custkey, nullif(c_acctbal, 0) AS c_acctbal, -1.0::DOUBLE AS absent, c_nationkey FROM customer"""
    q["payload_violations"] = """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(event_type))) AS k
 FROM events GROUP BY ALL),
v AS (SELECT user_id, day,
  array_to_string(list_filter(['click', 'view'], lambda x: NOT list_contains(k, x)), ',') AS missing_features,
  array_to_string(list_filter(k, lambda x: x NOT IN ('click', 'view', 'error')), ',') AS extra_fields FROM p)
SELECT *, missing_features = '' AND extra_fields = '' AS is_valid FROM v"""
    scaled = " UNION ALL ".join(
        f"SELECT {KEY}, '{c}' AS feature, {rnd(f'({c} - m) / s')} AS value FROM (SELECT {KEY}, {c}, "
        f"avg({c}) OVER () AS m, stddev_pop({c}) OVER () AS s FROM weekly) WHERE s * s > 0.01"
        for c in STAT_COLUMNS
    )
    q["scaled_features"] = f"WITH {WEEKS} {scaled}"
    return q
