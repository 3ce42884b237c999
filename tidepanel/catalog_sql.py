"""SQL counterparts of the registered queries, for checking them with DuckDB."""

from __future__ import annotations


def rounded(expression: str, name: str) -> str:
    """Six places, and never a negative zero."""
    return f"round({expression}, 6) + 0.0::DOUBLE AS {name}"


def _panel(group: str) -> str:
    def percent(condition: str) -> str:
        return f"100.0::DOUBLE * count(*) FILTER (WHERE {condition}) / count(*)"

    return f"""
panel AS (
  SELECT {group} AS grp, date_trunc('month', l_shipdate)::DATE AS date,
         {percent("l_returnflag = 'R'")} AS y,
         count(*) AS headcount,
         count(DISTINCT l_orderkey) AS admissions,
         {percent("l_returnflag = 'R' AND l_linestatus = 'O'")} AS vol,
         {percent("l_returnflag = 'R' AND l_linestatus = 'F'")} AS invol
  FROM lineitem GROUP BY 1, 2)"""


SUPPLIER = _panel("l_suppkey")
PART = _panel("l_partkey")
NATION = """
panel AS (
  SELECT n_name AS grp, date_trunc('month', o_orderdate)::DATE AS date,
         100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS y,
         count(DISTINCT o_custkey) AS headcount,
         count(*) AS admissions
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

_ROUNDED_NAMES = ("y", "vol", "invol", "actual", "naive", "lag_1")


def _with(ctes: str, body: str, **names: str) -> str:
    names = {n: rounded(n, n) for n in _ROUNDED_NAMES} | names
    for name, text in names.items():
        body = body.replace("{" + name + "}", text)
    return f"WITH {ctes.strip()}\n{body}"


def select(panel: str, body: str) -> str:
    return _with(panel, body)


# --- features ---------------------------------------------------------------


def _lags(column: str, distances, stem: str) -> dict[str, str]:
    return {f"{stem}_{k}": f"lag({column}, {k}) OVER w" for k in distances}


def _rolling(column: str) -> dict[str, str]:
    def guarded(function: str, rows: int) -> str:
        frame = f"OVER (w ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
        return f"CASE WHEN count({column}) {frame} = {rows} THEN {function}({column}) {frame} END"

    return {
        "rolling_mean_3": guarded("avg", 3),
        "rolling_mean_6": guarded("avg", 6),
        "rolling_std_6": guarded("stddev_samp", 6),
    }


def features(body: str, n_lags: int = 12, panel: str = SUPPLIER, components=("vol", "invol")) -> str:
    """Tables past (all rows), kept (complete rows) and sided (kept with its split)."""
    lags = _lags("y", range(1, n_lags + 1), "lag")
    exogenous = _lags("admissions", (1, 3, 6), "admissions_lag") | _lags("headcount", (1, 3, 6), "headcount_lag")
    parts = {}
    for c in components:
        parts |= _lags(c, (1, 3), f"{c}_lag")
    rolling = _rolling("y")
    new = lags | exogenous | parts | rolling
    calendar = {
        "month": "month(date)::INTEGER",
        "quarter": "quarter(date)::INTEGER",
        "is_december": "(month(date) = 12)::INTEGER",
    }
    columns = ",\n         ".join(f"{e} AS {n}" for n, e in (calendar | new).items())
    complete = " AND ".join(f"{n} IS NOT NULL" for n in new)
    ctes = f"""{panel.strip()},
past AS (
  SELECT *, {columns}
  FROM panel WINDOW w AS (PARTITION BY grp ORDER BY date)),
kept AS (SELECT * FROM past WHERE {complete}),
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT date FROM kept)),
point AS (SELECT date AS split_date FROM dates WHERE i = floor(n * 0.8::DOUBLE)),
sided AS (SELECT kept.*, CASE WHEN date < split_date THEN 'train' ELSE 'test' END AS split
          FROM kept, point)"""

    def listing(names) -> str:
        whole = ("headcount", "admissions")
        return ", ".join(n if n.startswith(whole) or n in calendar else rounded(n, n) for n in names)

    frame = "grp, date, " + listing(["y", "headcount", "admissions", *components, *calendar, *new])
    return _with(
        ctes,
        body,
        lags=listing(lags),
        exogenous=listing(exogenous),
        components=listing(parts),
        rolling=listing(rolling),
        frame=frame,
    )


def _numeric_features(n_lags: int = 12) -> list[str]:
    return [
        "month",
        "quarter",
        *[f"lag_{k}" for k in range(1, n_lags + 1)],
        *[f"{m}_lag_{k}" for m in ("admissions", "headcount") for k in (1, 3, 6)],
        *[f"{m}_lag_{k}" for m in ("vol", "invol") for k in (1, 3)],
        "rolling_mean_3",
        "rolling_mean_6",
        "rolling_std_6",
    ]


_ALL_FEATURES = [*_numeric_features(), "grp_encoded", "is_december"]

SCALER_STATS = features(
    "\nUNION ALL\n".join(
        f"SELECT {i}::INTEGER AS position, '{f}' AS feature, {rounded(f'avg({f})', 'mean')}, "
        f"{rounded(f'stddev_pop({f})', 'std')}, "
        f"{rounded(f'CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END', 'scale')} "
        "FROM sided WHERE split = 'train'"
        for i, f in enumerate(_numeric_features())
    )
)


def _scaled(name: str) -> str:
    return rounded(f"(sided.{name} - fit.m_{name}) / CASE WHEN fit.s_{name} = 0 THEN 1 ELSE fit.s_{name} END", name)


SCALED_FEATURES = features(
    "SELECT sided.grp, date, split, "
    + ", ".join(_scaled(f) for f in _numeric_features())
    + ", code AS grp_encoded, is_december FROM sided JOIN (SELECT DISTINCT grp, "
    "(dense_rank() OVER (ORDER BY grp::VARCHAR) - 1)::INTEGER AS code FROM kept) codes ON sided.grp = codes.grp, (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _numeric_features())
    + " FROM sided WHERE split = 'train') fit"
)

APPLIED_FEATURES = features(
    "SELECT sided.grp, date, {y}, headcount::DOUBLE AS weight, round(lag_1, 6) + 0.0::DOUBLE AS naive, "
    + ", ".join(_scaled(f) for f in _numeric_features())
    + ", coalesce(code, -1)::INTEGER AS grp_encoded, is_december FROM sided LEFT JOIN (SELECT grp, "
    "(dense_rank() OVER (ORDER BY grp::VARCHAR) - 1)::INTEGER AS code FROM "
    "(SELECT DISTINCT grp FROM sided WHERE split = 'train')) codes ON sided.grp = codes.grp, (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _numeric_features())
    + " FROM sided WHERE split = 'train') fit WHERE split = 'test'"
)

# The names are those of the frame's columns, in their order: measured ones before the label code and the flag.
FEATURE_ORDER = features(
    "SELECT (row_number() OVER (ORDER BY feature IN ('grp_encoded', 'is_december'), feature = 'is_december', place) - 1)::INTEGER"
    " AS position, feature FROM (SELECT feature, row_number() OVER () AS place FROM (UNPIVOT ("
    "SELECT COLUMNS(* EXCLUDE (grp, date, y, headcount, admissions, vol, invol, split))::DOUBLE, 0.0::DOUBLE AS grp_encoded "
    "FROM (SELECT * FROM sided ORDER BY grp, date LIMIT 1)) ON COLUMNS(*) INTO NAME feature VALUE v))"
)

SPLIT_SUMMARY = features(
    "SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, "
    f"max(date) AS last_date, {rounded('avg(y)', 'mean_target')} FROM sided GROUP BY split"
)

_EVENT_COLUMNS = _lags("value", range(1, 7), "lag") | _rolling("value")
LONG_GROUP_FEATURES = (
    "SELECT event_type, event_id, "
    + rounded("value", "value")
    + ", "
    + ", ".join(rounded(e, n) for n, e in _EVENT_COLUMNS.items())
    + " FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"
)

# --- scalar work ------------------------------------------------------------

PANEL_DUPLICATES = """
SELECT l_suppkey AS grp, date_trunc('month', l_shipdate)::DATE AS date, count(*) AS n_rows
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""

CALENDAR_FEATURES = """
SELECT o_orderdate::DATE AS date, count(*) AS n_orders, month(o_orderdate::DATE)::INTEGER AS month,
       quarter(o_orderdate::DATE)::INTEGER AS quarter, (month(o_orderdate::DATE) = 12)::INTEGER AS is_december,
       strftime(o_orderdate::DATE, '%b') AS month_name
FROM orders GROUP BY o_orderdate::DATE"""

COERCE_TARGET = r"""
WITH texts AS (
  SELECT event_id, user_id, trim(CASE
           WHEN event_type = 'error' THEN props
           WHEN user_id % 5 = 0 THEN ' ' || regexp_replace(props, '[^0-9]', '', 'g') || '.5 '
           WHEN user_id % 5 = 1 THEN '-' || regexp_replace(props, '[^0-9]', '', 'g') || 'e-1'
           WHEN user_id % 5 = 2 THEN regexp_replace(props, '[^0-9]', '', 'g') || ',5'
           ELSE regexp_replace(props, '[^0-9]', '', 'g') END) AS text
  FROM events)
SELECT event_id, user_id::VARCHAR AS user_key,
       round(coalesce(CASE WHEN regexp_matches(text, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')
                           THEN try_cast(text AS DOUBLE) END, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS y
FROM texts"""

LOG_ROUNDTRIP = select(
    SUPPLIER,
    "SELECT grp, date, "
    + ", ".join(
        [
            rounded("ln(1 + y)", "y_log"),
            rounded("y", "y_back"),
            rounded("greatest(exp(ln(1 + y) - 2) - 1, 0)", "y_clamped"),
            rounded("abs(y - 20)", "y_abs"),
            rounded("(y - 20) * (y - 20)", "y_square"),
            rounded("sqrt(y)", "y_sqrt"),
        ]
    )
    + " FROM panel",
)

# --- scores -----------------------------------------------------------------

_LAGGED = f"""{SUPPLIER.strip()},
lagged AS (
  SELECT grp, date, y AS actual, headcount::DOUBLE AS headcount, lag(y) OVER w AS naive,
         CASE WHEN count(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
              THEN avg(y) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS smooth
  FROM panel WINDOW w AS (PARTITION BY grp ORDER BY date))"""
_COMMON = _LAGGED + """,
scored AS (SELECT * FROM lagged WHERE naive IS NOT NULL AND smooth IS NOT NULL)"""
_NAIVE = _LAGGED + """,
scored AS (SELECT * FROM lagged WHERE naive IS NOT NULL)"""


def common(body: str) -> str:
    """Table ``scored``: the rows with both forecasts."""
    return _with(_COMMON, body)


def naive(body: str) -> str:
    """Table ``scored``: the rows with a lag-1 forecast; ``lagged``: all rows."""
    return _with(_NAIVE, body)


def metrics(predicted: str) -> str:
    error = f"(actual - {predicted})"
    return ", ".join(
        [
            "count(*) AS n",
            rounded(f"avg(abs({error}))", "mae"),
            rounded(f"sqrt(avg({error} * {error}))", "rmse"),
            rounded(f"1 - sum({error} * {error}) / (var_pop(actual) * count(*))", "r2"),
        ]
    )


METRICS_BY_MODEL = common(
    "SELECT model, "
    + metrics("predicted")
    + """ FROM (
  SELECT actual, unnest(['naive', 'smooth', 'mean_forecast']) AS model,
         unnest([naive, smooth, avg(actual) OVER ()]) AS predicted
  FROM scored) GROUP BY model"""
)

DM_TEST = common("""
SELECT pair, round(stat, 6) + 0.0::DOUBLE AS dm_stat, abs(stat) > 1.96::DOUBLE AS dm_significant
FROM (
  SELECT pair, CASE WHEN var_pop(d) = 0 THEN 0.0::DOUBLE ELSE avg(d) / sqrt(var_pop(d) / count(*)) END AS stat
  FROM (
    SELECT unnest(['naive vs mean_forecast', 'smooth vs mean_forecast', 'naive vs naive']) AS pair,
           unnest([(actual - naive) ** 2 - (actual - mean_forecast) ** 2,
                   (actual - smooth) ** 2 - (actual - mean_forecast) ** 2,
                   0.0::DOUBLE]) AS d
    FROM (SELECT *, avg(actual) OVER () AS mean_forecast FROM scored))
  GROUP BY pair)""")


def acf(keys: tuple[str, ...], max_lag: int = 20) -> str:
    """Residuals of the lag-1 forecast; one series over (grp, date), or one per key."""
    within = f"PARTITION BY {', '.join(keys)}" if keys else ""
    by = "".join(f"{k}, " for k in keys)
    order = "date" if keys else "grp, date"
    ctes = f"""{_NAIVE},
centred AS (
  SELECT grp, date, actual - naive - avg(actual - naive) OVER ({within}) AS e,
         count(*) OVER ({within}) AS n, row_number() OVER ({within} ORDER BY {order}) AS i
  FROM scored),
pairs AS (
  SELECT {"a.grp, " if keys else ""}b.i - a.i AS lag, any_value(a.n) AS n, sum(a.e * b.e) AS c
  FROM centred a JOIN centred b ON {"a.grp = b.grp AND " if keys else ""}b.i BETWEEN a.i AND a.i + {max_lag}
  GROUP BY ALL),
correlated AS (
  SELECT {by}lag, n, c / nullif(max(CASE WHEN lag = 0 THEN c END) OVER ({within}), 0) AS acf FROM pairs),
banded AS (
  SELECT {by}lag, acf, CASE WHEN lag = 0 THEN 0.0::DOUBLE ELSE 1.959964::DOUBLE * sqrt((1 + 2 * coalesce(
           sum(CASE WHEN lag > 0 THEN acf * acf END) OVER ({within} ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS margin
  FROM correlated)"""
    return _with(
        ctes,
        f"SELECT {by}lag::INTEGER AS lag, {rounded('acf', 'acf')}, {rounded('-margin', 'lower')}, "
        f"{rounded('margin', 'upper')} FROM banded",
    )


CLASSIFICATION_METRICS = f"""
WITH counts AS (
  SELECT count(*) AS n,
         count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 26) AS tp,
         count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity >= 26) AS fp,
         count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity < 26) AS fn,
         count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity < 26) AS tn
  FROM lineitem)
SELECT n, {rounded("(tp + tn)::DOUBLE / n", "accuracy")},
       {rounded("coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)", "precision")},
       {rounded("coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)", "recall")},
       {rounded("coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)", "f1")}
FROM counts"""


def _auc(name: str, score: str) -> str:
    return f"""
SELECT '{name}' AS score, round(
         (sum(CASE WHEN label = 1 THEN mid_rank END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
         / (sum(label)::DOUBLE * sum(1 - label)), 6) AS roc_auc
FROM (SELECT (l_returnflag = 'R')::INTEGER AS label,
             rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS mid_rank
      FROM lineitem)"""


ROC_AUC = _auc("price", "l_extendedprice") + "\nUNION ALL" + _auc("quantity", "l_quantity")

# --- series -----------------------------------------------------------------

GLOBAL_MEAN_SERIES = select(
    SUPPLIER, f"SELECT date, {rounded('avg(y)', 'value')} FROM panel GROUP BY date"
)


def _regular(keys: tuple[str, ...]) -> str:
    by = "".join(f"{k}, " for k in keys)
    within = f"PARTITION BY {', '.join(keys)} " if keys else ""
    using = ", ".join([*keys, "date"])
    grouping = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
series AS (SELECT {by}date, avg(y) AS value FROM panel GROUP BY {using}),
spine AS (SELECT {by}unnest(generate_series(first, last, INTERVAL 1 MONTH))::DATE AS date
          FROM (SELECT {by}min(date) AS first, max(date) AS last FROM series {grouping})),
regular AS (SELECT {by}date, last_value(value IGNORE NULLS) OVER (
              {within}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
            FROM spine LEFT JOIN series USING ({using}))"""


REGULARISED_SERIES = select(
    SUPPLIER + "," + _regular(("grp",)), f"SELECT grp, date, {rounded('value', 'value')} FROM regular"
)


def decomposition(keys: tuple[str, ...]) -> str:
    by = "".join(f"{k}, " for k in keys)
    within = f"PARTITION BY {', '.join(keys)}" if keys else ""
    ctes = f"""{SUPPLIER.strip()},{_regular(keys)},
numbered AS (
  SELECT *, row_number() OVER ({within} ORDER BY date) - 1 AS i, count(*) OVER ({within}) AS n FROM regular),
trended AS (
  SELECT *, CASE WHEN count(value) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
            THEN (sum(value) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
                  + sum(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) / 24 END AS trend
  FROM numbered WHERE n >= 24 WINDOW w AS ({within} ORDER BY date)),
phases AS (SELECT {by}i % 12 AS phase, avg(value - trend) AS m FROM trended GROUP BY ALL),
seasons AS (SELECT {by}phase, m - avg(m) OVER ({within}) AS seasonal FROM phases)"""
    match = " AND ".join([*[f"t.{k} = s.{k}" for k in keys], "t.i % 12 = s.phase"])
    return _with(
        ctes,
        "SELECT "
        + "".join(f"t.{k}, " for k in keys)
        + f"date, {rounded('value', 'observed')}, {rounded('trend', 'trend')}, {rounded('seasonal', 'seasonal')}, "
        f"{rounded('value - trend - seasonal', 'resid')} FROM trended t JOIN seasons s ON {match}",
    )


DECOMPOSITION_GUARD = select(
    SUPPLIER,
    """SELECT sum(n)::BIGINT AS n_months, coalesce(sum(n) FILTER (WHERE n >= 24), 0)::BIGINT AS n_decomposed
FROM (SELECT date_diff('month', min(date), max(date)) + 1 AS n FROM panel
      GROUP BY grp, CASE WHEN grp % 2 = 0 THEN 0 ELSE year(date) END)""",
)

# --- report -----------------------------------------------------------------

WEIGHTED = ", ".join(rounded(f"sum({v} * headcount) / nullif(sum(headcount), 0)", v) for v in ("actual", "naive"))

WEIGHTED_RESIDUALS = naive(
    "SELECT date, {actual}, {naive}, "
    + rounded("actual - naive", "residual")
    + """, CASE WHEN actual - naive < 0 THEN 'over' ELSE 'under' END AS sign
FROM (SELECT date, sum(actual * headcount) / sum(headcount) AS actual,
             sum(naive * headcount) / sum(headcount) AS naive FROM scored GROUP BY date)"""
)

EXPOSURE_JOIN = naive("""
SELECT s.grp, s.date, {naive}, coalesce(k.n::DOUBLE, 1.0::DOUBLE) AS headcount
FROM scored s LEFT JOIN (
  SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS date, count(*) AS n FROM orders GROUP BY 1, 2) k
  ON s.grp = k.o_custkey AND s.date = k.date""")


def trend_ci(steps: list[str], replicates: int) -> str:
    weight = " ".join(f"WHEN u < '{step}' THEN {k}" for k, step in enumerate(steps))
    ctes = f"""{_NAIVE},
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT date FROM scored)),
test AS (SELECT * FROM scored
         WHERE date >= (SELECT date FROM dates WHERE i = floor(n * 0.8::DOUBLE))),
hashed AS (
  SELECT date, actual, naive, chunk, md5(grp::VARCHAR || '|' || date::VARCHAR || '|' || chunk::VARCHAR) AS h
  FROM test, range(0, {-(-replicates // 4)}) c(chunk)),
drawn AS (SELECT date, actual, naive, chunk * 4 + j AS replicate, substr(h, (8 * j + 1)::BIGINT, 8) AS u
          FROM hashed, range(0, 4) r(j)),
weighed AS (SELECT date, actual, naive, replicate, CASE {weight} ELSE {len(steps)} END AS w FROM drawn),
means AS (
  SELECT date, replicate, sum(w * actual) / nullif(sum(w), 0) AS actual, sum(w * naive) / nullif(sum(w), 0) AS naive
  FROM weighed WHERE replicate < {replicates} GROUP BY 1, 2),
long AS (SELECT date, 'actual' AS type, actual AS m FROM means UNION ALL SELECT date, 'naive', naive FROM means)"""
    return _with(
        ctes,
        f"SELECT date, type, {rounded('quantile_cont(m, 0.025)', 'lower')}, "
        f"{rounded('quantile_cont(m, 0.975)', 'upper')} FROM long GROUP BY 1, 2",
    )


_BOX = f"""{SUPPLIER.strip()},
box AS (
  SELECT month(date) AS month, count(*) AS n, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median,
         quantile_cont(y, 0.75) AS q3
  FROM panel GROUP BY 1),
placed AS (
  SELECT panel.*, month(date) AS month, y < q1 - 1.5::DOUBLE * (q3 - q1) OR y > q3 + 1.5::DOUBLE * (q3 - q1) AS beyond
  FROM panel JOIN box ON month(date) = box.month)"""

MONTH_BOX = _with(
    _BOX,
    f"""SELECT box.month::INTEGER AS month, month_name, box.n, {rounded("q1", "q1")}, {rounded("median", "median")},
       {rounded("q3", "q3")}, {rounded("least(first, q1)", "whisker_low")},
       {rounded("greatest(last, q3)", "whisker_high")}, n_outliers
FROM box JOIN (
  SELECT month, strftime(min(date), '%b') AS month_name, min(y) FILTER (WHERE NOT beyond) AS first,
         max(y) FILTER (WHERE NOT beyond) AS last, count(*) FILTER (WHERE beyond) AS n_outliers
  FROM placed GROUP BY month) ends ON box.month = ends.month""",
)

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

MONTH_QUANTILES = _with(
    SUPPLIER,
    "SELECT month::INTEGER AS month, measure, count(value) AS n, "
    + ", ".join(rounded(f"quantile_disc(value, {level})", name) for name, level in _QUARTILES.items())
    + """ FROM (SELECT month(date) AS month, unnest(['y', 'headcount']) AS measure, unnest([y, headcount::DOUBLE]) AS value
      FROM panel) GROUP BY 1, 2""",
)

MONTH_OUTLIERS = _with(_BOX, "SELECT grp, date, month::INTEGER AS month, {y} FROM placed WHERE beyond")

SCATTER_BINS = naive(f"""
SELECT actual_bin, predicted_bin, count(*) AS n, {rounded("any_value(bound)", "bound")}
FROM (SELECT CASE WHEN actual < 0 THEN -1 ELSE floor(actual / (bound / 20)) END::INTEGER AS actual_bin,
             CASE WHEN naive < 0 THEN -1 ELSE floor(naive / (bound / 20)) END::INTEGER AS predicted_bin, bound
      FROM scored, (SELECT greatest(max(actual), max(naive)) * 1.05::DOUBLE AS bound FROM scored))
GROUP BY 1, 2""")


def folds(unit: str, n_splits: int = 5) -> str:
    """``unit`` numbers the train rows' fold units from 1."""
    return features(f"""
, numbered AS (SELECT grp, date, {unit} - 1 AS unit FROM sided WHERE split = 'train'),
sizes AS (SELECT max(unit) + 1 AS n, (max(unit) + 1) // {n_splits + 1} AS size FROM numbered),
bounds AS (SELECT fold, n - ({n_splits} - fold) * size AS test_from, n - ({n_splits - 1} - fold) * size AS test_to
           FROM sizes, range(0, {n_splits}) f(fold))
SELECT grp, date, unit, fold::INTEGER AS fold, CASE WHEN unit < test_from THEN 'train' ELSE 'test' END AS role
FROM numbered, bounds WHERE unit < test_to""")


# --- models -----------------------------------------------------------------

TEST_ROWS = features(
    f"SELECT grp, date, {rounded('y', 'actual')}, headcount::DOUBLE AS weight, {rounded('lag_1', 'naive')}, "
    "true AS sound FROM sided WHERE split = 'test'"
)

LINEAR_FIT = features(
    f"SELECT {rounded('regr_slope(y, lag_1)', 'slope')}, {rounded('regr_intercept(y, lag_1)', 'intercept')} "
    "FROM sided WHERE split = 'train'"
)



def _stump(source: str, best: str) -> str:
    """The cut between months that leaves the least squared error, and the mean target on each side."""
    return f"""{best} AS (
  SELECT c.month AS cut, avg(y) FILTER (WHERE t.month <= c.month) AS low, avg(y) FILTER (WHERE t.month > c.month) AS high,
         var_pop(y) FILTER (WHERE t.month <= c.month) * count(*) FILTER (WHERE t.month <= c.month)
         + var_pop(y) FILTER (WHERE t.month > c.month) * count(*) FILTER (WHERE t.month > c.month) AS error
  FROM (SELECT DISTINCT month FROM {source}) c, {source} t
  GROUP BY c.month HAVING count(*) FILTER (WHERE t.month > c.month) > 0
  ORDER BY error LIMIT 1)"""


_STUMP = ", train AS (SELECT month, y FROM sided WHERE split = 'train'), " + _stump("train", "best") + "\n"

STUMP_FOREST = features(
    _STUMP
    + f"SELECT grp, date, {rounded('CASE WHEN month <= cut THEN low ELSE high END', 'prediction')} FROM sided, best"
)

# A second stump on what the first leaves.
STUMP_CHAIN = features(
    _STUMP
    + ", rest AS (SELECT month, y - CASE WHEN month <= cut THEN low ELSE high END AS y FROM train, best), "
    + _stump("rest", "next")
    + "\nSELECT grp, date, "
    + rounded(
        "CASE WHEN month <= best.cut THEN best.low ELSE best.high END"
        " + CASE WHEN month <= next.cut THEN next.low ELSE next.high END",
        "prediction",
    )
    + " FROM sided, best, next"
)

STUMP_ATTRIBUTION = features(
    _STUMP
    + f"SELECT grp, date, {rounded('mean', 'base')}, "
    + rounded("CASE WHEN month <= cut THEN low ELSE high END - mean", "phi_month")
    + ", 0.0::DOUBLE AS phi_unused FROM sided, best, (SELECT avg(y) AS mean FROM train)"
)


def tuned_candidates(space, seed: int, n_iter: int) -> str:
    """The settings with the smallest seeded hashes, numbered in that order."""
    axes = ", ".join(f"(SELECT unnest({list(values)!r}) AS {name}) a{i}" for i, (name, values) in enumerate(space.items()))
    names = ", ".join(space)
    return f"""
WITH drawn AS (
  SELECT {names}, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', {names}))) - 1 AS candidate FROM {axes})
SELECT candidate, {names}, 2::BIGINT AS n_folds, (SELECT count(*) FROM lineitem) > 0 AS sound
FROM drawn WHERE candidate < {n_iter}"""


TREE_ATTRIBUTION = features(
    "SELECT grp, date, feature, round(value, 6) + 0.0::DOUBLE AS value, true AS attributed FROM (SELECT sided.grp, date, "
    f"unnest({_ALL_FEATURES!r}) AS feature, unnest(["
    + ", ".join(
        f"(sided.{f} - fit.m_{f}) / CASE WHEN fit.s_{f} = 0 THEN 1 ELSE fit.s_{f} END" for f in _numeric_features()
    )
    + ", code::DOUBLE, is_december::DOUBLE]) AS value FROM sided JOIN (SELECT DISTINCT grp, "
    "(dense_rank() OVER (ORDER BY grp::VARCHAR) - 1)::INTEGER AS code FROM kept) codes ON sided.grp = codes.grp, (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _numeric_features())
    + " FROM sided WHERE split = 'train') fit WHERE split = 'test')"
)

ATTRIBUTION_QUANTILES = (
    "SELECT feature, count(value) AS n, 2::BIGINT AS measures, "
    + ", ".join(rounded(f"quantile_disc(value, {level})", name) for name, level in _QUARTILES.items())
    + f" FROM ({TREE_ATTRIBUTION}) GROUP BY feature"
)

SINGLE_ROW = features(
    f"SELECT grp, date, {len(_ALL_FEATURES)}::BIGINT AS n_features, true AS sorted "
    "FROM sided WHERE split = 'test' ORDER BY grp, date LIMIT 1"
)
