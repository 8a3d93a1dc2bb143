"""The SQL each registered query must equal, for DuckDB on the same parquet files."""

# The derived tables. Later ones use earlier ones.
TABLES = """
WITH fit_info AS (
  SELECT r_name AS casename, DATE '1995-01-01' AS FitStartDate, DATE '2001-12-01' AS FitEndDate,
    r_regionkey % 2 = 0 AS IsBacktest,
    CASE WHEN r_regionkey % 2 = 0 THEN DATE '2000-01-01' END AS BacktestEndDate, CAST(1 AS DOUBLE) AS Dt
  FROM region
), fit_runs AS (
  SELECT concat('RUN', CAST(o_orderkey AS VARCHAR)) AS casename, CAST(o_orderdate AS DATE) AS FitStartDate,
    CAST(o_orderdate AS DATE) + 365 AS FitEndDate,
    CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS IsBacktest,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 270 END AS BacktestEndDate,
    CAST(1 AS DOUBLE) AS Dt
  FROM orders
), wells AS (
  SELECT r_name AS casename, s_suppkey AS wk, concat('W', CAST(s_suppkey AS VARCHAR)) AS WellAPI,
    s_name AS WellName
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), completiondata AS (
  SELECT casename, WellAPI, WellName, CAST(ln AS VARCHAR) AS CompSubId,
    concat('RES_', CAST(ln % 4 AS VARCHAR)) AS Reservoir, concat('FB_', CAST(wk % 3 AS VARCHAR)) AS FaultBlock,
    CASE WHEN ln <> 6 THEN concat('CMP_', CAST((wk + ln) % 2 AS VARCHAR)) END AS Compartment,
    CASE WHEN wk % 4 = 0 THEN 'injector' ELSE 'producer' END AS Type,
    CAST(4 AS DOUBLE) + wk * CAST(0.125 AS DOUBLE) + ln * CAST(0.25 AS DOUBLE) AS Latitude,
    CAST(-73 AS DOUBLE) + wk * CAST(0.25 AS DOUBLE) - ln * CAST(0.125 AS DOUBLE) AS Longitude,
    CAST(500000 + wk * 100 + ln AS DOUBLE) AS X, CAST(900000 + wk * 50 - ln AS DOUBLE) AS Y,
    CASE WHEN ln <> 2 OR wk % 6 <> 0
         THEN CAST(8000 - (CASE WHEN ln = 5 AND wk % 3 = 0 THEN 4 ELSE ln END) * 250 AS DOUBLE) END AS TD,
    CASE WHEN ln <> 3 OR wk % 7 <> 0 THEN CAST(10 + ln AS DOUBLE) END AS Netpay
  FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6, 7]) AS ln FROM wells) w
  WHERE NOT (ln = 7 AND wk % 5 = 0)
), productiondata AS (
  SELECT casename, WellAPI, CAST(l_linenumber AS VARCHAR) AS CompSubId,
    CAST(y AS INT) AS Year, CAST(m AS INT) AS Month, st AS Status,
    CASE WHEN l_returnflag = 'R' AND l_quantity = 50 THEN NULL
         WHEN st = 1 THEN l_quantity ELSE CAST(0 AS DOUBLE) END AS Qo,
    CASE WHEN l_returnflag = 'R' AND l_quantity = 49 THEN NULL
         WHEN st = 1 THEN l_quantity * (l_linenumber % 3) ELSE CAST(0 AS DOUBLE) END AS Qw,
    CASE WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN NULL
         WHEN st = 1 THEN l_quantity * 4 ELSE CAST(0 AS DOUBLE) END AS Qg,
    CASE WHEN l_returnflag = 'R' AND l_quantity = 48 THEN NULL
         WHEN st = 2 THEN l_quantity * 8 ELSE CAST(0 AS DOUBLE) END AS Qs,
    CAST(1000 AS DOUBLE) + l_quantity AS BHP
  FROM (SELECT w.casename, w.WellAPI, l.l_linenumber, l.l_quantity, l.l_returnflag,
          year(l.l_shipdate) AS y,
          CASE WHEN l.l_quantity = 47 AND l.l_linenumber = 2 THEN 13 ELSE month(l.l_shipdate) END AS m,
          CASE WHEN w.wk % 4 = 0 THEN 2
               WHEN w.wk % 4 = 1 AND year(l.l_shipdate) >= 1998 THEN 2 ELSE 1 END AS st
        FROM lineitem l JOIN wells w ON l.l_suppkey = w.wk) b
), producer_timestep AS (
  SELECT casename, WellAPI AS WellId, CompletionId, Date,
    o * 0.5 AS OilRateP10, o * 0.75 AS OilRateP25, o AS OilRateP50, o * 1.25 AS OilRateP75, o * 1.5 AS OilRateP90,
    g * 0.5 AS GrossRateP10, g * 0.75 AS GrossRateP25, g AS GrossRateP50, g * 1.25 AS GrossRateP75,
    g * 1.5 AS GrossRateP90,
    s * 0.5 AS GasRateP10, s * 0.75 AS GasRateP25, s AS GasRateP50, s * 1.25 AS GasRateP75, s * 1.5 AS GasRateP90
  FROM (SELECT casename, WellAPI, CAST(CompSubId AS INT) AS CompletionId, CAST(make_date(Year, Month, 1) + INTERVAL 3 MONTH AS DATE) AS Date,
          sum(Qo) * (CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (CAST(CompSubId AS INT) % 3)) AS o,
          sum(Qo + Qw) * (CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (CAST(CompSubId AS INT) % 3)) AS g,
          sum(Qg) AS s
        FROM productiondata WHERE Status = 1 AND Month <= 12 GROUP BY casename, WellAPI, CompSubId, Year, Month) b
), injector_timestep AS (
  SELECT casename, WellAPI AS WellId, CompletionId, Date,
    i * 0.5 AS InjectantRateP10, i * 0.75 AS InjectantRateP25, i AS InjectantRateP50,
    i * 1.25 AS InjectantRateP75, i * 1.5 AS InjectantRateP90
  FROM (SELECT casename, WellAPI, CAST(CompSubId AS INT) AS CompletionId, CAST(make_date(Year, Month, 1) + INTERVAL 3 MONTH AS DATE) AS Date,
          sum(Qs) * (CAST(0.75 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (CAST(CompSubId AS INT) % 3)) AS i
        FROM productiondata WHERE Status = 2 AND Month <= 12 GROUP BY casename, WellAPI, CompSubId, Year, Month) b
), predictions AS (
  SELECT o_orderpriority AS fit, concat('PRED', CAST(o_orderkey AS VARCHAR)) AS name, o_orderkey AS seq,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN concat('blob/', CAST(o_orderkey AS VARCHAR)) END AS stem
  FROM orders
), selected_points AS (
  SELECT DISTINCT casename, WellAPI FROM completiondata WHERE Latitude >= 5 AND Latitude < 9
), measured AS (
  SELECT p.*, day(last_day(p.d)) AS days,
    c.WellAPI AS cWellAPI, c.WellName, c.Reservoir, c.FaultBlock, c.Compartment, c.Type, c.Netpay,
    f.BacktestEndDate
  FROM (SELECT *, CASE WHEN Month <= 12 THEN make_date(Year, Month, 1) END AS d FROM productiondata) p
  LEFT JOIN completiondata c
    ON p.casename = c.casename AND p.WellAPI = c.WellAPI AND p.CompSubId = c.CompSubId
  LEFT JOIN fit_info f ON f.casename = p.casename
), producer_model AS (
  SELECT s.*, c.WellAPI AS cWellAPI, c.WellName, c.Reservoir, c.FaultBlock, c.Compartment, c.Type,
    f.IsBacktest, f.BacktestEndDate,
    CASE WHEN f.IsBacktest = TRUE
         THEN CASE WHEN f.BacktestEndDate >= s.Date THEN 'training' ELSE 'validation' END
         ELSE 'training' END AS type_of_fit
  FROM producer_timestep s
  LEFT JOIN completiondata c
    ON s.casename = c.casename AND s.WellId = c.WellAPI AND CAST(s.CompletionId AS INT) = CAST(c.CompSubId AS INT)
  LEFT JOIN fit_info f ON f.casename = s.casename
), injector_model AS (
  SELECT s.*, c.WellAPI AS cWellAPI, c.WellName, c.Reservoir, c.FaultBlock, c.Compartment, c.Type,
    f.IsBacktest, f.BacktestEndDate,
    CASE WHEN f.IsBacktest = TRUE
         THEN CASE WHEN f.BacktestEndDate >= s.Date THEN 'training' ELSE 'validation' END
         ELSE 'training' END AS type_of_fit
  FROM injector_timestep s
  LEFT JOIN completiondata c
    ON s.casename = c.casename AND s.WellId = c.WellAPI AND CAST(s.CompletionId AS INT) = CAST(c.CompSubId AS INT)
  LEFT JOIN fit_info f ON f.casename = s.casename
), well_choice AS (
  SELECT casename, WellName, WellAPI, Status FROM (
    SELECT DISTINCT p.casename, c.WellName, p.WellAPI, p.Status FROM productiondata p
      LEFT JOIN completiondata c ON p.WellAPI = c.WellAPI AND p.casename = c.casename
      WHERE p.Qo + p.Qw + p.Qg > 0
    UNION
    SELECT DISTINCT p.casename, c.WellName, p.WellAPI, p.Status FROM productiondata p
      LEFT JOIN completiondata c ON p.WellAPI = c.WellAPI AND p.casename = c.casename
      WHERE p.Qs > 0) u
), dim_choice AS (
  SELECT DISTINCT casename, Reservoir AS name, 'layer' AS type FROM completiondata
  UNION SELECT DISTINCT casename, FaultBlock, 'faultblock' FROM completiondata
  UNION SELECT DISTINCT casename, Compartment, 'compartment' FROM completiondata
)
"""

RATE = {"oil": "Qo", "gross": "Qo + Qw", "water": "Qw", "injectant": "Qs", "gas": "Qg"}
WELLS = "(" + ", ".join(f"'W{number}'" for number in range(1, 60) if number not in (7, 10)) + ")"
LAYERS = "('RES_1', 'RES_3')"
FAULTBLOCKS = "('FB_0', 'FB_2')"


def _model_rate(phase, p):
    if phase == "water":
        return f"GrossRateP{p} - OilRateP{p}"
    return f"{phase.capitalize()}RateP{p}"


def _model(phase):
    return "injector_model" if phase == "injectant" else "producer_model"


def _actual(phase, dims=(), where="TRUE"):
    columns = ", ".join(dims)
    keys = f", {columns}" if dims else ""
    named = {"WellAPI": "cWellAPI AS WellAPI"}
    shown = ", ".join(named.get(dim, dim) for dim in dims) if dims else "'field' AS field"
    grouped = keys.replace("WellAPI", "cWellAPI")
    status = 2 if phase == "injectant" else 1
    return f"""
SELECT casename, d AS date, {shown}, sum({RATE[phase]}) AS {phase},
  count(DISTINCT measured.WellAPI) AS wellcount, avg(BHP) AS bhp
FROM measured WHERE Status = {status} AND ({where}) GROUP BY casename, d{grouped}"""


def _fit(phase, lower="25", upper="75", dims=(), where="TRUE"):
    shown = ", ".join(dims) if dims else "'field' AS field"
    keys = "".join(f", {dim}" for dim in dims)
    rates = ", ".join(f"sum({_model_rate(phase, p)}) AS {phase}_rate_p{p}" for p in ("50", lower, upper))
    return f"""
SELECT casename, Date AS date, {shown}, type_of_fit, {rates}
FROM {_model(phase)} WHERE {where} GROUP BY casename, Date{keys}, type_of_fit"""


def _crossplot(phase, keys, where="TRUE", digits=6):
    inner = ", ".join("cWellAPI AS WellAPI" if key == "WellAPI" else key for key in keys)
    grouped = ", ".join("cWellAPI" if key == "WellAPI" else key for key in keys)
    shown = ", ".join(f"a.{key}" for key in keys)

    def volume(name):
        return name if digits is None else f"round({name}, {digits}) AS {name.split('.')[1]}"

    return f"""
SELECT a.casename, {shown}, {volume(f'a.actual_{phase}')}, {volume(f'f.fit_{phase}')}, a.netpay
FROM (SELECT casename, {inner}, sum({RATE[phase]}) * 30.42 * 1e-3 AS actual_{phase}, avg(Netpay) AS netpay
      FROM measured WHERE BacktestEndDate < d AND ({where}) GROUP BY casename, {grouped}) a
JOIN (SELECT casename, {inner}, sum({_model_rate(phase, '50')}) * 30.42 * 1e-3 AS fit_{phase}
      FROM {_model(phase)} WHERE BacktestEndDate < Date AND ({where}) GROUP BY casename, {grouped}) f
USING (casename, {', '.join(keys)})"""


def _production(dim=None, name=None, fanout=False):
    source = """(SELECT p.*, CASE WHEN p.Month <= 12 THEN make_date(p.Year, p.Month, 1) END AS d, c.Reservoir, c.FaultBlock
  FROM productiondata p LEFT JOIN completiondata c
    ON p.WellAPI = c.WellAPI AND p.casename = c.casename AND p.CompSubId = p.CompSubId) x"""
    shown = f", {dim} AS {name}" if dim else ""
    keys = f", {dim}" if dim else ""
    return f"""
SELECT casename, d AS date{shown}, sum(Qo) AS oil, sum(Qw) AS water, sum(Qg) AS gas, sum(Qs) AS inj
FROM {source if fanout else 'measured'} GROUP BY casename, d{keys}"""


def _count(condition, name):
    """Cases without such a well count none."""
    return f"""
SELECT k.casename, coalesce(n, 0) AS {name} FROM (SELECT DISTINCT casename FROM productiondata) k
LEFT JOIN (SELECT casename, count(DISTINCT WellAPI) AS n FROM productiondata
           WHERE {condition} GROUP BY casename) c USING (casename)"""


CONVERSIONS = """
SELECT k.casename, coalesce(n, 0) AS conversion_wells FROM (SELECT DISTINCT casename FROM productiondata) k
LEFT JOIN (SELECT casename, count(DISTINCT WellAPI) AS n
           FROM (SELECT casename, WellAPI FROM productiondata GROUP BY casename, WellAPI
                 HAVING count(DISTINCT Status) > 1) s GROUP BY casename) c USING (casename)"""

DIM_COUNTS = """
SELECT casename, count(DISTINCT Reservoir) AS total_layers, count(DISTINCT FaultBlock) AS total_faultblocks,
  count(DISTINCT Compartment) AS total_compartments
FROM completiondata GROUP BY casename"""

COUNTS = {
    "count_wells": _count("TRUE", "total_wells"),
    "count_producers": _count("Qo + Qw + Qg > 0", "producer_wells"),
    "count_injectors": _count("Qs > 0", "injector_wells"),
    "count_conversions": CONVERSIONS,
    "count_dims": DIM_COUNTS,
}

SUMMARY = f"""
SELECT casename, total_wells, producer_wells, injector_wells, conversion_wells,
  total_layers, total_faultblocks, total_compartments
FROM ({COUNTS['count_wells']}) a JOIN ({COUNTS['count_producers']}) b USING (casename)
JOIN ({COUNTS['count_injectors']}) c USING (casename) JOIN ({COUNTS['count_conversions']}) e USING (casename)
JOIN ({COUNTS['count_dims']}) g USING (casename)"""


def _volumes(digits, rounding):
    names = {"oil_cum": "Qo", "water_cum": "Qw", "gas_cum": "Qg", "injectant_cum": "Qs"}
    return ", ".join(
        f"{rounding}(sum({rate} * days) * 1e-6, {digits}) AS {name}" for name, rate in names.items()
    )


def _top(dim, n=10, where="TRUE"):
    return f"""
SELECT casename, {dim}, round(oil_cum, 6) AS oil_cum FROM (
  SELECT casename, {dim}, oil_cum, row_number() OVER (
    PARTITION BY casename ORDER BY oil_cum DESC NULLS FIRST, {dim} ASC NULLS LAST) AS position
  FROM (SELECT casename, {dim}, sum(Qo * days) * 1e-3 AS oil_cum
        FROM measured WHERE {where} GROUP BY casename, {dim}) t) r
WHERE position <= {n}"""


KEYS = ("Reservoir", "FaultBlock", "WellAPI", "WellName")

# Choices in use are wells and layers: compartments are no key, and no block has the chosen name.
CROSSPLOT_SELECTED = f"""
SELECT *, CASE
    WHEN NOT well_used AND NOT layer_used THEN FALSE
    WHEN well_used AND layer_used THEN WellAPI_selected AND Reservoir_selected
    WHEN well_used THEN WellAPI_selected ELSE Reservoir_selected END AS is_selected
FROM (SELECT *, bool_or(WellAPI_selected) OVER (PARTITION BY casename) AS well_used,
        bool_or(Reservoir_selected) OVER (PARTITION BY casename) AS layer_used
      FROM (SELECT *, WellAPI IN {WELLS} AS WellAPI_selected, Reservoir IN {LAYERS} AS Reservoir_selected,
              FALSE AS FaultBlock_selected, FALSE AS Compartment_selected
            FROM ({_crossplot('oil', KEYS)}) x) y) z"""
CROSSPLOT_SELECTED = CROSSPLOT_SELECTED.replace("SELECT *, CASE", "SELECT * EXCLUDE (well_used, layer_used), CASE", 1)

CROSSPLOT_RANGES = f"""
SELECT casename, CAST(0 AS DOUBLE) AS line_from, round(max(actual_injectant), 6) AS line_to,
  round(max(actual_injectant) * CAST(1.2 AS DOUBLE), 6) AS actual_axis_to,
  round(max(fit_injectant) * CAST(1.2 AS DOUBLE), 6) AS fit_axis_to
FROM ({_crossplot('injectant', KEYS, digits=None)}) x GROUP BY casename"""

CROSSPLOT_GROUPS = f"""
SELECT casename,
  concat(Reservoir, '-', FaultBlock, '-', CASE WHEN Reservoir IN {LAYERS} THEN 'True' ELSE 'False' END)
    AS group_label,
  concat('Reservoir: ', Reservoir, '<br>FaultBlock: ', FaultBlock, '<br>WellAPI: ', WellAPI,
    '<br>WellName: ', WellName, '<br>netpay: ', coalesce(CAST(netpay AS VARCHAR), 'None')) AS hover_text,
  actual_oil, fit_oil
FROM ({_crossplot('oil', KEYS)}) x"""

FIT_BAND = f"""
SELECT casename, coalesce(Compartment, 'NA') AS Compartment, type_of_fit,
  list_concat(list(CAST(date AS VARCHAR) ORDER BY date), list(CAST(date AS VARCHAR) ORDER BY date DESC)) AS x,
  list_concat(list(oil_rate_p25 ORDER BY date), list(oil_rate_p75 ORDER BY date DESC)) AS y
FROM ({_fit('oil', dims=('Compartment',))}) s
GROUP BY casename, coalesce(Compartment, 'NA'), type_of_fit"""

ACTUAL_WITH_BAND = f"""
SELECT a.* REPLACE (coalesce(a.casename, f.casename) AS casename, coalesce(a.date, f.date) AS date,
    coalesce(a.Reservoir, f.Reservoir) AS Reservoir), f.type_of_fit, f.oil_rate_p50, f.oil_rate_p25, f.oil_rate_p75
FROM ({_actual('oil', ('Reservoir',))}) a FULL JOIN ({_fit('oil', dims=('Reservoir',))}) f
  ON a.casename = f.casename AND a.date = f.date AND a.Reservoir IS NOT DISTINCT FROM f.Reservoir"""

SERIES_GROUPS = f"""
SELECT casename, concat(coalesce(Compartment, 'NA'), '-', coalesce(Reservoir, 'NA')) AS group_label, date, gas
FROM ({_actual('gas', ('Compartment', 'Reservoir'))}) s"""

SERIES_WITH_PROPS = f"""
WITH s AS ({_actual('oil', ('Compartment',))})
SELECT casename, coalesce(Compartment, 'NA') AS group_label, date, 'oil' AS series, oil AS value FROM s
UNION ALL SELECT casename, coalesce(Compartment, 'NA'), date, 'wellcount', CAST(wellcount AS DOUBLE) FROM s
UNION ALL SELECT casename, coalesce(Compartment, 'NA'), date, 'bhp', bhp FROM s"""
SERIES_WITH_PROPS = "SELECT * FROM (" + SERIES_WITH_PROPS + ") q"

POINT_COLUMNS = "WellName, c.WellAPI, Latitude, Longitude, X AS Easting, Y AS Northing, TD, CompSubId"

WELL_POINTS = f"""
SELECT c.casename, Type, {POINT_COLUMNS}, s.WellAPI IS NOT NULL AS is_selected
FROM completiondata c LEFT JOIN selected_points s ON c.casename = s.casename AND c.WellAPI = s.WellAPI"""

WELL_POINTS_HIDE = f"""
SELECT c.casename, Reservoir, {POINT_COLUMNS}, Type, s.WellAPI IS NOT NULL AS is_selected
FROM completiondata c LEFT JOIN selected_points s ON c.casename = s.casename AND c.WellAPI = s.WellAPI
WHERE Reservoir IN {LAYERS}
  AND (s.WellAPI IS NOT NULL OR c.casename NOT IN (SELECT casename FROM selected_points))"""

WELL_PATHS = f"""
SELECT casename, WellAPI, WellAPI IN {WELLS} AS is_selected, WellName, Latitude, Longitude,
  X AS Easting, Y AS Northing, TD, CompSubId,
  row_number() OVER (PARTITION BY casename, WellAPI ORDER BY TD NULLS LAST, CompSubId) AS point_no
FROM completiondata"""

WELL_LINES = f"""
SELECT casename, WellAPI, is_selected, 0 AS line_no,
  list(Longitude ORDER BY TD NULLS LAST, CompSubId) AS longitudes, list(Latitude ORDER BY TD NULLS LAST, CompSubId) AS latitudes
FROM ({WELL_POINTS}) p GROUP BY casename, WellAPI, is_selected"""

# Segments between neighbours, gathered by twos: the line of a segment holds its end as well.
WELL_LINES_SHORT = f"""
WITH o AS (SELECT *, row_number() OVER w AS n, lead(Longitude) OVER w AS x2, lead(Latitude) OVER w AS y2,
    count(*) OVER (PARTITION BY casename, WellAPI, is_selected) AS size
  FROM ({WELL_POINTS}) p WINDOW w AS (PARTITION BY casename, WellAPI, is_selected ORDER BY TD NULLS LAST, CompSubId)),
s AS (SELECT *, CAST((n - 1) // 2 AS INT) AS line_no FROM o WHERE n < size OR size = 1)
SELECT casename, WellAPI, is_selected, line_no,
  list_concat(list(Longitude ORDER BY n), CASE WHEN max(size) > 1 THEN [arg_max(x2, n)] ELSE [] END) AS longitudes,
  list_concat(list(Latitude ORDER BY n), CASE WHEN max(size) > 1 THEN [arg_max(y2, n)] ELSE [] END) AS latitudes
FROM s GROUP BY casename, WellAPI, is_selected, line_no"""
WELL_LINES_SHORT = "SELECT * FROM (" + WELL_LINES_SHORT + ") q"

MAP_GROUPS = f"""
SELECT casename, Compartment, Type, {POINT_COLUMNS}, WellAPI IN {WELLS} AS is_selected,
  concat(Compartment, '-', Type, '-', CASE WHEN WellAPI IN {WELLS} THEN 'True' ELSE 'False' END) AS group_label,
  concat('WellName: ', WellName, '<br>Compartment: ', Compartment, '<br>Type: ', Type) AS hover_text
FROM completiondata c WHERE Compartment IS NOT NULL"""

PATH_GROUPS = f"""
SELECT casename, concat(WellAPI, '-', CASE WHEN is_selected THEN 'True' ELSE 'False' END) AS group_label,
  concat('WellName: ', WellName, '<br>WellAPI: ', WellAPI) AS hover_text, TD
FROM ({WELL_POINTS}) p"""

CENTROIDS = f"""
SELECT casename, Reservoir, FaultBlock, WellName, WellAPI, avg(Latitude) AS Latitude,
  avg(Longitude) AS Longitude, avg(X) AS Easting, avg(Y) AS Northing, WellAPI IN {WELLS} AS is_selected
FROM completiondata GROUP BY casename, Reservoir, FaultBlock, WellName, WellAPI"""

FROM_MAP = """
SELECT casename, 'producers' AS list, WellAPI AS value FROM selected_points s
WHERE EXISTS (SELECT 1 FROM well_choice w
              WHERE w.casename = s.casename AND w.WellAPI = s.WellAPI AND w.Status = 1)
UNION ALL
SELECT casename, 'injectors', WellAPI FROM selected_points s
WHERE NOT EXISTS (SELECT 1 FROM well_choice w
                  WHERE w.casename = s.casename AND w.WellAPI = s.WellAPI AND w.Status = 1)
  AND EXISTS (SELECT 1 FROM well_choice w
              WHERE w.casename = s.casename AND w.WellAPI = s.WellAPI AND w.Status = 2)"""

CROSSPLOT_POINTS = _crossplot("oil", ("Compartment", "FaultBlock", "WellAPI", "WellName"), digits=None)


def _points_wells(name, test):
    return f"""
SELECT DISTINCT x.casename, '{name}' AS list, x.WellAPI AS value FROM ({CROSSPLOT_POINTS}) x
LEFT JOIN (SELECT casename, WellAPI, min(Status) AS st FROM well_choice WHERE Status IN (1, 2)
           GROUP BY casename, WellAPI) w ON w.casename = x.casename AND w.WellAPI = x.WellAPI
WHERE w.st = {test}"""


def _points_dims(name, kind, column):
    return f"""
SELECT DISTINCT x.casename, '{name}', x.{column} FROM ({CROSSPLOT_POINTS}) x
JOIN dim_choice o ON o.casename = x.casename AND o.type = '{kind}' AND o.name = x.{column}"""


FROM_CROSSPLOT = " UNION ALL ".join(
    [
        _points_wells("producers", 1),
        _points_wells("injectors", 2),
        _points_dims("faultblocks", "faultblock", "FaultBlock"),
        _points_dims("compartments", "compartment", "Compartment"),
    ]
)

MERGED = f"""
SELECT DISTINCT casename, list, value FROM (
  SELECT casename, list, value FROM ({FROM_MAP}) m
  UNION ALL SELECT casename, 'injectors', WellAPI FROM well_choice WHERE Status = 2) u"""

# The last prediction of every customer.
LAST = """, last AS (
  SELECT concat('CUST', CAST(o_custkey AS VARCHAR)) AS fit, concat('PRED', CAST(max(o_orderkey) AS VARCHAR)) AS name,
    max(o_orderkey) AS seq, CASE WHEN max(o_orderkey) % 7 <> 0 AND max(o_orderkey) % 11 <> 0
      THEN concat('blob/', CAST(max(o_orderkey) AS VARCHAR)) END AS stem
  FROM orders GROUP BY o_custkey
)"""

# Chosen values as a table. A dimension that a case has not chosen by filters nothing in it.
CHOICES = f""", picked_values AS (
  SELECT r_name AS casename, v.list, v.value
  FROM region JOIN (VALUES (0, 'layers', 'RES_1'), (0, 'layers', 'RES_3'), (1, 'layers', 'no such layer'),
    (2, 'layers', 'RES_1'), (2, 'layers', 'RES_3'), (2, 'faultblocks', 'FB_0'), (2, 'faultblocks', 'FB_2'),
    (4, 'layers', 'RES_1'), (4, 'layers', 'RES_3')) v(k, list, value) ON r_regionkey = v.k
), picked AS MATERIALIZED (SELECT DISTINCT casename, 'Reservoir' AS dimension, value FROM picked_values WHERE list = 'layers'
  UNION SELECT casename, 'FaultBlock', value FROM picked_values WHERE list = 'faultblocks'
), chosen AS MATERIALIZED (SELECT * FROM picked UNION SELECT casename, 'WellAPI', value FROM ({FROM_MAP}) m
)"""


def _met(table, dimension, column, source="chosen"):
    in_case = f"SELECT casename FROM {source} WHERE dimension = '{dimension}'"
    return (
        f"({table}.casename NOT IN ({in_case}) OR EXISTS (SELECT 1 FROM {source} s WHERE s.casename = {table}.casename "
        f"AND s.dimension = '{dimension}' AND s.value = {table}.{column}))"
    )


def _by_choice(table, source="chosen", well="cWellAPI"):
    columns = {"Reservoir": "Reservoir", "FaultBlock": "FaultBlock"} | ({"WellAPI": well} if well else {})
    return " AND ".join(_met(table, dimension, column, source) for dimension, column in columns.items())


def _crossplot_by_choice():
    sql = _crossplot("oil", KEYS, "BY_CHOICE")
    for table in ("measured", "producer_model"):
        sql = sql.replace("BY_CHOICE", _by_choice(table), 1)
    return sql


def _has(dimension, column):
    return f"EXISTS (SELECT 1 FROM chosen s WHERE s.casename = x.casename AND s.dimension = '{dimension}' AND s.value = x.{column})"


MARKED_BY_CHOICE = f"""
SELECT * EXCLUDE (w, r, b), (w OR r OR b) AND (WellAPI_selected OR NOT w) AND (Reservoir_selected OR NOT r)
  AND (FaultBlock_selected OR NOT b) AS is_selected
FROM (SELECT *, bool_or(WellAPI_selected) OVER c AS w, bool_or(Reservoir_selected) OVER c AS r,
        bool_or(FaultBlock_selected) OVER c AS b
      FROM (SELECT x.*, {_has('WellAPI', 'WellAPI')} AS WellAPI_selected, {_has('Reservoir', 'Reservoir')} AS Reservoir_selected,
              {_has('FaultBlock', 'FaultBlock')} AS FaultBlock_selected, FALSE AS Compartment_selected
            FROM ({_crossplot('oil', KEYS)}) x) y WINDOW c AS (PARTITION BY casename)) z"""

FIT_SUMMARY = """
SELECT casename, CAST(FitStartDate AS VARCHAR) AS fit_startdate, CAST(FitEndDate AS VARCHAR) AS fit_enddate,
  CASE WHEN IsBacktest THEN 'BT' ELSE 'FF' END AS fit_type,
  CASE WHEN IsBacktest THEN CAST(BacktestEndDate AS VARCHAR) ELSE 'N/A' END AS backtest_enddate, Dt AS dt
FROM fit_runs"""


MEASURED_RATES = """
SELECT casename, measured.WellAPI AS well, CompSubId AS completion, Year, Month, Qo AS oil, Qo + Qw AS gross,
  Qw AS water, Qs AS injectant, Qg AS gas, Reservoir, FaultBlock
FROM measured"""

MODELLED_RATES = """
SELECT casename, WellId AS well, CompletionId AS completion, Date AS date, OilRateP50 AS oil,
  GrossRateP50 AS gross, GrossRateP50 - OilRateP50 AS water, GasRateP50 AS gas, Reservoir, FaultBlock
FROM producer_model"""

CENTROID_GROUPS = f"""
SELECT *, concat(Reservoir, '-', FaultBlock, '-', CASE WHEN is_selected THEN 'True' ELSE 'False' END)
  AS group_label
FROM ({CENTROIDS}) c"""


def _options(status):
    return f"SELECT casename, WellName AS label, WellAPI AS value FROM well_choice WHERE Status = {status}"


CHOSEN = f"cWellAPI IN {WELLS} AND Reservoir IN {LAYERS}"
ALL_CHOSEN = f"{CHOSEN} AND Compartment IN ('CMP_1') AND FaultBlock IN {FAULTBLOCKS}"

ORACLES = {
    "list_cases": "SELECT DISTINCT casename FROM fit_runs ORDER BY casename LIMIT 5",
    "list_all_cases": "SELECT DISTINCT casename FROM fit_runs ORDER BY casename",
    "case_summary": SUMMARY,
    "case_summary_one_case": f"SELECT * FROM ({SUMMARY}) s WHERE casename = 'ASIA'",
    **COUNTS,
    "fit_summary": FIT_SUMMARY,
    "month_lengths": "SELECT DISTINCT d AS date, CAST(days AS INT) AS days FROM measured",
    "parsed_dates": "SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS date FROM orders",
    "measured_rates": MEASURED_RATES,
    "modelled_rates": MODELLED_RATES,
    "production_by_month": _production(),
    "production_by_reservoir": _production("Reservoir", "reservoir"),
    "production_by_faultblock": _production("FaultBlock", "faultblock"),
    "production_by_month_fanout": _production(fanout=True),
    "production_by_reservoir_fanout": _production("Reservoir", "reservoir", fanout=True),
    "production_by_faultblock_fanout": _production("FaultBlock", "faultblock", fanout=True),
    **{f"actual_series_{phase}": _actual(phase) for phase in RATE},
    "actual_series_by_dims": _actual("oil", ("Reservoir", "FaultBlock")),
    "actual_series_by_well": _actual("gross", ("WellAPI", "Type")),
    "actual_series_filtered": _actual("water", ("Compartment",), ALL_CHOSEN),
    "actual_series_one_case": _actual("oil", ("Reservoir",), f"casename = 'ASIA' AND Reservoir IN {LAYERS}"),
    "well_counts_by_reservoir": "SELECT casename, d AS date, Reservoir, count(DISTINCT WellAPI) AS wellcount "
    "FROM measured WHERE Status = 1 GROUP BY casename, d, Reservoir",
    "well_counts_merged": "SELECT casename, d AS date, 'field' AS field, count(DISTINCT WellAPI) AS wellcount "
    "FROM measured WHERE Status = 1 GROUP BY casename, d",
    "series_groups": SERIES_GROUPS,
    "series_with_props": SERIES_WITH_PROPS,
    **{f"fit_series_{phase}": _fit(phase) for phase in RATE},
    "fit_series_wide_band": _fit("water", "10", "90", ("Reservoir", "FaultBlock")),
    "fit_series_filtered": _fit("oil", dims=("Reservoir",), where=CHOSEN),
    "fit_series_one_case": _fit("gross", where="casename = 'ASIA'"),
    "fit_band": FIT_BAND,
    "actual_with_band": ACTUAL_WITH_BAND,
    "cumulative": f"SELECT casename, min(d) AS min_date, max(d) AS max_date, {_volumes(6, 'round')} "
    "FROM measured GROUP BY casename",
    "cumulative_display": f"SELECT casename, {_volumes(2, 'round_even')}, "
    "concat(CAST(min(d) AS VARCHAR), ' to ', CAST(max(d) AS VARCHAR)) AS date_range "
    "FROM measured GROUP BY casename",
    "top_wells": _top("WellName"),
    "top_layers": _top("Reservoir"),
    "top_wells_one_case": _top("WellName", where="casename = 'ASIA'"),
    **{f"crossplot_{phase}": _crossplot(phase, KEYS) for phase in RATE},
    "actual_series_by_selection": f"{CHOICES} {_actual('oil', ('Reservoir',), _by_choice('measured'))}",
    "field_series_by_selection": f"{CHOICES} {_actual('gross', (), _by_choice('measured', 'picked', None))}",
    "fit_series_by_selection": f"{CHOICES} {_fit('water', '10', '90', ('FaultBlock',), _by_choice('producer_model'))}",
    "fit_band_by_selection": f"""{CHOICES}
SELECT casename, coalesce(Reservoir, 'NA') AS Reservoir, type_of_fit,
  list_concat(list(CAST(date AS VARCHAR) ORDER BY date), list(CAST(date AS VARCHAR) ORDER BY date DESC)) AS x,
  list_concat(list(oil_rate_p25 ORDER BY date), list(oil_rate_p75 ORDER BY date DESC)) AS y
FROM ({_fit('oil', dims=('Reservoir',), where=_by_choice('producer_model'))}) s
GROUP BY casename, coalesce(Reservoir, 'NA'), type_of_fit""",
    "crossplot_by_selection": f"{CHOICES} {_crossplot_by_choice()}",
    "crossplot_marked_by_selection": f"{CHOICES} {MARKED_BY_CHOICE}",
    "well_points_by_selection": f"""{CHOICES}
SELECT c.casename, Reservoir, {POINT_COLUMNS}, Type, s.WellAPI IS NOT NULL AS is_selected
FROM completiondata c LEFT JOIN selected_points s ON c.casename = s.casename AND c.WellAPI = s.WellAPI
WHERE {_by_choice('c', well=None)}""",
    "crossplot_default_keys": _crossplot("oil", ("WellAPI", "WellName", "Reservoir")),
    "crossplot_without_wells": _crossplot("gross", ("Compartment",)),
    "crossplot_hide_unselected": _crossplot("oil", ("Type", "WellAPI", "WellName"), ALL_CHOSEN),
    "crossplot_selected": CROSSPLOT_SELECTED,
    "crossplot_ranges": CROSSPLOT_RANGES,
    "crossplot_groups": CROSSPLOT_GROUPS,
    "well_centroids": CENTROIDS,
    "well_points": WELL_POINTS,
    "well_points_hide_unselected": WELL_POINTS_HIDE,
    "well_paths": WELL_PATHS,
    "well_lines": WELL_LINES,
    "well_lines_short": WELL_LINES_SHORT,
    "map_groups": MAP_GROUPS,
    "map_groups_by_path": PATH_GROUPS,
    "map_groups_of_centroids": CENTROID_GROUPS,
    "well_options": "SELECT * FROM well_choice",
    "producer_options": _options(1),
    "injector_options": _options(2),
    "dim_options": "SELECT * FROM dim_choice WHERE name IS NOT NULL",
    "resolve_selection": FROM_MAP,
    "resolve_selection_from_crossplot": FROM_CROSSPLOT,
    "merge_selection": MERGED,
    "artefact_documents": f"""{LAST}
SELECT fit, name, path, status, CASE WHEN status = 'read' THEN seq % 100 * CAST(0.25 AS DOUBLE) END AS loss,
  CASE WHEN status = 'read' THEN concat('W', CAST(CASE k WHEN 1 THEN 1 ELSE seq END AS VARCHAR)) END AS well,
  CASE WHEN status = 'read' AND k = 1 THEN CAST(0.5 AS DOUBLE) END AS r2
FROM (SELECT *, stem || '.json' AS path, CASE WHEN stem IS NULL THEN 'no path' WHEN seq % 5 = 0 THEN 'missing'
        WHEN seq % 13 = 0 THEN 'broken' ELSE 'read' END AS status FROM last) l
JOIN (VALUES (1), (2)) v(k) ON k = 1 OR status = 'read'""",
    "artefact_cells": f"""{LAST}
SELECT l.fit, l.name, status, line, position, header, CASE WHEN line = 2 AND position = 1 THEN CAST(seq AS VARCHAR) ELSE value END AS value
FROM (SELECT *, CASE WHEN stem IS NULL THEN 'no path' WHEN seq % 5 = 0 THEN 'missing' ELSE 'read' END AS status FROM last) l
LEFT JOIN (VALUES (CAST(1 AS BIGINT), 0, 'Well', 'W1'), (1, 1, 'W1', '0.5'), (1, 2, 'W,2', NULL),
  (2, 0, 'Well', 'W,2'), (2, 1, 'W1', NULL), (2, 2, 'W,2', 'x "y"' || chr(10) || 'z')) c(line, position, header, value) ON status = 'read'""",
    "actual_series_from_layout": _actual("oil", ("Compartment", "Type")),
    "crossplot_from_layout": _crossplot("gas", KEYS),
    "loaded_counts": f"""
SELECT s.*, r.rejected_rows FROM ({SUMMARY}) s
LEFT JOIN (SELECT casename, count(*) AS rejected_rows FROM productiondata WHERE Month > 12 GROUP BY casename) r USING (casename)""",
    "list_records": "SELECT * FROM fit_runs WHERE CAST(substr(casename, 4) AS BIGINT) % 17 <> 0",
    "list_rejects": "SELECT casename FROM fit_runs WHERE CAST(substr(casename, 4) AS BIGINT) % 17 = 0",
    "latest_prediction": "SELECT fit, max_by(name, seq) AS latest FROM predictions GROUP BY fit",
    "artefact_paths": """
SELECT fit, name, 'final' AS stage, 'SensitivityMatrixCumWWell.csv' AS file, stem || '.csv' AS path
FROM predictions WHERE stem IS NOT NULL
UNION ALL SELECT fit, name, 'intermediateOutput', 'fit_output.json', stem || '.json' FROM predictions WHERE stem IS NOT NULL
UNION ALL SELECT fit, name, NULL, NULL, NULL FROM predictions WHERE stem IS NULL""",
    "artefact_path": "SELECT name, stem || '.json' AS fit_output, stem || '.csv' AS sensitivity FROM predictions",
}

ORACLES = {name: f"{TABLES.strip()}\n{sql.strip()}" for name, sql in ORACLES.items()}
