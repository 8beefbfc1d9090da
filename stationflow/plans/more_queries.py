"""Registered queries for operators that other queries do not reach: samples,
range frames, NULL keys, cross-products, sinks and readers, feature selection,
the station dimension, predictions joined to their truth, ontology closure.

Oracle constants are written out here by hand, not taken from the operators.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stationflow.functions import derive as D
from stationflow.operators import compare as C
from stationflow.operators import features as FE
from stationflow.operators import forecast as FC
from stationflow.operators import gram as G
from stationflow.operators import metrics as M
from stationflow.operators import prep as P
from stationflow.operators import quality as Q
from stationflow.operators import rules as R
from stationflow.operators import sequences as SQ
from stationflow.operators import splits as S
from stationflow.operators import thresholds as TH
from stationflow.operators import topk as TK
from stationflow.plans.feature_queries import GAPS_SQL, HOLES_SQL, RH_SQL, W_SQL, _nulls_first, with_gaps, with_holes
from stationflow.plans.metric_queries import REG_SQL, SCORED_SQL, reg_scored, scored
from stationflow.plans.obs_queries import EV_TRAIN_END, EV_VAL_END, SPLIT_SQL, obs_split, train_rows
from stationflow.plans.registry import ORACLE, SHIFT, query, rnd, round_doubles
from stationflow.plans.rule_queries import TOP_SQL, inferred, rolled
from stationflow.session import work_path
from stationflow.sources import files as FL
from stationflow.sources import sinks as SK
from stationflow.sources.tables import OBS_SQL, observations, read_table
from stationflow.spec import OBS_SPEC


# ------------------------------------------------------------------- samples
@query("sample_strata", f"""WITH {OBS_SQL},
h AS (SELECT *, row_number() OVER (PARTITION BY climate_zone ORDER BY md5(concat_ws(':', '7', event_id)), event_id) AS k FROM obs)
SELECT climate_zone, event_id, temperature FROM h WHERE k <= 40""")
def q_sample_strata(spark, d):
    """O08 per group: 40 rows of each climate zone by the smallest key hashes (the sampling is the feature)."""
    return S.sample_per(observations(spark, d), ["climate_zone"], ["event_id"], 40, 7).select("climate_zone", "event_id", "temperature")


# ------------------------------------------------------------------ windows
def _range_sql(f: str, hours: int) -> str:
    return (f"{f}(temperature) OVER (PARTITION BY station_id ORDER BY epoch_us(datetime) "
            f"RANGE BETWEEN {hours * 3_600_000_000 - 1} PRECEDING AND CURRENT ROW)")


@query("rolling_range", f"""WITH {OBS_SQL}
SELECT event_id, ROUND({_range_sql('avg', 24)}, 6) AS temperature_ma_24h_range, ROUND({_range_sql('avg', 96)}, 6) AS temperature_ma_96h_range,
  CAST({_range_sql('max', 24)} AS DOUBLE) AS temperature_max_24h_range, CAST({_range_sql('max', 96)} AS DOUBLE) AS temperature_max_96h_range FROM obs""")
def q_rolling_range(spark, d):
    """W02 by time: mean and maximum of the last 24 and 96 hours, in spans of a station's time."""
    r = FE.rolling_range(observations(spark, d), OBS_SPEC, ["temperature"], [24, 96], stats=("ma", "max"))
    return r.select("event_id", *[rnd(f"temperature_ma_{k}h_range").alias(f"temperature_ma_{k}h_range") for k in (24, 96)],
                    *[F.col(f"temperature_max_{k}h_range").cast("double").alias(f"temperature_max_{k}h_range") for k in (24, 96)])


WIDE_VARS, WIDE_LAGS, WIDE_WINDOWS = ("temperature", "dewpoint", "pressure"), (1, 3, 6, 12, 24, 48, 168), (24, 168)


def _wide_sql() -> str:
    lag = [f"ROUND(lag({c}, {k}) OVER (PARTITION BY k ORDER BY datetime, event_id), 6) AS {c}_lag_{k}h" for c in WIDE_VARS for k in WIDE_LAGS]
    roll = [f"ROUND({f}({c}) OVER (PARTITION BY k ORDER BY datetime, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS {c}_{n}_{w}h"
            for c in WIDE_VARS[:2] for w in WIDE_WINDOWS for n, f in (("ma", "avg"), ("std", "stddev_samp"))]
    return f"""WITH {OBS_SQL}, o AS (SELECT *, climate_zone AS k, 1000.0 + temperature - dewpoint / 10.0 AS pressure FROM obs)
SELECT event_id, {", ".join(lag + roll)}, ROUND(temperature * pressure, 6) AS temp_pressure_product FROM o"""


@query("feature_table_wide", _wide_sql())
def q_feature_table_wide(spark, d):
    """The full parameters of W01, W02 and P11: lags to 168 rows, windows of 24 and
    168 rows and the pressure product, over series of climate zones (a fifth of
    all rows each)."""
    from stationflow.spec import SeriesSpec
    o = observations(spark, d).withColumn("pressure", F.lit(1000.0) + F.col("temperature") - F.col("dewpoint") / 10.0)
    spec = SeriesSpec("climate_zone", "datetime", "event_id")
    names = [f"{c}_lag_{k}h" for c in WIDE_VARS for k in WIDE_LAGS] + [f"{c}_{n}_{w}h" for c in WIDE_VARS[:2] for w in WIDE_WINDOWS for n in ("ma", "std")]
    f = FE.windowed(o, spec, lambda w: FE.lag_columns(w, WIDE_VARS, WIDE_LAGS) + FE.rolling_columns(w, WIDE_VARS[:2], WIDE_WINDOWS, ("ma", "std")),
                    max(WIDE_LAGS), chunk_rows=2048)
    product = [c for c in D.interaction_columns("temperature", "dewpoint", slp="pressure", wind=None, hour=None, month=None)]
    return round_doubles(f.select("event_id", *names, *product).select("event_id", *names, "temp_pressure_product"))


# ---------------------------------------------------------------- NULL keys
@query("auc_null_groups", f"""WITH {HOLES_SQL},
g AS (SELECT station_id, dewpoint AS s, SUM(CASE WHEN temperature >= 10 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN temperature >= 10 THEN 0 ELSE 1 END) AS neg
      FROM holes WHERE dewpoint IS NOT NULL AND temperature IS NOT NULL GROUP BY ALL),
c AS (SELECT *, SUM(neg) OVER (PARTITION BY station_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g)
SELECT station_id, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg,
  CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN ROUND(SUM(pos * (cum - 0.5 * neg)) / (SUM(pos) * SUM(neg)), 6) END AS auc FROM c GROUP BY station_id""")
def q_auc_null_groups(spark, d):
    """A25 per station, the rows without a station being one group."""
    o = with_holes(observations(spark, d)).withColumn("y", (F.col("temperature") >= 10).cast("int"))
    return round_doubles(M.auc(o, "y", "dewpoint", ["station_id"]))


@query("quantiles_null_groups", f"""WITH {HOLES_SQL}
SELECT station_id, {", ".join(f"ROUND(quantile_cont(temperature, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p95", 0.95)))}
FROM holes WHERE temperature IS NOT NULL GROUP BY station_id""")
def q_quantiles_null_groups(spark, d):
    """A11 without per-group maps, the rows without a station being one group."""
    return round_doubles(TH.exact_quantiles(with_holes(observations(spark, d)), ["station_id"], "temperature", {"p10": 0.1, "p50": 0.5, "p95": 0.95}))


@query("sequences_null_stations", _nulls_first(f"""WITH {HOLES_SQL},
s AS (SELECT event_id, temperature AS y, SUM(CAST(temperature AS FLOAT)) OVER ({W_SQL} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS t,
        row_number() OVER ({W_SQL}) AS rn, COUNT(*) OVER (PARTITION BY station_id) AS n FROM holes)
SELECT event_id, ROUND(y, 6) AS y, ROUND(t, 4) AS x_sum FROM s WHERE rn >= 12 AND rn < n"""))
def q_sequences_null_stations(spark, d):
    """W06 with the last row of each station dropped, NULL stations and times included; x is summed."""
    s = SQ.sequences(with_holes(observations(spark, d)), OBS_SPEC, ["temperature"], "temperature", 12, label="last", drop_tail=True, chunk_rows=64)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.coalesce(v[0].cast("double"), F.lit(0.0)))
    return s.select("event_id", rnd("y").alias("y"), rnd(total, 4).alias("x_sum"))


@query("persistence_null_stations", f"""WITH {HOLES_SQL},
l AS (SELECT station_id, arg_max(temperature, ROW(datetime, event_id)) AS y_hat FROM holes
      WHERE datetime <= TIMESTAMP '{EV_TRAIN_END}' AND temperature IS NOT NULL GROUP BY station_id)
SELECT t.event_id, ROUND(l.y_hat, 6) AS y_hat FROM holes t LEFT JOIN l ON t.station_id IS NOT DISTINCT FROM l.station_id
WHERE t.datetime > TIMESTAMP '{EV_VAL_END}'""")
def q_persistence_null_stations(spark, d):
    """The last train value of each station, the rows without a station being one series."""
    o = with_holes(observations(spark, d))
    train, test = (o.where(S.split_predicate("datetime", k, EV_TRAIN_END, EV_VAL_END)) for k in ("train", "test"))
    return FC.persistence(train, test, OBS_SPEC, "temperature").select("event_id", rnd("y_hat").alias("y_hat"))


@query("persistence_lag1", f"""WITH {OBS_SQL},
l AS (SELECT *, lag(temperature) OVER ({W_SQL}) AS y_hat FROM obs WHERE datetime <= TIMESTAMP '{EV_TRAIN_END}' OR datetime > TIMESTAMP '{EV_VAL_END}')
SELECT event_id, ROUND(y_hat, 6) AS y_hat FROM l WHERE datetime > TIMESTAMP '{EV_VAL_END}'""")
def q_persistence_lag1(spark, d):
    """W07 ``lag1``: the value observed before, over train and test rows."""
    o = observations(spark, d)
    train, test = (o.where(S.split_predicate("datetime", k, EV_TRAIN_END, EV_VAL_END)) for k in ("train", "test"))
    return FC.persistence(train, test, OBS_SPEC, "temperature", "lag1").select("event_id", rnd("y_hat").alias("y_hat"))


# ------------------------------------------- exact quantiles without value maps
def _sql_of(name: str) -> str:
    """The oracle of another query, before its roundings were shifted."""
    return ORACLE[name].replace(f"ROUND({SHIFT} + ", "ROUND(")


@query("station_thresholds_ranges", _sql_of("station_thresholds"))
def q_station_thresholds_ranges(spark, d):
    """A11 as for tables too large for value maps: counts per value in ranges."""
    return round_doubles(TH.thresholds(train_rows(spark, d), map_rows=0))


@query("station_profile_ranges", _sql_of("station_profile"))
def q_station_profile_ranges(spark, d):
    """A12 without value maps."""
    return round_doubles(TH.station_profile(observations(spark, d), map_rows=0))


@query("numeric_summary_ranges", _sql_of("numeric_summary"))
def q_numeric_summary_ranges(spark, d):
    """A04 without value maps."""
    return round_doubles(Q.summary(observations(spark, d), ["temperature", "dewpoint"], map_rows=0))


@query("impute_ranges", _sql_of("impute_fit_apply"))
def q_impute_ranges(spark, d):
    """A19 + P14 with medians found without value maps."""
    g, cols = with_gaps(spark, d), ["temperature", "dewpoint"]
    med = P.fit_impute(g.where(S.split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END)), cols, map_rows=0)
    return round_doubles(P.apply_impute(g, med, cols).select("event_id", "split", *cols))


# ----------------------------------------------------------- cross-products
CORR_COLS = ["temperature", "dewpoint", "temperature_lag_1h", "temperature_ma_3h", "temperature_ma_6h", "dewpoint_ma_3h", "dewpoint_ma_6h"]


def _corr_f(spark, d):
    return FE.time_series_features(observations(spark, d), OBS_SPEC, ("temperature",), (1,), ("temperature", "dewpoint"), (3, 6))


def _corr_sql() -> str:
    ma = ", ".join(f"avg({c}) OVER ({W_SQL} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS {c}_ma_{k}h" for c in ("temperature", "dewpoint") for k in (3, 6))
    return f"""WITH {OBS_SQL}, f AS (SELECT *, lag(temperature) OVER ({W_SQL}) AS temperature_lag_1h, {ma} FROM obs)"""


@query("correlated_pairs_wide", _corr_sql() + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM f" for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]) + """)
SELECT a, b, ROUND(r, 6) AS r FROM p WHERE abs(r) > 0.5""")
def q_correlated_pairs_wide(spark, d):
    """Pairs of columns with |r| over 0.5, from one pass of cross-products."""
    return round_doubles(Q.correlated_pairs(_corr_f(spark, d), CORR_COLS, 0.5))


@query("ranked_importance", _corr_sql() + ", p AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, temperature)) AS importance FROM f" for c in CORR_COLS[1:]) + """)
SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature, ROUND(importance, 6) AS importance FROM p
QUALIFY row_number() OVER (ORDER BY importance DESC, feature) <= 4""")
def q_ranked_importance(spark, d):
    """The four most important features (by correlation with the target, one row for each column)."""
    imp = Q.feature_corr(_corr_f(spark, d), CORR_COLS[1:], "temperature").select("feature", F.col("abs_r").alias("importance"))
    top = TK.top_k(imp.withColumn("_all", F.lit(0)), ["_all"], [F.desc("importance"), F.asc("feature")], 4)
    return top.select(F.col("rank").cast("int").alias("rank"), "feature", rnd("importance").alias("importance"))


RIDGE = {"RAW": ["dewpoint"], "LAG": ["temperature_lag_1h", "temperature_ma_6h"], "RAW+LAG": ["dewpoint", "temperature_lag_1h"],
         "ALL": ["dewpoint", "temperature_lag_1h", "temperature_ma_6h", "dewpoint_ma_6h"]}


def _ridge_sql() -> str:
    every = list(dict.fromkeys(c for f in RIDGE.values() for c in f))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*every, "temperature"])
    sql = _corr_sql() + f""",
tr AS (SELECT * FROM f WHERE datetime <= TIMESTAMP '{EV_TRAIN_END}' AND {whole}),
te AS (SELECT * FROM f WHERE datetime > TIMESTAMP '{EV_VAL_END}' AND {whole})"""
    out = []
    for no, (name, feats) in enumerate(RIDGE.items()):
        k, cols = len(feats), [*feats, "temperature"]
        # centred normal equations with the target as last column, then Gauss-Jordan, one pivot after the other
        cells = [f"SUM({cols[i]} * {cols[j]}) - SUM({cols[i]}) * SUM({cols[j]}) / COUNT(*){' + 1.0' if i == j else ''} AS c{i}_{j}"
                 for i in range(k) for j in range(k + 1)]
        means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
        sql += f",\ns{no}_0 AS (SELECT {', '.join(cells)} FROM tr)"
        for p in range(k):
            step = [f"c{i}_{j} / c{p}_{p} AS c{i}_{j}" if i == p else f"c{i}_{j} - c{i}_{p} * c{p}_{j} / c{p}_{p} AS c{i}_{j}"
                    for i in range(k) for j in range(k + 1)]
            sql += f",\ns{no}_{p + 1} AS (SELECT {', '.join(step)} FROM s{no}_{p})"
        e = "temperature - m" + str(k) + "".join(f" - c{i}_{k} * ({feats[i]} - m{i})" for i in range(k))
        sql += f",\ne{no} AS (SELECT temperature AS y, {e} AS e FROM te, s{no}_{k}, (SELECT {means} FROM tr))"
        out.append(f"SELECT '{name}' AS scenario, {k} AS n_features, COUNT(*) AS n, ROUND(sqrt(avg(e * e)), 6) AS rmse, "
                   f"ROUND(avg(abs(e)), 6) AS mae, ROUND(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM e{no}")
    return sql + "\n" + " UNION ALL ".join(out)


@query("ridge_scenarios", _ridge_sql())
def q_ridge_scenarios(spark, d):
    """M01 + M03: ridge for four scenarios of a lag table, solved from one pass of cross-products."""
    f = _corr_f(spark, d)
    train, test = (f.where(S.split_predicate("datetime", k, EV_TRAIN_END, EV_VAL_END)) for k in ("train", "test"))
    return round_doubles(G.ridge_scenarios(train, test, RIDGE, "temperature", 1.0))


# --------------------------------------------------------- sinks and readers
@query("sink_parquet", f"""WITH {OBS_SQL} SELECT {SPLIT_SQL} AS split, climate_zone, COUNT(*) AS n, ROUND(SUM(temperature), 4) AS total FROM obs GROUP BY ALL""")
def q_sink_parquet(spark, d):
    """Splits written partitioned by split and zone, and read back."""
    path = work_path(spark, "splits")
    SK.write_parquet(obs_split(spark, d), path, ["split", "climate_zone"])
    back = spark.read.parquet(path)
    return back.groupBy("split", "climate_zone").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("temperature"), 4).alias("total"))


@query("sink_csv", f"""WITH {OBS_SQL} SELECT station_id, COUNT(*) AS n, ROUND(avg(temperature), 6) AS mean FROM obs GROUP BY station_id""")
def q_sink_csv(spark, d):
    """S07 + S08: a table per station written as CSV and read with its schema."""
    path = work_path(spark, "csv")
    g = observations(spark, d).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.avg("temperature").alias("mean"))
    SK.write_csv(g, path)
    return round_doubles(FL.read_csv(spark, path, "station_id long, n long, mean double"))


@query("sink_json", f"""WITH {OBS_SQL} SELECT event_id, climate_zone, CASE WHEN dewpoint >= 5 THEN temperature END AS temperature FROM obs""")
def q_sink_json(spark, d):
    """S10 + S09: rows written as JSON lines, NULL fields kept, and read back."""
    path = work_path(spark, "json")
    o = observations(spark, d).select("event_id", "climate_zone", F.when(F.col("dewpoint") >= 5, F.col("temperature")).alias("temperature"))
    SK.write_json(o, path)
    return FL.read_json(spark, path, "event_id long, climate_zone string, temperature double", multiline=False)


@query("json_map", f"""WITH {OBS_SQL} SELECT climate_zone, COUNT(*) AS n, ROUND(min(temperature), 6) AS lo, ROUND(max(temperature), 6) AS hi FROM obs GROUP BY climate_zone""")
def q_json_map(spark, d):
    """S10 + S09 in the map shape: one document keyed by zone (five entries), and its rows again."""
    path = work_path(spark, "map")
    g = observations(spark, d).groupBy("climate_zone").agg(F.count(F.lit(1)).alias("n"), F.min("temperature").alias("lo"), F.max("temperature").alias("hi"))
    SK.to_json_map(g, "climate_zone", ["n", "lo", "hi"]).write.text(path)
    return round_doubles(FL.read_json_map(spark, path, "struct<n: bigint, lo: double, hi: double>", "climate_zone"))


@query("params_roundtrip", GAPS_SQL + """ SELECT event_id, ROUND(temperature, 6) AS temperature, ROUND(dewpoint, 6) AS dewpoint FROM imp""")
def q_params_roundtrip(spark, d):
    """Train medians saved, restored and applied."""
    g, cols, path = with_gaps(spark, d), ["temperature", "dewpoint"], work_path(spark, "params")
    SK.save_params(P.fit_impute(g.where(S.split_predicate("datetime", "train", EV_TRAIN_END, EV_VAL_END)), cols), path)
    return round_doubles(P.apply_impute(g, SK.load_params(spark, path), cols).select("event_id", *cols))


@query("resolve_files", f"""WITH {OBS_SQL},
f AS (SELECT DISTINCT station_id, CAST(datetime AS DATE) AS day FROM obs WHERE station_id % 3 <> 2)
SELECT printf('S%05d', s) AS station, CAST(y AS INTEGER) AS year, CASE s % 3 WHEN 0 THEN 1 ELSE 2 END AS priority, COUNT(*) AS n
FROM (SELECT station_id AS s, 2000 + day(day) AS y FROM f WHERE day(day) <= 3) GROUP BY s, y""")
def q_resolve_files(spark, d):
    """S03 + J09: file names of two layouts made from the stations' first days, resolved to one for each station and year."""
    o = observations(spark, d).where((F.col("station_id") % 3 != 2) & (F.dayofmonth("datetime") <= 3))
    days = o.select("station_id", (F.lit(2000) + F.dayofmonth("datetime")).alias("y")).distinct()
    st, y = F.format_string("S%05d", "station_id"), F.col("y").cast("string")
    path = F.when(F.col("station_id") % 3 == 0, F.concat(F.lit("/raw/"), y, F.lit("/"), st, F.lit("-"), y)).otherwise(
        F.concat(F.lit("/raw/"), y, F.lit("/"), st, F.lit("/"), st, F.lit("-"), y))
    stations = observations(spark, d).select(st.alias("station_code")).distinct()
    r = FL.resolve_files(days.select(path.alias("path")), stations, 2001, 2003)
    return r.select("station", "year", F.col("priority").cast("int").alias("priority"), F.lit(1).cast("long").alias("n"))


@query("missing_customer_years", """SELECT c.c_custkey, CAST(y AS INTEGER) AS year FROM customer c, range(1995, 2002) t(y)
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND year(o.o_orderdate) = y)""")
def q_missing_customer_years(spark, d):
    """(customer, year) pairs without an order."""
    found = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year")).distinct()
    return FL.missing_grid(read_table(spark, d, "customer").select("c_custkey"), 1995, 2001, found, "c_custkey")


@query("station_dim_join", """SELECT n.n_name AS station_name, r.r_name AS state, COUNT(*) AS n
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""")
def q_station_dim_join(spark, d):
    """J01 + S11: records keyed without a dash joined to a dimension whose codes have one."""
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    dim = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left").select(
        F.format_string("7%02d-%03d", F.col("n_nationkey"), F.col("n_nationkey") * 7).alias("station_code"),
        F.col("n_name").alias("station_name"), F.col("r_name").alias("state"))
    c = read_table(spark, d, "customer").select(F.format_string("7%02d%03d", F.col("c_nationkey"), F.col("c_nationkey") * 7).alias("station_id"))
    return FL.with_station_dim(c, dim).groupBy("station_name", "state").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------- feature selection
SELECT_SQL = f"""WITH {OBS_SQL}, h AS (SELECT *, {RH_SQL} AS relative_humidity, CAST(hour(datetime) AS INTEGER) AS hour, CAST(year(datetime) AS INTEGER) AS year,
  sin(2 * pi() * hour(datetime) / 24.0) AS hour_sin, lag(temperature, 3) OVER ({W_SQL}) AS temperature_lag_3h,
  lag(temperature, 24) OVER ({W_SQL}) AS temperature_lag_24h FROM obs)"""
SELECTED = {"numeric": ["event_id", "dewpoint", "relative_humidity", "hour_sin", "temperature_lag_3h", "temperature_lag_24h"],
            "strategic": ["temperature", "hour", "year", "hour_sin", "temperature_lag_3h"],
            "present": ["temperature", "hour_sin"], "categorical": ["climate_zone"]}


@query("select_features", SELECT_SQL + " " + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, '{c}' AS feature, COUNT({c}) AS n FROM h" for rule, cs in SELECTED.items() for c in cs))
def q_select_features(spark, d):
    """The features each rule selects, with their number of values."""
    o = D.humidity_and_heat(observations(spark, d)).drop("heat_index")
    f = FE.lags(o, OBS_SPEC, ("temperature",), (3, 24)).withColumn("hour", F.hour("datetime")).withColumn("year", F.year("datetime"))
    f = f.withColumn("hour_sin", F.sin(F.lit(2 * 3.141592653589793) * F.hour("datetime") / F.lit(24.0)))
    rules = {"numeric": P.numeric_features(f), "strategic": P.strategic_features(f, ["temperature"]),
             "present": P.select_present(f, ["temperature", "wind", "hour_sin"]).columns, "categorical": P.categorical_features(f)}
    names = list(dict.fromkeys(c for cs in rules.values() for c in cs))
    counts = f.agg(*[F.count(c).alias(c) for c in names])
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("feature"), F.col(c).alias("n")) for r, cs in rules.items() for c in cs]
    return counts.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


@query("sentinels", f"""WITH {OBS_SQL} SELECT event_id, CASE WHEN dewpoint IN (0, 50, 99) THEN NULL ELSE dewpoint END AS dewpoint,
  CASE WHEN climate_zone = 'error' THEN NULL ELSE climate_zone END AS climate_zone FROM obs""")
def q_sentinels(spark, d):
    """sentinel codes become NULL."""
    o = observations(spark, d).select("event_id", "dewpoint", "climate_zone")
    return D.null_sentinels(o, {"dewpoint": [0.0, 50.0, 99.0], "climate_zone": ["error"]})


# --------------------------------------------------------------- evaluation
@query("sequence_truth", f"""WITH {OBS_SQL},
s AS (SELECT event_id, station_id, temperature AS y, avg(temperature) OVER ({W_SQL} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS y_hat,
        row_number() OVER ({W_SQL}) AS rn, COUNT(*) OVER ({W_SQL} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m FROM obs)
SELECT station_id, COUNT(*) AS n, ROUND(avg(abs(y - y_hat)), 4) AS mae FROM s WHERE m = 6 AND y IS NOT NULL AND y_hat IS NOT NULL GROUP BY station_id""")
def q_sequence_truth(spark, d):
    """Predictions made from sequences, joined to their truth by key."""
    o = observations(spark, d)
    s = SQ.sequences(o, OBS_SPEC, ["temperature"], "temperature", 6)
    pred = s.select("station_id", "datetime", "event_id", (F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0].cast("double")) / 6).alias("y_hat"))
    j = pred.join(o.select("station_id", "datetime", "event_id", "temperature"), ["station_id", "datetime", "event_id"])
    m = M.regression_metrics(j, "temperature", "y_hat", ["station_id"])
    return m.select("station_id", "n", rnd("mae", 4).alias("mae"))


@query("mape_policies", REG_SQL + """,
e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE temperature END AS y FROM ok)
SELECT split, ROUND(avg(abs((y - y_hat) / y)) FILTER (WHERE y <> 0) * 100.0, 4) AS skip,
  ROUND(ln(1 + avg(abs((y - y_hat) / (y + 1e-10))) * 100.0), 4) AS log_eps, isinf(avg(CASE WHEN y = 0 THEN 'inf'::DOUBLE ELSE abs((y - y_hat) / y) END)) AS plain_infinite
FROM e GROUP BY split""")
def q_mape_policies(spark, d):
    """The three policies for zero truths (one truth in fifty is zero)."""
    r = reg_scored(spark, d).where(F.col("temperature").isNotNull() & F.col("y_hat").isNotNull())
    r = r.withColumn("y", F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("temperature")))
    g = r.groupBy("split").agg(M.mape(r, "y", "y_hat", "skip").alias("skip"), M.mape(r, "y", "y_hat", "eps").alias("eps"),
                               M.mape(r, "y", "y_hat", "plain").alias("plain"))
    return g.select("split", rnd("skip", 4).alias("skip"), rnd(F.log1p("eps"), 4).alias("log_eps"), (F.col("plain") == float("inf")).alias("plain_infinite"))


@query("weighted_ce", SCORED_SQL + """,
p AS (SELECT y5, CASE y5 WHEN 0 THEN 0.6 WHEN 1 THEN 0.05 WHEN 2 THEN 0.15 WHEN 3 THEN 0.05 ELSE 0.15 END AS py,
  CASE y5 WHEN 0 THEN 0.25 WHEN 1 THEN 3.0 WHEN 2 THEN 1.5 WHEN 3 THEN 3.0 ELSE 1.5 END AS w FROM sc)
SELECT COUNT(*) AS n, ROUND(avg(w * -ln(py)), 6) AS weighted_ce FROM p""")
def q_weighted_ce(spark, d):
    """Class-weighted cross-entropy of a constant forecast of class shares."""
    s = scored(spark, d).withColumn("probs", F.array(*[F.lit(x) for x in (0.6, 0.05, 0.15, 0.05, 0.15)]))
    return s.agg(F.count(F.lit(1)).alias("n"), rnd(M.weighted_ce("y5", "probs", {0: 0.25, 1: 3.0, 2: 1.5, 3: 3.0, 4: 1.5})).alias("weighted_ce"))


@query("model_efficiency", REG_SQL + """,
m AS (SELECT split, sqrt(avg((temperature - y_hat) * (temperature - y_hat))) AS rmse, COUNT(*) / 1000.0 AS minutes FROM ok GROUP BY split)
SELECT split, ROUND(rmse, 6) AS rmse, ROUND((1.0 / rmse) / (minutes + 1), 6) AS efficiency FROM m""")
def q_model_efficiency(spark, d):
    """Accuracy for the time spent (a minute for each thousand rows scored)."""
    m = M.regression_metrics(reg_scored(spark, d), "temperature", "y_hat", ["split"]).withColumn("minutes", F.col("n") / 1000.0)
    return round_doubles(C.efficiency(m).select("split", "rmse", "efficiency"))


# --------------------------------------------------------- rules and ontology
@query("alerts_theta", TOP_SQL + """
SELECT event_id, event_inferred, severity_inferred, alert_level_inferred, confidence_inferred, rule_triggered FROM t""")
def q_alerts_theta(spark, d):
    """The top alert of each row by a range join with the rule table."""
    r = R.infer_theta(rolled(spark, d), ["event_id"], "temp_rolling_48h", spark)
    return r.select("event_id", "event_inferred", "severity_inferred", "alert_level_inferred", F.col("confidence_inferred").alias("confidence_inferred"), "rule_triggered")


@query("alerts_from_table", TOP_SQL + """ SELECT event_id, event_inferred, rule_triggered FROM t""")
def q_alerts_from_table(spark, d):
    """The rule catalogue written, read back and compiled again."""
    path = work_path(spark, "rules")
    R.rules_table(spark).write.parquet(path)
    a = R.infer_top(rolled(spark, d), R.rules_from_table(spark.read.parquet(path)))
    return a.select("event_id", "event_inferred", "rule_triggered")


@query("station_alert_history", TOP_SQL + """
SELECT station_id, datetime, event_id, event_inferred FROM t WHERE rule_triggered <> 'NONE' AND station_id = 7
  AND datetime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'""")
def q_station_alert_history(spark, d):
    """The alerts of one station between two times."""
    a = inferred(spark, d).where(F.col("rule_triggered") != "NONE")
    t0, t1 = (F.to_timestamp_ntz(F.lit(f"2024-01-{x} 00:00:00")) for x in ("05", "25"))
    return R.alert_history(a, 7, t0, t1).select("station_id", "datetime", "event_id", "event_inferred")


# parent, alias and relation edges, written out for the oracle
EDGES = [("Canicule", "EvenementClimatique"), ("VagueFroid", "EvenementClimatique"), ("Secheresse", "EvenementClimatique"),
         ("PrecipitationIntense", "EvenementClimatique"), ("Canicule", "Heatwave"), ("Canicule", "Chaleur_extreme"), ("Canicule", "Forte_chaleur"),
         ("VagueFroid", "Cold_wave"), ("VagueFroid", "Grand_froid"), ("Secheresse", "Drought"), ("PrecipitationIntense", "Heavy_rain"),
         ("PrecipitationIntense", "Pluie_diluvienne"), ("Secheresse", "Canicule"), ("Canicule", "Incendie_foret"), ("Vent_fort", "Canicule"),
         ("Humidite_haute", "Canicule"), ("Vent_fort", "VagueFroid"), ("Secheresse", "Incendie"), ("Chaleur", "Orage")]


@query("alert_closure", TOP_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e(a, b) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + """),
near(a, b) AS (SELECT a, b FROM e UNION SELECT near.a, e.b FROM near JOIN e ON near.b = e.a)
SELECT near.b AS reached, COUNT(*) AS n FROM t JOIN near ON upper(replace(near.a, '_', '')) = replace(t.event_inferred, '_', '') GROUP BY near.b""")
def q_alert_closure(spark, d):
    """Alerts counted by every concept that their own leads to over parents, aliases and relations."""
    near = R.concept_closure(R.concept_edges(spark).where(~F.col("kind").isin("impacts", "populations_vulnerables")).select("name", "target"))
    t = inferred(spark, d).select(F.upper(F.regexp_replace("event_inferred", "_", "")).alias("_c"))
    near = near.select(F.upper(F.regexp_replace("name", "_", "")).alias("_c"), F.col("target").alias("reached"))
    return t.join(F.broadcast(near), "_c").groupBy("reached").agg(F.count(F.lit(1)).alias("n"))
