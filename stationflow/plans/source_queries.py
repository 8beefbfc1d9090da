"""Registered queries for sources (fixed-width round trip), dimension joins,
grids, data-quality extras, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationflow.operators import quality as Q
from stationflow.operators import splits as S
from stationflow.operators import topk as TK
from stationflow.plans.registry import query, rnd, round_doubles
from stationflow.session import work_path
from stationflow.sources import fixed_width as FW
from stationflow.sources.files import missing_grid
from stationflow.sources.tables import OBS_SQL, observations, read_table

# ------------------------------------------------------------- fixed width
# Encoding of the events as station reports: every field is derived from the
# event (k = props.k, v10 = value in tenths) so that sentinels, junk numbers,
# an invalid month and every line-length case occur in the data.


def _encoded(spark, d):
    ev = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    v10 = F.round(F.col("value") * 10).cast("int")
    e = ev.select("user_id", "ts", "event_type", k.alias("k"), (v10 - 250).alias("t10"))
    kk, et = F.col("k"), F.col("event_type")
    ymd = F.date_format("ts", "yyyyMMddHHmm")
    fields = {
        "station": FW.padded(F.col("user_id"), 11),
        "datetime": F.when((et == "error") & (kk >= 95),
                           F.concat(F.substring(ymd, 1, 4), F.lit("13"), F.substring(ymd, 7, 6))).otherwise(ymd),
        "wind_direction": F.when(kk >= 90, F.lit("999")).otherwise(FW.padded(F.pmod(kk * 7, F.lit(360)), 3)),
        "wind_speed": F.when(kk < 3, F.lit("9999")).otherwise(FW.padded(kk * 3, 4)),
        "temperature": F.when((et == "error") & (kk < 20), F.lit("+9999"))
                        .when(kk.between(40, 42), F.lit("ab12x")).otherwise(FW.signed4(F.col("t10"))),
        "dewpoint": F.when(kk >= 97, F.lit("+9999")).otherwise(FW.signed4(kk * 3 - 100)),
        "sea_level_pressure": F.when(kk.between(50, 54), F.lit("99999")).otherwise(FW.padded(kk * 20 + 9000, 5)),
    }
    length = F.when(kk < 5, 99).when(kk < 10, 100).when(kk < 15, 103).otherwise(110)
    return FW.encode_fixed_width(e, fields, length).select("value")


ENC_SQL = """enc AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(round(value * 10) AS INTEGER) - 250 AS t10, strftime(ts, '%Y%m%d%H%M') AS ymd FROM events),
f AS (SELECT *,
  lpad(CAST(user_id AS VARCHAR), 11, '0') AS f_station,
  CASE WHEN event_type = 'error' AND k >= 95 THEN substr(ymd, 1, 4) || '13' || substr(ymd, 7, 6) ELSE ymd END AS f_dt,
  CASE WHEN k >= 90 THEN '999' ELSE lpad(CAST((k * 7) % 360 AS VARCHAR), 3, '0') END AS f_wd,
  CASE WHEN k < 3 THEN '9999' ELSE lpad(CAST(k * 3 AS VARCHAR), 4, '0') END AS f_ws,
  CASE WHEN event_type = 'error' AND k < 20 THEN '+9999' WHEN k BETWEEN 40 AND 42 THEN 'ab12x'
       ELSE (CASE WHEN t10 < 0 THEN '-' ELSE '+' END) || lpad(CAST(abs(t10) AS VARCHAR), 4, '0') END AS f_t,
  CASE WHEN k >= 97 THEN '+9999'
       ELSE (CASE WHEN k * 3 - 100 < 0 THEN '-' ELSE '+' END) || lpad(CAST(abs(k * 3 - 100) AS VARCHAR), 4, '0')
  END AS f_d,
  CASE WHEN k BETWEEN 50 AND 54 THEN '99999' ELSE lpad(CAST(k * 20 + 9000 AS VARCHAR), 5, '0') END AS f_p,
  CASE WHEN k < 5 THEN 99 WHEN k < 10 THEN 100 WHEN k < 15 THEN 103 ELSE 110 END AS len
  FROM enc),
lines AS (SELECT substr('0000' || f_station || f_dt || repeat(' ', 33) || f_wd || '  ' || f_ws || repeat(' ', 18)
                        || f_t || ' ' || f_d || ' ' || f_p || repeat(' ', 6), 1, len) AS v FROM f),
ok AS (SELECT v FROM lines WHERE length(v) >= 100),
dec AS (SELECT trim(substr(v, 5, 11)) AS station_id,
  TRY_CAST(substr(v, 16, 4) AS INTEGER) AS year, TRY_CAST(substr(v, 20, 2) AS INTEGER) AS month,
  TRY_CAST(substr(v, 22, 2) AS INTEGER) AS day, TRY_CAST(substr(v, 24, 2) AS INTEGER) AS hour,
  TRY_CAST(substr(v, 26, 2) AS INTEGER) AS minute,
  trim(substr(v, 88, 5)) AS rt, trim(substr(v, 94, 5)) AS rd, trim(substr(v, 61, 3)) AS rwd,
  trim(substr(v, 66, 4)) AS rws, trim(substr(v, 100, 5)) AS rp, length(v) AS n FROM ok)"""


@query("decode_fixed_width", f"""WITH {ENC_SQL}
SELECT station_id,
  TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:00', year, month, day, hour, minute) AS TIMESTAMP) AS datetime,
  year, month, day, hour, minute,
  CASE WHEN rt IN ('', '+9999') THEN NULL ELSE TRY_CAST(rt AS DOUBLE) / 10.0 END AS temperature,
  CASE WHEN rd IN ('', '+9999') THEN NULL ELSE TRY_CAST(rd AS DOUBLE) / 10.0 END AS dewpoint,
  CASE WHEN rwd IN ('', '999') THEN NULL ELSE TRY_CAST(rwd AS DOUBLE) / 1.0 END AS wind_direction,
  CASE WHEN rws IN ('', '9999') THEN NULL ELSE TRY_CAST(rws AS DOUBLE) / 10.0 END AS wind_speed,
  CASE WHEN n >= 104 THEN (CASE WHEN rp IN ('', '99999') THEN NULL ELSE TRY_CAST(rp AS DOUBLE) / 10.0 END) END
    AS sea_level_pressure
FROM dec
WHERE TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:00', year, month, day, hour, minute) AS TIMESTAMP) IS NOT NULL""")
def q_decode_fixed_width(spark, d):
    """S01 + S02: events encoded as fixed-width reports, written as text to the
    shared work folder, scanned back and decoded."""
    path = work_path(spark, "reports")
    _encoded(spark, d).write.mode("overwrite").text(path)
    lines = FW.read_fixed_width(spark, path)
    return FW.decode_fixed_width(lines)


# --------------------------------------------------------------- dimensions
@query("dim_join", """SELECT r.r_name, n.n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY ALL""")
def q_dim_join(spark, d):
    """Fact ⋈ customer (shuffle join) ⋈ nation ⋈ region. Nation and
    region are fixed-size dimensions (25 and 5 rows), broadcast."""
    o = read_table(spark, d, "orders").select("o_custkey", "o_totalprice")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, d, "region").select("r_regionkey", "r_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"),
                                             rnd(F.sum("o_totalprice"), 2).alias("revenue"))


@query("missing_grid", """WITH grid AS (SELECT n_nationkey, y AS year FROM nation, range(1995, 2002) t(y)),
found AS (SELECT DISTINCT c.c_nationkey AS n_nationkey, CAST(year(o.o_orderdate) AS INTEGER) AS year
          FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority = '1-URGENT')
SELECT n_nationkey, CAST(year AS INTEGER) AS year FROM grid
WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.n_nationkey = grid.n_nationkey AND f.year = grid.year)""")
def q_missing_grid(spark, d):
    """Expected (nation, year) pairs without any urgent order."""
    nation = read_table(spark, d, "nation").select("n_nationkey")
    o = read_table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    c = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    found = (o.join(c, o.o_custkey == c.c_custkey)
             .select("n_nationkey", F.year("o_orderdate").alias("year")).distinct())
    return missing_grid(nation, 1995, 2001, found, "n_nationkey")


# ---------------------------------------------------------- quality extras
@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_duplicate_keys(spark, d):
    """Repeated (order, line) keys."""
    li = read_table(spark, d, "lineitem")
    return Q.duplicate_keys(li, ["l_orderkey", "l_linenumber"])


@query("union_sources", """SELECT * FROM (
  SELECT 'orders' AS source, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n,
    ROUND(SUM(o_totalprice), 2) AS total_price, NULL::DOUBLE AS total_quantity FROM orders GROUP BY ALL
  UNION ALL
  SELECT 'lineitem', CAST(year(l_shipdate) AS INTEGER), COUNT(*), NULL::DOUBLE, ROUND(SUM(l_quantity), 2)
  FROM lineitem GROUP BY ALL)""")
def q_union_sources(spark, d):
    """Union by column name of two sources with different columns."""
    o = read_table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total_price"))
    li = read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("total_quantity"))
    u = (o.select(F.lit("orders").alias("source"), "*")
         .unionByName(li.select(F.lit("lineitem").alias("source"), "*"), allowMissingColumns=True))
    return u.select("source", "year", "n", "total_price", "total_quantity")


LI_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("feature_corr", """SELECT feature, ROUND(r, 6) AS r, ROUND(abs(r), 6) AS abs_r,
  CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' WHEN abs(r) >= 0.1 THEN 'weak'
       ELSE 'negligible' END AS strength FROM (
  SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)""")
def q_feature_corr(spark, d):
    """Correlation of each feature with the target, bucketed."""
    li = read_table(spark, d, "lineitem")
    return round_doubles(Q.feature_corr(li, LI_COLS, "l_extendedprice"))


@query("outliers", """WITH st AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
  avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, avg(l_tax) AS mt, stddev_pop(l_tax) AS stt
  FROM lineitem)
SELECT feature, n_outliers, ROUND(n_outliers * 100.0 / n, 6) AS pct FROM (
  SELECT 'l_quantity' AS feature, COUNT(*) FILTER (WHERE abs((l_quantity - mq) / sq) > 3) AS n_outliers,
    COUNT(*) AS n FROM lineitem, st
  UNION ALL SELECT 'l_extendedprice', COUNT(*) FILTER (WHERE abs((l_extendedprice - mp) / sp) > 3), COUNT(*)
    FROM lineitem, st
  UNION ALL SELECT 'l_tax', COUNT(*) FILTER (WHERE abs((l_tax - mt) / stt) > 3), COUNT(*) FROM lineitem, st)""")
def q_outliers(spark, d):
    """Rows with |z| > 3 per column."""
    li = read_table(spark, d, "lineitem")
    return round_doubles(Q.outliers(li, ["l_quantity", "l_extendedprice", "l_tax"]))


@query("correlated_pairs", """SELECT a, b, ROUND(r, 6) AS r FROM (
  SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem
  UNION ALL SELECT 'l_discount', 'l_tax', corr(l_discount, l_tax) FROM lineitem) WHERE abs(r) > 0.5""")
def q_correlated_pairs(spark, d):
    """Highly correlated column pairs (|r| > 0.5)."""
    li = read_table(spark, d, "lineitem")
    return round_doubles(Q.correlated_pairs(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.5))


@query("histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT CAST(LEAST(FLOOR((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, lo, hi
      FROM lineitem, b WHERE l_extendedprice IS NOT NULL)
SELECT bin, ROUND(lo + bin * ((hi - lo) / 50), 6) AS bin_lo, ROUND(lo + (bin + 1) * ((hi - lo) / 50), 6) AS bin_hi,
  COUNT(*) AS n FROM h GROUP BY bin, lo, hi""")
def q_histogram(spark, d):
    """50 equal-width bins of the extended price."""
    li = read_table(spark, d, "lineitem")
    return round_doubles(Q.histogram(li, "l_extendedprice", 50))


# ------------------------------------------------------------ top-k, sample
@query("topk_extremes", f"""WITH {OBS_SQL},
h AS (SELECT station_id, 'hot' AS kind, event_id, temperature,
        row_number() OVER (PARTITION BY station_id ORDER BY temperature ASC, datetime, event_id) AS rank
      FROM obs WHERE temperature >= 40.0),
c AS (SELECT station_id, 'cold' AS kind, event_id, temperature,
        row_number() OVER (PARTITION BY station_id ORDER BY temperature DESC, datetime, event_id) AS rank
      FROM obs WHERE temperature <= -10.0)
SELECT station_id, kind, CAST(rank AS INTEGER) AS rank, event_id, ROUND(temperature, 6) AS temperature
FROM (SELECT * FROM h UNION ALL SELECT * FROM c) WHERE rank <= 5""")
def q_topk_extremes(spark, d):
    """Per station the 5 mildest readings ≥ 40 and ≤ −10."""
    o = observations(spark, d)
    hot = TK.top_k(o.where(F.col("temperature") >= 40.0), ["station_id"],
                   [F.col("temperature").asc(), F.col("datetime"), F.col("event_id")], 5)
    cold = TK.top_k(o.where(F.col("temperature") <= -10.0), ["station_id"],
                    [F.col("temperature").desc(), F.col("datetime"), F.col("event_id")], 5)
    out = hot.select("station_id", F.lit("hot").alias("kind"), "rank", "event_id", "temperature").unionByName(
        cold.select("station_id", F.lit("cold").alias("kind"), "rank", "event_id", "temperature"))
    return round_doubles(out)


@query("first_per_class", f"""WITH {OBS_SQL}
SELECT CASE WHEN temperature >= 33.0 THEN 1 WHEN temperature <= -5.0 THEN 2 ELSE 0 END AS extreme_event,
  arg_min(event_id, (datetime, event_id)) AS event_id, min(datetime) AS datetime
FROM obs GROUP BY 1""")
def q_first_per_class(spark, d):
    """First example row per class (aggregate min_by, no sort of the class)."""
    from stationflow.operators.labels import label_fixed
    lab = label_fixed(observations(spark, d))
    return TK.first_per(lab, ["extreme_event"], ["datetime", "event_id"], ["event_id", "datetime"])


@query("sample_det", f"""WITH {OBS_SQL} SELECT station_id, event_id, temperature FROM obs
ORDER BY md5(concat_ws(':', '42', station_id, event_id)), station_id, event_id LIMIT 1000""")
def q_sample_det(spark, d):
    """Reproducible bottom-k sample of 1,000 rows by key hash (the sampling is the feature)."""
    o = observations(spark, d)
    return S.sample_det(o, ["station_id", "event_id"], 1000, 42).select("station_id", "event_id", "temperature")
