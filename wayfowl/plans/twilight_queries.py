"""Queries over light series and events."""

from pyspark.sql import functions as F

from wayfowl.functions.tracks import hour_of_day
from wayfowl.operators import twilights as tw

from .register import query

THR = 50.0

CROSS = """
WITH s AS (SELECT *, lag(lux) OVER w AS l0, US(ts) AS u, lag(US(ts)) OVER w AS u0 FROM v_light WINDOW w AS (PARTITION BY trip_id ORDER BY ts, ord)),
c AS (SELECT trip_id, ord, u0 + CAST(round((50.0::DOUBLE - l0) / (lux - l0) * (u - u0)) AS BIGINT) AS u, CASE WHEN lux >= 50 THEN 1 ELSE 2 END AS type
  FROM s WHERE l0 IS NOT NULL AND (l0 < 50) <> (lux < 50)),
f AS (SELECT *, (type = 2 AND coalesce(lead(type) OVER w = 1 AND lead(u) OVER w - u < 900000000, false)) OR (type = 1 AND coalesce(lag(type) OVER w = 2 AND u - lag(u) OVER w < 900000000, false)) AS gone
  FROM c WINDOW w AS (PARTITION BY trip_id ORDER BY u, ord)),
e AS (SELECT trip_id, ord, u, make_timestamp(u) AS ts, type FROM f WHERE NOT gone)
"""


HOUR = "((hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INT)) / 3600.0::DOUBLE)"


def events(v):
    return tw.threshold_crossings(v("light"), THR)


@query("c1_threshold_crossings", CROSS + "SELECT trip_id, u AS ts, ord, type FROM e")
def c1(v):
    return events(v)


@query("c2_pair_twilights", CROSS + ", p AS (SELECT *, lead(u) OVER (PARTITION BY trip_id ORDER BY u, ord) AS n FROM e) SELECT trip_id, ord, u AS tFirst, n AS tSecond, type, u AS ts FROM p WHERE n IS NOT NULL")
def c2(v):
    return tw.pair_twilights(events(v))


REPAIR = """
WITH e AS (SELECT trip_id, ts, ord, type FROM v_dates),
r AS (SELECT *, CASE WHEN type IS DISTINCT FROM lag(type) OVER w THEN 1 ELSE 0 END AS ch FROM e WINDOW w AS (PARTITION BY trip_id ORDER BY ts, ord)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY trip_id ORDER BY ts, ord) AS run FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY trip_id, run ORDER BY ts, ord) - 1 AS k, count(*) OVER (PARTITION BY trip_id, run) AS n FROM g)
"""


@query("c3_repair_types", REPAIR + "SELECT trip_id, ord, US(ts) AS ts, CAST(CASE WHEN k % 2 = 1 AND k < n - 1 THEN 3 - type ELSE type END AS INT) AS type FROM h")
def c3(v):
    return tw.repair_types(v("dates"))


@query("c4_shift_minute", CROSS + ", p AS (SELECT *, lead(u) OVER (PARTITION BY trip_id ORDER BY u, ord) AS n FROM e) SELECT trip_id, ord, u + CASE WHEN type = 2 THEN 60000000 ELSE 0 END AS tFirst, n + CASE WHEN type = 1 THEN 60000000 ELSE 0 END AS tSecond, type FROM p WHERE n IS NOT NULL")
def c4(v):
    return tw.shift_minute(tw.pair_twilights(events(v))).drop("ts")


CONF = "least(abs(date_diff('day', make_date(year(d), 9, 23), d)), abs(date_diff('day', make_date(year(d), 3, 21), d)))"


@query("c5_event_confidence", f"WITH e AS (SELECT *, CAST(ts AS DATE) AS d FROM v_dates) SELECT trip_id, ord, US(ts) AS ts, type, CASE WHEN {CONF} <= 10 THEN 1 WHEN {CONF} <= 20 THEN 2 ELSE 9 END AS confidence FROM e")
def c5(v):
    return tw.event_confidence(v("dates"))


@query("c6_rise_julian", "SELECT trip_id, ord, US(ts) AS ts, type, type = 1 AS rise, CAST(dayofyear(ts) AS INT) AS julian FROM v_dates")
def c6(v):
    return tw.rise_julian(v("dates"))


#: The nearest rows by rank, here; the operator slides a window.
LOCAL = CROSS + f""", a AS (SELECT trip_id, type, ord, u, {HOUR} AS value, greatest(5, CAST(floor(count(*) OVER (PARTITION BY trip_id, type) * 0.05::DOUBLE + 1e-5) AS BIGINT)) AS q FROM e),
n AS (SELECT a.trip_id, a.type, a.ord, a.value, CAST(b.u - a.u AS DOUBLE) AS d, b.value AS y, a.q, row_number() OVER (PARTITION BY a.trip_id, a.type, a.ord ORDER BY abs(b.u - a.u), b.u, b.ord) AS k FROM a JOIN a b ON a.trip_id = b.trip_id AND a.type = b.type),
m AS (SELECT *, max(abs(d)) OVER (PARTITION BY trip_id, type, ord) AS h FROM n WHERE k <= q),
z AS (SELECT * REPLACE (CASE WHEN h > 0 THEN d / h ELSE 0 END AS d), pow(1 - pow(CASE WHEN h > 0 THEN abs(d) / h ELSE 0 END, 3), 3) AS w FROM m),
g AS (SELECT trip_id, type, ord, any_value(value) AS value, avg(y) AS mean, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * d * d * d) AS s3, sum(w * d * d * d * d) AS s4, sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d * d * y) AS t2 FROM z GROUP BY 1, 2, 3),
k AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM g),
sm AS (SELECT *, CASE WHEN abs(det) > 1e-9 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det WHEN s0 > 0 THEN t0 / s0 ELSE mean END AS smooth FROM k)
"""


@query("c7_loess_filter_flag", LOCAL + ", rs AS (SELECT *, round(abs(value - smooth), 9) AS r FROM sm), q AS (SELECT trip_id, type, quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS iqr FROM rs GROUP BY 1, 2) SELECT rs.trip_id, rs.type, ord, round(r - 3 * iqr, 6) > 0 AS loess_flag FROM rs JOIN q ON rs.trip_id = q.trip_id AND rs.type = q.type")
def c7(v):
    return tw.loess_filter_flag(events(v)).select("trip_id", "type", "ord", "loess_flag")


#: Row by row, with the last kept position carried along.
SPEED = """
WITH RECURSIVE p AS (SELECT t.trip_id, ord, US(ts) AS u, x * 3 - 75 AS lon, y / 2 AS lat, row_number() OVER (PARTITION BY trip_id ORDER BY ts, ord) AS i FROM v_track t),
f AS (
  SELECT trip_id, i, ord, u AS u0, lon AS lon0, lat AS lat0, false AS flag FROM p WHERE i = 1
  UNION ALL
  SELECT trip_id, i, ord, CASE WHEN flag THEN u0 ELSE u END, CASE WHEN flag THEN lon0 ELSE lon END, CASE WHEN flag THEN lat0 ELSE lat END, flag FROM (
    SELECT p.*, u0, lon0, lat0, p.u > u0 AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - lon0) / 2), 2)))) > 50 * ((p.u - u0) / 3.6e9) AS flag
    FROM f JOIN p ON p.trip_id = f.trip_id AND p.i = f.i + 1
  )
)
SELECT trip_id, ord, flag AS speed_flag FROM f
"""


@query("c8_speed_filter_flag", SPEED)
def c8(v):
    p = v("track").select("trip_id", "ord", "ts", (F.col("x") * 3 - 75).alias("lon"), (F.col("y") / 2).alias("lat"))
    return tw.speed_filter_flag(p, 50.0).select("trip_id", "ord", "speed_flag")


SAME = CROSS + """, d AS (SELECT *, count(*) OVER w AS n, max(u) OVER w - min(u) OVER w AS span FROM e WINDOW w AS (PARTITION BY trip_id, type, CAST(ts AS DATE))),
r AS (SELECT *, n > 1 AND NOT (n = 2 AND span > 79200000000) AS remove FROM d)
"""


@query("d1_flag_same_day", SAME + "SELECT trip_id, ord, u AS ts, type, remove FROM r")
def d1(v):
    return tw.flag_same_day(events(v))


@query("twilight_flagship", SAME + ", p AS (SELECT trip_id, ord, u, type, dayofyear(ts) AS julian, lead(u) OVER (PARTITION BY trip_id ORDER BY u, ord) AS n, remove FROM r) SELECT trip_id, ord, type, u AS tFirst, CASE WHEN remove THEN NULL ELSE 1 END AS kept, CAST(julian AS INT) AS julian FROM p WHERE NOT remove")
def flagship(v):
    e = tw.rise_julian(tw.flag_same_day(events(v)).where(~F.col("remove")))
    return e.select("trip_id", "ord", "type", F.col("ts").alias("tFirst"), F.lit(1).alias("kept"), "julian")


@query("d2_rolling_sd", CROSS + ", m AS (SELECT *, coalesce(stddev_samp(hour(ts) * 60 + minute(ts)) OVER (PARTITION BY trip_id, type ORDER BY u, ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 10000) AS sd FROM e) SELECT trip_id, ord, type, round(sd, 6) AS sd, sd < 60 AS usable FROM m")
def d2(v):
    return tw.rolling_sd(events(v)).select("trip_id", "ord", "type", "sd", "usable")




@query("d3_unwrap_hours", CROSS + f""", h AS (SELECT trip_id, type, u, ord, i, ({HOUR} + i) % 24 AS s FROM e CROSS JOIN range(24) t(i)),
j AS (SELECT trip_id, type, i, abs(s - lag(s) OVER (PARTITION BY trip_id, type, i ORDER BY u, ord)) AS d FROM h),
m AS (SELECT trip_id, type, i, coalesce(round(max(d), 2), 0) AS jump FROM j GROUP BY ALL)
SELECT trip_id, type, CAST(arg_min(i, jump * 1000 + i / 1000.0) AS INT) AS shift, min(jump) AS jump FROM m GROUP BY ALL""")
def d3(v):
    return tw.unwrap_hours(events(v))


@query("d4_local_regression", LOCAL + "SELECT trip_id, type, ord, round(value, 6) AS value, round(smooth, 6) AS smooth FROM sm")
def d4(v):
    return tw.local_regression(events(v).withColumn("value", hour_of_day("ts"))).select("trip_id", "type", "ord", "value", "smooth")


GRID = """
, g AS (SELECT trip_id, type, CAST(ts AS DATE) AS day, min(u) AS u FROM e GROUP BY ALL),
b AS (SELECT trip_id, type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM g GROUP BY trip_id, type)
"""


@query("d5_daily_grid", CROSS + GRID + "SELECT b.trip_id, b.type, CAST(CAST(b.day AS DATE) AS VARCHAR) AS day, g.u AS ts FROM b LEFT JOIN g ON b.trip_id = g.trip_id AND b.type = g.type AND CAST(b.day AS DATE) = g.day")
def d5(v):
    return tw.daily_grid(events(v))


FILL = """
WITH s AS (SELECT trip_id, ord, ts, CASE WHEN ord % 3 = 0 OR ord % 17 < 7 THEN NULL ELSE y END AS y FROM v_track),
n AS (SELECT *, row_number() OVER w AS i, CASE WHEN y IS NULL THEN NULL ELSE avg(y) OVER (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS b,
  CASE WHEN y IS NULL THEN NULL ELSE avg(y) OVER (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS a FROM s WINDOW w AS (PARTITION BY trip_id ORDER BY ts, ord)),
k AS (SELECT *, CASE WHEN y IS NULL THEN NULL ELSE i END AS k FROM n),
m AS (SELECT *, last_value(b IGNORE NULLS) OVER p AS b0, last_value(k IGNORE NULLS) OVER p AS k0, first_value(a IGNORE NULLS) OVER f AS a1, first_value(k IGNORE NULLS) OVER f AS k1 FROM k
  WINDOW p AS (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT trip_id, ord, round(CASE WHEN y IS NULL AND k1 - k0 - 1 <= 5 THEN b0 + (a1 - b0) * (i - k0) / (k1 - k0) ELSE y END, 6) AS y FROM m
"""


@query("d6_fill_gaps", FILL)
def d6(v):
    s = v("track").select("trip_id", "ord", "ts", F.when((F.col("ord") % 3 == 0) | (F.col("ord") % 17 < 7), None).otherwise(F.col("y")).alias("y"))
    return tw.fill_gaps(s, "y", 3, 5).select("trip_id", "ord", "y")


PRED = CROSS + f", g AS (SELECT trip_id, type, CAST(ts AS DATE) AS day, arg_min({HOUR}, u) AS pred FROM e GROUP BY ALL)"


def predictions(v):
    return events(v).select("trip_id", "type", F.to_date("ts").alias("day"), "ts", hour_of_day("ts").alias("pred"))


@query("d7_join_prediction", PRED + " SELECT e.trip_id, e.ord, e.type, round(g.pred, 6) AS pred FROM e LEFT JOIN g ON e.trip_id = g.trip_id AND e.type = g.type AND CAST(e.ts AS DATE) = g.day")
def d7(v):
    return tw.join_prediction(events(v), predictions(v)).select("trip_id", "ord", "type", "pred")


@query("d9_prediction_fallback", """
WITH p AS (SELECT trip_id, ord, type, CAST(ts AS DATE) AS day, CASE WHEN ord % 4 = 0 THEN NULL ELSE (ord % 2300) / 100.0::DOUBLE END AS pred, CAST(ord % 24 AS INT) AS shift FROM v_dates),
b AS (SELECT *, abs(pred - shift) AS k, epoch_us(CAST(day AS TIMESTAMP)) AS d0 FROM p),
h AS (SELECT *, CASE WHEN k > 24 THEN 48 - k ELSE k END AS h FROM b)
SELECT trip_id, ord, coalesce(d0 + CAST(floor(h * 60) * 60000000 AS BIGINT), CASE WHEN month(day) BETWEEN 5 AND 8 THEN CASE WHEN type = 1 THEN d0 + 18000000000 ELSE d0 + 72000000000 END END) AS pred_ts FROM h""")
def d9(v):
    p = v("dates").select("trip_id", "ord", "type", F.to_date("ts").alias("day"), F.when(F.col("ord") % 4 == 0, None).otherwise((F.col("ord") % 2300) / F.lit(100.0)).alias("pred"), (F.col("ord") % 24).cast("int").alias("shift"))
    p = p.withColumn("dawn", F.expr("CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR")).withColumn("dusk", F.expr("CAST(day AS TIMESTAMP) + INTERVAL 20 HOUR"))
    return tw.prediction_fallback(p).select("trip_id", "ord", "pred_ts")


RESCUE = SAME + f""", q AS (SELECT *, (ord % 240) / 10.0::DOUBLE AS pred FROM r),
a AS (SELECT *, abs(({HOUR} - pred) * 3600) AS ap FROM q),
z AS (SELECT *, row_number() OVER (PARTITION BY trip_id, type, CAST(ts AS DATE), remove ORDER BY round(least(ap, 86400 - ap), 6), u, ord) AS k FROM a)
"""


def rescued(v):
    return tw.rescue_nearest(tw.flag_same_day(events(v)).withColumn("pred", (F.col("ord") % 240) / F.lit(10.0)))


BORROW = CROSS + f""", p AS (SELECT trip_id, ord, type, u, ts, CAST(ts AS DATE) AS day, CASE WHEN ord % 3 = 0 THEN {HOUR} END AS pred FROM e),
n AS (SELECT *, last_value(CASE WHEN pred IS NOT NULL THEN day END IGNORE NULLS) OVER b AS bd, last_value(pred IGNORE NULLS) OVER b AS bp, first_value(CASE WHEN pred IS NOT NULL THEN day END IGNORE NULLS) OVER f AS ad, first_value(pred IGNORE NULLS) OVER f AS ap FROM p
  WINDOW b AS (PARTITION BY trip_id, type ORDER BY u, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY trip_id, type ORDER BY u, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
"""


@query("d10_borrow_prediction", BORROW + "SELECT trip_id, ord, type, round(coalesce(pred, CASE WHEN day - bd <= 1 AND (ad IS NULL OR day - bd <= ad - day) THEN bp WHEN ad - day <= 1 THEN ap END), 6) AS pred FROM n")
def d10b(v):
    e = events(v).withColumn("pred", F.when(F.col("ord") % 3 == 0, hour_of_day("ts")))
    return tw.borrow_prediction(e, (1,), 1).select("trip_id", "ord", "type", "pred")


@query("d10_rescue_nearest", RESCUE + "SELECT trip_id, ord, type, remove AND k <> 1 AS remove FROM z")
def d10(v):
    return rescued(v).select("trip_id", "ord", "type", "remove")


@query("d11_rechain", RESCUE + ", o AS (SELECT trip_id, ord, u AS tFirst, lead(u) OVER (PARTITION BY trip_id ORDER BY u, ord) AS n, u + 1000000 AS own FROM z WHERE NOT (remove AND k <> 1)) SELECT trip_id, ord, tFirst, coalesce(n, own) AS tSecond FROM o")
def d11(v):
    pairs = rescued(v).select("trip_id", "ord", "remove", F.col("ts").alias("tFirst"), F.expr("ts + INTERVAL 1 SECOND").alias("tSecond"))
    return tw.rechain(pairs).drop("remove")


def fill_ctes(src: str, out: str, span: int, most: int) -> str:
    """Layers of common table expressions that fill gaps of lat; the last is called out."""
    return f"""
{out}n AS (SELECT *, row_number() OVER w AS i, CASE WHEN lat IS NULL THEN NULL ELSE avg(lat) OVER (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN {span - 1} PRECEDING AND CURRENT ROW) END AS b,
  CASE WHEN lat IS NULL THEN NULL ELSE avg(lat) OVER (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN CURRENT ROW AND {span - 1} FOLLOWING) END AS a FROM {src} WINDOW w AS (PARTITION BY trip_id ORDER BY ts, ord)),
{out}k AS (SELECT *, CASE WHEN lat IS NULL THEN NULL ELSE i END AS k FROM {out}n),
{out}m AS (SELECT *, last_value(b IGNORE NULLS) OVER p AS b0, last_value(k IGNORE NULLS) OVER p AS k0, first_value(a IGNORE NULLS) OVER f AS a1, first_value(k IGNORE NULLS) OVER f AS k1 FROM {out}k
  WINDOW p AS (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT trip_id, ord, ts, CASE WHEN lat IS NULL AND k1 - k0 - 1 <= {most} THEN b0 + (a1 - b0) * (i - k0) / (k1 - k0) ELSE lat END AS lat FROM {out}m)"""


MASK = "WITH s AS (SELECT trip_id, ord, ts, CASE WHEN ord % 11 < 3 THEN NULL ELSE y END AS lat FROM v_track)," + fill_ctes("s", "p1", 1, 5) + ", ms AS (SELECT trip_id, ord, ts, CASE WHEN dayofyear(ts) BETWEEN 51 AND 95 OR dayofyear(ts) BETWEEN 251 AND 293 THEN NULL ELSE lat END AS lat FROM p1)," + fill_ctes("ms", "p2", 10, 130)


@query("e2_mask_equinox_lat", MASK + " SELECT trip_id, ord, round(lat, 6) AS lat FROM p2")
def e2(v):
    return tw.mask_equinox_lat(v("track").select("trip_id", "ord", "ts", F.when(F.col("ord") % 11 >= 3, F.col("y")).alias("lat"))).select("trip_id", "ord", "lat")


#: Minutes by reference latitude and month, from a rule: they grow with latitude and towards the solstices.
REFERENCE = "SELECT CAST(a * 12 - 60 AS DOUBLE) AS lat, CAST(m AS INT) AS month, CAST(18 + abs(a - 5) + abs(m - 6) AS DOUBLE) AS minutes FROM"


@query("e3_daylength_threshold", f"""
WITH ref AS ({REFERENCE} range(11) t(a), range(1, 13) s(m)),
p AS (SELECT trip_id, ord, CAST(month(ts) AS INT) AS month, CASE WHEN ord % 9 = 0 THEN NULL ELSE x - 25 END AS lat FROM v_track)
SELECT p.trip_id, p.ord, CASE WHEN p.lat IS NULL THEN 22.0::DOUBLE ELSE (SELECT arg_min(r.minutes, abs(r.lat - p.lat) * 1000 + r.minutes / 1000) FROM ref r WHERE r.month = p.month) END AS threshold FROM p""")
def e3(v):
    p = v("track").select("trip_id", "ord", "ts", F.when(F.col("ord") % 9 == 0, None).otherwise(F.col("x") - 25).alias("lat"))
    spark = p.sparkSession
    ref = spark.sql(REFERENCE + " (SELECT id AS a FROM range(11)) CROSS JOIN (SELECT id AS m FROM range(1, 13))")
    return tw.daylength_threshold(p, ref).select("trip_id", "ord", "threshold")


MIN = "(hour(ts) * 60 + minute(ts))"
DIFF = CROSS + f""", m AS (SELECT *, {MIN} AS m, lead({MIN}, 1) OVER w AS m1, lead({MIN}, 2) OVER w AS m2, dayofyear(ts) AS y, lead(dayofyear(ts), 1) OVER w AS y1, lead(dayofyear(ts), 2) OVER w AS y2 FROM e WINDOW w AS (PARTITION BY trip_id, type ORDER BY u, ord)),
d AS (SELECT *, CASE WHEN (m < 60 AND m1 > 1380) OR (m > 1380 AND m1 < 60) THEN 1440 - abs(m1 - m) ELSE abs(m1 - m) END AS d1,
  CASE WHEN (m < 60 AND m2 > 1380) OR (m > 1380 AND m2 < 60) THEN 1440 - abs(m2 - m) ELSE abs(m2 - m) END AS d2, y1 - y AS doy1, y2 - y AS doy2 FROM m)
"""


@query("e4_circular_minute_diff", DIFF + "SELECT trip_id, ord, type, CAST(d1 AS INT) AS d1, CAST(d2 AS INT) AS d2 FROM d")
def e4(v):
    return tw.circular_minute_diff(events(v)).select("trip_id", "ord", "type", "d1", "d2")


@query("e5_doy_diff", DIFF + "SELECT trip_id, ord, type, CAST(doy1 AS INT) AS doy1, CAST(doy2 AS INT) AS doy2 FROM d")
def e5(v):
    return tw.doy_diff(events(v)).select("trip_id", "ord", "type", "doy1", "doy2")


MOVED = DIFF + """, n AS (SELECT *, lag(m) OVER w AS ma, lead(m) OVER w AS mc, coalesce(lag(doy1) OVER w = 1 AND lag(doy2) OVER w = 2 AND lag(d1) OVER w > 120 AND d1 > 120 AND lag(d2) OVER w < 225, false) AS odd FROM d WINDOW w AS (PARTITION BY trip_id, type ORDER BY u, ord)),
x AS (SELECT *, CASE WHEN odd THEN ((round(degrees(atan2((sin(radians(ma * 360.0 / 1440)) + sin(radians(mc * 360.0 / 1440))) / 2, (cos(radians(ma * 360.0 / 1440)) + cos(radians(mc * 360.0 / 1440))) / 2)) * 1440 / 360 - 1, 6) % 1440) + 1440) % 1440 END AS new_minute FROM n)
"""


@query("e6_detect_displaced", MOVED + "SELECT trip_id, ord, type, round(new_minute, 6) AS new_minute FROM x")
def e6(v):
    return tw.detect_displaced(events(v), 225.0).select("trip_id", "ord", "type", "new_minute")


@query("e7_apply_move", MOVED + "SELECT trip_id, ord, type, new_minute IS NOT NULL AS moved, CASE WHEN new_minute IS NULL THEN u ELSE epoch_us(date_trunc('day', ts)) + CAST(round(new_minute) AS BIGINT) * 60000000 + CAST(floor(second(ts)) AS BIGINT) * 1000000 END AS ts FROM x")
def e7(v):
    return tw.apply_move(tw.detect_displaced(events(v), 225.0)).select("trip_id", "ord", "type", "moved", "ts")
