"""Queries over tracks, segments and edits."""

from pyspark.sql import functions as F

from wayfowl.functions.tracks import rounded
from wayfowl.operators import behaviour as bh
from wayfowl.operators import review as rv
from wayfowl.operators import tracks as tr

from .register import query
from .workflows import GROUPS

W = "(PARTITION BY trip_id ORDER BY ts, ord)"
TURN = "CASE WHEN d > pi() + 1e-9 THEN d - 2 * pi() WHEN d <= -pi() + 1e-9 THEN d + 2 * pi() ELSE d END"
STEPS = f"""
WITH a AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, (US(lead(ts) OVER w) - US(ts)) / 1e6 AS dt, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM v_track WINDOW w AS {W}),
b AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist, (x - x0) * (x - x0) + (y - y0) * (y - y0) AS r2n FROM a),
c AS (SELECT *, CASE WHEN dist >= 1e-7 THEN atan2(dy, dx) END AS abs_angle FROM b),
e AS (SELECT *, abs_angle - lag(abs_angle) OVER {W} AS d FROM c),
s AS (SELECT *, {TURN} AS rel_angle FROM e)
"""
STEPS = STEPS.replace("(US(lead(ts) OVER w) - US(ts))", "(lead(US(ts)) OVER w - US(ts))")


@query("h1_step_attributes", STEPS + "SELECT trip_id, ord, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dist, 6) AS dist, round(dt, 6) AS dt, round(r2n, 6) AS r2n, round(abs_angle, 6) AS abs_angle, round(rel_angle, 6) AS rel_angle FROM s")
def h1(v):
    return tr.step_attributes(v("track")).select("trip_id", "ord", *tr.ATTRIBUTES)


@query("h2_drop_large_jumps_pass", f"WITH a AS (SELECT *, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM v_track WINDOW w AS {W}) SELECT trip_id, ord, x, round(y, 6) AS y FROM a WHERE d IS NULL OR d <= 40")
def h2_once(v):
    return tr.drop_large_jumps_once(v("track")).select("trip_id", "ord", "x", "y")


@query("h2_drop_large_jumps")
def h2(v):
    return tr.drop_large_jumps(v("track")).select("trip_id", "ord", "dist", "rel_angle")


EQ = "CASE WHEN abs(date_diff('day', make_date(year(ts), 9, 23), CAST(ts AS DATE))) <= 20 THEN 'Sep' WHEN abs(date_diff('day', make_date(year(ts), 3, 21), CAST(ts AS DATE))) <= 20 THEN 'Mar' ELSE 'No' END"


@query("h3_equinox_label", f"SELECT trip_id, ord, {EQ} AS equinox FROM v_track")
def h3(v):
    return tr.equinox_label(v("track")).select("trip_id", "ord", "equinox")


@query("h4_remove_dates", "SELECT t.trip_id, t.ord, t.x FROM v_track t WHERE NOT EXISTS (SELECT 1 FROM v_days d WHERE d.trip_id = t.trip_id AND d.day = CAST(t.ts AS DATE) AND d.light)")
def h4(v):
    return tr.remove_dates(v("track"), v("days").where("light")).select("trip_id", "ord", "x")


@query("h5_collapse_static_equinox", f"WITH a AS (SELECT trip_id, ord, ts, {EQ} AS equinox, CASE WHEN trip_id % 2 = 0 THEN 1.0 ELSE y END AS y FROM v_track), b AS (SELECT *, min(y) OVER g = max(y) OVER g AND equinox <> 'No' AS still, row_number() OVER (PARTITION BY trip_id, equinox ORDER BY ts, ord) AS i, count(*) OVER g AS n FROM a WINDOW g AS (PARTITION BY trip_id, equinox)) SELECT trip_id, ord, equinox FROM b WHERE NOT still OR i = 1 OR i = n")
def h5(v):
    t = v("track").withColumn("y", F.when(F.col("trip_id") % 2 == 0, 1.0).otherwise(F.col("y")))
    return tr.collapse_static_equinox(tr.equinox_label(t)).select("trip_id", "ord", "equinox")


@query("h6_drop_repeated_lat", "WITH a AS (SELECT *, row_number() OVER (PARTITION BY trip_id, y ORDER BY ts, ord) AS i FROM v_track), b AS (SELECT *, count(*) FILTER (i > 1) OVER (PARTITION BY trip_id) AS d FROM a) SELECT trip_id, ord FROM b WHERE d <= 4 OR i = 1")
def h6(v):
    return tr.drop_repeated_lat(v("track")).select("trip_id", "ord")


TRIM = f"""
WITH t AS (SELECT trip_id, ord, ts, floor(y / 10) AS y FROM v_track),
a AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY trip_id) AS n FROM t),
b AS (SELECT trip_id, count(y) FILTER (i > n - 5) > count(DISTINCT y) FILTER (i > n - 5) AS late, count(y) FILTER (i <= 5) > count(DISTINCT y) FILTER (i <= 5) AS early FROM a GROUP BY 1)
SELECT a.trip_id, a.ord FROM a JOIN b ON a.trip_id = b.trip_id WHERE NOT ((late AND i > n - 5) OR (NOT late AND early AND i <= 4))
"""


@query("h7_trim_ends", TRIM)
def h7(v):
    return tr.trim_ends(v("track").withColumn("y", F.floor(F.col("y") / 10))).select("trip_id", "ord")


@query("h8_colony_r2n", "SELECT t.trip_id, t.ord, round(pow(t.x - c.lon, 2) + pow(t.y - c.lat, 2), 6) AS r2n FROM v_track t LEFT JOIN (SELECT s.trip_id, k.lon, k.lat FROM v_trips s JOIN v_colony k ON s.colony_id = k.colony_id) c ON t.trip_id = c.trip_id")
def h8(v):
    return tr.colony_r2n(v("track"), v("trips").join(v("colony"), "colony_id")).select("trip_id", "ord", "r2n")


@query("h9_segment_tracks")
def h9(v):
    return tr.segment_tracks(v("track"))


@query("h10_select_model", "WITH m AS (SELECT trip_id, CAST(seg % 5 + 3 AS INT) AS n_seg, CAST(seg % 3 + 2 AS INT) AS n_cluster, max(round(mu_x * 7) - seg) AS bic FROM v_seg GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY bic DESC, n_seg, n_cluster) AS k FROM m) SELECT trip_id, n_seg, n_cluster, bic FROM r WHERE k = 1")
def h10(v):
    m = v("seg").groupBy("trip_id", (F.col("seg") % 5 + 3).cast("int").alias("n_seg"), (F.col("seg") % 3 + 2).cast("int").alias("n_cluster")).agg(F.max(F.round(F.col("mu_x") * 7) - F.col("seg")).alias("bic"))
    return tr.select_model(m)


SEG = "CAST(floor((ord - 1) / 40.0) AS INT) + 1"


def seg_steps(v):
    return tr.step_attributes(v("track")).withColumn("seg", (F.floor((F.col("ord") - 1) / 40) + 1).cast("int"))


@query("h11_segment_stats", STEPS + f"SELECT trip_id, {SEG} AS seg, round(avg(dx), 6) AS mu_dx, round(stddev_samp(dx), 6) AS sd_dx, round(avg(dist), 6) AS mu_dist, round(stddev_samp(dist), 6) AS sd_dist, round(avg(r2n), 6) AS mu_r2n, round(stddev_samp(r2n), 6) AS sd_r2n FROM s GROUP BY 1, 2")
def h11(v):
    return tr.segment_stats(seg_steps(v), ("dx", "dist", "r2n"))


SHAPE = STEPS + f""", g AS (SELECT trip_id, {SEG} AS seg, sum(dist) AS len, sqrt(pow(sum(dx), 2) + pow(sum(dy), 2)) AS net, count(dist) AS n, avg(dist) AS p, stddev_samp(dist) AS sd, avg(dist * dist) AS p2, avg(cos(rel_angle)) AS c, avg(sin(rel_angle)) AS si,
  avg(abs(degrees(rel_angle)) * 50) AS dc, avg(r2n) AS rm FROM s GROUP BY 1, 2)
SELECT trip_id, seg, round(net / len, 2) AS straightness, round(2 / sqrt(p * ((1 + c) / (1 - c) + pow(sd / p, 2))), 2) AS sinuosity, round(c / (1 - c), 2) AS emax, round(sqrt(c * c + si * si), 2) AS ang_vector, round(dc, 2) AS dc_mean, round(rm + 1e-7, 2) AS r2n_mean FROM g
"""


@query("h12_shape_metrics", SHAPE)
def h12(v):
    s = tr.raw_shape_metrics(seg_steps(v), 1 / 50, None)  # as its SQL twin does; the next query has the reference's metrics
    return s.select("trip_id", "seg", *(rounded(F.col(c), 2).alias(c) for c in ("straightness", "sinuosity", "emax", "ang_vector", "dc_mean")), rounded(F.col("r2n_mean") + 1e-7, 2).alias("r2n_mean"))


def _steps_of(name: str, rows: str, more: str = "") -> str:
    """CTEs up to {name}s: the steps of rows (trip_id, seg, o, x, y) within each segment."""
    w = "(PARTITION BY trip_id, seg ORDER BY o)"
    return f"""{name}a AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM {rows} WINDOW w AS {w}),
{name}b AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM {name}a),
{name}c AS (SELECT *, CASE WHEN dist >= 1e-7 THEN atan2(dy, dx) END AS abs_angle FROM {name}b),
{name}d AS (SELECT *, abs_angle - lag(abs_angle) OVER {w} AS d FROM {name}c),
{name}s AS (SELECT *, {TURN} AS rel_angle FROM {name}d),
{name}g AS (SELECT trip_id, seg, sum(dist) AS len, sqrt(pow(sum(dx), 2) + pow(sum(dy), 2)) AS net, count(dist) AS n, avg(dist) AS p, stddev_samp(dist) AS sd, avg(dist * dist) AS p2, avg(cos(rel_angle)) AS c0, avg(sin(rel_angle)) AS si,
  avg(abs(degrees(rel_angle)) * 50) AS dc_mean, stddev_samp(abs(degrees(rel_angle)) * 50) AS dc_sd{more} FROM {name}s GROUP BY 1, 2),
{name}m AS (SELECT *, CASE WHEN abs(c0) < 1 THEN c0 END AS c FROM {name}g)"""


def _walked(seg: str) -> str:
    """The reference's metrics: each segment's path is walked chord by chord, from one point to the last place at a step's distance on
    the first leg whose end is as far."""
    def r(c: str, name: str) -> str:
        return f"round({c} + 1e-7, 3) AS {name}"

    return f"""
WITH RECURSIVE ra AS (SELECT *, lead(x) OVER w - x AS dx0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM v_track WINDOW w AS {W}),
rows AS (SELECT trip_id, {seg} AS seg, ord AS o, x, y, (x - x0) * (x - x0) + (y - y0) * (y - y0) AS r2n, row_number() OVER (PARTITION BY trip_id, {seg} ORDER BY ts, ord) AS i FROM ra),
{_steps_of("r", "rows", ", avg(r2n) AS r2n_mean, stddev_samp(r2n) AS r2n_sd").replace("ra AS (SELECT *, lead(x) OVER w - x AS dx, ", "rz AS (SELECT *, lead(x) OVER w - x AS dx, ").replace("FROM ra)", "FROM rz)")},
walk AS (
  SELECT trip_id, seg, 1 AS o, CAST(2 AS BIGINT) AS i, x, y FROM rows WHERE i = 1
  UNION ALL
  SELECT trip_id, seg, o + 1, i, bx + (-qb + sqrt(greatest(0.0, qb * qb - 4 * qa * qc))) / (2 * qa) * lx, by_ + (-qb + sqrt(greatest(0.0, qb * qb - 4 * qa * qc))) / (2 * qa) * ly FROM (
    SELECT f.trip_id, f.seg, f.o, f.i, a.x AS bx, a.y AS by_, b.x - a.x AS lx, b.y - a.y AS ly, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS qa, 2 * ((a.x - f.x) * (b.x - a.x) + (a.y - f.y) * (b.y - a.y)) AS qb, pow(a.x - f.x, 2) + pow(a.y - f.y, 2) - p * p AS qc
    FROM (SELECT walk.trip_id, walk.seg, walk.o, any_value(walk.x) AS x, any_value(walk.y) AS y, any_value(p) AS p, min(rows.i) AS i FROM walk JOIN rm ON rm.trip_id = walk.trip_id AND rm.seg = walk.seg JOIN rows ON rows.trip_id = walk.trip_id AND rows.seg = walk.seg AND rows.i >= walk.i
      WHERE p > 0 AND sqrt(pow(rows.x - walk.x, 2) + pow(rows.y - walk.y, 2)) >= p GROUP BY 1, 2, 3) f
    JOIN rows a ON a.trip_id = f.trip_id AND a.seg = f.seg AND a.i = f.i - 1 JOIN rows b ON b.trip_id = f.trip_id AND b.seg = f.seg AND b.i = f.i
  )
),
{_steps_of("k", "walk")}
SELECT rm.trip_id, rm.seg, {r("km.net / nullif(km.len, 0)", "straightness")}, {r("CASE WHEN km.p * ((1 + km.c) / (1 - km.c) + pow(km.sd / nullif(km.p, 0), 2)) > 0 THEN 2 / sqrt(km.p * ((1 + km.c) / (1 - km.c) + pow(km.sd / nullif(km.p, 0), 2))) END", "sinuosity")},
  {r("sqrt(km.c0 * km.c0 + km.si * km.si)", "ang_vector")}, {r("atan2(km.si, km.c0)", "ang_mean")}, {r("rm.c / (1 - rm.c)", "emax")}, {r("rm.n * rm.p2 + 2 * rm.p * rm.p * (rm.c / (1 - rm.c)) * (rm.n - (1 - pow(rm.c, rm.n)) / (1 - rm.c))", "sq_disp")},
  {r("rm.dc_mean", "dc_mean")}, {r("rm.dc_sd", "dc_sd")}, {r("rm.r2n_mean", "r2n_mean")}, {r("rm.r2n_sd", "r2n_sd")} FROM rm LEFT JOIN km ON rm.trip_id = km.trip_id AND rm.seg = km.seg
"""


def _three_places(m, key):
    return m.select("trip_id", key, *(rounded(F.col(c) + 1e-7, 3).alias(c) for c in m.columns if c not in ("trip_id", key)))


@query("h12_shape_metrics_rediscretised", _walked(SEG))
def h12w(v):
    return _three_places(tr.shape_metrics(seg_steps(v), places=None), "seg")


@query("h12_shape_metrics_by_cluster", _walked(f"({SEG}) % 3").replace("SELECT rm.trip_id, rm.seg,", "SELECT rm.trip_id, rm.seg AS cluster,"))
def h12c(v):
    return _three_places(tr.shape_metrics(seg_steps(v).withColumn("cluster", F.col("seg") % 3), places=None, by="cluster"), "cluster")


WALKED = _walked(SEG).split(",\nka AS")[0] + f""" SELECT walk.trip_id, walk.seg, CAST(o AS BIGINT) AS ord, f.ts, round(x, 5) AS x, round(y, 5) AS y
FROM walk JOIN (SELECT trip_id, {SEG} AS seg, min(US(ts)) AS ts FROM v_track GROUP BY 1, 2) f ON f.trip_id = walk.trip_id AND f.seg = walk.seg"""


@query("h12_rediscretise", WALKED)
def h12r(v):
    walked = tr.rediscretise(v("track").withColumn("seg", (F.floor((F.col("ord") - 1) / 40) + 1).cast("int")))
    return walked.withColumn("x", rounded(F.col("x"), 5)).withColumn("y", rounded(F.col("y"), 5))


@query("h13_r2n_limit")
def h13(v):
    return tr.r2n_limit(tr.step_attributes(v("track")))


# --- behaviour ---------------------------------------------------------------------------------------------------------

#: Metrics of the stand-in segments, from their means; one text for both engines.
METRICS = """SELECT trip_id, seg, first_ord, last_ord - CASE WHEN seg % 4 = 0 THEN 36 ELSE 0 END AS last_ord, f_day, l_day, CAST((seg * 37 + trip_id * 13) % 100 AS DOUBLE) / 100 AS straightness, CAST((seg * 53 + trip_id * 7) % 100 AS DOUBLE) / 100 AS ang_vector,
  CAST((seg * 71 + trip_id * 3) % 200 AS DOUBLE) / 100 AS sinuosity, CAST((seg * 89 + trip_id * 11) % 1000 AS DOUBLE) AS r2n_mean, CAST((seg * 97 + trip_id * 5) % 500 AS DOUBLE) AS sq_disp, CAST((seg * 31 + trip_id) % 10 AS DOUBLE) AS sd_x, CAST((seg * 43 + trip_id) % 23 AS DOUBLE) AS sd_y,
  CAST((seg * 17 + trip_id) % 2 + 1 AS INT) AS clust_sm, CAST((seg * 29 + trip_id * 3) % 5 % 2 + 1 AS INT) AS clust_bnb, CAST(450 AS DOUBLE) AS r2n_limit, CASE WHEN (seg + trip_id) % 3 = 0 THEN 'B' WHEN (seg * 7 + trip_id) % 5 < 2 THEN 'W' ELSE 'mig' END AS breed, CAST((seg * 5 + trip_id) % 4 AS DOUBLE) AS confidence FROM """
SM = f"WITH m AS ({METRICS} v_seg)"
SW = "(PARTITION BY trip_id ORDER BY seg)"


def metrics(v):
    s = v("seg")
    return s.sparkSession.sql(METRICS + "{s}", s=s)


@query("i1_metric_combinations", "WITH c AS (SELECT a, b, c FROM range(11) x(a), range(11) y(b), range(11) z(c) WHERE a < b AND b < c UNION ALL SELECT a, b, NULL FROM range(11) x(a), range(11) y(b) WHERE a < b UNION ALL SELECT a, NULL, NULL FROM range(11) x(a)) SELECT t.trip_id, CAST(count(*) AS BIGINT) AS combos FROM (SELECT DISTINCT trip_id FROM v_seg) t CROSS JOIN c GROUP BY 1")
def i1(v):
    t = v("seg").select("trip_id").distinct()
    return t.crossJoin(F.broadcast(bh.metric_combinations(t.sparkSession, GROUPS))).groupBy("trip_id").agg(F.count("metrics").alias("combos"))


@query("i2_zscore", SM + " SELECT trip_id, seg, round((straightness - avg(straightness) OVER t) / nullif(stddev_samp(straightness) OVER t, 0), 6) AS straightness, round((r2n_mean - avg(r2n_mean) OVER t) / nullif(stddev_samp(r2n_mean) OVER t, 0), 6) AS r2n_mean FROM m WINDOW t AS (PARTITION BY trip_id)")
def i2(v):
    return bh.zscore(metrics(v).select("trip_id", "seg", "straightness", "r2n_mean"), ["straightness", "r2n_mean"])


def shapes(v):
    """All metrics of GROUPS for each segment, with its first and last position."""
    steps = seg_steps(v)
    m = tr.shape_metrics(steps).join(tr.segment_stats(steps, ("x", "y", "dx", "dy", "dist")), ["trip_id", "seg"])
    return m.join(steps.groupBy("trip_id", "seg").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")), ["trip_id", "seg"])


def clustered(m):
    """(trip_id, combo, seg, cluster) of all combinations of one to three groups."""
    cols = [c for g in GROUPS for c in g]
    return bh.two_cluster(bh.zscore(m.select("trip_id", "seg", *cols), cols), bh.metric_combinations(m.sparkSession, GROUPS), cols)


@query("i3_two_cluster")
def i3(v):
    return clustered(shapes(v))


@query("i6_best_of_all_combinations")
def i6_all(v):
    m = shapes(v)
    spark = m.sparkSession
    home = bh.two_cluster(bh.zscore(m.select("trip_id", "seg", "r2n_mean"), ["r2n_mean"]), spark.createDataFrame([(0, ["r2n_mean"])], "combo int, metrics array<string>"), ["r2n_mean"])
    d = m.join(home.select("trip_id", "seg", F.col("cluster").alias("clust_bnb")), ["trip_id", "seg"]).join(clustered(m).withColumnRenamed("cluster", "clust_sm"), ["trip_id", "seg"])
    d = d.join(tr.r2n_limit(tr.step_attributes(v("track"))).withColumnRenamed("limit", "r2n_limit"), "trip_id", "left")
    d = d.join(F.broadcast(bh.metric_combinations(spark, GROUPS).select("combo", F.size("metrics").alias("n_metrics"))), "combo")
    # Each trip is judged once for each combination, so both are the key of the rules' windows.
    d = bh.confidence_score(bh.classify_segment(d.withColumn("trip_id", F.struct("trip_id", "combo"))))
    return bh.best_combination(d.withColumn("trip_id", F.col("trip_id.trip_id")))


CLASSIFY = SM + f""", k AS (SELECT *, arg_min(clust_sm, ang_vector) OVER t = clust_sm AS still, arg_min(clust_bnb, r2n_mean) OVER t = clust_bnb AS home, row_number() OVER {SW} AS i, count(*) OVER t AS n FROM m WINDOW t AS (PARTITION BY trip_id)),
l AS (SELECT *, CASE WHEN still AND home THEN 'B' WHEN still AND last_ord - first_ord <= 5 AND straightness > 0.5 THEN 'mig' WHEN still THEN 'W' WHEN NOT home THEN 'mig' WHEN last_ord - first_ord <= 5 OR i = 1 THEN 'B'
  WHEN i = n AND r2n_mean <= r2n_limit THEN 'B' WHEN i <> n AND r2n_mean <= r2n_limit AND ang_vector < 0.75 THEN 'B' ELSE 'mig' END AS label FROM k)
"""


@query("i4_classify_segment", CLASSIFY + "SELECT trip_id, seg, label AS breed, CASE WHEN still THEN 'Stationary' ELSE 'Mig' END AS s_m, CASE WHEN home THEN 'B' ELSE 'Non-B' END AS b_nb FROM l")
def i4(v):
    return bh.classify_segment(metrics(v)).select("trip_id", "seg", "breed", "s_m", "b_nb")


SCORE = CLASSIFY + """, s AS (SELECT *, CAST(CASE WHEN i = 1 OR i = n THEN 3 WHEN label = 'B' AND r2n_mean > r2n_limit THEN 0 WHEN label = 'W' AND r2n_mean < r2n_limit THEN 0 WHEN label = 'mig' AND straightness < 0.2 AND ang_vector < 0.9 THEN 0
  WHEN label = 'mig' THEN CAST(straightness > 0.5 AS INT) + CAST(ang_vector > 0.5 AS INT) + CAST(sinuosity < 1 AS INT) ELSE CAST(straightness < 0.5 AS INT) + CAST(ang_vector < 0.5 AS INT) + CAST(sinuosity > 1 AS INT) END AS DOUBLE) AS conf FROM l)
"""


def scored(v):
    return bh.confidence_score(bh.classify_segment(metrics(v)))


@query("i5_confidence_score", SCORE + "SELECT trip_id, seg, label AS breed, conf AS confidence FROM s")
def i5(v):
    return scored(v).select("trip_id", "seg", "breed", "confidence")


@query("i6_best_combination", SCORE + ", c AS (SELECT s.trip_id, CAST(s.seg % 4 AS INT) AS combo, avg(conf) / 3 AS score, max(s.seg % 3) AS n_metrics FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(score, 9) DESC, n_metrics, combo) AS k FROM c) SELECT trip_id, combo, round(score, 6) AS score, n_metrics FROM r WHERE k = 1")
def i6(v):
    return bh.best_combination(scored(v).withColumn("combo", (F.col("seg") % 4).cast("int")).withColumn("n_metrics", F.col("seg") % 3))


OVER = " OR ".join(f"(l_day >= make_date(year({d}), {m}, {dom}) - 20 AND f_day <= make_date(year({d}), {m}, {dom}) + 20)" for m, dom in ((9, 23), (3, 21)) for d in ("f_day", "l_day"))
#: Segments of a month each, so that equinoxes matter.
MONTHS = "SELECT * REPLACE (CAST(f_day + CAST(seg % 12 AS INT) * 30 AS DATE) AS f_day, CAST(f_day + CAST(seg % 12 AS INT) * 30 + 25 AS DATE) AS l_day) FROM m"


def monthly(v):
    d = metrics(v).withColumn("f0", F.expr("date_add(f_day, CAST(seg % 12 AS INT) * 30)"))
    return bh.equinox_interference(d.withColumn("f_day", F.col("f0")).withColumn("l_day", F.date_add("f0", 25)).drop("f0"))


INTER = SM + f", mm AS ({MONTHS}), q AS (SELECT *, {OVER} AS eq FROM mm), z AS (SELECT * REPLACE (CASE WHEN breed = 'mig' AND eq AND confidence < 3 THEN confidence / 2 ELSE confidence END AS confidence) FROM q)"


@query("i7_equinox_interference", INTER + " SELECT trip_id, seg, eq, confidence FROM z")
def i7(v):
    return monthly(v).select("trip_id", "seg", "eq", "confidence")


def _rule(n: int, text: str) -> str:
    return f", r{n} AS (SELECT * REPLACE (CASE {text} ELSE breed END AS breed) FROM r{n - 1})"


CORRECT = INTER + ", st AS (SELECT trip_id, median(sq_disp) AS med, avg(r2n_mean) AS mean FROM z GROUP BY 1), r0 AS (SELECT z.*, med, mean FROM z JOIN st ON z.trip_id = st.trip_id)"
CORRECT += _rule(1, "WHEN breed = 'mig' AND eq AND sq_disp < med AND 2 * sd_x < sd_y THEN CASE WHEN r2n_mean < mean THEN 'B' ELSE 'W' END WHEN breed = 'B' AND eq AND (sd_x > 1 OR sd_y > 1) AND sd_x > 4 * sd_y THEN 'mig'").replace("r1 AS (SELECT *", "r1a AS (SELECT *") + ", r1 AS (SELECT *, breed AS breed_0 FROM r1a)"
CORRECT += _rule(2, "WHEN breed = 'B' AND r2n_mean > mean AND straightness < 0.2 THEN 'W'")
CORRECT += _rule(3, f"WHEN breed = 'B' AND confidence < 1.5 AND (coalesce(lead(breed) OVER {SW} = 'mig', false) OR coalesce(lag(breed) OVER {SW} = 'mig', false)) AND straightness > 0.2 AND sq_disp > med THEN 'mig'")
CORRECT += _rule(4, "WHEN breed = 'W' AND r2n_mean < mean THEN 'B'")
CORRECT += _rule(5, "WHEN breed = 'W' AND sq_disp > med AND sinuosity < 1 AND straightness > 0.2 THEN 'mig'")
CORRECT += _rule(6, f"WHEN breed <> 'B' AND lead(breed) OVER {SW} = 'B' AND lag(breed) OVER {SW} = 'B' THEN 'B' WHEN breed = 'B' AND lead(breed) OVER {SW} = 'W' AND lag(breed) OVER {SW} = 'W' THEN 'W'")
CORRECT += _rule(7, f"WHEN breed = 'B' AND lead(breed) OVER {SW} = 'mig' AND lag(breed) OVER {SW} = 'mig' THEN 'W'")
CORRECT += ", o AS (SELECT * REPLACE (CASE WHEN breed <> breed_0 THEN 3.0 ELSE confidence END AS confidence) FROM r7)"


@query("i8_correct_segments", CORRECT + " SELECT trip_id, seg, breed, breed_0, CAST(confidence AS DOUBLE) AS confidence FROM o")
def i8(v):
    return bh.correct_segments(monthly(v)).select("trip_id", "seg", "breed", "breed_0", "confidence")


@query("i9_review_flag", CORRECT + f", f AS (SELECT *, row_number() OVER {SW} AS i, count(*) OVER (PARTITION BY trip_id) AS n, coalesce(lag(breed) OVER {SW} <> breed OR lead(breed) OVER {SW} <> breed, false) AS dif FROM o) SELECT trip_id, seg, CASE WHEN confidence < 2 OR (eq AND i > 1 AND i < n AND dif) THEN 'Check' ELSE 'OK' END AS \"check\" FROM f")
def i9(v):
    return bh.review_flag(bh.correct_segments(monthly(v))).select("trip_id", "seg", "check")


@query("i10_trip_summary", SM + " SELECT trip_id, count(*) AS n_seg, string_agg(breed, '-' ORDER BY seg) AS breed_class, count(*) FILTER (breed = 'B') AS \"n_seg_B\", count(*) FILTER (breed = 'mig') AS n_seg_mig, count(*) FILTER (breed = 'W') AS \"n_seg_W\", round(avg(confidence) / 3, 6) AS confidence FROM m GROUP BY 1")
def i10(v):
    return bh.trip_summary(metrics(v))


LABEL = "SELECT trip_id, ord, seg FROM (SELECT t.trip_id, t.ord, t.ts, s.seg, row_number() OVER (PARTITION BY t.trip_id, t.ord ORDER BY s.seg) AS k FROM v_track t JOIN v_seg s ON t.trip_id = s.trip_id AND CAST(t.ts AS DATE) BETWEEN s.f_day AND s.l_day) WHERE k = 1"


@query("i11_label_positions", LABEL)
def i11(v):
    return bh.label_positions(v("track"), v("seg").select("trip_id", "seg", "f_day", "l_day")).select("trip_id", "ord", "seg")


SPLIT = "CASE WHEN label <> 'mig' THEN label WHEN coalesce(sum(CAST(label = 'W' AS INT)) OVER (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) > 0 THEN 'mig1' WHEN coalesce(sum(CAST(label = 'W' AS INT)) OVER (PARTITION BY trip_id ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'mig2' ELSE 'mig' END"


@query("i12_split_migration", f"SELECT trip_id, ord, {SPLIT} AS label2 FROM v_label")
def i12(v):
    return bh.split_migration(v("label")).select("trip_id", "ord", "label2")


# --- review ------------------------------------------------------------------------------------------------------------

PREP = SM + ", p AS (SELECT trip_id, seg, breed AS label, f_day, l_day, row_number() OVER (PARTITION BY trip_id ORDER BY seg) AS number, seg AS ts, 0 AS ord FROM m), q AS (SELECT trip_id, seg, f_day, l_day, CAST(number AS INT) AS number, " + SPLIT + " AS breed2 FROM p)"


@query("j1_prepare_segments", PREP + " SELECT trip_id, seg, number, breed2 FROM q")
def j1(v):
    return rv.prepare_segments(metrics(v)).select("trip_id", "seg", "number", "breed2")


@query("j2_join_track_segments", PREP + f", h AS ({LABEL}), t AS (SELECT h.*, CASE WHEN h.ord % 5 = 0 THEN 'W' ELSE 'B' END AS breed2 FROM h) SELECT t.trip_id, t.ord, t.seg, t.breed2, q.number FROM t LEFT JOIN q ON t.trip_id = q.trip_id AND t.seg = q.seg AND t.breed2 = q.breed2")
def j2(v):
    t = v("track").withColumn("breed2", F.when(F.col("ord") % 5 == 0, "W").otherwise("B"))
    return rv.join_track_segments(t, rv.prepare_segments(metrics(v)).select("trip_id", "seg", "f_day", "l_day", "breed2", "number")).select("trip_id", "ord", "seg", "breed2", "number")


EDIT = "WITH t AS (SELECT trip_id, ord, ts, " + SEG + " AS seg, CASE WHEN x > 30 THEN 'B' WHEN x > 10 THEN 'mig' END AS label FROM v_track), a AS (SELECT * REPLACE (CASE WHEN (trip_id * 31 + seg) % 7 = 0 THEN 'W' ELSE label END AS label) FROM t), b AS (SELECT * REPLACE (CASE WHEN (trip_id + ord) % 97 = 0 THEN 'B' ELSE label END AS label) FROM a)"


def labelled(v):
    return v("track").withColumn("seg", (F.floor((F.col("ord") - 1) / 40) + 1).cast("int")).withColumn("label", F.when(F.col("x") > 30, "B").when(F.col("x") > 10, "mig"))


def edited(v):
    t = labelled(v)
    edits = t.select("trip_id", "seg").distinct().where((F.col("trip_id") * 31 + F.col("seg")) % 7 == 0).withColumn("label", F.lit("W"))
    return rv.apply_segment_edits(t, edits)


def point_edited(v):
    t = edited(v)
    own = v("track").where((F.col("trip_id") + F.col("ord")) % 97 == 0).select("trip_id", "ord")
    edits = own.withColumn("label", F.lit("mig")).withColumn("edit_ts", F.lit(1)).unionByName(own.withColumn("label", F.lit("B")).withColumn("edit_ts", F.lit(2)))
    return rv.apply_point_edits(t, edits)


@query("j3_apply_segment_edits", EDIT + " SELECT trip_id, ord, label FROM a")
def j3(v):
    return edited(v).select("trip_id", "ord", "label")


@query("j4_apply_point_edits", EDIT + " SELECT trip_id, ord, label FROM b")
def j4(v):
    return point_edited(v).select("trip_id", "ord", "label")


@query("j5_corrected_segments", EDIT + " SELECT DISTINCT trip_id, seg, label FROM b WHERE label IS NOT NULL")
def j5(v):
    return rv.corrected_segments(point_edited(v))


@query("j6_review_progress", EDIT + " SELECT trip_id, count(*) AS positions, count(label) AS labelled FROM b GROUP BY 1")
def j6(v):
    return rv.review_progress(point_edited(v))


@query("j6_review_preview", EDIT + " SELECT trip_id, ord, label FROM b ORDER BY trip_id, ts, ord LIMIT 200")
def j6p(v):
    return rv.review_preview(point_edited(v)).select("trip_id", "ord", "label")
