"""Calibration of loggers: periods, error distributions, outliers, pooled means, and the choice of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfowl.functions.solar import with_sun, without_sun, zenith
from wayfowl.functions.tracks import us


def unpivot_periods(info: DataFrame) -> DataFrame:
    """(logger_id, period, place, start, end, loc, lon, lat, n_days) of up to three calibration periods a logger; the end is
    moved to the next day, so that a window up to it holds the whole last day."""
    long = info.selectExpr("logger_id", "stack(3, 'PD1', 'predep', start_1, end_1, loc_1, lon_1, lat_1, 'PD2', 'predep', start_2, end_2, loc_2, lon_2, lat_2, 'PR3', 'postrec', start_3, end_3, loc_3, lon_3, lat_3) AS (period, place, start, end, loc, lon, lat)")
    return long.where("start IS NOT NULL AND end IS NOT NULL").withColumn("n_days", F.datediff("end", "start")).withColumn("end", F.date_add("end", 1))


def calibration_window(light: DataFrame, periods: DataFrame, least: int = 3) -> DataFrame:
    """Readings strictly inside a period of their logger; a period is only used if twice its rounded days reach `least`."""
    p = periods.select("trip_id", "period", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"))
    inside = light.join(p, "trip_id").where((F.col("ts") > F.col("start")) & (F.col("ts") < F.col("end")))
    if "deleted" in light.columns:
        inside = inside.where(~F.coalesce("deleted", F.lit(False)))
    w = Window.partitionBy("trip_id", "period")
    days = (us(F.max("ts").over(w)) - us(F.min("ts").over(w))) / 86400e6
    return inside.withColumn("days", days).where(F.round("days") * 2 >= least).drop("start", "end", "days")


def enforce_alternation(events: DataFrame) -> DataFrame:
    """Sorted events: the first of each value, the last of each run and the last row stay; of an odd number the last goes."""
    w = Window.partitionBy("trip_id").orderBy("ts", "ord")
    whole = Window.partitionBy("trip_id")
    first = F.row_number().over(Window.partitionBy("trip_id", "type").orderBy("ts", "ord")) == 1
    nxt = F.lead("type").over(w)
    kept = events.withColumn("k", first | nxt.isNull() | (nxt != F.col("type"))).where("k").drop("k")
    place, n = F.row_number().over(w), F.count("*").over(whole)
    return kept.withColumn("i", place).withColumn("n", n).where((F.col("n") % 2 == 0) | (F.col("i") < F.col("n"))).drop("i", "n")


def twilight_deviation(events: DataFrame, reference_zenith: float = 96.0) -> DataFrame:
    """At the known lon, lat: the zenith of the sun at each event, and the minutes between the event and the reference zenith (a
    local linear estimate from the sun's motion over one minute)."""
    t = us("ts") / 1e6
    d, now = with_sun(events, "_s1", t)
    d, later = with_sun(d, "_s2", t + 60.0)
    d = d.withColumn("zenith", zenith(now, F.col("lon"), F.col("lat"))).withColumn("_z1", zenith(later, F.col("lon"), F.col("lat")))
    slope = F.when(F.abs(F.col("_z1") - F.col("zenith")) > 1e-9, F.col("_z1") - F.col("zenith"))
    return without_sun(d.withColumn("deviation", (reference_zenith - F.col("zenith")) / slope), "_s1", "_s2").drop("_z1")


def fit_error_distribution(errors: DataFrame, keys: list[str], value: str = "error", method: str = "gamma", zenith: str | None = None) -> DataFrame:
    """Shape and scale of positive errors by group: gamma after Minka's closed form, or mean and deviation of the logarithm.
    Groups without two different positive values get nulls. With a column of zeniths also zenith and zenith0: where the line of
    zenith over error stands at the distribution's mode and at no error. Aggregates only."""
    if zenith:
        x = F.when(F.col(value) > 0, F.col(value))
        line = errors.groupBy(*keys).agg(F.regr_slope(F.col(zenith), x).alias("_slope"), F.regr_intercept(F.col(zenith), x).alias("zenith0"))
        fitted = fit_error_distribution(errors, keys, value, method).join(line, keys)
        a, b = F.col("shape"), F.col("scale")
        mode = F.when(a > 1, (a - 1) * b).otherwise(0.0) if method == "gamma" else F.exp(a - b * b)
        return fitted.select(*keys, "shape", "scale", F.when(a.isNotNull(), F.col("zenith0") + F.col("_slope") * mode).alias("zenith"), F.when(a.isNotNull(), F.col("zenith0")).alias("zenith0"))
    x = F.when(F.col(value) > 0, F.col(value))
    sums = errors.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.avg(F.ln(x)).alias("ml"), F.stddev_samp(F.ln(x)).alias("sl"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    ok = (F.col("n") >= 2) & (F.col("hi") > F.col("lo"))
    if method == "gamma":
        s = F.ln("m") - F.col("ml")
        shape = (3 - s + F.sqrt(F.pow(s - 3, 2.0) + 24 * s)) / (12 * s)
        return sums.select(*keys, F.when(ok, shape).alias("shape"), F.when(ok, F.col("m") / shape).alias("scale"))
    return sums.select(*keys, F.when(ok, F.col("ml")).alias("shape"), F.when(ok, F.col("sl")).alias("scale"))


def pivot_periods(params: DataFrame, keys: list[str], metrics: list[str], periods: list[str]) -> DataFrame:
    """One row a logger with columns <metric>_<period>, the first non-null value of each."""
    ordered = [F.min_by(m, F.when(F.col(m).isNotNull(), F.col("ord"))).alias(m) for m in metrics]
    wide = params.groupBy(*keys).pivot("period", periods).agg(*ordered)
    names = {(f"{p}_{m}" if len(metrics) > 1 else p): f"{m}_{p}" for p in periods for m in metrics}
    return wide.select(*keys, *(F.col(f"`{old}`").alias(new) for old, new in names.items()))


#: Parts of a group's values that are counted before the one that holds a hinge is sorted.
HINGE_PARTS = 64


def tukey_hinges(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, column, lower, upper) of each group's known values. Distinct values are counted in parts that an approximate quantile cuts;
    only the parts that hold a hinge are sorted, so a group may have any number of rows."""
    keys = [by, "column"]
    long = df.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("_v")).select(by, "_v.*")
    values = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("value", [i / HINGE_PARTS for i in range(1, HINGE_PARTS)], 10_000).alias("cuts"))
    parted = values.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    before = Window.partitionBy(*keys).orderBy("part")
    parts = parted.groupBy(*keys, "part").agg(F.sum("n").alias("own")).withColumn("to", F.sum("own").over(before)).withColumn("all", F.sum("own").over(Window.partitionBy(*keys)))
    depth = F.floor((F.col("all") + 3) / F.lit(2.0)) / 2  # of the hinges, from either end
    places = {"l0": F.floor(depth), "l1": F.ceil(depth), "u0": F.col("all") + 1 - F.floor(depth), "u1": F.col("all") + 1 - F.ceil(depth)}
    parts = parts.withColumns({k: F.when((c > F.col("to") - F.col("own")) & (c <= F.col("to")), c - F.col("to") + F.col("own")) for k, c in places.items()})
    parts = parts.where(F.coalesce(*places).isNotNull()).drop("own", "to", "all")
    placed = parted.join(parts, [*keys, "part"]).withColumn("_c", F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("value")))
    found = placed.groupBy(*keys).agg(*(F.min(F.when(F.col("_c") >= F.col(k), F.col("value"))).alias(k) for k in places))
    return found.select(*keys, ((F.col("l0") + F.col("l1")) / 2).alias("lower"), ((F.col("u0") + F.col("u1")) / 2).alias("upper"))


def boxplot_outliers_to_null(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Values beyond 1.5 times the hinge spread from Tukey's hinges of their group become null."""
    hinges = tukey_hinges(df, columns, by).groupBy(by).pivot("column", columns).agg(F.first(F.struct("lower", "upper")))
    out = df.join(hinges.select(by, *(F.col(f"`{c}`").alias(f"_h_{c}") for c in columns)), by, "left")
    for c in columns:
        lower, upper = F.col(f"_h_{c}.lower"), F.col(f"_h_{c}.upper")
        spread = 1.5 * (upper - lower)
        outside = (F.col(c) < lower - spread) | (F.col(c) > upper + spread)
        out = out.withColumn(c, F.when(~F.coalesce(outside, F.lit(False)), F.col(c)))
    return out.select(*df.columns)


def pooled_mean(wide: DataFrame, metric: str, periods: list[str], by: list[str]) -> DataFrame:
    """mean_<metric>: where a period is missing the mean of all periods of all loggers in the group, else the own first period."""
    cols = [F.col(f"{metric}_{p}") for p in periods]
    w = Window.partitionBy(*by)
    total = sum((F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((F.count(c).over(w) for c in cols), F.lit(0))
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return wide.withColumn(f"mean_{metric}", F.when(missing, F.when(count > 0, total / count)).otherwise(cols[0]))


def calibration_summary(params: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return params.groupBy(*by).agg(F.count_distinct("logger_id").alias("n_geos"), *(F.avg(m).alias(m) for m in metrics))


def select_calibration(loggers: DataFrame, own: DataFrame, summary: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """The logger's own parameters, else its group's, else nulls; the two sources are never mixed. sun_angle is 90 - zenith."""
    mine = own.where(F.col(metrics[0]).isNotNull()).select("logger_id", F.struct(*metrics).alias("_own"))
    group = summary.select(*by, F.struct(*metrics).alias("_group"))
    found = loggers.join(mine, "logger_id", "left").join(group, by, "left").withColumn("_c", F.coalesce("_own", "_group"))
    source = F.when(F.col("_own").isNotNull(), "own").when(F.col("_group").isNotNull(), "group")
    return found.select(*loggers.columns, *(F.col(f"_c.{m}").alias(m) for m in metrics), source.alias("source")).withColumn("sun_angle", 90 - F.col(metrics[0]))
