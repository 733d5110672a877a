"""From light series to twilight events, and their clean-up. Tables have trip_id, ts, ord; all rules are windows of one trip."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfowl.functions.tracks import hour_of_day, in_order, last_known, minute_of_day, near_day, next_known, rounded, run_number, us


def from_us(c: Column) -> Column:
    return F.timestamp_micros(c)


# --- detection ---------------------------------------------------------------------------------------------------------


def threshold_crossings(light: DataFrame, threshold: float = 2.0, dark_min: float = 15.0) -> DataFrame:
    """(trip_id, ts, ord, type): where light crosses the threshold, interpolated; 1 rising, 2 falling. A dark spell shorter than
    dark_min minutes goes with both its ends."""
    w = in_order()
    thr = F.lit(float(threshold))
    steps = light.select("trip_id", "ts", "ord", "lux", F.lag("lux").over(w).alias("l0"), us(F.lag("ts").over(w)).alias("u0"))
    cross = steps.where(F.col("l0").isNotNull() & ((F.col("l0") < thr) != (F.col("lux") < thr)))
    part = (thr - F.col("l0")) / (F.col("lux") - F.col("l0")) * (us("ts") - F.col("u0"))
    found = cross.select("trip_id", from_us(F.col("u0") + F.round(part).cast("long")).alias("ts"), "ord", F.when(F.col("lux") >= thr, 1).otherwise(2).alias("type"))
    short = dark_min * 60e6
    next_up = (F.lead("type").over(w) == 1) & (us(F.lead("ts").over(w)) - us("ts") < short)
    last_down = (F.lag("type").over(w) == 2) & (us("ts") - us(F.lag("ts").over(w)) < short)
    flags = found.withColumn("drop", ((F.col("type") == 2) & F.coalesce(next_up, F.lit(False))) | ((F.col("type") == 1) & F.coalesce(last_down, F.lit(False))))
    return flags.where(~F.col("drop")).drop("drop")


def pair_twilights(events: DataFrame) -> DataFrame:
    """Each event with the next one: tFirst, tSecond, type."""
    w = in_order()
    return events.select("trip_id", "ord", F.col("ts").alias("tFirst"), F.lead("ts").over(w).alias("tSecond"), "type", "ts").where("tSecond IS NOT NULL")


def repair_types(events: DataFrame) -> DataFrame:
    """Where three types in a row are equal the middle one flips, from left to right: in a run of n equal types these are the
    places 1, 3, 5, ... below n - 1."""
    w = in_order()
    runs = events.withColumn("run", run_number(F.coalesce(F.col("type") != F.lag("type").over(w), F.lit(True)), w))
    of_run = Window.partitionBy("trip_id", "run")
    place = F.row_number().over(of_run.orderBy("ts", "ord")) - 1
    flip = (place % 2 == 1) & (place < F.count("*").over(of_run) - 1)
    return runs.withColumn("type", F.when(flip, 3 - F.col("type")).otherwise(F.col("type"))).drop("run")


def shift_minute(pairs: DataFrame) -> DataFrame:
    """One minute later: tFirst of sunsets, tSecond of sunrises."""
    later = F.expr("INTERVAL 60 SECOND")
    return pairs.withColumn("tFirst", F.when(F.col("type") == 2, F.col("tFirst") + later).otherwise(F.col("tFirst"))).withColumn("tSecond", F.when(F.col("type") == 1, F.col("tSecond") + later).otherwise(F.col("tSecond")))


def event_confidence(events: DataFrame, d_outer: int = 20, d_inner: int = 10, sep: int = 23, mar: int = 21, literal_order: bool = False) -> DataFrame:
    """9, but 2 within d_outer days of an equinox and 1 within d_inner. With literal_order the outer band is tested first."""
    day = F.to_date("ts")

    def near(d: int) -> Column:
        return near_day(day, 9, sep, d) | near_day(day, 3, mar, d)

    bands = [(near(d_inner), 1), (near(d_outer), 2)]
    first, second = bands[::-1] if literal_order else bands
    return events.withColumn("confidence", F.when(*first).when(*second).otherwise(9))


def rise_julian(events: DataFrame) -> DataFrame:
    return events.withColumn("rise", F.col("type") == 1).withColumn("julian", F.dayofyear("ts"))


def loess_filter_flag(events: DataFrame, k: float = 3.0, span: float = 0.05) -> DataFrame:
    """Flags events whose hour departs from the smooth of their type by more than k interquartile ranges."""
    smooth = local_regression(events.withColumn("value", hour_of_day("ts")), span).withColumn("resid", F.round(F.abs(F.col("value") - F.col("smooth")), 9))
    iqr = smooth.groupBy("trip_id", "type").agg((F.percentile("resid", F.lit(0.75)) - F.percentile("resid", F.lit(0.25))).alias("iqr"))
    return smooth.join(iqr, ["trip_id", "type"]).withColumn("loess_flag", F.round(F.col("resid") - k * F.col("iqr"), 6) > 0).drop("resid", "iqr", "value", "smooth")


def _speed_flags(max_kmh: float):
    """Flags of rows sorted by trip and time; the last kept position goes on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = kept = None
        for batch in batches:
            flags = []
            for trip, t, lon, lat in zip(batch.column("trip_id").to_pylist(), batch.column("_us").to_pylist(), batch.column("lon").to_pylist(), batch.column("lat").to_pylist(), strict=True):
                if trip != now:
                    now, kept = trip, None
                fast = False
                if lon is not None and lat is not None and t is not None:
                    hours = (t - kept[0]) / 3.6e9 if kept else 0
                    fast = hours > 0 and _km(*kept[1:], lon, lat) > max_kmh * hours
                    if not fast:
                        kept = t, lon, lat
                flags.append(fast)
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_us"), pa.array(flags, pa.bool_())], names=[*(n for n in batch.schema.names if n != "_us"), "speed_flag"])

    return run


def _km(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def speed_filter_flag(positions: DataFrame, max_kmh: float = 500.0) -> DataFrame:
    """Flags positions (lon, lat) that are too far from the last one that was kept, for the time between: after an outlier the next
    good position is held against the one before it. The first position, those without a place, and those without a time span
    are kept; one without a place is nobody's last. Rows stream in their trip's order, with one position held, however long a
    trip is."""
    rows = positions.withColumn("_us", us("ts")).repartition("trip_id").sortWithinPartitions("trip_id", "ts", "ord")
    schema = T.StructType([*positions.schema.fields, T.StructField("speed_flag", T.BooleanType())])
    return rows.mapInArrow(_speed_flags(max_kmh), schema)


# --- clean-up ----------------------------------------------------------------------------------------------------------


def flag_same_day(events: DataFrame, apart_hours: float = 22.0) -> DataFrame:
    """remove is true for events that share trip, type and date, unless they are two and more than apart_hours apart."""
    w = Window.partitionBy("trip_id", "type", F.to_date("ts"))
    n, span = F.count("*").over(w), (us(F.max("ts").over(w)) - us(F.min("ts").over(w)))
    return events.withColumn("remove", (n > 1) & ~((n == 2) & (span > apart_hours * 3600e6)))


def rolling_sd(events: DataFrame, rows: int = 5, limit: float = 60.0, missing: float = 10_000.0) -> DataFrame:
    """Centred rolling sample deviation of the minute of day, per type."""
    half = rows // 2
    w = in_order("type").rowsBetween(-half, half)
    return events.withColumn("sd", F.coalesce(F.stddev_samp(minute_of_day("ts").cast("double")).over(w), F.lit(missing))).withColumn("usable", F.col("sd") < limit)


def unwrap_hours(events: DataFrame) -> DataFrame:
    """(trip_id, type, shift): the shift of 0..23 hours that makes the largest jump between neighbours smallest; on ties the
    first. All 24 shifts are candidate columns of one pass, so nothing is multiplied."""
    w = in_order("type")
    hours = events.select("trip_id", "type", "ts", "ord", hour_of_day("ts").alias("h")).withColumn("h0", F.lag("h").over(w))
    shifted = lambda c, i: F.pmod(F.col(c) + i, F.lit(24.0))
    jumps = hours.select("trip_id", "type", *(F.abs(shifted("h", i) - shifted("h0", i)).alias(f"j{i}") for i in range(24)))
    worst = jumps.groupBy("trip_id", "type").agg(*(rounded(F.max(f"j{i}"), 2).alias(f"j{i}") for i in range(24)))
    best = F.array_min(F.array(*(F.struct(F.coalesce(F.col(f"j{i}"), F.lit(0.0)).alias("jump"), F.lit(i).alias("shift")) for i in range(24))))
    return worst.select("trip_id", "type", best["shift"].alias("shift"), best["jump"].alias("jump"))


#: Rows times neighbours that are held at once.
NEIGHBOUR_CELLS = 1 << 20


def local_quadratic(x: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """At each x, in ascending order, a quadratic over the k nearest known values with tricube weights, the farthest of them having
    none. The neighbours are a window that slides with x and is one-sided at the ends. Where they don't determine a quadratic, their
    weighted mean; without any known value, not a number."""
    known = ~np.isnan(values)
    near, y = x[known], values[known]
    k = min(k, len(near))
    out = np.full(len(x), np.nan)
    if not k:
        return out
    # A window goes on by one as long as the row that comes in is nearer than the one that goes out.
    first = np.searchsorted(near[:-k] + near[k:], 2 * x, "left") if k < len(near) else np.zeros(len(x), int)
    rows = max(1, NEIGHBOUR_CELLS // k)
    for lo in range(0, len(x), rows):
        at = first[lo : lo + rows, None] + np.arange(k)
        d, v = near[at] - x[lo : lo + rows, None], y[at]
        h = np.abs(d).max(axis=1, keepdims=True)
        z = d / np.where(h > 0, h, 1)
        w = (1 - np.abs(z) ** 3) ** 3
        s0, s1, s2, s3, s4 = ((w * z**i).sum(axis=1) for i in range(5))
        t0, t1, t2 = ((w * v * z**i).sum(axis=1) for i in range(3))
        det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
        top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[lo : lo + rows] = np.where(np.abs(det) > 1e-9, top / det, np.where(s0 > 0, t0 / s0, v.mean(axis=1)))
    return out


def local_regression(values: DataFrame, span: float = 0.05, least: int = 5) -> DataFrame:
    """smooth: at each row a local quadratic over the nearest share `span` of its trip's and type's values in time, `least` of them at
    least. A group has the rows of one trip and type, whatever their number; their neighbours are held in blocks."""
    schema = T.StructType([*values.schema.fields, T.StructField("smooth", T.DoubleType())])

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("ts", "ascending"), ("ord", "ascending")], null_placement="at_start"))
        value = rows.column("value").cast(pa.float64()).to_numpy().astype(np.float64)
        time = rows.column("ts").cast(pa.timestamp("us", rows.schema.field("ts").type.tz)).cast(pa.int64()).to_numpy()
        smooth = local_quadratic((time - time[0]) / 1e6, value, max(least, int(len(value) * span + 1e-5)))
        return rows.append_column("smooth", pa.array(smooth, pa.float64(), from_pandas=True))

    return values.groupBy("trip_id", "type").applyInArrow(one, schema)


def daily_grid(events: DataFrame) -> DataFrame:
    """The first event of each (trip, type, date), completed to every calendar day between the first and the last."""
    first = events.groupBy("trip_id", "type", F.to_date("ts").alias("day")).agg(F.min(F.struct("ts", "ord")).alias("e")).select("trip_id", "type", "day", F.col("e.ts").alias("ts"))
    grid = first.groupBy("trip_id", "type").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("trip_id", "type", F.explode(F.sequence("a", "b")).alias("day"))
    return grid.join(first, ["trip_id", "type", "day"], "left")


def fill_gaps(series: DataFrame, value: str, span: int = 1, max_fill: int = 5) -> DataFrame:
    """Linear fill of runs of nulls of at most max_fill rows; the ends are means of span known rows on either side."""
    w = in_order()
    v = F.col(value)
    group = series.withColumn("_i", F.row_number().over(w)).withColumn("_g", F.count(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.avg(v).over(w.rowsBetween(-(span - 1), 0)) if span > 1 else v
    after = F.avg(v).over(w.rowsBetween(0, span - 1)) if span > 1 else v
    ends = group.withColumn("_b", F.when(v.isNotNull(), before)).withColumn("_a", F.when(v.isNotNull(), after)).withColumn("_k", F.when(v.isNotNull(), F.col("_i")))
    known = ends.select("*", last_known("_b", w).alias("_b0"), last_known("_k", w).alias("_k0"), next_known("_a", w).alias("_a1"), next_known("_k", w).alias("_k1"))
    line = F.col("_b0") + (F.col("_a1") - F.col("_b0")) * (F.col("_i") - F.col("_k0")) / (F.col("_k1") - F.col("_k0"))
    fits = v.isNull() & (F.col("_k1") - F.col("_k0") - 1 <= max_fill)
    return known.withColumn(value, F.when(fits, line).otherwise(v)).drop("_i", "_g", "_b", "_a", "_k", "_b0", "_k0", "_a1", "_k1")


def join_prediction(events: DataFrame, predicted: DataFrame) -> DataFrame:
    """The predicted hour of (trip, type, day) at each event; of several predictions of a day the first counts."""
    one = predicted.groupBy("trip_id", "type", "day").agg(F.min(F.struct("ts", "pred")).alias("p")).select("trip_id", "type", "day", F.col("p.pred").alias("pred"))
    return events.withColumn("day", F.to_date("ts")).join(one, ["trip_id", "type", "day"], "left")


def prediction_fallback(predicted: DataFrame, dawn: str = "dawn", dusk: str = "dusk", breeding_months: tuple[int, ...] = (5, 6, 7, 8)) -> DataFrame:
    """pred_ts: hours taken back by shift, folded at 24, floored to the minute; in breeding months a missing one is dawn or dusk."""
    back = F.abs(F.col("pred") - F.col("shift"))
    hour = F.when(back > 24, 48 - back).otherwise(back)
    stamp = F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) + (F.floor(hour * 60) * 60_000_000).cast("long"))
    civil = F.when(F.month("day").isin(*breeding_months), F.when(F.col("type") == 1, F.col(dawn)).otherwise(F.col(dusk)))
    return predicted.withColumn("pred_ts", F.coalesce(stamp, civil))


def borrow_prediction(events: DataFrame, months: tuple[int, ...], within_days: int = 10) -> DataFrame:
    """In these months an event without a prediction takes that of the nearest date of its trip and type, at most within_days away;
    of two as near the earlier one's. Windows over the trip's own rows."""
    w = in_order("type")
    own = F.when(F.col("pred").isNotNull(), F.struct(F.to_date("ts").alias("day"), "pred"))
    before, after = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(own, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    e = events.withColumn("_b", before).withColumn("_a", after)
    gap_b, gap_a = F.datediff(F.to_date("ts"), F.col("_b.day")), F.datediff(F.col("_a.day"), F.to_date("ts"))
    near = F.when((gap_b <= within_days) & (gap_a.isNull() | (gap_b <= gap_a)), F.col("_b.pred")).when(gap_a <= within_days, F.col("_a.pred"))
    return e.withColumn("pred", F.when(F.month("ts").isin(*months), F.coalesce("pred", near)).otherwise(F.col("pred"))).drop("_b", "_a")


def rescue_nearest(events: DataFrame, borrow_months: tuple[int, ...] = ()) -> DataFrame:
    """Of the flagged events of a (trip, type, date) the one nearest to the predicted hour on a 24 h clock is kept. In the months of
    `borrow_months` (leg tucking; none by default) a missing prediction is that of the nearest date."""
    if borrow_months:
        events = borrow_prediction(events, borrow_months)
    apart = F.abs((hour_of_day("ts") - F.col("pred")) * 3600)
    clock = F.round(F.least(apart, 86400 - apart), 6)  # so that two events as far from it are a tie, which the earlier one wins
    w = Window.partitionBy("trip_id", "type", F.to_date("ts"), "remove").orderBy(F.col("clock").asc_nulls_last(), "ts", "ord")
    ranked = events.withColumn("clock", clock).withColumn("place", F.row_number().over(w))
    return ranked.withColumn("remove", F.col("remove") & ~((F.col("place") == 1) & F.col("clock").isNotNull())).drop("clock", "place")


def rechain(pairs: DataFrame) -> DataFrame:
    """Keeps what is not flagged; each tSecond is the next tFirst, the last row keeps its own."""
    w = Window.partitionBy("trip_id").orderBy("tFirst", "ord")
    return pairs.where(~F.col("remove")).withColumn("tSecond", F.coalesce(F.lead("tFirst").over(w), F.col("tSecond")))


# --- displaced twilights -----------------------------------------------------------------------------------------------


def mask_equinox_lat(positions: DataFrame, lat: str = "lat") -> DataFrame:
    """Short gaps are filled, latitudes around both equinoxes removed and bridged."""
    doy = F.dayofyear("ts")
    near = doy.between(51, 95) | doy.between(251, 293)
    masked = fill_gaps(positions, lat, 1, 5).withColumn(lat, F.when(~near, F.col(lat)))
    return fill_gaps(masked, lat, 10, 130)


def daylength_threshold(positions: DataFrame, reference: DataFrame, default: float = 22.0) -> DataFrame:
    """minutes: from the reference row (lat, month, minutes) of the nearest latitude in the event's month. The reference is a small
    table of fixed size: at most some latitudes times twelve months."""
    by_month = reference.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("lat", "minutes"))).alias("ref"))
    joined = positions.withColumn("month", F.month("ts")).join(F.broadcast(by_month), "month", "left")
    nearest = F.array_min(F.transform("ref", lambda r: F.struct(F.abs(r["lat"] - F.col("lat")).alias("d"), r["minutes"].alias("m"))))["m"]
    return joined.withColumn("threshold", F.when(F.col("lat").isNull(), F.lit(default)).otherwise(F.coalesce(nearest, F.lit(default)))).drop("ref", "month")


def circular_minute_diff(events: DataFrame) -> DataFrame:
    """d1, d2: minutes of day between an event and the next two of its type; they wrap at midnight only if one lies in the first
    and the other in the last hour."""
    w = in_order("type")
    m = minute_of_day("ts")

    def apart(k: int) -> Column:
        n = F.lead(m, k).over(w)
        wrap = ((m < 60) & (n > 1380)) | ((m > 1380) & (n < 60))
        return F.when(wrap, 1440 - F.abs(n - m)).otherwise(F.abs(n - m))

    return events.withColumn("d1", apart(1)).withColumn("d2", apart(2))


def doy_diff(events: DataFrame) -> DataFrame:
    w = in_order("type")
    doy = F.dayofyear("ts")
    return events.withColumn("doy1", F.lead(doy, 1).over(w) - doy).withColumn("doy2", F.lead(doy, 2).over(w) - doy)


def detect_displaced(events: DataFrame, minutes: float = 15.0) -> DataFrame:
    """For days A, B, C in a row: if B is far from both while A and C agree, B moves to their circular mean less one minute
    (new_minute). The threshold is A's column `threshold`, or minutes."""
    w = in_order("type")
    both = doy_diff(circular_minute_diff(events))
    thr = F.lag(F.coalesce("threshold", F.lit(minutes)) if "threshold" in events.columns else F.lit(minutes)).over(w)
    ab, ac, bc = F.lag("d1").over(w), F.lag("d2").over(w), F.col("d1")
    limit = (thr - 15) / 2 + 15
    odd = (F.lag("doy1").over(w) == 1) & (F.lag("doy2").over(w) == 2) & (ab > limit) & (bc > limit) & (ac < thr)
    turn = lambda c: F.radians(c * 360.0 / 1440)
    a, c = minute_of_day(F.lag("ts").over(w)), minute_of_day(F.lead("ts").over(w))
    mean = F.degrees(F.atan2((F.sin(turn(a)) + F.sin(turn(c))) / 2, (F.cos(turn(a)) + F.cos(turn(c))) / 2)) * 1440 / 360 - 1
    return both.withColumn("new_minute", F.when(odd, F.pmod(F.round(mean, 6), F.lit(1440.0))))


def apply_move(events: DataFrame) -> DataFrame:
    """The event at its new minute of the same date, seconds kept."""
    seconds = F.unix_micros(F.date_trunc("day", "ts")) + F.round(F.col("new_minute")).cast("long") * 60_000_000 + F.second("ts").cast("long") * 1_000_000
    return events.withColumn("moved", F.col("new_minute").isNotNull()).withColumn("ts", F.when(F.col("new_minute").isNotNull(), F.timestamp_micros(seconds)).otherwise(F.col("ts")))
