"""Positions from twilights: threshold estimates, tolerance, and anchoring at the colony."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfowl.functions.solar import destination, threshold_lat, threshold_lon, with_sun, without_sun
from wayfowl.functions.tracks import in_order, last_known, near_day, next_known, one_trip_a_partition, us


def solar_terms(pairs: DataFrame) -> DataFrame:
    """The parts of a threshold estimate that do not depend on a tolerance: lon, both latitudes, and both |sin declination|."""
    d, first = with_sun(pairs, "_s1", us("tFirst") / 1e6)
    d, second = with_sun(d, "_s2", us("tSecond") / 1e6)
    lon = F.when(F.col("type") == 1, threshold_lon(first, second)).otherwise(threshold_lon(second, first))
    z, none = F.col("zenith"), F.lit(-1.0)
    mid = F.timestamp_micros(F.floor((us("tFirst") + us("tSecond")) / 2).cast("long"))
    d = d.withColumn("lon", lon).withColumns({"lat1": threshold_lat(first, F.col("lon"), z, none), "lat2": threshold_lat(second, F.col("lon"), z, none), "dec1": F.abs(first.sin_dec), "dec2": F.abs(second.sin_dec), "ts": mid})
    return without_sun(d, "_s1", "_s2")


def latitude(tol: Column) -> Column:
    """Mean of the latitudes whose declination is beyond the tolerance."""
    a = F.when(F.col("dec1") > tol, F.col("lat1"))
    b = F.when(F.col("dec2") > tol, F.col("lat2"))
    return F.coalesce((a + b) / 2, a, b)


def threshold_location(pairs: DataFrame, tol: float = 0.0) -> DataFrame:
    """(lon, lat, ts) of consecutive opposite twilights (tFirst, tSecond, type of the first) at their zenith."""
    return solar_terms(pairs).withColumn("lat", latitude(F.lit(float(tol)))).drop("lat1", "lat2", "dec1", "dec2")


def interpolate(df: DataFrame, value: str, window_keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """Nulls are interpolated over time between known neighbours; the ends are held."""
    w = Window.partitionBy(*window_keys).orderBy("ts", "ord")
    t = F.when(F.col(value).isNotNull(), us("ts"))
    d = df.withColumn("_t", t).select("*", last_known(value, w).alias("_v0"), last_known("_t", w).alias("_t0"), next_known(value, w).alias("_v1"), next_known("_t", w).alias("_t1"))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (us("ts") - F.col("_t0")) / F.nullif(F.col("_t1") - F.col("_t0"), F.lit(0))
    return d.withColumn(value, F.coalesce(F.col(value), line, F.col("_v0"), F.col("_v1"))).drop("_t", "_v0", "_t0", "_v1", "_t1")


def unwrap_lon(df: DataFrame, window_keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """Longitudes without jumps at the date line: a running sum of the jumps' corrections."""
    w = Window.partitionBy(*window_keys).orderBy("ts", "ord")
    step = F.col("lon") - F.lag("lon").over(w)
    jumps = df.withColumn("_j", F.when(step > 180, -360.0).when(step < -180, 360.0).otherwise(0.0))
    return jumps.withColumn("lon", F.col("lon") + F.sum("_j").over(w)).drop("_j")


def threshold_path(pairs: DataFrame, tol: Column | float = 0.0, window_keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """A position for every pair: latitudes within the tolerance of an equinox are interpolated."""
    tol = F.lit(float(tol)) if isinstance(tol, (int, float)) else tol
    found = solar_terms(pairs).withColumn("lat", latitude(tol)).drop("lat1", "lat2", "dec1", "dec2")
    return interpolate(unwrap_lon(found, window_keys), "lat", window_keys)


class Extremes:
    """The least and largest of values that come and go under keys: two heaps, whose outdated entries go when they come up."""

    def __init__(self) -> None:
        self.low: list[tuple[float, int, int]] = []
        self.high: list[tuple[float, int, int]] = []
        self.now: dict[int, int] = {}
        self.version = 0

    def put(self, key: int, values: tuple[float, ...]) -> None:
        """The key's values from now on; none removes it."""
        self.now.pop(key, None)
        if values:
            self.version += 1
            self.now[key] = self.version
            for v in values:
                heapq.heappush(self.low, (v, key, self.version))
                heapq.heappush(self.high, (-v, key, self.version))

    def spread(self) -> float | None:
        for heap in (self.low, self.high):
            while heap and self.now.get(heap[0][1]) != heap[0][2]:
                heapq.heappop(heap)
        return -self.high[0][0] - self.low[0][0] if self.low else None


class Latitudes:
    """A trip's latitudes while they get lost one after the other. Between two known rows, and beyond the outermost, latitudes are
    linear in time, so of the rows of a window in such a gap the first and last have the extremes: a change touches one row and two
    gaps."""

    def __init__(self, at: list[int], value: list[float], windows: list[list[int]]):
        self.at, self.value, self.windows = at, value, [(w, set(w), Extremes()) for w in windows]
        known = [-1, *(i for i, v in enumerate(value) if v == v), len(at)]
        self.after, self.before = dict(itertools.pairwise(known)), {b: a for a, b in itertools.pairwise(known)}
        self.known = len(known) - 2
        for i in known[1:-1]:
            self._row(i)
        for a in known[:-1]:
            self._gap(a)

    def _row(self, i: int) -> None:
        for _, inside, extremes in self.windows:
            if i in inside:
                extremes.put(i, (self.value[i],) if i in self.after else ())

    def _gap(self, a: int) -> None:
        """What lies between the known row a (or the start) and the next one."""
        b, n = self.after.get(a), len(self.at)
        for rows, _, extremes in self.windows:
            ends = ()
            if b is not None and not (a < 0 and b == n):
                first, last = bisect.bisect_right(rows, a), bisect.bisect_left(rows, b) - 1
                if first <= last:
                    ends = tuple(self._between(a, b, rows[k]) for k in {first, last})
            extremes.put(-2 - a, ends)

    def _between(self, a: int, b: int, i: int) -> float:
        if a < 0 or b == len(self.at):
            return self.value[b if a < 0 else a]
        span = self.at[b] - self.at[a]
        return self.value[a] + (self.value[b] - self.value[a]) * (self.at[i] - self.at[a]) / span if span else self.value[a]

    def change(self, i: int, value: float) -> None:
        self.value[i] = value
        self._row(i)
        self._gap(self.before[i])
        self._gap(i)

    def lose(self, i: int) -> None:
        a, b = self.before.pop(i), self.after.pop(i)
        self.after[a], self.before[b] = b, a
        self.known -= 1
        self._row(i)
        self._gap(i)
        self._gap(a)


def spreads(at: np.ndarray, lats: np.ndarray, decs: np.ndarray, near_sep: np.ndarray, near_mar: np.ndarray, tols: np.ndarray) -> list[tuple[float | None, float, int]]:
    """(spread_sep, spread_mar, n_mar) at each tolerance: a row's latitude is the mean of those of its two whose declination is beyond
    the tolerance, and interpolated where neither is. Time is in proportion to rows and tolerances, with a logarithm for the heaps."""
    ends = np.where(np.isnan(lats) | np.isnan(decs), 0, np.searchsorted(tols, decs, "left"))  # from this tolerance on it is lost
    lats = np.where(ends > 0, lats, np.nan)
    both = np.where(np.isnan(lats[0]), lats[1], np.where(np.isnan(lats[1]), lats[0], (lats[0] + lats[1]) / 2))
    windows = [np.flatnonzero(w).tolist() for w in (near_sep, near_mar)]
    path = Latitudes(at.tolist(), both.tolist(), windows)
    first, last = np.minimum(*np.where(ends > 0, ends, len(tols) + 1)), ends.max(axis=0)
    longer = np.where(ends[0] >= ends[1], lats[0], lats[1]).tolist()
    events: list[list[tuple[int, bool]]] = [[] for _ in tols]
    for i, (one, gone) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if 0 < gone < len(tols):
            events[gone].append((i, True))
        if 0 < one < gone and one < len(tols):
            events[one].append((i, False))
    out = []
    for now in events:
        for i, gone in now:
            if gone:
                path.lose(i)
            else:
                path.change(i, longer[i])
        n_mar = len(windows[1]) if path.known else 0
        spread = [w[2].spread() for w in path.windows]
        out.append((spread[0], spread[1] if n_mar > 1 else math.inf, n_mar))
    return out


def tolerance_sweep(pairs: DataFrame, n: float = 0.001, largest: float = 0.2, d: int = 20, sep: int = 23, mar: int = 21) -> DataFrame:
    """(trip_id, tol, spread_sep, spread_mar, n_mar): the range of interpolated latitudes near both equinoxes for each tolerance. A
    group has a trip's solar terms once; as the tolerance grows, only what each lost latitude changes is looked at."""
    day, steps = F.to_date("ts"), round(largest / n)
    terms = solar_terms(pairs).select("trip_id", "ord", us("ts").alias("at"), "lat1", "lat2", "dec1", "dec2", near_day(day, 9, sep, d).alias("sep"), near_day(day, 3, mar, d).alias("mar"))
    tols = np.arange(1, steps + 1) * n

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("ord", "ascending")])
        num = lambda *names: np.array([rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names])
        near = (rows.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for c in ("sep", "mar"))
        found = spreads(rows.column("at").to_numpy(), num("lat1", "lat2"), num("dec1", "dec2"), *near, tols)
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.int64()))]
        return pa.table([pa.repeat(rows.column("trip_id")[0], steps), pa.array(tols), *columns], names=["trip_id", "tol", "spread_sep", "spread_mar", "n_mar"])

    return one_trip_a_partition(terms).groupBy("trip_id").applyInArrow(one, "trip_id long, tol double, spread_sep double, spread_mar double, n_mar long")


def select_tolerance(sweep: DataFrame, spread: str, k: float = 0.95, least: int | None = None) -> DataFrame:
    """(trip_id, tol): spreads are rounded, their decreases summed up, and the first tolerance that reaches k of the whole is
    taken; trips with fewer than `least` events get null."""
    w = Window.partitionBy("trip_id").orderBy("tol")
    whole = Window.partitionBy("trip_id")
    s = sweep.withColumn("_s", F.round(spread, 2))
    dec = s.withColumn("_d", F.round(F.lag("_s").over(w) - F.col("_s"), 2)).where(F.col("_d").isNotNull() & (F.col("_d") != 0))
    cum = dec.withColumn("_c", F.sum("_d").over(w)).withColumn("_m", F.max("_c").over(whole))
    picked = cum.where(F.col("_c") >= k * F.col("_m")).groupBy("trip_id").agg(F.min("tol").alias("tol"))
    trips = sweep.groupBy("trip_id").agg(F.max("n_mar").alias("n")) if least else sweep.select("trip_id").distinct().withColumn("n", F.lit(0))
    return trips.join(picked, "trip_id", "left").select("trip_id", F.when(F.col("n") >= (least or 0), F.col("tol")).alias("tol"))


def split_at_new_year(events: DataFrame, tolerances: DataFrame) -> DataFrame:
    """half and tol of each event: up to January 1 of the trip's last year tol_sep holds, later tol_mar; one half if that is null."""
    last = Window.partitionBy("trip_id")
    joined = events.join(tolerances, "trip_id", "left").withColumn("_y", F.max(F.year("ts")).over(last))
    late = (F.to_date("ts") > F.make_date(F.col("_y"), F.lit(1), F.lit(1))) & F.col("tol_mar").isNotNull()
    return joined.withColumn("half", F.when(late, 2).otherwise(1)).withColumn("tol", F.when(late, F.col("tol_mar")).otherwise(F.col("tol_sep"))).drop("_y", "tol_sep", "tol_mar")


def equinox_window(events: DataFrame, d: int = 20, sep: int = 23, mar: int = 21) -> DataFrame:
    day = F.to_date("ts")
    return events.withColumn("near_equinox", near_day(day, 9, sep, d) | near_day(day, 3, mar, d))


def anchor_class(positions: DataFrame, days: DataFrame, trips: DataFrame) -> DataFrame:
    """anchor: 1 for a day with light at the colony, 2 with wetdry, 3 with an unknown wetdry, the later test overruled by the
    earlier in the order 3, 2, 1; the first two events are 1, the last two 1 if the trip ends on their day and else 0."""
    used = days.where(F.coalesce("light", F.lit(False)) | F.coalesce("wetdry", F.lit(False)))
    d = used.select("trip_id", "day", "light", "wetdry", F.lit(True).alias("_hit"))
    j = positions.withColumn("day", F.to_date("ts")).join(d, ["trip_id", "day"], "left").join(trips.select("trip_id", "end_date"), "trip_id", "left")
    w, whole = in_order(), Window.partitionBy("trip_id")
    i, n, last = F.row_number().over(w), F.count("*").over(whole), F.to_date(F.max("ts").over(whole))
    by_day = F.when(F.col("_hit") & F.coalesce("light", F.lit(False)), 1).when(F.col("_hit") & F.coalesce("wetdry", F.lit(False)), 2).when(F.col("_hit") & F.col("wetdry").isNull(), 3).otherwise(0)
    k = F.when(i > n - 2, F.when(last == F.col("end_date"), 1).otherwise(0)).when(i <= 2, 1).otherwise(by_day)
    return j.withColumn("anchor", k).drop("light", "wetdry", "_hit", "end_date", "day")


def apply_anchor(positions: DataFrame, colonies: DataFrame, km: float = 100.0, seed: int = 0) -> DataFrame:
    """Class 1 moves to the colony, class 2 to a point km away in a bearing that a checksum of trip and time gives."""
    j = positions.join(colonies.select("trip_id", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), "trip_id", "left")
    digest = F.md5(F.concat_ws("|", F.col("trip_id").cast("string"), us("ts").cast("string"), F.lit(str(seed))))
    bearing = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(36000)) / 100.0
    lon2, lat2 = destination(F.col("_lon"), F.col("_lat"), bearing, km)
    lon = F.when(F.col("anchor") == 1, F.col("_lon")).when(F.col("anchor") == 2, lon2).otherwise(F.col("lon"))
    lat = F.when(F.col("anchor") == 1, F.col("_lat")).when(F.col("anchor") == 2, lat2).otherwise(F.col("lat"))
    return j.withColumn("lon", lon).withColumn("lat", lat).drop("_lon", "_lat")


def civil_twilight(days: DataFrame, zenith_deg: float = 96.0) -> DataFrame:
    """dawn and dusk of a day at lon, lat: solar noon from the equation of time, less and plus the hour angle of that zenith."""
    noon0 = F.unix_micros(F.col("day").cast("timestamp")) / 1e6 + 43200.0 - F.col("lon") * 240.0
    d, s = with_sun(days.withColumn("_noon", noon0), "_s", F.col("_noon"))
    noon = F.col("_noon") - (F.pmod(s.solar_time + F.col("lon"), F.lit(360.0)) - 180.0) * 240.0
    phi = F.radians("lat")
    cos_h = (F.cos(F.radians(F.lit(zenith_deg))) - F.sin(phi) * s.sin_dec) / (F.cos(phi) * s.cos_dec)
    half = F.when(F.abs(cos_h) <= 1, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_h)))) * 240.0)
    d = d.withColumn("dawn", F.timestamp_micros(((noon - half) * 1e6).cast("long"))).withColumn("dusk", F.timestamp_micros(((noon + half) * 1e6).cast("long")))
    return without_sun(d, "_s").drop("_noon")
