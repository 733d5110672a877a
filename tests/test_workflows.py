"""Whole ways through the operators."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from wayfowl.functions import solar
from wayfowl.operators import phenology
from wayfowl.operators import tracks as tr
from wayfowl.operators import twilights as tw
from wayfowl.plans import workflows

START = dt.datetime(2024, 6, 1)


def journey(trip, legs, seed=0):
    """Two rows a day of legs (label, rows, from, to) along a meridian, with noise at rest."""
    rng, rows = np.random.default_rng(seed), []
    for label, n, a, b in legs:
        for i in range(n):
            lat = a + (b - a) * (i + 0.5) / n + float(rng.normal(0, 0.01 if label == "mig" else 0.3))
            lon = -15 + float(rng.normal(0, 0.3))
            rows.append((trip, START + dt.timedelta(hours=12 * len(rows)), len(rows), lon, lat, lon, lat, label))
    return rows


LONG = [("B", 60, 40, 40), ("mig", 40, 40, 0), ("W", 80, 0, 0), ("mig", 40, 0, 40), ("B", 60, 40, 40)]


def track_of(spark, *journeys):
    return spark.createDataFrame([r for j in journeys for r in j], "trip_id long, ts timestamp, ord long, lon double, lat double, x double, y double, label string")


def wide(spark, *journeys):
    staged = workflows.staged_track(track_of(spark, *journeys))
    migrants = phenology.migrant_class(staged)
    return {r.trip_id: r for r in phenology.final_layout(workflows.arrivals_and_departures(staged, migrants), workflows.LAYOUT).join(migrants, "trip_id").collect()}


def day(row):
    return (START + dt.timedelta(hours=12 * row)).date()


def test_migration_does_not_widen_a_stage(spark):
    got = wide(spark, journey(1, LONG))[1]
    for found, row in ((got.B1_dep_KDE, 60), (got.W1_arr_KDE, 100), (got.W1_dep_KDE, 180), (got.B2_arr_KDE, 220)):
        assert abs((found - day(row)).days) <= 2
    assert (got.W1_arr, got.W1_dep, got.B2_arr, got.migrant) == (day(100), day(180), day(220), "Migrant")


def test_residents(spark):
    still = journey(2, [("B", 80, 40, 40)])
    moved = journey(3, [("B", 60, 40, 40), ("W", 60, 20, 20), ("B", 60, 40, 40)])  # no migration between
    got = wide(spark, still, moved)
    assert got[2].migrant == "Resident" and got[2].B1_dep is None and got[2].B1_dep_KDE is None
    r = got[3]
    assert r.migrant == "Resident2" and r.B1_dep == r.W1_arr == day(60)
    assert r.B1_dep_KDE == r.W1_arr_KDE and abs((r.W1_arr_KDE - day(60)).days) <= 2
    assert r.W1_dep_KDE == r.W1_dep == day(120)  # what Resident2's W1 takes from B1's arrival is missing, so the label's


def test_short_stages_have_the_dates_of_their_labels(spark):
    got = wide(spark, journey(4, [("B", 30, 40, 40), ("mig", 10, 40, 20), ("W", 5, 20, 20), ("mig", 10, 20, 40), ("B", 30, 40, 40)]))[4]
    assert (got.W1_arr_KDE, got.W1_dep_KDE) == (got.W1_arr, got.W1_dep) == (day(40), day(45))


def test_cleaned_track(spark):
    rows = journey(5, LONG)
    spike = [list(r) for r in rows]
    spike[30][5] += 90  # one jump
    for i in range(100, 112):
        spike[i][6] = 0.25  # repeated latitudes
    track = track_of(spark, [tuple(r) for r in rows], [(6, *r[1:]) for r in spike]).drop("label")
    home = spark.createDataFrame([(5, -15.0, 41.0), (6, -15.0, 41.0)], "trip_id long, lon double, lat double")
    got = workflows.cleaned_track(track, home)
    assert got.columns == [*track.columns, "r2n"]
    five, six = ([r for r in got.where(F.col("trip_id") == t).orderBy("ts").collect()] for t in (5, 6))
    assert len(five) == 278 and abs(five[0].r2n - ((five[0].x - rows[0][5]) ** 2 + (five[0].y - rows[0][6]) ** 2)) < 1e-9
    assert [r.ord for r in six if 99 < r.ord < 112] == [100] and 30 not in {r.ord for r in six}
    assert all(abs(r.r2n - ((r.x + 15) ** 2 + (r.y - 41) ** 2)) < 1e-9 for r in six)
    some = workflows.cleaned_track(track, home, spark.createDataFrame([(5, day(20))], "trip_id long, day date"))
    assert some.where("trip_id = 5").count() == 276


def light_at(spark, lon, lat, days, trip=1):
    """Readings of ten minutes at one place: 100 by day, 0 by night, and some of the night where clouds and lamps disturb."""
    moments = spark.range(days * 144).select(F.lit(trip).cast("long").alias("trip_id"), F.timestamp_seconds(F.lit(1_730_000_000) + F.col("id") * 600).alias("ts"), F.col("id").alias("ord"))
    d, s = solar.with_sun(moments, "_s", F.unix_micros("ts") / 1e6)
    high = F.sin(F.radians(F.lit(lat))) * s.sin_dec + F.cos(F.radians(F.lit(lat))) * s.cos_dec * F.cos(F.radians(s.solar_time + lon - 180))
    lamp = (F.col("ord") % 1009).between(100, 102)
    return d.select("trip_id", "ts", "ord", F.when((high > float(np.cos(np.radians(96.0)))) | lamp, 100.0).otherwise(0.0).alias("lux"))


def test_light_finds_its_place(spark):
    lon, lat, start = -15.4, 28.0, dt.date(2024, 10, 27)
    light = light_at(spark, lon, lat, 300)
    colony = spark.createDataFrame([(1, 40.0, 60.0)], "trip_id long, lon double, lat double")
    zenith = spark.createDataFrame([(1, 96.0)], "trip_id long, zenith double")
    reference = spark.createDataFrame([(0.0, m + 1, 30.0) for m in range(12)], "lat double, month int, minutes double")
    events = workflows.light_to_twilights(light, colony, zenith, reference, 50.0, breeding=()).checkpoint()
    rows = events.orderBy("ts").collect()
    raw = tw.threshold_crossings(light, 50.0).count()
    assert 580 <= len(rows) < raw  # lamps are gone
    late = sum(a.type == b.type for a, b in zip(rows, rows[1:]))
    assert late <= 4 and {r.confidence for r in rows} == {1, 2, 9}
    trips = spark.createDataFrame([(1, start, start + dt.timedelta(days=299))], "trip_id long, start_date date, end_date date")
    days = spark.createDataFrame([(1, start + dt.timedelta(days=100), True, None)], "trip_id long, day date, light boolean, wetdry boolean")
    found = workflows.twilights_to_positions(events, trips, colony, zenith, days).orderBy("ts").collect()
    free = [r for r in found if r.anchor == 0]
    assert np.median([abs(r.lon - lon) for r in free]) < 2 and np.median([abs(r.lat - lat) for r in free]) < 4
    assert all((r.lon, r.lat) == (40.0, 60.0) for r in found if r.anchor == 1) and 2 <= sum(r.anchor == 1 for r in found) <= 8
    assert len({r.tol for r in found}) <= 2 and all(0 <= r.tol <= 0.2 for r in found)


def test_track_to_dates_finds_the_journey(spark):
    track = track_of(spark, *(journey(t, LONG, t) for t in (7, 8))).drop("label")
    home = spark.createDataFrame([(t, -15.0, 40.0) for t in (7, 8)], "trip_id long, lon double, lat double")
    corners = [(-30.0, -10.0), (0.0, -10.0), (0.0, 10.0), (-30.0, 10.0)]
    south = spark.createDataFrame([("south", i, x, y) for i, (x, y) in enumerate(corners)], "region string, idx int, x double, y double")
    got = workflows.track_to_dates(track, home, south).collect()
    assert got[0].__fields__ == ["trip_id", *workflows.LAYOUT, "migrant", *(f"WA{i}" for i in range(1, 6))]
    for r in got:
        assert r.migrant == "Migrant" and r.WA1 == "south" and abs((r.W1_arr_KDE - day(100)).days) <= 10 and abs((r.B2_arr_KDE - day(220)).days) <= 10
    assert tr.ATTRIBUTES[4] == "r2n" and len(got) == 2
