"""Properties and traps that SQL twins do not show."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfowl.functions import solar
from wayfowl.operators import behaviour, calibrate, phenology, positions, tracks, twilights

T0 = dt.datetime(2024, 1, 1)


def events(spark, types, minutes=60):
    return spark.createDataFrame([(1, T0 + dt.timedelta(minutes=minutes * i), i, t) for i, t in enumerate(types)], "trip_id long, ts timestamp, ord long, type int")


def test_repair_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(1)
    for _ in range(3):
        types = rng.integers(1, 3, 60).tolist()
        want = list(types)
        for i in range(len(want) - 2):
            if want[i] == want[i + 1] == want[i + 2]:
                want[i + 1] = 3 - want[i + 1]
        got = [r.type for r in twilights.repair_types(events(spark, types)).orderBy("ord").collect()]
        assert got == want


def test_confidence_bands_and_literal_order(spark):
    days = [dt.datetime(2002, 9, d) for d in (2, 3, 12, 13, 23)] + [dt.datetime(2002, 10, d) for d in (3, 4, 13, 14)]
    df = spark.createDataFrame([(1, d, i, 1) for i, d in enumerate(days)], "trip_id long, ts timestamp, ord long, type int")
    assert [r.confidence for r in twilights.event_confidence(df).orderBy("ord").collect()] == [9, 2, 2, 1, 1, 1, 2, 2, 9]
    assert set(r.confidence for r in twilights.event_confidence(df, literal_order=True).collect()) == {9, 2}


def test_threshold_recovers_the_place(spark):
    sites = [(lon, lat, d) for lon in (-120.0, -15.0, 0.0, 100.0) for lat in (-40.0, 10.0, 28.0, 55.0) for d in (dt.datetime(2023, 12, 1), dt.datetime(2024, 6, 5))]
    days = spark.createDataFrame([(i, lon, lat, d.date()) for i, (lon, lat, d) in enumerate(sites)], "trip_id long, lon double, lat double, day date")
    tw = positions.civil_twilight(days)
    pairs = tw.select("trip_id", F.lit(1).alias("type"), F.col("dawn").alias("tFirst"), F.col("dusk").alias("tSecond"), F.lit(96.0).alias("zenith"), F.lit(0).alias("ord"))
    found = {r.trip_id: r for r in positions.threshold_location(pairs).collect()}
    for i, (lon, lat, _) in enumerate(sites):
        assert abs(found[i].lon - lon) < 0.3 and abs(found[i].lat - lat) < 0.3


def test_known_sun(spark):
    at = dt.datetime(2024, 6, 20, 21, tzinfo=dt.UTC).timestamp()
    d, s = solar.with_sun(spark.range(1), "s", F.lit(at))
    assert d.select(F.degrees(F.asin(s.sin_dec))).first()[0] == pytest.approx(23.44, abs=0.01)


def test_pooled_mean_and_outlier_of_the_published_sample(spark):
    # One group's zeniths and the published pooled mean over the seven non-null ones differ by logger; here the rule.
    rows = [("a", "p", 1, 10.0, 20.0, None), ("b", "p", 1, 11.0, 12.0, 13.0), ("c", "q", 1, None, None, None)]
    df = spark.createDataFrame(rows, "logger_id string, producer string, g int, z_P1 double, z_P2 double, z_P3 double")
    got = {r.logger_id: r.mean_z for r in calibrate.pooled_mean(df, "z", ["P1", "P2", "P3"], ["g", "producer"]).collect()}
    assert got == {"a": pytest.approx(66 / 5), "b": 11.0, "c": None}
    # Fixed value: the sample's zenith of 72.2402272985754 is an outlier among values near 97.
    box = spark.createDataFrame([(i, "x", v) for i, v in enumerate([72.2402272985754, 96.9, 97.1, 97.6, 97.3, 96.8])], "logger_id long, producer string, z double")
    kept = {r.logger_id: r.z for r in calibrate.boxplot_outliers_to_null(box, ["z"], "producer").collect()}
    assert kept[0] is None and None not in [kept[i] for i in range(1, 6)]


def test_segmentation_equals_brute_force():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, (7, 2)), rng.normal(6, 1, (6, 2)), rng.normal(0, 3, (6, 2))])
    cost = tracks.segment_costs(v, 3)
    ends, best = tracks.best_segments(v, 4, 3)
    for k in range(4):
        options = [(0, *c, len(v)) for c in itertools.combinations(range(1, len(v)), k)]
        want = min(sum(cost[a, b] for a, b in itertools.pairwise(o)) for o in options)
        assert best[k] == pytest.approx(want) and sum(cost[a, b] for a, b in itertools.pairwise([0, *ends[k]])) == pytest.approx(want)


def test_complete_linkage_is_not_the_largest_gap():
    x = np.array([[0.0], [1.0], [2.1], [3.3], [4.6], [9.0]])
    assert behaviour.complete_linkage_two(x).tolist() == [1, 1, 1, 1, 1, 2]
    assert behaviour.complete_linkage_two(np.array([[0.0], [4.0], [5.0], [9.5]])).tolist() == [1, 1, 1, 2]
    assert behaviour.complete_linkage_two(np.array([[1.0]])).tolist() == [1]


def test_jumps_go_until_none_is_left(spark):
    xs = [0, 1, 100, 101, 2, 3, 300, 4, 6, 8]
    track = spark.createDataFrame([(1, T0 + dt.timedelta(days=i), i, float(x), float(i % 3)) for i, x in enumerate(xs)], "trip_id long, ts timestamp, ord long, x double, y double")
    got = tracks.drop_large_jumps(track, 40.0)
    assert got.agg(F.max("dist")).first()[0] <= 40 and got.count() > 0


def test_smoothing_and_numbering(spark):
    labels = ["W"] * 6 + ["mig"] * 6 + ["B"] * 6 + ["W"] * 2 + ["B"] * 6
    df = spark.createDataFrame([(1, T0 + dt.timedelta(days=i), i, x) for i, x in enumerate(labels)], "trip_id long, ts timestamp, ord long, label string")
    got = [r.stage for r in phenology.number_stages(phenology.smooth_short_runs(df)).orderBy("ord").collect()]
    assert got == ["W1"] * 6 + ["mig"] * 6 + ["B2"] * 14


def test_empty_tables(spark):
    e = events(spark, [1, 2]).limit(0)
    for f in (twilights.repair_types, twilights.flag_same_day, twilights.unwrap_hours, twilights.daily_grid, calibrate.enforce_alternation):
        assert f(e).count() == 0


def test_light_files(spark, tmp_path):
    from wayfowl.sources import files

    (tmp_path / "1001.lig").write_text("header,line\nok,05/06/24 12:00:00,0,3\nok,05/06/2024 12:10:00,0,4,5,6\nok,2024-06-05 12:20:00\nbad,xx,1,2\n")
    got = files.read_light_delimited(spark, str(tmp_path / "*.lig")).orderBy("ts").collect()
    assert [(r.trip_id, r.ts.minute, r.light) for r in got] == [("1001", 0, "3"), ("1001", 10, "4"), ("1001", 20, None)]
    (tmp_path / "2.lux").write_text("x\n" * 19 + "date\tlight\n05/06/2024 01:00:00\t3,25\n31/02/2024 01:00:00\t1\n")
    assert [(r.trip_id, r.lux) for r in files.normalise_light(files.read_light_tabbed(spark, str(tmp_path / "*.lux"))).collect()] == [("2", 3.25)]


def at_seconds(spark, rows):
    """Events (trip, second of the day, type), in order."""
    return spark.createDataFrame([(trip, T0 + dt.timedelta(seconds=s), i, t) for i, (trip, s, t) in enumerate(rows)], "trip_id long, ts timestamp, ord long, type int")


def test_a_jump_that_is_half_a_hundredth(spark):
    got = twilights.unwrap_hours(at_seconds(spark, [(1, 15455, 1), (1, 64937, 1), (2, 74068, 1), (2, 22462, 1)])).collect()

    def best(a, b):
        jumps = [math.floor(abs((a / 3600.0 + i) % 24 - (b / 3600.0 + i) % 24) * 100 + 0.5) / 100 for i in range(24)]
        return jumps.index(min(jumps)), min(jumps)

    assert {r.trip_id: (r.shift, r.jump) for r in got} == {1: best(15455, 64937), 2: best(74068, 22462)}


#: Two pairs of events as far before as after their predicted hour, where the differences of hours as doubles say otherwise.
AS_NEAR = [(4.9, 16174, 19106), (6.9, 24667, 25013)]


def as_near(spark):
    rows = [(trip, s, 1) for trip, (_, a, b) in enumerate(AS_NEAR) for s in (a, b)]
    hours = F.element_at(F.array(*(F.lit(p) for p, _, _ in AS_NEAR)), F.col("trip_id").cast("int") + 1)
    return twilights.rescue_nearest(twilights.flag_same_day(at_seconds(spark, rows)).withColumn("pred", hours))


def test_of_two_events_as_near_the_earlier_one_is_kept(spark):
    assert {r.ord: r.remove for r in as_near(spark).collect()} == {0: False, 1: True, 2: False, 3: True}


def test_the_chain_goes_on_from_the_earlier_of_two_events_as_near(spark):
    pairs = as_near(spark).select("trip_id", "ord", "remove", F.col("ts").alias("tFirst"), F.col("ts").alias("tSecond"))
    later = pairs.where("ord % 2 = 0").select("trip_id", (F.col("ord") + 10).alias("ord"), F.lit(False).alias("remove"), (F.col("tFirst") + F.expr("INTERVAL 1 DAY")).alias("tFirst"), F.col("tSecond"))
    got = twilights.rechain(pairs.unionByName(later)).where("ord < 10").collect()
    assert sorted((r.trip_id, (r.tFirst - T0).seconds, (r.tSecond - r.tFirst).days) for r in got) == [(0, 16174, 1), (1, 24667, 1)]
