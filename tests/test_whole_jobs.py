"""Jobs that must be done whole, however large a trip is."""

import datetime as dt
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from wayfowl.operators import behaviour, calibrate, phenology, tracks, twilights
from wayfowl.operators import positions as positions_op

T0 = dt.datetime(2024, 1, 1)


def positions_of(spark, xs, ys=None, trip=1):
    return spark.createDataFrame([(trip, T0 + dt.timedelta(days=i), i, float(x), float(i % 3 if ys is None else ys[i])) for i, x in enumerate(xs)], "trip_id long, ts timestamp, ord long, x double, y double")


def slow_jumps(xs, limit):
    """Positions (row, x, y) left by the reference's loop."""
    rows = [(i, float(x), float(i % 3)) for i, x in enumerate(xs)]
    while True:
        far = [float(np.hypot(b[1] - a[1], b[2] - a[2])) > limit for a, b in zip(rows, rows[1:])] + [False]
        if not any(far):
            return rows
        rows = [r for r, f in zip(rows, far) if not f]


def test_one_relocation_needs_as_many_rounds_as_rows(spark):
    xs = [*range(100), *range(1000, 1100)]
    left = slow_jumps(xs, 40.0)
    got = sorted(r.ord for r in tracks.drop_large_jumps(positions_of(spark, xs)).collect())
    assert got == [r[0] for r in left][1:-1] and len(got) == 98  # the first has no turn, the last no step


def test_pass_equals_the_rounds():
    rng = np.random.default_rng(4)
    for _ in range(30):
        xs = np.cumsum(rng.normal(0, 25, 80)).tolist()
        keep = tracks.rows_without_jumps(xs, [float(i % 3) for i in range(80)], 40.0)
        assert np.flatnonzero(keep).tolist() == [r[0] for r in slow_jumps(xs, 40.0)]


def test_densities_reach_every_part_of_a_trip(spark, sf):
    from wayfowl.plans import registry

    whole = {(r.trip_id, r.ord) for r in registry.queries()["k5_project_laea"](spark, sf).select("trip_id", "ord").collect()}
    assert {(r.trip_id, r.ord) for r in registry.queries()["k8_points_in_ud"](spark, sf).select("trip_id", "ord").collect()} == whole
    groups = {(r.trip_id, r.g) for r in registry.queries()["k6_href"](spark, sf).where("h > 0").select("trip_id", "g").collect()}
    assert {(r.trip_id, r.g) for r in registry.queries()["k7_utilisation_distribution"](spark, sf).select("trip_id", "g").distinct().collect()} == groups


def test_density_equals_the_sum_of_all_kernels(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(0, 30, (300, 2)), rng.normal(200, 5, (40, 2))])
    points = spark.createDataFrame([(1, float(x), float(y)) for x, y in xy], "g long, px double, py double")
    h = points.transform(lambda p: phenology.href(p, ["g"])).first().h
    got = {(r.gx, r.gy): r.density for r in phenology.utilisation_distribution(points, ["g"], 2.0).collect()}
    cells = {(math.floor(x / h * 2) + i, math.floor(y / h * 2) + j) for x, y in xy for i in range(-6, 7) for j in range(-6, 7)}
    assert set(got) == cells
    for (gx, gy), d in got.items():
        centre = (np.array([gx, gy]) + 0.5) * h / 2
        near = (np.abs(np.floor(xy / h * 2) - [gx, gy]) <= 6).all(axis=1)
        assert math.isclose(d, np.exp(-((xy[near] - centre) ** 2).sum(axis=1) / (2 * h * h)).sum(), rel_tol=1e-9)


def test_long_trips_are_not_averaged(spark):
    rng = np.random.default_rng(6)
    xs = np.concatenate([rng.normal(0, 1, 801), rng.normal(30, 1, 800)])
    got = tracks.segment_tracks(positions_of(spark, xs, rng.normal(0, 1, 1601)), 2, 5, (2,)).collect()
    assert sorted((r.first_row, r.last_row) for r in got) == [(1, 801), (802, 1601)]


def tracks_of_kinds(rng, n):
    """A walk, pieces with noise, and a walk on a grid, which has many equal costs and segments without variance."""
    yield rng.normal(size=(n, 2)).cumsum(axis=0)
    yield np.repeat(rng.normal(0, 5, (n // 10 + 1, 2)), 10, axis=0)[:n] + rng.normal(0, 1, (n, 2))
    yield np.round(rng.normal(0, 1, (n, 2)).cumsum(axis=0) / 4)


def test_pruned_blocks_lose_no_split():
    rng = np.random.default_rng(7)
    for n in (4, 11, 57, 200, 400):
        for v in tracks_of_kinds(rng, n):
            cost = tracks.segment_costs(v - v.mean(axis=0), 5)
            want = [cost[0]]
            for _ in range(min(6, n // 5) - 1):
                want.append((want[-1][:, None] + cost).min(axis=0))
            for block in (4, 16, 128):
                ends, best = tracks.best_segments(v, 6, 5, block)
                assert np.allclose(best, [w[n] for w in want[: n // 5]]) and len(ends) == min(6, n // 5)
                for cut, b in zip(ends, best, strict=True):
                    assert math.isclose(sum(cost[i, j] for i, j in zip([0, *cut], cut)), b, rel_tol=1e-9, abs_tol=1e-6)


def test_pruning_skips_most_of_a_long_trip(monkeypatch):
    rng, cells, costs = np.random.default_rng(1), [], tracks._costs
    monkeypatch.setattr(tracks, "_costs", lambda s, q, a, b, lmin: cells.append(len(a) * len(b)) or costs(s, q, a, b, lmin))
    v = np.concatenate([rng.normal(m, 1, (2000, 1)) for m in (0, 8, -5, 20, 3)])
    ends, _ = tracks.best_segments(v, 5, 5)
    assert ends[4] == [2000, 4000, 6000, 8000, 10000] and bool(sum(cells) < 0.3 * len(v) ** 2 / 2)


def slow_joint(v, k, clusters, lmin):
    """The largest likelihood over all segments and all their groupings in so many clusters at most."""
    best = -np.inf
    for cuts in itertools.combinations(range(1, len(v)), k - 1):
        ends = [0, *cuts, len(v)]
        if min(b - a for a, b in itertools.pairwise(ends)) >= lmin:
            for labels in itertools.product(range(clusters), repeat=k):
                rows = np.repeat(labels, np.diff(ends))
                ll = 0.0
                for c in set(labels):
                    own = v[rows == c]
                    var = np.maximum(own.var(axis=0), tracks.LEAST_VARIANCE)
                    ll -= 0.5 * (len(own) * np.log(2 * np.pi * var) + ((own - own.mean(axis=0)) ** 2).sum(axis=0) / var).sum()
                best = max(best, ll)
    return best


def test_joint_model_equals_exhaustive_search_and_never_falls():
    rng, hits = np.random.default_rng(11), 0
    for trial in range(40):
        places = rng.normal(0, 4, (2, 2))
        v = np.concatenate([rng.normal(places[i % 2], 1, (int(rng.integers(3, 6)), 2)) for i in range(3)])
        cut = tracks.best_segments(v, 3, 3)[0][2]
        starts = [tracks.row_clusters(v, 2, seed) for seed in range(6)]
        for c in starts:
            history = tracks.joint_segments(v, 3, c, 3)[3]
            assert all(b >= a for a, b in itertools.pairwise(history))
        ends, label, own, ll = tracks.joint_model(v, 3, 2, cut, 3, starts)
        assert math.isclose(ll, own.density(v)[np.repeat(label, np.diff([0, *ends])), np.arange(len(v))].sum(), rel_tol=1e-9)
        want = slow_joint(v, 3, 2, 3)
        assert ll <= want + 1e-6
        hits += ll >= want - 1e-6
    assert hits == 40


def test_joint_likelihood_is_never_below_the_two_stages(spark):
    from wayfowl.plans.standins import stand_in

    track = stand_in(spark, "/root/testdata/sf0.01", "track").select("trip_id", "ts", "ord", "x", "y").toPandas()
    more = 0
    for _, trip in track.groupby("trip_id"):
        v = trip.sort_values(["ts", "ord"])[["x", "y"]].to_numpy()
        for cut in tracks.best_segments(v, 12, 5)[0][5::3]:
            two = tracks.cluster_segments(v, cut, 5)[1]
            joint = tracks.joint_model(v, len(cut), 5, cut, 5, [])[3]
            assert joint >= two - 1e-6
            more += joint > two + 1
    assert more > 0


def test_a_trip_of_many_rows(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(m, 1, (6000, 2)) for m in (0, 9, 0, -9)])
    got = tracks.segment_tracks(positions_of(spark, v[:, 0], v[:, 1]), 4, 5, (2, 3)).where("n_cluster = 3").orderBy("seg").collect()
    assert [r.last_row for r in got] == [6000, 12000, 18000, 24000] and got[0].state == got[2].state and len({r.state for r in got}) == 3


def test_segmentation_query_takes_whole_trips(spark, sf):
    from wayfowl.plans import registry

    rows = {r.trip_id: r["count"] for r in registry.queries()["h3_equinox_label"](spark, sf).groupBy("trip_id").count().collect()}
    models = registry.queries()["h9_segment_tracks"](spark, sf).groupBy("trip_id", "n_cluster").agg({"last_row": "max"}).collect()
    assert {r.n_cluster for r in models} == set(range(5, 11)) and {r.trip_id for r in models} == set(rows)
    assert all(r["max(last_row)"] == rows[r.trip_id] for r in models)


def slow_chords(p, step):
    """Small moves along the path, until a straight step is done."""
    out, at = [p[0]], p[0]
    for a, b in zip(p, p[1:]):
        for t in np.linspace(0, 1, 20_001)[1:]:
            q = a + t * (b - a)
            if math.dist(q, at) >= step:
                out.append(q)
                at = q
    return np.array(out)


def test_shape_metrics_come_from_the_rediscretised_track(spark):
    rng = np.random.default_rng(8)
    x, y = rng.exponential(3, 40).cumsum(), rng.normal(0, 4, 40).cumsum()
    track = positions_of(spark, x, y).withColumn("seg", F.lit(1))
    got = tracks.shape_metrics(track, places=9).first()
    p = np.column_stack([x, y])
    step = np.hypot(*np.diff(p, axis=0).T).mean()
    q = tracks.equal_chords(p, step)
    assert np.allclose(np.hypot(*np.diff(q, axis=0).T), step) and np.abs(q - slow_chords(p, step)).max() < 0.05
    angle = np.arctan2(*np.diff(q, axis=0).T[::-1])
    turns = np.diff(angle)
    c, s = np.mean(np.cos(turns)), np.mean(np.sin(turns))
    assert math.isclose(got.straightness, math.dist(q[-1], q[0]) / (step * (len(q) - 1)), rel_tol=1e-6)
    assert math.isclose(got.sinuosity, 2 / math.sqrt(step * ((1 + c) / (1 - c))), rel_tol=1e-6)
    assert math.isclose(got.ang_vector, math.hypot(c, s), rel_tol=1e-6) and math.isclose(got.ang_mean, math.atan2(s, c), rel_tol=1e-5)
    raw = tracks.raw_shape_metrics(tracks.step_attributes(track), places=9).first()
    assert got.emax == raw.emax and got.sq_disp == raw.sq_disp and got.straightness != raw.straightness
    both = track.unionByName(positions_of(spark, x + 5, y).withColumn("seg", F.lit(2)).withColumn("ord", F.col("ord") + 100)).withColumn("cluster", F.col("seg") * 0 + 4)
    assert tracks.shape_metrics(both, by="cluster").select("trip_id", "cluster").collect() == [(1, 4)]
    alone = {r.seg: r.dc_mean for r in tracks.shape_metrics(both).collect()}
    assert alone[1] == alone[2]  # no step leads from one segment to the next


def test_local_regression_takes_the_nearest_in_time():
    rng = np.random.default_rng(3)
    for n, k in ((3000, 150), (40, 5), (5, 5), (4, 9)):
        x = (rng.exponential(50_000, n) * (1 + 20 * (np.arange(n) % 50 == 0))).cumsum()
        v = rng.normal(size=n).cumsum()
        v[rng.random(n) < 0.02] = np.nan
        got = twilights.local_quadratic(x, v, k)
        known = np.flatnonzero(~np.isnan(v))
        for i in (0, 1, n // 3, n // 2, n - 2, n - 1):
            rows = known[np.argsort(np.abs(x[known] - x[i]), kind="stable")[:k]]
            h = np.abs(x[rows] - x[i]).max()
            w = (1 - (np.abs(x[rows] - x[i]) / h) ** 3) ** 3
            assert (w > 0).sum() >= 3
            fit = np.polyfit((x[rows] - x[i]) / h, v[rows], 2, w=np.sqrt(w))
            assert math.isclose(got[i], fit[2], rel_tol=1e-6, abs_tol=1e-6)
    ends = twilights.local_quadratic(np.arange(200.0), np.arange(200.0) ** 2, 10)
    assert np.allclose(ends, np.arange(200.0) ** 2)  # a quadratic is its own fit, at the ends too
    assert twilights.local_quadratic(np.zeros(6), np.arange(6.0), 5)[0] == 2.0 and np.isnan(twilights.local_quadratic(np.zeros(2), np.full(2, np.nan), 5)).all()


def test_blocks_of_neighbours_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    x, v = rng.exponential(1, 500).cumsum(), rng.normal(size=500)
    want = twilights.local_quadratic(x, v, 25)
    monkeypatch.setattr(twilights, "NEIGHBOUR_CELLS", 100)
    assert (twilights.local_quadratic(x, v, 25) == want).all()


def test_one_spike_is_one_flag(spark):
    places = [0.0, 0.5, 1.0, 80.0, 1.5, None, 2.0, 2.0, 40.0, 41.0, 2.5]
    rows = [(t, T0 + dt.timedelta(hours=12 * (i - (i == 7))), i, x, 0.0, "x") for t in (1, 2) for i, x in enumerate(places)] + [(3, T0, 0, 170.0, 0.0, "x")]
    df = spark.createDataFrame(rows, "trip_id long, ts timestamp, ord long, lon double, lat double, _note string")
    got = twilights.speed_filter_flag(df, 100.0)
    assert got.columns == [*df.columns, "speed_flag"]
    flags = {t: [r.speed_flag for r in got.where(F.col("trip_id") == t).orderBy("ts", "ord").collect()] for t in (1, 2, 3)}
    assert flags[1] == flags[2] == [i in (3, 8, 9) for i in range(11)] and flags[3] == [False]
    assert twilights.speed_filter_flag(df.limit(0)).count() == 0


def test_hinges_of_large_groups(spark):
    rng = np.random.default_rng(14)
    groups = {"a": rng.normal(size=5000), "b": np.round(rng.normal(size=4001), 1), "c": np.ones(300), "d": rng.normal(size=1), "e": rng.normal(size=2), "f": rng.normal(size=3), "g": np.array([])}
    rows = [(g, float(x), float(-x) if i % 3 else None) for g, v in groups.items() for i, x in enumerate(v)] + [("g", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.g, r.column): (r.lower, r.upper) for r in calibrate.tukey_hinges(df, ["x", "y"], "g").collect()}
    for g in groups:
        for k, c in ((1, "x"), (2, "y")):
            v = sorted(r[k] for r in rows if r[0] == g and r[k] is not None)
            if v:
                depth = ((len(v) + 3) // 2) / 2
                want = tuple((u[math.floor(depth) - 1] + u[math.ceil(depth) - 1]) / 2 for u in (v, v[::-1]))
                assert np.allclose(got[g, c], want)
            else:
                assert (g, c) not in got
    assert calibrate.boxplot_outliers_to_null(df, ["x", "y"], "g").count() == len(rows)


def test_holes_and_parts_of_polygons(spark):
    square = lambda r, a, b: [("r", r, i + 1, x, y) for i, (x, y) in enumerate([(a, a), (b, a), (b, b), (a, b)])]
    shapes = spark.createDataFrame([*square(1, 0.0, 10.0), *square(2, 3.0, 6.0), *square(3, 20.0, 22.0)], "region string, ring int, idx int, x double, y double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (4, 4), (7, 5), (21, 21), (15, 5), (-1, 5), (5, 2.5)])], "pid int, x double, y double")
    for band in (1.0, 0.3, 50.0):
        assert sorted(r.pid for r in phenology.point_in_polygon_join(points, shapes, band).collect()) == [0, 2, 3, 6]


def test_strips_of_a_coast_with_many_vertices(spark):
    """A round island with a rough coast, of 8,000 vertices, and a lake in it."""
    rng = np.random.default_rng(13)
    angle = np.linspace(0, 2 * np.pi, 8_000, endpoint=False)
    radius = 30 + np.sin(7 * angle) + rng.normal(0, 0.001, 8_000)
    coast = [("island", 1, i, float(r * np.cos(a)), float(r * np.sin(a))) for i, (a, r) in enumerate(zip(angle, radius, strict=True))]
    lake = [("island", 2, i, float(10 * np.cos(a)), float(10 * np.sin(a))) for i, a in enumerate(angle[::50])]
    shapes = spark.createDataFrame([*coast, *lake], "region string, ring int, idx int, x double, y double")
    strips = phenology.edge_strips(shapes, 1.0).select("level", F.size("edges").alias("n")).collect()
    assert max(r.n for r in strips) <= 128 and len({r.level for r in strips}) > 3
    xy = [(float(x), float(y)) for x, y in rng.uniform(-33, 33, (400, 2))] + [(0.0, y) for y in (-40.0, 0.0, 9.99, 10.01, 29.0, 64.0)]
    xs, ys = np.array([c[3] for c in coast]), np.array([c[4] for c in coast])
    lx, ly = np.array([c[3] for c in lake]), np.array([c[4] for c in lake])

    def crossings(x, y, px, py):
        x2, y2 = np.roll(x, -1), np.roll(y, -1)
        at = (y > py) != (y2 > py)
        return int((px < (x2 - x)[at] * (py - y[at]) / (y2 - y)[at] + x[at]).sum())

    want = {i for i, (px, py) in enumerate(xy) if (crossings(xs, ys, px, py) + crossings(lx, ly, px, py)) % 2}
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(xy)], "pid int, x double, y double")
    got = phenology.point_in_polygon_join(points, shapes)
    assert got.columns == ["pid", "x", "y", "region"] and {r.pid for r in got.collect()} == want and 0 < len(want) < len(xy)
    assert phenology.point_in_polygon_join(points, shapes.limit(0)).count() == 0


def test_twilight_files_of_many_trips_share_folders(spark, tmp_path):
    from wayfowl.sources import files

    events = spark.createDataFrame([(i % 50, T0 + dt.timedelta(hours=i), i, 1) for i in range(500)], "trip_id long, ts timestamp, ord long, type int")
    files.write_twilights(events, str(tmp_path / "t"), folders=4)
    assert len(list((tmp_path / "t").glob("folder=*"))) <= 4
    back = files.read_twilights(spark, str(tmp_path / "t"), "trip_id long, ts timestamp, ord long, type int, folder int")
    assert back.count() == 500 and back.groupBy("trip_id").agg(F.count_distinct("folder").alias("n")).where("n > 1").count() == 0


def test_all_tolerances_and_combinations(spark, sf):
    from wayfowl.plans import registry

    sweep = registry.queries()["g3_tolerance_sweep"](spark, sf)
    assert {r.n for r in sweep.groupBy("trip_id").agg(F.count_distinct("tol").alias("n")).collect()} == {200}
    clusters = registry.queries()["i3_two_cluster"](spark, sf)
    assert {r.n for r in clusters.groupBy("trip_id").agg(F.count_distinct("combo").alias("n")).collect()} == {231}
    best = registry.queries()["i6_best_of_all_combinations"](spark, sf).collect()
    assert len(best) == len({r.trip_id for r in best}) == clusters.select("trip_id").distinct().count() and all(0 <= r.score <= 1 for r in best)


def slow_spreads(at, lats, decs, near_sep, near_mar, tols):
    """The whole trip interpolated anew for each tolerance."""
    out = []
    for tol in tols:
        a, b = (np.where(dec > tol, lat, np.nan) for dec, lat in zip(decs, lats))
        lat = np.where(np.isnan(a), b, np.where(np.isnan(b), a, (a + b) / 2))
        known = ~np.isnan(lat)
        if known.any():
            lat = np.where(known, lat, np.interp(at, at[known], lat[known]))
        s, m = (x[~np.isnan(x)] for x in (lat[near_sep], lat[near_mar]))
        out.append((np.ptp(s) if len(s) else None, np.ptp(m) if len(m) > 1 else np.inf, len(m)))
    return out


def test_sweep_over_lost_latitudes_equals_interpolating_anew():
    rng, tols = np.random.default_rng(12), np.arange(1, 61) * 0.005
    for n in (1, 2, 3, 10, 80, 80, 400):
        at = np.sort(rng.choice(10**9, n, replace=False))
        lats, decs = rng.normal(30, 20, (2, n)), np.abs(rng.normal(0, 0.15, (2, n)))
        lats[rng.random((2, n)) < 0.15] = np.nan
        decs[:, n // 2 :] = np.round(decs[:, n // 2 :], 2)  # on the grid of tolerances
        windows = [rng.random(n) < share for share in (0.4, 0.2)]
        got, want = (f(at, lats, decs, *windows, tols) for f in (positions_op.spreads, slow_spreads))
        for g, w in zip(got, want, strict=True):
            assert g[2] == w[2] and (g[0] is None) == (w[0] is None) and np.allclose([x or 0 for x in g[:2]], [x or 0 for x in w[:2]], atol=1e-9)


def test_linkage_equals_the_slow_one():
    rng = np.random.default_rng(9)
    for n in range(1, 16):
        points = rng.integers(0, 6, (n, 2)).astype(float)  # with ties
        groups = [[i] for i in range(n)]
        far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        while len(groups) > 2:
            _, i, j = min((far[np.ix_(groups[i], groups[j])].max(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            groups[i] += groups.pop(j)
        want = [1 if any(0 in g and i in g for g in groups) else 2 for i in range(n)]
        assert behaviour.complete_linkage_two(points).tolist() == want


def test_linkage_of_all_combinations_equals_one_by_one(monkeypatch):
    rng = np.random.default_rng(10)
    used = [list(c) for k in (1, 2, 3) for c in itertools.combinations(range(5), k)]
    for n in range(1, 16):
        points = rng.integers(0, 5, (n, 5)).astype(float) if n % 2 else rng.normal(size=(n, 5))
        want = np.array([behaviour.complete_linkage_two(points[:, u]) for u in used])
        for cells in (1 << 22, 700):
            monkeypatch.setattr(behaviour, "LINKED_CELLS", cells)
            assert (behaviour.linkage_of_combinations(points, used) == want).all()


def test_light_files_are_written_by_several_tasks(spark, sf, tmp_path, monkeypatch):
    from wayfowl.plans import place_queries, registry

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # Spark joins small partitions, which these are
    for name in ("a1_read_light_delimited", "a2_read_light_tabbed"):
        path = str(tmp_path / name)
        monkeypatch.setattr(place_queries, "_scratch", lambda _, path=path: path)
        rows = registry.queries()[name](spark, sf).count()
        parts = {f.name.split("-")[1] for f in (tmp_path / name).glob("*/part-*")}
        assert rows == spark.read.text(path + "/*").count() and len(parts) > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def chords_of_sql(p):
    """The walk as its SQL states it: sums row by row, squares by pow."""
    steps = [math.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1])) for a, b in itertools.pairwise(p)]
    step = 0.0
    for s in steps:
        step += s
    step /= len(steps)
    out, i = [tuple(p[0])], 1
    while i < len(p):
        (fx, fy), (ax, ay), (bx, by) = out[-1], p[i - 1], p[i]
        if math.sqrt(math.pow(bx - fx, 2) + math.pow(by - fy, 2)) < step:
            i += 1
            continue
        lx, ly = bx - ax, by - ay
        qa, qb, qc = math.pow(lx, 2) + math.pow(ly, 2), 2 * ((ax - fx) * lx + (ay - fy) * ly), math.pow(ax - fx, 2) + math.pow(ay - fy, 2) - step * step
        t = (-qb + math.sqrt(max(0.0, qb * qb - 4 * qa * qc))) / (2 * qa)
        out.append((ax + t * lx, ay + t * ly))
    return out


def test_a_long_walk_keeps_to_the_last_digit(spark):
    paths = {}
    for seed in range(40):
        rng = np.random.default_rng(seed)
        paths[seed] = np.stack([rng.integers(1, 51, 200).astype(float), np.floor(rng.random(200) * 500) / 10], 1).tolist()
    rows = [(seed, 1, T0 + dt.timedelta(days=i), i, *p) for seed, path in paths.items() for i, p in enumerate(path)]
    got = tracks.rediscretise(spark.createDataFrame(rows, "trip_id long, seg int, ts timestamp, ord long, x double, y double")).orderBy("ord").collect()
    for seed, path in paths.items():
        assert [(r.x, r.y) for r in got if r.trip_id == seed] == chords_of_sql(path)


def test_walks_side_by_side_equal_walks_alone():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 60, 300)
    end = np.cumsum(n)
    p, step = rng.normal(0, 20, (end[-1], 2)), np.where(n > 1, rng.exponential(20, 300), 0.0)
    path, x, y = tracks._walk_all(*p.T.copy(), end - n, end, step)
    for k in range(300):
        assert np.array_equal(tracks.equal_chords(p[end[k] - n[k] : end[k]], step[k]), np.stack([x, y], 1)[path == k])


def test_metrics_without_places_are_not_rounded(spark):
    steps = spark.createDataFrame([(1, 1, 1.0, 0.0, 199.9999999, 0.1, 0.0), (1, 1, 0.0, 0.0, 0.0, 0.1, 0.0)], "trip_id long, seg int, dx double, dy double, dist double, rel_angle double, r2n double")
    assert tracks.raw_shape_metrics(steps, places=None).first().straightness == 1 / 199.9999999  # a bit over 0.005, by less than nine places show


def files_written(spark, sf, name, monkeypatch):
    """How many files a query leaves in the scratch folders that it makes, and its trips."""
    from pathlib import Path

    from wayfowl.plans import place_queries, registry

    made, scratch = [], place_queries._scratch
    monkeypatch.setattr(place_queries, "_scratch", lambda s: made.append(scratch(s)) or made[-1])
    trips = registry.queries()[name](spark, sf).select("trip_id").distinct().count()
    return sum(len(list(Path(p.removeprefix("file:")).rglob("part-*"))) for p in made), trips


def test_twilights_are_written_to_fewer_files_than_trips(spark, sf, monkeypatch):
    n, trips = files_written(spark, sf, "a6_write_twilights", monkeypatch)
    assert 0 < n <= 64 < trips


def test_light_is_written_to_fewer_files_than_trips(spark, sf, monkeypatch):
    for name in ("a1_read_light_delimited", "a2_read_light_tabbed"):
        n, trips = files_written(spark, sf.replace("sf0.001", "sf0.01"), name, monkeypatch)
        assert 0 < n <= 64 < trips


def test_light_of_many_trips_in_one_file(spark, tmp_path):
    from wayfowl.sources import files

    (tmp_path / "all.lig").write_text("ok,01/02/2024 03:04:05,0,1.5,7\nok,01/02/2024 03:05:05,0,,8\n")
    got = files.normalise_light(files.read_light_delimited(spark, str(tmp_path / "all.lig"), trip_field=4)).orderBy("ts").collect()
    assert [(r.trip_id, r.lux) for r in got] == [("7", 1.5), ("8", None)]


def test_latitude_lost_between_rows_of_one_time():
    at, lat = np.array([0, 5, 5, 5, 9]), np.array([[0.0, 10.0, 99.0, 30.0, 40.0]] * 2)
    decs = np.array([[1.0, 1.0, 0.0, 1.0, 1.0]] * 2)
    inside = np.array([True, False, True, False, False])
    got = positions_op.spreads(at, lat, decs, inside, inside, np.array([0.1, 0.2]))
    assert got == [(10.0, 10.0, 2), (10.0, 10.0, 2)]  # the known row before it, as interpolate() and SQL have it
