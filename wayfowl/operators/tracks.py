"""Track preparation, segmentation and segment metrics. A track has trip_id, ts, ord, x, y; distances are in its units."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfowl.functions.tracks import checkpoint_folder, in_order, near_day, one_trip_a_partition, us

ATTRIBUTES = ("dx", "dy", "dist", "dt", "r2n", "abs_angle", "rel_angle")


def _turn(a: Column, b: Column) -> Column:
    """b - a within (-pi, pi], half a turn being pi however it is rounded."""
    d, eps = b - a, 1e-9
    return F.when(d > F.lit(np.pi + eps), d - 2 * np.pi).when(d <= F.lit(-np.pi + eps), d + 2 * np.pi).otherwise(d)


def step_attributes(track: DataFrame, keys: tuple[str, ...] = ("trip_id",)) -> DataFrame:
    """Step to the next point: dx, dy, dist, dt (seconds), its direction and the turn from the step before; r2n is the squared
    distance to the track's first point. A step without length has no direction."""
    w = Window.partitionBy(*keys).orderBy("ts", "ord")
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    d = track.withColumn("dx", F.lead("x").over(w) - F.col("x")).withColumn("dy", F.lead("y").over(w) - F.col("y"))
    d = d.withColumn("dist", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).withColumn("dt", (us(F.lead("ts").over(w)) - us("ts")) / 1e6)
    ax, ay = F.col("x") - F.first("x").over(first), F.col("y") - F.first("y").over(first)
    d = d.withColumn("r2n", ax * ax + ay * ay).withColumn("abs_angle", F.when(F.col("dist") >= 1e-7, F.atan2("dy", "dx")))
    return d.withColumn("rel_angle", _turn(F.lag("abs_angle").over(w), F.col("abs_angle")))


def rows_without_jumps(x: list, y: list, limit: float) -> np.ndarray:
    """Which of a trip's rows, in order, stay when rounds drop all rows whose step to the next one is too long until none is. A
    round only looks at rows whose next one went in the round before, so the work is in proportion to the rows."""
    n = len(x)
    keep, after, before = np.ones(n, bool), list(range(1, n + 1)), list(range(-1, n - 1))

    def far(i: int) -> bool:
        j = after[i]
        if j == n or None in (x[i], y[i], x[j], y[j]):
            return False
        return not math.sqrt((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2) <= limit  # what is not a number is far, as in Spark's order

    look = list(range(n))
    while gone := [i for i in look if far(i)]:
        keep[gone] = False
        for i in gone:
            a, b = before[i], after[i]
            if a >= 0:
                after[a] = b
            if b < n:
                before[b] = a
        look = list({a for i in gone if (a := before[i]) >= 0 and keep[a]})
    return keep


def drop_large_jumps(track: DataFrame, limit: float = 40.0, window_rounds: int = 12) -> DataFrame:
    """Drops rows whose step to the next one is too long, until none is, then rows without complete attributes. A round is a
    window and a filter; dirty trips go on to the next one, clean ones are set aside, and each round is checkpointed. Trips that
    are dirty after `window_rounds` are finished by one pass over each trip's rows, however many rounds they need."""
    checkpoint_folder(track.sparkSession)
    todo, done = track, None
    for _ in range(window_rounds):
        w = in_order()
        step = F.sqrt(F.pow(F.lead("x").over(w) - F.col("x"), 2.0) + F.pow(F.lead("y").over(w) - F.col("y"), 2.0))
        marked = todo.withColumn("_far", F.coalesce(step > limit, F.lit(False))).withColumn("_dirty", F.max("_far").over(Window.partitionBy("trip_id")))
        marked = marked.checkpoint()
        clean = marked.where(~F.col("_dirty")).drop("_far", "_dirty")
        done = clean if done is None else done.unionByName(clean)
        todo = marked.where(F.col("_dirty") & ~F.col("_far")).drop("_far", "_dirty")
        if todo.isEmpty():
            break
    else:

        def one(rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, [("ts", "ascending"), ("ord", "ascending")], null_placement="at_start"))
            x, y = (rows[c].cast(pa.float64()).to_pylist() for c in ("x", "y"))
            return rows.filter(pa.array(rows_without_jumps(x, y, limit)))

        rest = todo.groupBy("trip_id").applyInArrow(one, todo.schema)
        done = rest if done is None else done.unionByName(rest)
    return step_attributes(done).na.drop(subset=[*ATTRIBUTES])


def drop_large_jumps_once(track: DataFrame, limit: float = 40.0) -> DataFrame:
    w = in_order()
    step = F.sqrt(F.pow(F.lead("x").over(w) - F.col("x"), 2.0) + F.pow(F.lead("y").over(w) - F.col("y"), 2.0))
    return track.withColumn("_d", step).where(F.col("_d").isNull() | (F.col("_d") <= limit)).drop("_d")


def equinox_label(track: DataFrame, d: int = 20, sep: int = 23, mar: int = 21) -> DataFrame:
    day = F.to_date("ts")
    return track.withColumn("equinox", F.when(near_day(day, 9, sep, d), "Sep").when(near_day(day, 3, mar, d), "Mar").otherwise("No"))


def remove_dates(track: DataFrame, days: DataFrame) -> DataFrame:
    """Without the positions of the given (trip_id, day)."""
    return track.withColumn("day", F.to_date("ts")).join(days.select("trip_id", "day").distinct(), ["trip_id", "day"], "left_anti").drop("day")


def collapse_static_equinox(track: DataFrame) -> DataFrame:
    """Of an equinox window with one latitude only its first and last rows stay."""
    group = Window.partitionBy("trip_id", "equinox")
    w = group.orderBy("ts", "ord")
    static = (F.col("equinox") != "No") & (F.min("y").over(group) == F.max("y").over(group))
    i, n = F.row_number().over(w), F.count("*").over(group)
    return track.withColumn("_k", ~F.coalesce(static, F.lit(False)) | (i == 1) | (i == n)).where("_k").drop("_k")


def drop_repeated_lat(track: DataFrame, more_than: int = 4) -> DataFrame:
    """Where a trip has more than so many repeated latitudes, the first of each stays."""
    i = F.row_number().over(Window.partitionBy("trip_id", "y").orderBy("ts", "ord"))
    marked = track.withColumn("_i", i).withColumn("_d", F.count_if(F.col("_i") > 1).over(Window.partitionBy("trip_id")))
    return marked.where((F.col("_d") <= more_than) | (F.col("_i") == 1)).drop("_i", "_d")


def trim_ends(track: DataFrame, last: int = 5, first: int = 5, drop_last: int = 5, drop_first: int = 4) -> DataFrame:
    """Repeated latitudes within the last rows: these go. Else, within the first rows: the first go."""
    d = track.withColumn("_i", F.row_number().over(in_order())).withColumn("_n", F.count("*").over(Window.partitionBy("trip_id")))

    def repeats(inside: Column) -> Column:
        y = F.when(inside, F.col("y"))
        return F.count(y) > F.count_distinct(y)

    ends = d.where((F.col("_i") > F.col("_n") - last) | (F.col("_i") <= first)).groupBy("trip_id").agg(repeats(F.col("_i") > F.col("_n") - last).alias("_late"), repeats(F.col("_i") <= first).alias("_early"))
    d = d.join(ends, "trip_id", "left")
    gone = (F.col("_late") & (F.col("_i") > F.col("_n") - drop_last)) | (~F.col("_late") & F.col("_early") & (F.col("_i") <= drop_first))
    return d.where(~gone).drop("_i", "_n", "_late", "_early")


def colony_r2n(track: DataFrame, colonies: DataFrame) -> DataFrame:
    """r2n as the squared distance to the trip's colony (lon, lat)."""
    j = track.join(colonies.select("trip_id", F.col("lon").alias("_x"), F.col("lat").alias("_y")), "trip_id", "left")
    return j.withColumn("r2n", F.pow(F.col("x") - F.col("_x"), 2.0) + F.pow(F.col("y") - F.col("_y"), 2.0)).drop("_x", "_y")


# --- segmentation: a dynamic programme per trip ------------------------------------------------------------------------


#: Rows of a block: starts and ends of segments are compared by blocks first.
SEGMENT_BLOCK = 128
#: Least variance of a segment or cluster.
LEAST_VARIANCE = 1e-6


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(v, axis=0)]) for v in (values, values**2))


def _costs(s: np.ndarray, q: np.ndarray, starts: np.ndarray, ends: np.ndarray, lmin: int) -> np.ndarray:
    length = ends[None, :] - starts[:, None]
    safe, product = np.maximum(length, 1), np.ones(length.shape)
    for c in range(s.shape[1]):
        mean = (s[ends, c][None] - s[starts, c][:, None]) / safe
        product *= 2 * np.pi * np.maximum((q[ends, c][None] - q[starts, c][:, None]) / safe - mean * mean, LEAST_VARIANCE)
    cost = safe * (np.log(product) + s.shape[1])
    return np.where(length >= lmin, 0.5 * cost, np.inf)


def segment_costs(values: np.ndarray, lmin: int) -> np.ndarray:
    """cost[i, j] of rows i..j-1 as one segment: Gaussian, with a mean and a variance of its own, from prefix sums."""
    rows = np.arange(len(values) + 1)
    return _costs(*_sums(values), rows, rows, lmin)


def _least_costs(s: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray, lo: int, hi: int, lmin: int) -> np.ndarray:
    """For blocks of starts first..last, a bound below the costs of all segments to the ends lo..hi-1; -inf where the blocks touch.
    A segment's sum of squares is no less than that of the rows which all these segments share, and for a given sum the cost is
    concave in the length and then falls, so that its least value is at one of the lengths' ends."""
    inner = np.maximum(lo - last, 1)
    least = np.zeros(len(first))
    for c in range(s.shape[1]):
        squares = q[lo, c] - q[last, c] - (s[lo, c] - s[last, c]) ** 2 / inner
        squares = np.maximum(squares - 1e-12 * q[-1, c], 0)  # what prefix sums may have lost
        costs = [n * (np.log(2 * np.pi * np.maximum(squares / n, LEAST_VARIANCE)) + 1) for n in (np.maximum(inner, lmin), hi - 1 - first)]
        least += 0.5 * np.minimum(*costs)
    return np.where(lo > last, least - 1e-9 * np.abs(least), -np.inf)


def best_segments(values: np.ndarray, kmax: int, lmin: int, block: int = SEGMENT_BLOCK) -> tuple[list[list[int]], np.ndarray]:
    """For each number of segments the ends of the best split, and its cost. For a block of ends, blocks of starts are visited in the
    order of a bound below their costs, until it is above what each of the ends has reached: starts that can't win are pruned by the
    block, and the result is exact. Memory is in proportion to rows times kmax; of equally good starts the first is taken."""
    n = len(values)
    kmax = min(kmax, n // lmin)
    if kmax < 1:
        return [], np.zeros(0)
    s, q = _sums(values - values.mean(axis=0))
    best, back = np.full((kmax, n + 1), np.inf), np.zeros((kmax, n + 1), np.int32)
    least = np.full((kmax, n // block + 1), np.inf)  # of each block's entries in best
    for lo in range(0, n + 1, block):
        hi = min(lo + block, n + 1)
        ends, here = np.arange(lo, hi), lo // block
        best[0, lo:hi] = _costs(s, q, np.zeros(1, int), ends, lmin)[0]
        least[0, here] = best[0, lo:hi].min()
        first = np.arange(0, max(hi - lmin, 0), block)
        if not len(first):
            continue
        bound, costs = _least_costs(s, q, first, np.minimum(first + block - 1, n), lo, hi, lmin), {}
        for k in range(1, kmax):
            can = ends >= (k + 1) * lmin
            if not can.any():
                break
            now, at = np.full(hi - lo, np.inf), np.zeros(hi - lo, np.int32)
            hope = least[k - 1, : len(first)] + bound
            for i in np.argsort(hope, kind="stable").tolist():
                if hope[i] > now[can].max():
                    break
                if least[k - 1, i] == np.inf:
                    continue
                if i not in costs:
                    costs[i] = _costs(s, q, np.arange(first[i], min(first[i] + block, n + 1)), ends, lmin)
                total = best[k - 1, first[i] : first[i] + block, None] + costs[i]
                start = total.argmin(axis=0)
                found = total[start, np.arange(hi - lo)]
                start += first[i]
                better = (found < now) | ((found == now) & (start < at))
                now[better], at[better] = found[better], start[better]
            best[k, lo:hi], back[k, lo:hi], least[k, here] = now, at, now.min()
    ends = []
    for k in range(kmax):
        cut, at = [n], n
        for b in back[1 : k + 1][::-1]:
            at = int(b[at])
            cut.append(at)
        ends.append(cut[::-1])
    return ends, best[:, n].copy()


def cluster_segments(values: np.ndarray, ends: list[int], clusters: int, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Groups given segments by mean and variance (classification EM): the label of each segment and the log-likelihood."""
    parts = np.split(values, ends[:-1])
    size, mean, sq = np.array([len(p) for p in parts]), np.array([p.mean(axis=0) for p in parts]), np.array([(p**2).mean(axis=0) for p in parts])
    order = np.argsort(mean[:, 0], kind="stable")
    label = np.empty(len(parts), int)
    label[order] = np.arange(len(parts)) * clusters // len(parts)
    loglik = -np.inf
    for _ in range(rounds):
        fit = np.full((len(parts), clusters), -np.inf)
        for c in range(clusters):
            own = label == c
            if own.any():
                w = size[own] / size[own].sum()
                m = w @ mean[own]
                var = np.maximum(w @ sq[own] - m**2, LEAST_VARIANCE)
                fit[:, c] = -0.5 * size * (np.log(2 * np.pi * var) + (sq - 2 * m * mean + m**2) / var).sum(axis=1)
        new = fit.argmax(axis=1)
        loglik = float(fit.max(axis=1).sum())
        if (new == label).all():
            break
        label = new
    return label, loglik


class Clusters:
    """Means and variances that the segments of a cluster share."""

    def __init__(self, values: np.ndarray, label: np.ndarray, clusters: int, before: Clusters | None = None):
        """Of labelled rows; a cluster without rows keeps what it had before."""
        count = np.bincount(label, minlength=clusters)
        sums = [np.array([np.bincount(label, v[:, c], clusters) for c in range(values.shape[1])]) for v in (values, values**2)]
        self.mean = sums[0] / np.maximum(count, 1)
        self.var = np.maximum(sums[1] / np.maximum(count, 1) - self.mean**2, LEAST_VARIANCE)
        if before is not None:
            self.mean[:, count == 0], self.var[:, count == 0] = before.mean[:, count == 0], before.var[:, count == 0]

    def density(self, values: np.ndarray) -> np.ndarray:
        """Log-density of each row under each cluster (clusters x rows)."""
        out = np.zeros((self.mean.shape[1], len(values)))
        for v, m, var in zip(values.T, self.mean, self.var, strict=True):
            out -= 0.5 * (np.log(2 * np.pi * var)[:, None] + (v[None] - m[:, None]) ** 2 / var[:, None])
        return out

    def likeliest(self, values: np.ndarray, ends: list[int]) -> float:
        """The log-likelihood of given segments, each in its likeliest cluster."""
        return float(np.add.reduceat(self.density(values), [0, *ends[:-1]], axis=1).max(axis=0).sum())


def segments_under(density: np.ndarray, k: int, lmin: int) -> tuple[list[int], list[int], float]:
    """Ends, clusters and log-likelihood of the best k segments of at least lmin rows when each row has these log-densities. As rows
    add up, the best start before each end is a running maximum, and time is in proportion to rows."""
    n = density.shape[1]
    total = np.concatenate([np.zeros((len(density), 1)), np.cumsum(density, axis=1)], axis=1)
    best = np.full((k + 1, n + 1), -np.inf)
    best[0, 0] = 0
    before, after = np.empty_like(total), np.empty((len(total), n + 1 - lmin))
    for i in range(1, k + 1):
        np.maximum.accumulate(np.subtract(best[i - 1], total, out=before), axis=1, out=before)
        np.add(total[:, lmin:], before[:, : n + 1 - lmin], out=after).max(axis=0, out=best[i, lmin:])
    ends, labels, at = [], [], n
    for i in range(k, 0, -1):
        before = best[i - 1, : at - lmin + 1][None] - total[:, : at - lmin + 1]
        start = before.argmax(axis=1)
        c = int((before[np.arange(len(before)), start] + total[:, at]).argmax())
        ends.append(at)
        labels.append(c)
        at = int(start[c])
    return ends[::-1], labels[::-1], float(best[k, n])


def joint_segments(values: np.ndarray, k: int, clusters: Clusters, lmin: int, rounds: int = 30) -> tuple[list[int], np.ndarray, Clusters, list[float]]:
    """Segments, their clusters and the clusters' parameters, and the log-likelihood of each round. Rounds alternate between the best
    segments under the clusters and the best clusters of the segments, so the likelihood never falls; they end when it stays."""
    history: list[float] = []
    for _ in range(rounds):
        ends, labels, found = segments_under(clusters.density(values), k, lmin)
        if history and found <= history[-1] + 1e-9 * abs(history[-1]):
            break
        history.append(found)
        kept = ends, np.array(labels), clusters
        clusters = Clusters(values, np.repeat(labels, np.diff([0, *ends])), len(clusters.mean.T), clusters)
    return *kept, history


def row_clusters(values: np.ndarray, clusters: int, seed: int = 0, rounds: int = 10) -> Clusters:
    """Clusters of rows without their order: the farthest row of those chosen is chosen next, then rows and means alternate."""
    scaled = (values - values.mean(axis=0)) / np.maximum(values.std(axis=0), 1e-3)
    centre = scaled[[int(np.random.default_rng(seed).integers(len(values)))]]
    far = ((scaled - centre[0]) ** 2).sum(axis=1)
    while len(centre) < clusters:
        centre = np.concatenate([centre, scaled[[int(far.argmax())]]])
        far = np.minimum(far, ((scaled - centre[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        label = ((scaled[None] - centre[:, None]) ** 2).sum(axis=2).argmin(axis=0)
        count = np.bincount(label, minlength=clusters)
        mean = np.array([np.bincount(label, v, clusters) for v in scaled.T]).T / np.maximum(count, 1)[:, None]
        centre = np.where(count[:, None] > 0, mean, centre)
    return Clusters(values, label, clusters)


def merged_segments(values: np.ndarray, ends: list[int], least: int) -> dict[int, np.ndarray]:
    """For each number of groups down to `least` the labels of the given segments when the two groups whose union costs least are
    merged again and again."""
    parts = np.split(values, ends[:-1])
    size, sums = np.array([len(p) for p in parts], float), np.array([[p.sum(axis=0), (p**2).sum(axis=0)] for p in parts])

    def cost(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        mean = m[..., 0, :] / n[..., None]
        return 0.5 * n * np.log(np.maximum(m[..., 1, :] / n[..., None] - mean * mean, LEAST_VARIANCE)).sum(axis=-1)

    label = np.arange(len(parts))
    out = {len(parts): label}
    while len(size) > least:
        alone = cost(size, sums)
        more = cost(size[:, None] + size, sums[:, None] + sums) - alone[:, None] - alone
        i, j = divmod(int(np.where(np.tri(len(size), dtype=bool), np.inf, more).argmin()), len(size))
        size[i], sums[i] = size[i] + size[j], sums[i] + sums[j]
        size, sums = np.delete(size, j), np.delete(sums, j, axis=0)
        label = np.where(label == j, i, np.where(label > j, label - 1, label))
        out[len(size)] = label
    return out


def joint_model(values: np.ndarray, k: int, clusters: int, ends: list[int], lmin: int, starts: list[Clusters], merged: np.ndarray | None = None) -> tuple[list[int], np.ndarray, Clusters, float]:
    """The joint model from the start whose first segments are likeliest: the given ends with their segments clustered (so it is
    never below that two-stage model) or merged, and the given clusters."""
    labels = cluster_segments(values, ends, clusters)[0], merged_segments(values, ends, clusters)[clusters] if merged is None else merged
    rows = [np.repeat(label, np.diff([0, *ends])) for label in labels]
    own = max((Clusters(values, r, clusters) for r in rows), key=lambda c: c.likeliest(values, ends))
    first = max([own, *starts], key=lambda c: segments_under(c.density(values), k, lmin)[2]) if starts else own
    cut, label, found, history = joint_segments(values, k, first, lmin)
    return cut, label, found, history[-1]


_SEGMENTS = "trip_id long, n_seg int, n_cluster int, bic double, seg int, state int, first_row int, last_row int"


def segment_tracks(track: DataFrame, kmax: int = 15, lmin: int = 5, clusters: tuple[int, ...] = tuple(range(5, 11)), columns: tuple[str, ...] = ("x", "y"), seeds: int = 0) -> DataFrame:
    """Joint segmentation and clustering of each trip for every number of clusters: n_seg and bic of the best model, and its
    segments with their cluster (state). Segments of a cluster share its mean and variance. Starts are the best segments with
    parameters of their own, clustered or merged, `seeds` clusterings of rows, and what the model of one segment less has found. A trip is one group of
    its own rows, whatever its length; rows without values of the columns don't count."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "ord"], ignore_index=True)
        values = pdf[list(columns)].to_numpy(np.float64)
        rows, trip = [], int(pdf.trip_id.iloc[0])
        ends, _ = best_segments(values, kmax, lmin)
        merged = {len(cut): merged_segments(values, cut, min(clusters)) for cut in ends if len(cut) >= min(clusters)}
        for c in clusters:
            starts = [row_clusters(values, c, seed) for seed in range(seeds)] if len(ends) >= c else []
            models, last = [], []
            for cut in ends[c - 1 :]:
                cut, label, own, ll = joint_model(values, len(cut), c, cut, lmin, [*starts, *last], merged[len(cut)][c])
                last = [own]
                free = len(cut) - 1 + 2 * len(columns) * c
                models.append((2 * ll - free * np.log(len(values)), cut, label))
            if models:
                bic, cut, label = max(models, key=lambda m: m[0])
                rows += [(trip, len(cut), c, bic, i + 1, int(s) + 1, a + 1, b) for i, (s, a, b) in enumerate(zip(label, [0, *cut[:-1]], cut, strict=True))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _SEGMENTS.split(", ")])

    return track.select("trip_id", "ts", "ord", *columns).na.drop(subset=list(columns)).transform(one_trip_a_partition).groupBy("trip_id").applyInPandas(one, _SEGMENTS)


def select_model(models: DataFrame) -> DataFrame:
    """The model with the largest BIC of each trip; ties go to fewer segments, then fewer clusters."""
    w = Window.partitionBy("trip_id").orderBy(F.desc("bic"), "n_seg", "n_cluster")
    return models.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def segment_stats(steps: DataFrame, columns: tuple[str, ...] = ("dx", "dy", "r2n", "x", "y", "dist")) -> DataFrame:
    """Mean and sample deviation of each column per (trip_id, seg)."""
    return steps.groupBy("trip_id", "seg").agg(*(a for c in columns for a in (F.avg(c).alias(f"mu_{c}"), F.stddev_samp(c).alias(f"sd_{c}"))))


def raw_shape_metrics(steps: DataFrame, frame_s: float = 1 / 50, places: int | None = 3) -> DataFrame:
    """Per (trip_id, seg), from the raw steps: straightness, sinuosity, Emax, expected squared displacement, directional change.
    Sums over steps only; a segment without turns gets nulls. Without `places` nothing is rounded."""
    c, to = F.cos("rel_angle"), lambda m: m if places is None else F.round(m, places)
    w = Window.partitionBy("trip_id", "seg")
    a = steps.withColumn("_x", F.sum("dx").over(w)).withColumn("_y", F.sum("dy").over(w))
    dc = F.abs(F.degrees("rel_angle")) / frame_s
    s = a.groupBy("trip_id", "seg").agg(
        F.sum("dist").alias("length"), F.sqrt(F.first("_x") * F.first("_x") + F.first("_y") * F.first("_y")).alias("net"), F.count("dist").alias("n"), F.avg("dist").alias("p"),
        F.stddev_samp("dist").alias("sd"), F.avg(F.col("dist") * F.col("dist")).alias("p2"), F.avg(c).alias("c"), F.avg(F.sin("rel_angle")).alias("s"), F.avg(dc).alias("dc_mean"), F.stddev_samp(dc).alias("dc_sd"), F.avg("r2n").alias("r2n_mean"), F.stddev_samp("r2n").alias("r2n_sd"),
    )
    b2 = F.pow(F.col("sd") / F.nullif("p", F.lit(0.0)), 2.0)
    one = F.when(F.abs(F.col("c")) < 1, F.col("c"))
    sq = F.col("n") * F.col("p2") + 2 * F.col("p") * F.col("p") * (one / (1 - one)) * (F.col("n") - (1 - F.pow(one, F.col("n").cast("double"))) / (1 - one))
    inner = F.col("p") * ((1 + one) / (1 - one) + b2)
    return s.select(
        "trip_id", "seg", to(F.col("net") / F.nullif("length", F.lit(0.0))).alias("straightness"), to(F.when(inner > 0, 2 / F.sqrt(inner))).alias("sinuosity"), to(one / (1 - one)).alias("emax"),
        to(sq).alias("sq_disp"), to(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("ang_vector"), to(F.atan2("s", "c")).alias("ang_mean"), to(F.col("dc_mean")).alias("dc_mean"), to(F.col("dc_sd")).alias("dc_sd"), to(F.col("r2n_mean")).alias("r2n_mean"), to(F.col("r2n_sd")).alias("r2n_sd"),
    )


#: Metrics that the reference takes from the rediscretised track; all others come from the raw steps.
OF_REDISCRETISED = ("straightness", "sinuosity", "ang_vector", "ang_mean")


def shape_metrics(track: DataFrame, frame_s: float = 1 / 50, places: int | None = 3, by: str = "seg") -> DataFrame:
    """Per (trip_id, by), where `by` is the segment or its cluster, the metrics of raw_shape_metrics from steps between the group's own
    positions, but turning vector, straightness and sinuosity of its track rediscretised to its mean step. track may bring r2n."""
    own = track.select("trip_id", F.col(by).alias("seg"), "ts", "ord", "x", "y", *(F.col(c).alias("_r2n") for c in track.columns if c == "r2n"))
    keys = ("trip_id", "seg")
    steps = step_attributes(own, keys)
    if "_r2n" in own.columns:
        steps = steps.withColumn("r2n", F.col("_r2n")).drop("_r2n")
    walked = raw_shape_metrics(step_attributes(rediscretise(own), keys), frame_s, places)
    raw = raw_shape_metrics(steps, frame_s, places).drop(*OF_REDISCRETISED)
    return raw.join(walked.select(*keys, *OF_REDISCRETISED), [*keys], "left").withColumnRenamed("seg", by)


_REDISCRETISED = "trip_id long, seg int, ord long, ts timestamp, x double, y double"


def _walk(x: list, y: list, i: int, n: int, at: tuple[float, float], step: float) -> list[tuple[float, float]]:
    """The points of equal_chords after `at`, which lies before row i of rows up to n. Squares are those of pow, as in SQL, and terms in
    its order: where a step meets a leg at a flat angle, the last digit grows from chord to chord."""
    out, pow2 = [], math.pow
    ax, ay = at
    while i < n:
        if not math.sqrt(pow2(x[i] - ax, 2) + pow2(y[i] - ay, 2)) >= step:
            i += 1
            continue
        cx, cy = x[i - 1], y[i - 1]
        dx, dy, ex, ey = x[i] - cx, y[i] - cy, cx - ax, cy - ay  # |e + t d| = step, the later of both places
        qa, qb, qc = pow2(dx, 2) + pow2(dy, 2), 2 * (ex * dx + ey * dy), pow2(ex, 2) + pow2(ey, 2) - step * step
        t = (-qb + math.sqrt(max(0.0, qb * qb - 4 * qa * qc))) / (2 * qa)
        ax, ay = cx + t * dx, cy + t * dy
        out.append((ax, ay))
    return out


def equal_chords(p: np.ndarray, step: float) -> np.ndarray:
    """Points on a path, each `step` from the one before in a straight line; what is left at the end is shorter than a step."""
    return np.array([p[0], *(_walk(*p.T.tolist(), 1, len(p), tuple(p[0].tolist()), step) if step > 0 else ())])


#: Rows whose paths are walked at once, and the number of paths from which on each is walked alone.
WALK_ROWS, WALK_ALONE = 1 << 16, 32


def _pow2(v: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.pow, v.tolist(), itertools.repeat(2.0)), np.float64, len(v))


def _walk_all(x: np.ndarray, y: np.ndarray, start: np.ndarray, end: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, x, y) of equal_chords of all paths, whose rows go from start to end: all of them look at their next row or go on by a
    chord at once, with the terms of _walk."""
    ax, ay, i = x[start], y[start], start + 1
    found = [(np.arange(len(start)), ax.copy(), ay.copy())]
    g = np.flatnonzero((step > 0) & (i < end))
    while len(g) > WALK_ALONE:
        row, p = i[g], step[g]
        dx, dy = x[row] - ax[g], y[row] - ay[g]
        d = np.sqrt(dx * dx + dy * dy)
        far = d >= p
        near = np.flatnonzero(np.abs(d - p) <= 1e-12 * p)
        if len(near):
            far[near] = np.sqrt(_pow2(dx[near]) + _pow2(dy[near])) >= p[near]
        i[g[~far]] += 1
        h, row, p = g[far], row[far], p[far]
        if len(h):
            cx, cy = x[row - 1], y[row - 1]
            dx, dy, ex, ey = x[row] - cx, y[row] - cy, cx - ax[h], cy - ay[h]
            qa, qb, qc = _pow2(dx) + _pow2(dy), 2 * (ex * dx + ey * dy), _pow2(ex) + _pow2(ey) - p * p
            t = (-qb + np.sqrt(np.maximum(0.0, qb * qb - 4 * qa * qc))) / (2 * qa)
            ax[h], ay[h] = cx + t * dx, cy + t * dy
            found.append((h, ax[h], ay[h]))
        g = g[i[g] < end[g]]
    for k in g.tolist():
        a, n = int(i[k]) - 1, int(end[k])
        rest = _walk(x[a:n].tolist(), y[a:n].tolist(), 1, n - a, (float(ax[k]), float(ay[k])), float(step[k]))
        if rest:
            found.append((np.full(len(rest), k), *np.array(rest).T))
    path, px, py = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(path, kind="stable")
    return path[order], px[order], py[order]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of sorted rows as tables of so many rows or more that hold whole groups, and where each group starts."""

    def numbers(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        return np.array([batch.column(k).cast(pa.int64()).fill_null(-(2**63)).to_numpy() for k in keys])

    def whole(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        now = numbers(table)
        return table, np.flatnonzero(np.concatenate([[True], (now[:, 1:] != now[:, :-1]).any(axis=0)]))

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= rows:
            other = (numbers(batch) != numbers(held[-1].slice(held[-1].num_rows - 1))).any(axis=0)
            if other.any():
                cut = int(other.argmax())
                yield whole([*held, batch.slice(0, cut)])
                held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield whole(held)


def rediscretise(track: DataFrame) -> DataFrame:
    """Each segment's path walked again in straight steps of its mean step length. The paths of a task are walked side by side, in
    blocks of whole segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in _whole_groups(batches, ("trip_id", "seg"), WALK_ROWS):
            x, y = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y"))
            group = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
            known = ~(np.isnan(x) | np.isnan(y))
            x, y, group = x[known], y[known], group[known]
            here, start = np.unique(group, return_index=True)
            if not len(here):
                continue
            end = np.append(start[1:], len(x))
            own = group[1:] == group[:-1]
            dx, dy = np.diff(x)[own], np.diff(y)[own]
            n = end - start
            length = np.bincount(np.searchsorted(here, group[1:][own]), np.sqrt(dx * dx + dy * dy), len(here))  # added up row by row
            path, px, py = _walk_all(x, y, start, end, np.where(n > 1, length / np.maximum(n - 1, 1), 0.0))
            at = rows.select(["trip_id", "seg", "ts"]).take(pa.array(first[here[path]]))
            place = np.arange(len(path)) - np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))[path] + 1
            columns = [at.column("trip_id").cast(pa.int64()), at.column("seg").cast(pa.int32()), pa.array(place), at.column("ts"), pa.array(px), pa.array(py)]
            yield from pa.table(columns, names=["trip_id", "seg", "ord", "ts", "x", "y"]).to_batches()

    rows = one_trip_a_partition(track.select("trip_id", "seg", "ts", "ord", "x", "y"))
    ordered = rows.sortWithinPartitions("trip_id", "seg", F.col("ts").asc_nulls_last(), F.col("ord").asc_nulls_last())
    return ordered.mapInArrow(run, _REDISCRETISED)


def r2n_limit(steps: DataFrame, lmin: int = 5) -> DataFrame:
    """(trip_id, limit): mean of r2n at the starts of the second and third segment of the best split of r2n in three."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["ts", "ord"]).r2n.to_numpy(np.float64)
        ends, _ = best_segments(v[:, None], 3, lmin)
        limit = float(v[ends[2][:2]].mean()) if len(ends) == 3 else None
        return pd.DataFrame({"trip_id": [int(pdf.trip_id.iloc[0])], "limit": [limit]})

    return steps.where("r2n IS NOT NULL").select("trip_id", "ts", "ord", "r2n").transform(one_trip_a_partition).groupBy("trip_id").applyInPandas(one, "trip_id long, limit double")
