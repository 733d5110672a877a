"""Behaviour of segments: metric combinations, clustering, rules, confidence, corrections, and labels on positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from wayfowl.functions.tracks import in_order, one_trip_a_partition


def _segs() -> WindowSpec:
    return Window.partitionBy("trip_id").orderBy("seg")


def _trip() -> WindowSpec:
    return Window.partitionBy("trip_id")


BASE_METRICS = ("straightness", "sinuosity", "ang_vector")


def metric_combinations(spark: SparkSession, groups: list[tuple[str, ...]], largest: int = 3, base: tuple[str, ...] = BASE_METRICS) -> DataFrame:
    """(combo, metrics): all subsets of 1 to `largest` metric groups, the base metrics appended. The list has a fixed size."""
    subsets = [c for k in range(1, largest + 1) for c in combinations(groups, k)]
    rows = [(i + 1, list(dict.fromkeys([m for g in c for m in g] + list(base)))) for i, c in enumerate(subsets)]
    return spark.createDataFrame(rows, "combo int, metrics array<string>")


def zscore(segments: DataFrame, columns: list[str]) -> DataFrame:
    return segments.select(*(c for c in segments.columns if c not in columns), *(((F.col(c) - F.avg(c).over(_trip())) / F.nullif(F.stddev_samp(c).over(_trip()), F.lit(0.0))).alias(c) for c in columns))


def complete_linkage_two(points: np.ndarray) -> np.ndarray:
    """Labels 1 and 2 of agglomerative clustering with complete linkage, cut at two; the first row is in cluster 1."""
    groups = [[i] for i in range(len(points))]
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    far[np.tril_indices(len(far))] = np.inf  # pairs i < j; ties go to the first
    while len(groups) > 2:
        i, j = divmod(int(far.argmin()), len(far))
        both = np.minimum(far, far.T)
        farther = np.maximum(both[i], both[j])
        far[i, i + 1 :], far[:i, i] = farther[i + 1 :], farther[:i]
        far = np.delete(np.delete(far, j, axis=0), j, axis=1)
        groups[i] += groups.pop(j)
    out = np.ones(len(points), np.int64)
    if len(groups) == 2:
        out[[g for g in groups if 0 not in g][0]] = 2
    return out


#: Distances of combinations that are linked at once.
LINKED_CELLS = 1 << 22


def linkage_of_combinations(points: np.ndarray, used: list[list[int]]) -> np.ndarray:
    """complete_linkage_two() for many choices of columns at once (choices x rows). Squared differences are made once a column and
    added up for each choice; each merge is then a step over all choices."""
    n, cells = len(points), len(points) ** 2
    apart = (points.T[:, :, None] - points.T[:, None, :]) ** 2
    out = np.ones((len(used), n), np.int64)
    for lo in range(0, len(used), block := max(1, LINKED_CELLS // max(cells, 1))):
        some = used[lo : lo + block]
        far = np.sqrt(np.array([apart[c].sum(axis=0) for c in some]))
        far[:, np.tri(n, dtype=bool)] = np.inf  # pairs i < j; ties go to the first
        group, rows, all_rows = np.tile(np.arange(n), (len(some), 1)), np.arange(len(some)), np.arange(n)
        for _ in range(n - 2):
            i, j = np.divmod(far.reshape(len(some), -1).argmin(axis=1), n)
            both = [np.minimum(far[rows, k], far[rows, :, k]) for k in (i, j)]
            farther = np.maximum(*both)
            later = all_rows[None] > i[:, None]
            far[rows, i] = np.where(later, farther, np.inf)
            far[rows, :, i] = np.where(~later & (all_rows[None] != i[:, None]), farther, np.inf)
            far[rows, j], far[rows, :, j] = np.inf, np.inf
            group = np.where(group == j[:, None], i[:, None], group)
        out[lo : lo + block] = np.where(group == group[:, :1], 1, 2)
    return out


def two_cluster(segments: DataFrame, combos: DataFrame, columns: list[str]) -> DataFrame:
    """(trip_id, combo, seg, cluster): each trip's segments in two clusters for each combination of metrics. A group has a trip's
    few segments and takes all combinations of the list, which has a fixed size, at once."""
    listed = [(r.combo, [columns.index(m) for m in r.metrics if m in columns]) for r in combos.collect()]
    numbers, used = np.array([c for c, _ in listed]), [u for _, u in listed]

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seg")
        points = np.column_stack([np.nan_to_num(rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)) for c in columns])
        clusters, seg = linkage_of_combinations(points, used), rows.column("seg").to_numpy()
        return pa.table({"trip_id": pa.repeat(rows.column("trip_id")[0], clusters.size), "combo": np.repeat(numbers, len(seg)).astype(np.int32), "seg": np.tile(seg, len(used)).astype(np.int32), "cluster": clusters.ravel()})

    return one_trip_a_partition(segments.select("trip_id", "seg", *columns)).groupBy("trip_id").applyInArrow(one, "trip_id long, combo int, seg int, cluster long")


def classify_segment(segments: DataFrame, short: int = 5) -> DataFrame:
    """s_m, b_nb and breed (B, W, mig) from two clusterings: the cluster of the least ang_vector is stationary, that of the least
    r2n_mean is breeding. Stationary segments are B or W, but a short straight one away from breeding is migration. Moving
    segments are migration, unless they are near breeding and short, first, or within the trip's r2n_limit."""
    still = F.min_by("clust_sm", "ang_vector").over(_trip()) == F.col("clust_sm")
    home = F.min_by("clust_bnb", "r2n_mean").over(_trip()) == F.col("clust_bnb")
    i, n = F.row_number().over(_segs()), F.count("*").over(_trip())
    s = segments.withColumn("_still", still).withColumn("_home", home).withColumn("_first", i == 1).withColumn("_last", i == n)
    brief, inside = F.col("last_ord") - F.col("first_ord") <= short, F.col("r2n_mean") <= F.col("r2n_limit")
    settled = F.when(F.col("_home"), "B").when(brief & (F.col("straightness") > 0.5), "mig").otherwise("W")
    near_home = brief | F.col("_first") | (inside & (F.col("_last") | (F.col("ang_vector") < 0.75)))
    moving = F.when(F.col("_home") & F.coalesce(near_home, F.lit(False)), "B").otherwise("mig")
    out = s.withColumn("breed", F.when(F.col("_still"), settled).otherwise(moving))
    return out.withColumn("s_m", F.when(F.col("_still"), "Stationary").otherwise("Mig")).withColumn("b_nb", F.when(F.col("_home"), "B").otherwise("Non-B")).drop("_still", "_home", "_first", "_last")


def confidence_score(segments: DataFrame) -> DataFrame:
    """How many of three shape tests speak for the label: crooked, turning and winding for B and W, the opposite for migration. The
    first and last row have 3; labels that contradict the trip's r2n_limit, or straight-line migration that turns, have 0."""
    mig, b = F.col("breed") == "mig", F.col("breed")
    settled = [F.col("straightness") < 0.5, F.col("ang_vector") < 0.5, F.col("sinuosity") > 1]
    moving = [F.col("straightness") > 0.5, F.col("ang_vector") > 0.5, F.col("sinuosity") < 1]
    votes = F.when(mig, sum((t.cast("int") for t in moving), F.lit(0))).otherwise(sum((t.cast("int") for t in settled), F.lit(0)))
    i, n = F.row_number().over(_segs()), F.count("*").over(_trip())
    far, near = F.col("r2n_mean") > F.col("r2n_limit"), F.col("r2n_mean") < F.col("r2n_limit")
    impossible = ((b == "B") & far) | ((b == "W") & near) | (mig & (F.col("straightness") < 0.2) & (F.col("ang_vector") < 0.9))
    score = F.when((i == 1) | (i == n), 3).when(F.coalesce(impossible, F.lit(False)), 0).otherwise(F.coalesce(votes, F.lit(0)))
    return segments.withColumn("confidence", score.cast("double"))


def best_combination(scored: DataFrame) -> DataFrame:
    """Per trip the combination with the largest mean confidence; ties go to fewer metrics, then to the earlier one."""
    means = scored.groupBy("trip_id", "combo").agg((F.avg("confidence") / 3).alias("score"), F.max("n_metrics").alias("n_metrics"))
    w = Window.partitionBy("trip_id").orderBy(F.desc(F.round("score", 9)), "n_metrics", "combo")
    return means.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def equinox_interference(segments: DataFrame, d: int = 20, sep: int = 23, mar: int = 21) -> DataFrame:
    """eq: the segment's days overlap an equinox window; unsure migration there counts half."""

    def overlaps(month: int, dom: int) -> Column:
        hit = F.lit(False)
        for year in (F.year("f_day"), F.year("l_day")):
            day = F.make_date(year, F.lit(month), F.lit(dom))
            hit = hit | ((F.col("l_day") >= F.date_sub(day, d)) & (F.col("f_day") <= F.date_add(day, d)))
        return hit

    eq = segments.withColumn("eq", overlaps(9, sep) | overlaps(3, mar))
    half = (F.col("breed") == "mig") & F.col("eq") & (F.col("confidence") < 3)
    return eq.withColumn("confidence", F.when(half, F.col("confidence") / 2).otherwise(F.col("confidence")))


def correct_segments(segments: DataFrame) -> DataFrame:
    """The equinox rule, then seven rules in order, each on the labels that the rule before left. Segments that those seven change
    get confidence 3. sq_disp is held against its trip's median, r2n_mean against its trip's mean."""
    b, lead, lag = F.col("breed"), F.lead("breed").over(_segs()), F.lag("breed").over(_segs())
    far, near = F.col("r2n_mean") > F.col("_mean"), F.col("r2n_mean") < F.col("_mean")
    spread, tight = F.col("sq_disp") > F.col("_median"), F.col("sq_disp") < F.col("_median")
    stats = segments.groupBy("trip_id").agg(F.median("sq_disp").alias("_median"), F.avg("r2n_mean").alias("_mean"))
    s = segments.join(stats, "trip_id")

    def label(df: DataFrame, *rules: tuple[Column, Column | str]) -> DataFrame:
        out = F.col("breed")
        for when, to in rules[::-1]:
            out = F.when(F.coalesce(when, F.lit(False)), F.lit(to) if isinstance(to, str) else to).otherwise(out)
        return df.withColumn("breed", out)

    north_south = 2 * F.col("sd_x") < F.col("sd_y")
    blurred = (b == "B") & F.col("eq") & ((F.col("sd_x") > 1) | (F.col("sd_y") > 1)) & (F.col("sd_x") > 4 * F.col("sd_y"))
    s = label(s, ((b == "mig") & F.col("eq") & tight & north_south, F.when(near, "B").otherwise("W")), (blurred, "mig"))
    s = s.withColumn("breed_0", b)
    s = label(s, ((b == "B") & far & (F.col("straightness") < 0.2), "W"))
    beside = F.coalesce(lead == "mig", F.lit(False)) | F.coalesce(lag == "mig", F.lit(False))
    s = label(s, ((b == "B") & (F.col("confidence") < 1.5) & beside & (F.col("straightness") > 0.2) & spread, "mig"))
    s = label(s, ((b == "W") & near, "B"))
    s = label(s, ((b == "W") & spread & (F.col("sinuosity") < 1) & (F.col("straightness") > 0.2), "mig"))
    s = label(s, ((b != "B") & (lead == "B") & (lag == "B"), "B"), ((b == "B") & (lead == "W") & (lag == "W"), "W"))
    s = label(s, ((b == "B") & (lead == "mig") & (lag == "mig"), "W"))
    return s.withColumn("confidence", F.when(b != F.col("breed_0"), 3.0).otherwise(F.col("confidence"))).drop("_median", "_mean")


def review_flag(segments: DataFrame) -> DataFrame:
    i, n = F.row_number().over(_segs()), F.count("*").over(_trip())
    differs = (F.lag("breed").over(_segs()) != F.col("breed")) | (F.lead("breed").over(_segs()) != F.col("breed"))
    check = (F.col("confidence") < 2) | (F.col("eq") & (i > 1) & (i < n) & F.coalesce(differs, F.lit(False)))
    return segments.withColumn("check", F.when(check, "Check").otherwise("OK"))


def trip_summary(segments: DataFrame) -> DataFrame:
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "breed"))), lambda s: s["breed"]), "-")
    return segments.groupBy("trip_id").agg(F.count("*").alias("n_seg"), labels.alias("breed_class"), *(F.count_if(F.col("breed") == b).alias(f"n_seg_{b}") for b in ("B", "mig", "W")), (F.avg("confidence") / 3).alias("confidence"))


def label_positions(track: DataFrame, segments: DataFrame) -> DataFrame:
    """Each position takes the first segment whose days hold its date. Segments are spread over their days, of which the first segment
    stays, and joined by trip and day, so rows grow with days and positions, not with their product."""
    s = segments.select("trip_id", "seg", "f_day", "l_day", *(c for c in segments.columns if c not in ("trip_id", "seg", "f_day", "l_day", "first_ord", "last_ord")))
    days = s.where("f_day <= l_day").select("trip_id", "seg", F.explode(F.sequence("f_day", "l_day")).alias("_day")).groupBy("trip_id", "_day").agg(F.min("seg").alias("seg"))
    hit = track.withColumn("_day", F.to_date("ts")).join(days, ["trip_id", "_day"]).drop("_day")
    return hit.join(s.drop("f_day", "l_day"), ["trip_id", "seg"]) if len(s.columns) > 4 else hit


def split_migration(rows: DataFrame, label: str = "label") -> DataFrame:
    """label2: migration with a wintering to come is mig1, one with only a past wintering mig2, one without any stays mig."""
    w = in_order() if "ts" in rows.columns else _segs()
    is_w = (F.col(label) == "W").cast("int")
    later = F.sum(is_w).over(w.rowsBetween(1, Window.unboundedFollowing)) > 0
    earlier = F.sum(is_w).over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0
    split = F.when(F.coalesce(later, F.lit(False)), "mig1").when(F.coalesce(earlier, F.lit(False)), "mig2").otherwise("mig")
    return rows.withColumn("label2", F.when(F.col(label) == "mig", split).otherwise(F.col(label)))
