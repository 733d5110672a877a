"""Stages, their utilisation distributions and regions, and arrival and departure dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wayfowl.functions.tracks import checkpoint_folder, in_order, run_number


def _trip() -> WindowSpec:
    return Window.partitionBy("trip_id")


def _with_runs(rows: DataFrame, label: str = "label", name: str = "run") -> DataFrame:
    w = in_order()
    return rows.withColumn(name, run_number(F.coalesce(F.col(label) != F.lag(label).over(w), F.lit(True)), w))


def _run_table(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy("trip_id", "run").agg(F.min("ord").alias("start_ord"), F.max("ord").alias("end_ord"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"), F.first(label).alias("label"))


def smooth_short_runs(rows: DataFrame, least: int = 5) -> DataFrame:
    """A run shorter than `least` between two runs of one label takes that label; runs are those of the given labels."""
    r = _with_runs(rows)
    runs = r.groupBy("trip_id", "run").agg(F.count("*").alias("n"), F.first("label").alias("own"))
    w = Window.partitionBy("trip_id").orderBy("run")
    before, after = F.lag("own").over(w), F.lead("own").over(w)
    new = F.when((F.col("n") < least) & (before == after), before)
    return r.join(runs.select("trip_id", "run", new.alias("_new")), ["trip_id", "run"]).withColumn("label", F.coalesce("_new", "label")).drop("_new", "run")


def number_stages(rows: DataFrame) -> DataFrame:
    """stage: runs of B and W numbered in their order (B1, W1, ...); other labels stay. If a trip does not begin with B, its B1 is
    named B2."""
    w = in_order()
    start = F.coalesce(F.col("label") != F.lag("label").over(w), F.lit(True))
    s = rows.withColumn("_s", start).withColumn("_first", F.first("label").over(w))
    number = F.sum(F.when(F.col("_s"), 1).otherwise(0)).over(Window.partitionBy("trip_id", "label").orderBy("ts", "ord"))
    stage = F.when(F.col("label").isin("B", "W"), F.concat("label", number.cast("string"))).otherwise(F.col("label"))
    s = s.withColumn("stage", stage)
    return s.withColumn("stage", F.when((F.col("stage") == "B1") & (F.col("_first") != "B"), "B2").otherwise(F.col("stage"))).drop("_s", "_first")


def stage_runs(rows: DataFrame, label: str = "stage") -> DataFrame:
    return _run_table(_with_runs(rows, label), label)


def stage_context(rows: DataFrame, label: str = "stage") -> DataFrame:
    """Each B and W run with all rows of the run before and after: (trip_id, context_run, context, rows' columns)."""
    r = _with_runs(rows, label)
    around = r.select("*", F.explode(F.array(F.col("run") - 1, F.col("run"), F.col("run") + 1)).alias("context_run"))
    names = r.groupBy("trip_id", "run").agg(F.first(label).alias("context")).where(F.col("context").rlike("^B|^W")).withColumnRenamed("run", "context_run")
    return around.join(names, ["trip_id", "context_run"])


def project_laea(rows: DataFrame, keys: list[str], radius_km: float = 6371.0, of: Column | None = None) -> DataFrame:
    """px, py in km: Lambert azimuthal equal-area about the mean position of the group, or of those of its rows that `of` holds for."""
    w = Window.partitionBy(*keys)
    lon, lat = (F.col(c) if of is None else F.when(of, F.col(c)) for c in ("lon", "lat"))
    lon0, lat0 = F.radians(F.avg(lon).over(w)), F.radians(F.avg(lat).over(w))
    d = rows.withColumn("_l0", lon0).withColumn("_p0", lat0)
    l, p = F.radians("lon") - F.col("_l0"), F.radians("lat")
    k = F.sqrt(2 / (1 + F.sin("_p0") * F.sin(p) + F.cos("_p0") * F.cos(p) * F.cos(l)))
    return d.withColumn("px", radius_km * k * F.cos(p) * F.sin(l)).withColumn("py", radius_km * k * (F.cos("_p0") * F.sin(p) - F.sin("_p0") * F.cos(p) * F.cos(l))).drop("_l0", "_p0")


def href(points: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """(keys, n, h): the reference bandwidth; groups of fewer than `least` points have none."""
    s = points.groupBy(*keys).agg(F.count("*").alias("n"), F.var_samp("px").alias("vx"), F.var_samp("py").alias("vy"))
    h = F.sqrt((F.col("vx") + F.col("vy")) / 2) * F.pow(F.col("n").cast("double"), F.lit(-1 / 6))
    return s.where(F.col("n") >= least).select(*keys, "n", h.alias("h"))


#: Powers of a point's place in its cell that are kept; the series' error is below 1e-11 of a kernel's value.
MOMENTS = 13


def utilisation_distribution(points: DataFrame, keys: list[str], level: float = 0.9, reach: float = 3.0) -> DataFrame:
    """(keys, gx, gy, density): the smallest set of grid cells that holds `level` of a Gaussian kernel density. Cells have the size
    of h / 2; a point only reaches cells within `reach` times h in either direction. The kernel is a product of one along x and one
    along y: points are spread along x and summed up by cells, with moments of their places within the cell along y, and these
    sums are spread along y, where the moments give what each point would have. So rows grow with points times 13, then with
    cells times 13, not with points times 169. The grid has no outer edge, so no density falls off it and no other grid is needed
    where one would not close. Cells of equal density are taken in the order of gx and gy."""
    near = math.ceil(2 * reach)
    steps = F.sequence(F.lit(-near), F.lit(near))
    p = points.join(href(points, keys), keys).where("h > 0").withColumn("cell", F.col("h") / 2)
    p = p.select(*keys, "cell", *(F.floor(F.col(f"p{c}") / F.col("cell")).alias(f"g{c}") for c in "xy"), *((F.col(f"p{c}") / F.col("cell") - F.floor(F.col(f"p{c}") / F.col("cell")) - 0.5).alias(f"u{c}") for c in "xy"))
    across = p.withColumn("i", F.explode(steps)).withColumn("gx", F.col("gx") + F.col("i")).withColumn("w", F.exp(-(F.pow(F.col("i") - F.col("ux"), F.lit(2.0)) + F.col("uy") * F.col("uy")) / 8))
    sums = across.groupBy(*keys, "gx", "gy").agg(F.first("cell").alias("cell"), *(F.sum(F.col("w") * F.pow("uy", F.lit(float(k)))).alias(f"m{k}") for k in range(MOMENTS)))
    series = F.col(f"m{MOMENTS - 1}")
    for k in range(MOMENTS - 2, -1, -1):
        series = F.col(f"m{k}") + series * F.col("j") / F.lit(4.0 * (k + 1))
    up = sums.withColumn("j", F.explode(steps)).select(*keys, "cell", "gx", (F.col("gy") + F.col("j")).alias("gy"), (F.exp(-F.col("j") * F.col("j") / 8.0) * series).alias("part"))
    density = up.groupBy(*keys, "gx", "gy").agg(F.sum("part").alias("density"), F.first("cell").alias("cell"))
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(F.desc(F.round("density", 6)), "gx", "gy").rowsBetween(Window.unboundedPreceding, -1)
    held = density.withColumn("before", F.coalesce(F.sum("density").over(order), F.lit(0.0))).withColumn("total", F.sum("density").over(whole))
    return held.where(F.col("before") < level * F.col("total")).drop("before", "total")


def points_in_ud(points: DataFrame, ud: DataFrame, keys: list[str]) -> DataFrame:
    """inside: whether a point's cell is one of its group's cells."""
    size = ud.groupBy(*keys).agg(F.first("cell").alias("_cell"))
    p = points.join(size, keys, "left").withColumn("gx", F.floor(F.col("px") / F.col("_cell"))).withColumn("gy", F.floor(F.col("py") / F.col("_cell")))
    return p.join(ud.select(*keys, "gx", "gy", F.lit(True).alias("_in")), [*keys, "gx", "gy"], "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in", "_cell", "gx", "gy")


def arrival_departure(points: DataFrame, context: str = "context") -> DataFrame:
    """(trip_id, stage, arr, dep) of contexts with `inside`: the first time inside, and the time of the row after the last inside.
    B1 has no arrival, B2 no departure; only B1, B2 and W stages are reported."""
    keys = ["trip_id", "context_run", context]
    nxt = F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts", "ord"))
    p = points.withColumn("_n", nxt)
    t = F.when(F.col("inside"), F.col("ts"))
    g = p.groupBy(*keys).agg(F.min(t).alias("arr"), F.max_by("_n", F.when(F.col("inside"), F.struct("ts", "ord"))).alias("dep"))
    c = F.col(context)
    g = g.where(c.isin("B1", "B2") | c.startswith("W"))
    return g.select("trip_id", c.alias("stage"), F.when(c != "B1", F.col("arr")).alias("arr"), F.when(c != "B2", F.col("dep")).alias("dep"))


#: Edges of a strip, and halvings of a strip's height at most.
STRIP_EDGES = 64
STRIP_HALVINGS = 24


def _edges(vertices: DataFrame) -> DataFrame:
    rings = vertices if "ring" in vertices.columns else vertices.withColumn("ring", F.lit(1))
    w = Window.partitionBy("region", "ring").orderBy("idx")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return rings.select("region", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2")).where("y1 != y2")


def edge_strips(vertices: DataFrame, band: float = 1.0, most: int = STRIP_EDGES, halvings: int = STRIP_HALVINGS) -> DataFrame:
    """(region, level, cell, edges, right): a cover of each region's edges by strips of y. A strip of level k has the height band /
    2**k and the number floor(y / height); one with more than `most` edges is halved, level by level, as long as most of them end in
    it, so that strips are short where a coast has many vertices. What is left are edges that a horizontal line really crosses. No
    point of a region is in two of its strips. An edge is in each strip that it touches."""
    checkpoint_folder(vertices.sparkSession)
    number = lambda c, k: F.floor(c / F.lit(band / 2**k))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    todo, done = _edges(vertices).withColumn("cell", F.explode(F.sequence(number(low, 0), number(high, 0)))), None
    for k in range(halvings + 1):
        w = Window.partitionBy("region", "cell")
        through = (number(low, k) < F.col("cell")) & (number(high, k) > F.col("cell"))
        todo = todo.withColumn("_n", F.count("*").over(w)).withColumn("_through", F.count_if(through).over(w)).checkpoint()
        full = F.lit(k < halvings) & (F.col("_n") > most) & (F.col("_through") * 2 < F.col("_n"))
        own = todo.where(~full).withColumn("level", F.lit(k))
        done = own if done is None else done.unionByName(own)
        todo = todo.where(full).drop("_n", "_through")
        if todo.isEmpty():
            break
        # Either half that the edge reaches.
        halves = F.sequence(F.greatest(number(low, k + 1), F.col("cell") * 2), F.least(number(high, k + 1), F.col("cell") * 2 + 1))
        todo = todo.withColumn("cell", F.explode(halves))
    return done.groupBy("region", "level", "cell").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), F.max(F.greatest("x1", "x2")).alias("right"))


def point_in_polygon_join(points: DataFrame, vertices: DataFrame, band: float = 1.0) -> DataFrame:
    """(points' columns, region): planar, by the parity of crossings of a ray over all rings, so that holes and several parts count.
    Regions come as vertex rows (region, idx, x, y), with `ring` where they have several. Points and strips of edges are joined on
    the strip's number at each level that there is; a ray meets the few edges of its strip only."""
    strips = edge_strips(vertices, band)
    levels = sorted(r.level for r in strips.select("level").distinct().collect())  # as many as halvings, at most
    if not levels:
        return points.crossJoin(vertices.select("region").limit(0))
    at = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("y") / F.lit(band / 2**k)).alias("cell")) for k in levels))
    hit = points.withColumn("_at", F.explode(at)).join(strips.select("region", "edges", "right", F.struct("level", "cell").alias("_at")), "_at").where(F.col("x") <= F.col("right"))
    crosses = F.filter("edges", lambda e: ((e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))) & (F.col("x") < (e["x2"] - e["x1"]) * (F.col("y") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return hit.where(F.size(crosses) % 2 == 1).select(*points.columns, "region")


def modal_region(located: DataFrame, stages: DataFrame, default: str = "Saharan_Upwelling") -> DataFrame:
    """(trip_id, stage, region) of W stages: the commonest region, ties by name; a trip without any match has `default` for W1."""
    n = located.where(F.col("stage").startswith("W")).groupBy("trip_id", "stage", "region").count()
    best = n.withColumn("_k", F.row_number().over(Window.partitionBy("trip_id", "stage").orderBy(F.desc("count"), "region"))).where("_k = 1").select("trip_id", "stage", "region")
    w = stages.where(F.col("stage").startswith("W")).select("trip_id", "stage").distinct()
    j = w.join(best, ["trip_id", "stage"], "left")
    none = F.count("region").over(_trip()) == 0
    return j.withColumn("region", F.when(none & (F.col("stage") == "W1"), default).otherwise(F.col("region")))


def migrant_class(rows: DataFrame, five: bool = True) -> DataFrame:
    """(trip_id, migrant), tested in this order: only B1; no split migration; mig1 without wintering; no mig1; else Migrant."""
    s, m = F.col("stage"), F.col("label2")
    a = rows.groupBy("trip_id").agg(F.every(s == "B1").alias("b1"), F.bool_or(m == "mig1").alias("m1"), F.bool_or(m == "mig2").alias("m2"), F.bool_or(s.startswith("W")).alias("w"))
    if not five:
        return a.select("trip_id", F.when(F.col("b1"), "Resident").otherwise("Migrant").alias("migrant"))
    kind = F.when(F.col("b1"), "Resident").when(~F.col("m1") & ~F.col("m2"), "Resident2").when(F.col("m1") & ~F.col("w"), "Resident_mig").when(~F.col("m1"), "Resident2_mig").otherwise("Migrant")
    return a.select("trip_id", kind.alias("migrant"))


def stage_subset(context: DataFrame, migrants: DataFrame) -> DataFrame:
    """Rows of stage_context() as they enter a stage's distribution: a Resident2 trip's stages without the runs beside them."""
    j = context.join(migrants, "trip_id", "left")
    return j.where((F.coalesce("migrant", F.lit("")) != "Resident2") | (F.col("stage") == F.col("context"))).drop("migrant")


def resident_overrides(wide: DataFrame, suffix: str = "") -> DataFrame:
    """Residents have no departure from B1; Resident2 leaves B1 when it arrives in W1, and W1 when it arrives in B1."""
    r, r2 = F.col("migrant") == "Resident", F.col("migrant") == "Resident2"
    c = lambda name: F.col(name + suffix)
    b1 = F.when(r, F.lit(None)).when(r2, c("W1_arr")).otherwise(c("B1_dep"))
    return wide.withColumn("W1_dep" + suffix, F.when(r2, c("B1_arr")).otherwise(c("W1_dep"))).withColumn("B1_dep" + suffix, b1)


def resident_label_dates(wide: DataFrame) -> DataFrame:
    """By labels, Resident2 and Resident2_mig leave B1 when they arrive in W1."""
    return wide.withColumn("B1_dep", F.when(F.col("migrant").isin("Resident2", "Resident2_mig"), F.col("W1_arr")).otherwise(F.col("B1_dep")))


def pivot_regions(regions: DataFrame, most: int = 5) -> DataFrame:
    """(trip_id, WA1, WA2, ...): the region of each W stage."""
    wide = regions.groupBy("trip_id").pivot("stage", [f"W{i + 1}" for i in range(most)]).agg(F.first("region"))
    return wide.select("trip_id", *(F.col(f"W{i + 1}").alias(f"WA{i + 1}") for i in range(most)))


def stage_dates(rows: DataFrame) -> DataFrame:
    """(trip_id, stage, arr, dep) from labels alone: the first date of a stage, and the first date of the run after its last run."""
    runs = stage_runs(rows)
    nxt = runs.withColumn("next_ts", F.lead("start_ts").over(Window.partitionBy("trip_id").orderBy("run")))
    g = nxt.where(F.col("label").rlike("^B|^W")).groupBy("trip_id", F.col("label").alias("stage")).agg(F.to_date(F.min("start_ts")).alias("arr"), F.to_date(F.max_by("next_ts", "run")).alias("dep"))
    return g


def pivot_dates(dates: DataFrame, stages: tuple[str, ...] = ("B1", "W1", "W2", "W3", "W4", "W5", "B2"), suffix: str = "") -> DataFrame:
    """One row a trip: <stage>_arr and <stage>_dep with the suffix, for a fixed list of stages."""
    wide = dates.groupBy("trip_id").pivot("stage", list(stages)).agg(F.first("arr").alias("arr"), F.first("dep").alias("dep"))
    return wide.select("trip_id", *(F.col(f"{s}_{k}").alias(f"{s}_{k}{suffix}") for s in stages for k in ("arr", "dep")))


def fallback_dates(wide: DataFrame, suffix: str = "_KDE") -> DataFrame:
    """Dates of the distribution, or the label-based ones where they are missing."""
    return wide.select(*(F.coalesce(F.col(c), F.col(c.removesuffix(suffix))).alias(c) if c.endswith(suffix) else F.col(c) for c in wide.columns))


def final_layout(wide: DataFrame, columns: list[str], kind: str = "date") -> DataFrame:
    """A fixed order of columns; missing ones are null."""
    return wide.select("trip_id", *(F.col(c) if c in wide.columns else F.lit(None).cast(kind).alias(c) for c in columns))
