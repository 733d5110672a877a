"""Predicates, dedupe, lookups, and reviewers' edits as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfowl.functions.tracks import in_order, last_known, us


def recording_interval(light: DataFrame) -> DataFrame:
    """Median minutes between readings, per trip."""
    gap = (us("ts") - us(F.lag("ts").over(in_order()))) / 60e6
    return light.withColumn("gap", gap).groupBy("trip_id").agg(F.percentile("gap", F.lit(0.5)).alias("minutes"))


def enough_data(light: DataFrame, unit: str = "year") -> DataFrame:
    """Readings of trips whose first and last record fall in different years (or months)."""
    part = F.date_trunc(unit, F.col("ts"))
    ok = light.groupBy("trip_id").agg(F.min(part).alias("a"), F.max(part).alias("b")).where("a <> b").select("trip_id")
    return light.join(ok, "trip_id", "left_semi")


def trip_range(events: DataFrame, trips: DataFrame) -> DataFrame:
    """Events from start_date to end_date, both whole days; of equal times the first stays."""
    j = events.join(trips.select("trip_id", "start_date", "end_date"), "trip_id").where(F.to_date("ts").between(F.col("start_date"), F.col("end_date")))
    return j.withColumn("_k", F.row_number().over(Window.partitionBy("trip_id", "ts").orderBy("ord"))).where("_k = 1").drop("_k", "start_date", "end_date")


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def drop_null_coords_round(track: DataFrame, colours: dict[str, str]) -> DataFrame:
    """Positions with both coordinates, rounded to 2 places, by date, with the colour of their label."""
    colour: Column = F.lit("grey")
    for label, c in colours.items():
        colour = F.when(F.col("label") == label, c).otherwise(colour)
    return track.where("x IS NOT NULL AND y IS NOT NULL").withColumn("x", F.round("x", 2)).withColumn("y", F.round("y", 2)).withColumn("day", F.to_date("ts")).withColumn("colour", colour)


def fill_down(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, last_known(column, in_order()))


def stage_match(df: DataFrame, stage: str = "stage") -> DataFrame:
    """is_stay, is_numbered_w, is_w of a stage name."""
    s = F.col(stage)
    return df.withColumn("is_stay", s.rlike("^B|^W")).withColumn("is_numbered_w", s.rlike("^W\\d+$")).withColumn("is_w", s.startswith("W"))


def normalise_colony(df: DataFrame, aliases: dict[str, str], colonies: DataFrame) -> DataFrame:
    """Recoded colony names with their coordinates."""
    name: Column = F.col("colony")
    for old, new in aliases.items():
        name = F.when(F.col("colony") == old, new).otherwise(name)
    return df.withColumn("colony", name).join(colonies.select("colony", "lon", "lat"), "colony", "left")


def tag_trip_constants(rows: DataFrame, trips: DataFrame) -> DataFrame:
    """Each row with its trip's constants."""
    return rows.join(trips, "trip_id", "left")


def choose_file(trips: DataFrame, found: DataFrame) -> DataFrame:
    """The adjusted file of a trip if named, else the raw one; trips whose file was not found are left out."""
    return trips.withColumn("file", F.coalesce("file_adjlux", "file_lux")).where("file IS NOT NULL").join(found.select("file"), "file", "left_semi")


def update_status(trips: DataFrame, status: DataFrame, columns: list[str]) -> DataFrame:
    """Flags of a stage written over the trips', by name; trips without a new flag keep theirs."""
    new = status.select("trip_id", *(F.col(c).alias(f"_{c}") for c in columns))
    j = trips.join(new, "trip_id", "left")
    return j.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in trips.columns))


def locator_backup(events: DataFrame) -> DataFrame:
    """(trip_id, date_time, type, confidence) as text for the backup format, to be sorted by the formatted text."""
    return events.select("trip_id", F.date_format("ts", "dd/MM/yy HH:mm:ss").alias("date_time"), F.when(F.col("type") == 1, "Sunrise").otherwise("Sunset").alias("type"), "confidence")


def calibration_events(events: DataFrame) -> DataFrame:
    """(trip_id, place, date_time, type, confidence) of calibration twilights; the marker is the confidence."""
    return events.select("trip_id", "place", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_time"), F.when(F.col("type") == 1, "Sunrise").otherwise("Sunset").alias("type"), F.col("marker").alias("confidence"))


# --- edits -------------------------------------------------------------------------------------------------------------


def prepare_segments(segments: DataFrame) -> DataFrame:
    """Segments with their running number and breed2, in which migration is split around wintering."""
    from wayfowl.operators.behaviour import split_migration

    n = F.row_number().over(Window.partitionBy("trip_id").orderBy("seg"))
    return split_migration(segments.withColumn("number", n), "breed").withColumnRenamed("label2", "breed2")


def join_track_segments(track: DataFrame, segments: DataFrame) -> DataFrame:
    """Positions with the segment of their date, and its attributes where its breed2 is also the position's; else nulls."""
    from wayfowl.operators.behaviour import label_positions

    hit = label_positions(track, segments.select("trip_id", "seg", "f_day", "l_day"))
    attributes = segments.drop("f_day", "l_day", "first_ord", "last_ord")
    return hit.join(attributes, ["trip_id", "seg", "breed2"], "left")


def apply_segment_edits(track: DataFrame, edits: DataFrame) -> DataFrame:
    """Whole segments relabelled by (trip_id, seg, label)."""
    e = edits.groupBy("trip_id", "seg").agg(F.max("label").alias("_new"))
    return track.join(e, ["trip_id", "seg"], "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def apply_point_edits(track: DataFrame, edits: DataFrame) -> DataFrame:
    """Points relabelled by (trip_id, ord, label, edit_ts); the latest edit of a point counts."""
    e = edits.groupBy("trip_id", "ord").agg(F.max_by("label", F.struct("edit_ts", "label")).alias("_new"))
    return track.join(e, ["trip_id", "ord"], "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def corrected_segments(track: DataFrame) -> DataFrame:
    return track.select("trip_id", "seg", "label").distinct().na.drop()


def review_progress(track: DataFrame) -> DataFrame:
    return track.groupBy("trip_id").agg(F.count("*").alias("positions"), F.count("label").alias("labelled"))


def review_preview(track: DataFrame, rows: int = 200) -> DataFrame:
    return track.orderBy("trip_id", "ts", "ord").limit(rows)
