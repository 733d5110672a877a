"""Readers and writers of the file formats: light files, tables with NA, twilight files, results, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Timestamp patterns of logger files, tried in this order.
PATTERNS = ("dd/MM/yy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")

TRIPS = T.StructType([T.StructField(n, t) for n, t in (
    ("Ring", T.LongType()), ("Colony", T.StringType()), ("Colony.lat", T.DoubleType()), ("Colony.lon", T.DoubleType()), ("Sp", T.StringType()), ("geo_alfanum", T.StringType()), ("Producer", T.StringType()), ("Modelo", T.StringType()),
    ("Year_dep", T.IntegerType()), ("Year_rec", T.IntegerType()), ("N_trips", T.IntegerType()), ("start_date", T.TimestampType()), ("end_date", T.TimestampType()), ("geo_trip", T.StringType()),
)])
COLONY_DAYS = T.StructType([T.StructField(n, t) for n, t in (("geoID", T.StringType()), ("geo_trip", T.StringType()), ("date", T.DateType()), ("sum.Light", T.IntegerType()), ("percent", T.DoubleType()), ("light", T.BooleanType()), ("percentage_night", T.DoubleType()), ("dur_hours", T.DoubleType()), ("wetdry", T.BooleanType()))])


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parse_time(text: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """The first pattern that fits; two-digit years are only tried on two-digit years."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in patterns))


def _light(spark: SparkSession, path: str, separator: str, time_field: int, light_field: int, patterns: tuple[str, ...], folder: str | None, trip_field: int | None) -> DataFrame:
    name, fields = F.col("_metadata.file_path"), F.split("value", separator)
    trip = F.trim(F.get(fields, F.lit(trip_field))) if trip_field is not None else file_stem(name) if folder is None else F.regexp_extract(name, f"/{folder}=([^/]+)/", 1)
    lines = spark.read.text(path).select(trip.alias("trip_id"), fields.alias("f"))
    time = F.trim(F.get("f", F.lit(time_field)))
    return lines.select("trip_id", parse_time(time, patterns).alias("ts"), F.trim(F.get("f", F.lit(light_field))).alias("light")).where("ts IS NOT NULL")


def read_light_delimited(spark: SparkSession, path: str, folder: str | None = None, trip_field: int | None = None) -> DataFrame:
    """Comma-separated light files: time in the second field, light in the fourth; lines without a time are headers. The trip is
    the file's name, or the value in the name of its folder, or a field of each line, for archives of very many trips in few files."""
    return _light(spark, path, ",", 1, 3, PATTERNS, folder, trip_field)


def read_light_tabbed(spark: SparkSession, path: str, folder: str | None = None, trip_field: int | None = None) -> DataFrame:
    """Tab-separated light files with a header: time, light. The trip as in read_light_delimited."""
    return _light(spark, path, "\t", 0, 1, ("dd/MM/yyyy HH:mm:ss",), folder, trip_field)


def normalise_light(raw: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """lux from text with a decimal comma or point, with its day and time; within the trips' whole days if given."""
    df = raw.withColumn("lux", F.expr("try_cast(replace(light, ',', '.') AS DOUBLE)")).withColumn("day", F.to_date("ts")).withColumn("time", F.date_format("ts", "HH:mm:ss")).drop("light")
    if trips is None:
        return df
    return df.join(trips.select("trip_id", "start_date", "end_date"), "trip_id").where(F.col("day").between(F.to_date("start_date"), F.to_date("end_date"))).drop("start_date", "end_date")


def _write_lines(rows: DataFrame, name: Column, columns: list[str], path: str, order: list[str]) -> None:
    """Headerless lines, in a folder for each file name; within a folder the part files are in order, one after the other."""
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns))
    named = rows.withColumn("file", name).repartitionByRange("file", *order).sortWithinPartitions("file", *order)
    named.select("file", line.alias("value")).write.partitionBy("file").text(path)


def write_locator_backup(backup: DataFrame, trips: DataFrame, path: str) -> None:
    """`dd/mm/yy HH:MM:SS,Sunrise|Sunset,confidence`, sorted by the formatted text; (trip_id, file) names the files."""
    _write_lines(backup.join(trips.select("trip_id", F.col("file").alias("_file")), "trip_id"), F.col("_file"), ["date_time", "type", "confidence"], path, ["date_time"])


def write_calibration_twilights(events: DataFrame, loggers: DataFrame, path: str) -> None:
    """`date_time,type,confidence`; files are named by the logger's (trip_id, file) and the period before or after deployment."""
    j = events.join(loggers.select("trip_id", F.col("file").alias("_file")), "trip_id")
    _write_lines(j, F.concat_ws("_", "_file", "place", F.lit(".trn")), ["date_time", "type", "confidence"], path, ["date_time"])


def read_table_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA")


def write_twilights(events: DataFrame, path: str, folders: int | None = None) -> None:
    """One folder a trip, with the trip as a column; csv with a header and without quotes. `folders` sets how many folders all trips
    share instead, for archives of very many trips: there a trip's rows lie together in one of them."""
    if folders:
        shared = events.withColumn("folder", F.pmod(F.xxhash64("trip_id"), F.lit(folders)))
        shared.repartition("folder").sortWithinPartitions("folder", "trip_id").write.partitionBy("folder").option("header", True).option("nullValue", "NA").csv(path)
        return
    events.write.partitionBy("trip_id").option("header", True).option("nullValue", "NA").csv(path)


def read_twilights(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, nullValue="NA")


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result table; csv keeps nulls as NA."""
    if kind == "csv":
        df.write.option("header", True).option("nullValue", "NA").csv(path)
    else:
        df.write.format(kind).save(path)


def twilight_file_name(trips: DataFrame) -> DataFrame:
    return trips.withColumn("file_name", F.concat_ws("_", F.col("trip_id").cast("string"), "species", F.col("year").cast("string"), "colony", F.lit("automated.trn")))


def polygons(vertices: DataFrame) -> DataFrame:
    """Regions as vertex rows (region, ring, idx, lon, lat), reduced to the region's name; all rings stay: parts and holes."""
    return vertices.select("region", "ring", "idx", F.col("lon").alias("x"), F.col("lat").alias("y"))
