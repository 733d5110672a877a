"""A ledger of stages: which trips a stage has done, from which input, and with what result, so that only what is new or changed is
computed again, and a run that was cut off goes on where it stopped.

A stage has a folder with two tables, both in folders of runs that are written once: results (the job's rows) and state (trip_id,
fingerprint, version, status). A run first writes its results and then its state, which is what makes them count; results without
state are overwritten by the next run of that number. The last run that names a trip holds its result. Trips without any result
are in the state as well, with status no_data, so that they are not tried again.

Defined cases: a trip is done again if its rows, the version (of the stage's parameters) or a mark of the user's says so; the order
of rows does not matter, repeated rows and nulls do; trips that are no longer in the input keep their place in the ledger, but are not
returned; rows without a trip_id take no part; of two runs at the same time only one is allowed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfowl.functions.tracks import checkpoint_folder

_STATE = "trip_id long, fingerprint string, version string, status string, run long"


def fingerprints(rows: DataFrame) -> DataFrame:
    """(trip_id, fingerprint): number and sum of the hashes of a trip's rows."""
    columns = sorted(c for c in rows.columns if c != "trip_id")
    h = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns)) if columns else F.lit(0)
    text = F.concat_ws("-", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"))
    return rows.where("trip_id IS NOT NULL").groupBy(F.col("trip_id").cast("long").alias("trip_id")).agg(text.alias("fingerprint"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/run=*").withColumn("run", F.col("run").cast("long"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def stage_state(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """(trip_id, fingerprint, version, status, run) of each trip's last run."""
    every = _read(spark, f"{path}/{stage}/state")
    if every is None:
        return spark.createDataFrame([], _STATE)
    return every.groupBy("trip_id").agg(F.max_by(F.struct("fingerprint", "version", "status"), "run").alias("s"), F.max("run").alias("run")).select("trip_id", "s.*", "run")


def due_trips(spark: SparkSession, path: str, stage: str, prints: DataFrame, version: str = "", again: DataFrame | None = None) -> DataFrame:
    """(trip_id, fingerprint) of trips that are new, changed, of another version or marked to be done again."""
    known = stage_state(spark, path, stage).select("trip_id", F.col("fingerprint").alias("_f"), F.col("version").alias("_v"))
    marks = (again.select(F.col("trip_id").cast("long").alias("trip_id")).distinct() if again is not None else prints.select("trip_id").limit(0)).withColumn("_again", F.lit(True))
    joined = prints.join(known, "trip_id", "left").join(marks, "trip_id", "left")
    same = (F.col("fingerprint") == F.col("_f")) & (F.col("_v") == version) & F.col("_again").isNull()
    return joined.where(~F.coalesce(same, F.lit(False))).select("trip_id", "fingerprint")


def run_stage(inputs: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, stage: str, version: str = "", again: DataFrame | None = None, batches: int = 1) -> DataFrame:
    """job's results for all trips of inputs, with the run that they are from. job gets the rows of the trips that are due, in
    `batches` by a hash of their ids; each batch is a run, so a stage that breaks off has lost the last batch only."""
    spark = inputs.sparkSession
    checkpoint_folder(spark)
    prints = fingerprints(inputs).checkpoint()
    # What is due is settled before the first batch, else a mark would hold again in the next one.
    due = due_trips(spark, path, stage, prints, version, again).withColumn("batch", F.pmod(F.xxhash64("trip_id"), F.lit(batches))).checkpoint()
    last = stage_state(spark, path, stage).agg(F.max("run")).first()[0] or 0
    for batch in [r.batch for r in due.select("batch").distinct().orderBy("batch").collect()]:
        now, last = due.where(F.col("batch") == batch), last + 1
        folder = f"{path}/{stage}/results/run={last}"
        job(inputs.join(now.select("trip_id"), "trip_id", "left_semi")).write.mode("overwrite").parquet(folder)
        found = spark.read.parquet(folder).select(F.col("trip_id").cast("long").alias("trip_id")).distinct().withColumn("_found", F.lit(True))
        status = F.when(F.col("_found"), "done").otherwise("no_data").alias("status")
        now.join(found, "trip_id", "left").select("trip_id", "fingerprint", F.lit(version).alias("version"), status).write.mode("overwrite").parquet(f"{path}/{stage}/state/run={last}")
    results = _read(spark, f"{path}/{stage}/results")
    if results is None:
        return job(inputs.limit(0)).withColumn("run", F.lit(None).cast("long"))
    current = stage_state(spark, path, stage).where("status = 'done'").select("trip_id", "run").join(prints.select("trip_id"), "trip_id", "left_semi")
    return results.join(current, ["trip_id", "run"])
