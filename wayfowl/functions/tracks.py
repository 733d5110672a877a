"""Column functions and windows that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

TRIP = ("trip_id",)


def in_order(*extra: str) -> WindowSpec:
    """A trip's rows in time; all operators use this one order, so that Spark plans one exchange and sort for a chain of them."""
    return Window.partitionBy(*TRIP, *extra).orderBy("ts", "ord")


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def minute_of_day(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.hour(c) * 60 + F.minute(c)


def hour_of_day(c: str | Column) -> Column:
    """Hours and fractions since midnight, from whole seconds."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c).cast("int")) / 3600.0


def rounded(c: Column, places: int) -> Column:
    """A double to so many places: half of the scaled double up, as SQL engines do it. Spark's round goes by the decimal digits of the
    unscaled one, where what is meant as a half may lie below."""
    return F.round(c * 10.0**places) / 10.0**places


def near_day(day: Column, month: int, dom: int, d: int) -> Column:
    """Whether a date lies within d days of month-dom of its own year."""
    return F.abs(F.datediff(day, F.make_date(F.year(day), F.lit(month), F.lit(dom)))) <= d


def run_number(changed: Column, window: WindowSpec) -> Column:
    return F.sum(F.when(changed, 1).otherwise(0)).over(window)


def last_known(c: str, window: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def next_known(c: str, window: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))


def one_trip_a_partition(rows: DataFrame) -> DataFrame:
    """Each trip's rows together, in all of the session's shuffle partitions: few rows with much work on each are not drawn together
    into one task, as Spark does by their bytes. Groups of a trip need no other shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trip_id")


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a cluster is refused; a session on one machine (tests) gets a folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-wayfowl-')}"
        sc.setCheckpointDir(base)
    return base
