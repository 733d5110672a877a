"""The ledger of stages."""

import pytest
from pyspark.sql import functions as F

from wayfowl.sources import ledger


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "trip_id long, x double, run string")


def doubled(rows):
    return rows.where("x > 0").select("trip_id", (F.col("x") * 2).alias("twice"))


def seen(df):
    return sorted((r.trip_id, r.twice, r.run) for r in df.collect())


def test_only_what_changed_is_done_again(spark, tmp_path):
    path, asked = str(tmp_path), []

    def job(rows):
        asked.append(sorted({r.trip_id for r in rows.collect()}))
        return doubled(rows)

    first = [(1, 1.0, "a"), (1, 2.0, None), (2, 3.0, "b"), (3, -1.0, "c"), (None, 9.0, "d")]
    assert seen(ledger.run_stage(rows_of(spark, first), job, path, "s")) == [(1, 2.0, 1), (1, 4.0, 1), (2, 6.0, 1)]
    ledger.run_stage(rows_of(spark, first[::-1]), job, path, "s")  # the same rows in another order
    assert asked == [[1, 2, 3]]
    changed = [(1, 1.0, "a"), (1, None, "2.0"), (2, 3.0, "b"), (2, 3.0, "b"), (4, 5.0, "e")]
    assert seen(ledger.run_stage(rows_of(spark, changed), job, path, "s")) == [(1, 2.0, 2), (2, 6.0, 2), (2, 6.0, 2), (4, 10.0, 2)]
    assert asked[1:] == [[1, 2, 4]]
    ledger.run_stage(rows_of(spark, changed), job, path, "s", again=spark.createDataFrame([(4,), (77,)], "trip_id long"))
    ledger.run_stage(rows_of(spark, changed), job, path, "s", version="other parameters")
    assert asked[2:] == [[4], [1, 2, 4]]
    state = {r.trip_id: (r.status, r.run) for r in ledger.stage_state(spark, path, "s").collect()}
    assert state == {1: ("done", 4), 2: ("done", 4), 3: ("no_data", 1), 4: ("done", 4)}
    assert ledger.run_stage(rows_of(spark, []), job, path, "empty").count() == 0


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    path, calls = str(tmp_path), []
    rows = rows_of(spark, [(i, float(i + 1), "x") for i in range(40)])

    def breaks(some):
        calls.append(1)
        if len(calls) == 3:
            return some.select("trip_id", F.raise_error(F.lit("lost")).cast("double").alias("twice"))
        return doubled(some)

    with pytest.raises(Exception, match="lost"):
        ledger.run_stage(rows, breaks, path, "s", batches=4)
    kept = {r.trip_id for r in ledger.stage_state(spark, path, "s").collect()}
    assert 0 < len(kept) < 40
    asked = []
    got = ledger.run_stage(rows, lambda some: asked.extend(r.trip_id for r in some.collect()) or doubled(some), path, "s", batches=4)
    assert sorted(r.trip_id for r in got.collect()) == list(range(40)) and set(asked) == set(range(40)) - kept
    assert {r.run for r in got.where(F.col("trip_id").isin(*kept)).collect()} == {1, 2}
