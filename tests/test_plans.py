"""Plans: how often the input is read, what is shuffled, and how evenly work is dealt."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import climate, evaluate, stdindex
from gridloom.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["e01_rolling_sums", "e02_water_year_indices"])
def test_sums_read_their_input_once_and_run_no_job_before(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"plan-{name}", "")
    out = queries.queries()[name](spark, SF)
    jobs = tracker.getJobIdsForGroup(f"plan-{name}")
    text = plan(out)
    spark.sparkContext.setJobGroup("other", "")
    # reading a file's schema is the only job that a view starts
    assert len(jobs) <= 1 and text.count("FileScan") == 1 and "Broadcast" not in text


def annual(spark, n=40):
    rows = spark.range(n).select((F.col("id") % 8).cast("int").alias("row"), (F.col("id") / 8).cast("int").alias("col"))
    rows = rows.withColumn("year", F.explode(F.sequence(F.lit(1960), F.lit(2009))))
    value = lambda k: F.pmod(F.xxhash64("row", "col", "year", F.lit(k)), F.lit(1000)) / 10.0
    return rows.withColumns({"ppt": value(1), "pet": value(2) / 2})


def test_years_given_are_the_years_found(spark):
    df = annual(spark, 5).where("year NOT IN (1970, 1971) AND NOT (row = 1 AND year = 1980)")
    years = [y for y in range(1960, 2010) if y not in (1970, 1971)]
    found, given = (climate.rolling_indices(df, spans=(3,), years=y).orderBy("row", "col", "year").collect() for y in (None, years))
    assert found == given
    one = {r.year: r.PR3 for r in given if r.row == 1}
    assert one[1972] is not None and one[1982] is None and 1980 not in one
    cut = climate.rolling_indices(df, spans=(3,), years=range(1990, 2000))
    assert cut.agg(F.min("year"), F.max("year")).first() == (1990, 1999)


def test_projections_share_stored_parameters(spark):
    df = annual(spark)
    rolled = climate.rolling_indices(df, spans=(1, 2), years=range(1960, 2010))
    tables = {}
    for name, source, kind in (("SPI", "PR", "gamma"), ("SPEI", "PRET", "shifted_gamma")):
        fitted = stdindex.fit_parameters(rolled, [f"{source}1", f"{source}2"], (1970, 2000), kind)
        tables[name] = stdindex.store_parameters(fitted, f"parameters_{name}", buckets=4)
    want = climate.index_suite(df, (1970, 2000), (1995, 2009), (1, 2), years=range(1960, 2010)).orderBy("row", "col", "year").collect()
    shared = climate.index_suite(df, (1970, 2000), (1995, 2009), (1, 2), years=range(1960, 2010), parameters=tables)
    assert shared.orderBy("row", "col", "year").collect() == want and sum(r.SPEI2 is not None for r in want) > 100
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(stdindex.standardised(None, rolled, {"PRET1": "S"}, None, "shifted_gamma", parameters=tables["SPEI"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    side = text[text.index("parameters_spei") - 400 :]
    assert "fit(" not in text and "collect_list" not in text and text.count("Exchange hashpartitioning") == 1 and "Exchange" not in side[: side.index("parameters_spei")].split("Sort")[-1]


def test_slices_of_skewed_ids_are_even(spark):
    ids = spark.range(20_000).select(F.when(F.col("id") == 0, F.lit(10**15)).otherwise(F.col("id")).alias("id"))
    rows = ids.select(F.lit(1).alias("train_year"), F.lit(1).alias("eval_year"), F.lit(0).alias("fold"), "id", F.lit(1.0).alias("prediction"), F.lit(2.0).alias("target"))
    largest = evaluate.with_slices(rows, 256).groupBy("__slice").count().agg(F.max("count")).first()[0]
    assert largest < 0.02 * 20_000
    got = [r.id for r in evaluate.systematic_sample(rows, 1000).orderBy("id").collect()]
    assert got == sorted(r.id for r in ids.collect())[::1000]
