"""The scan of a day from stored indicators against the whole history."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbars.plans import scan
from sparkbars.plans.features import feature_frame

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["rn", "white_line", "yellow_line", "j", "obv", "macd_hist", "atr30", "low_obv10", "vwap", "anchor_recent", "active", "factor_a", "factor_c", "factor_d", "dry_recent",
           "near_count", "crossed_recent", "score", "signal_v60", "signal_v63", "signal_v64"]


def test_newest_bars_of_a_block_are_those_of_the_history(spark):
    whole = feature_frame(spark, ROOT, scan.BEST).select("sym", "d", *COLUMNS).persist()
    for day in ("1995-03-06", "1996-01-01", "1997-12-30", "1998-02-14", "2001-09-03", "2024-01-01"):
        df = scan._block_of(spark, ROOT, day)
        for step in scan.SIGNAL_STEPS:
            df = step(df, scan.BEST)
        newest = lambda x: x.groupBy("sym").agg(F.max_by(F.struct("d", *COLUMNS), "d").alias("r")).select("sym", "r.*")
        got, want = newest(df), newest(whole.where(F.col("d") <= F.lit(day).cast("date")))
        assert sorted(got.collect()) == sorted(want.collect()), day
    whole.unpersist()


def test_a_day_reads_its_period_only(spark):
    plan = scan._block_of(spark, ROOT, "1996-08-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "PushedFilters: [IsNotNull(d), LessThanOrEqual(d,1996-08-05)]" in plan
    part = scan._block_of(spark, ROOT, "1996-08-05").count()
    assert 0 < part < scan.views.bars(spark, ROOT).count() / 2


def test_stored_views_follow_files_inside_a_folder(spark, tmp_path):
    rows = spark.read.parquet(f"{ROOT}/lineitem.parquet")
    rows.limit(3000).repartition(2).write.parquet(str(tmp_path / "lineitem.parquet"))
    first = scan.views.market_daily(spark, str(tmp_path)).agg(F.sum("stock_count")).first()[0]
    rows.limit(500).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert first == 3000 and scan.views.market_daily(spark, str(tmp_path)).agg(F.sum("stock_count")).first()[0] == 3500


def test_a_block_keeps_no_column_that_follows_from_others(spark):
    stored = scan.indicator_blocks(spark, ROOT).columns
    assert set(stored) == {*scan.STORED, "period"} and not {"prev_close", "ema12", "body", "close_sum"} & set(stored)
