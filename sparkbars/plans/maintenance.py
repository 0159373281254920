"""Registered table-maintenance, universe, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkbars.functions.windows import dealt
from sparkbars.operators import maintenance as m
from sparkbars.operators import regime
from sparkbars.operators import universe as u
from sparkbars.params import BEST
from sparkbars.plans.features import feature_frame, project
from sparkbars.plans.ledgers import industry_gate, market_gate, regime_settings
from sparkbars.plans.market import regime_grid_fine
from sparkbars.sources import bartable, csvfiles, views
from sparkbars.sources.tables import scratch, table

CUT = "2000-01-01"


def day(value: str):
    return F.to_date(F.lit(value))


def _old(spark, root):
    """Cached part of the bars; every symbol ends at its own date."""
    return views.bars(spark, root).where(F.col("d") < F.date_add(day(CUT), ((F.col("sym") % 5) * 14).cast("int")))


def _new(spark, root):
    """Fresh part: overlaps the cached part, and every sixth symbol comes with another price base."""
    rows = views.bars(spark, root).where(F.col("d") >= F.date_sub(day(CUT), 21))
    factor = F.when(F.col("sym") % 6 == 0, 1.25).otherwise(1.0)
    return rows.withColumns({c: F.col(c) * factor for c in m.OHLC})


def _dirty(spark, root):
    """Bars with stopped days, missing closes, zero opens and price jumps put in by date and symbol."""
    n = F.row_number().over(m.by_day())
    calm = {c: F.sqrt(F.sqrt(c)) * 10 for c in m.OHLC}  # small natural moves, so the injected jumps stand out
    bars = views.bars(spark, root).withColumns(calm).withColumn("n", n)
    few = (F.col("sym") % 2 == 0) & (F.col("n") % 120 == 65)
    many = (F.col("sym") % 2 == 1) & (F.col("n") % 40 == 20)
    return bars.withColumns({
        "volume": F.when(F.col("n") % 13 == 5, 0.0).otherwise(F.col("volume")),
        "close": F.when(F.col("n") % 17 == 9, F.lit(None).cast("double")).when(few | many, F.col("close") * 2).otherwise(F.col("close")),
        "open": F.when(F.col("n") % 19 == 11, 0.0).otherwise(F.col("open"))}).drop("n")


def _money(df):
    return project(df, "open:4 high:4 low:4 close:4 volume:2")


def scan_symbol_bars(spark, root):
    return _money(m.min_history(views.bars(spark, root), 10))


def bars_min_history(spark, root):
    return _money(m.min_history(views.bars(spark, root), 290))


def scan_csv_bars(spark, root):
    path = scratch(spark, "csv-scan")
    csvfiles.write_csv(views.bars(spark, root), path)
    return _money(csvfiles.read_csv(spark, path))


def sink_csv_bars(spark, root):
    path = scratch(spark, "csv-sink")
    csvfiles.write_csv(views.bars_raw(spark, root), path)
    return csvfiles.read_csv(spark, path).groupBy("sym").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("volume"), 2).alias("volume"))


def _csv_lines(spark, root):
    """Files per symbol as they come: some with a line that is cut off, some with a price that is no number, some with no bars."""
    bars = dealt(views.bars(spark, root)).withColumn("n", F.row_number().over(m.by_day()))
    cells = [F.col(c).cast("string") for c in ("d", *m.OHLC, "volume")]
    line = F.concat_ws(",", *cells)
    bad = F.when((F.col("sym") % 7 == 3) & (F.col("n") == 2), F.concat_ws(",", *cells[:3])).when(
        (F.col("sym") % 7 == 5) & (F.col("n") % 9 == 4), F.concat_ws(",", cells[0], F.lit("n/a"), *cells[2:]))
    head = F.when(F.col("n") == 1, "d,open,high,low,close,volume\n").otherwise("")  # every file has one, also that of a symbol whose bars are left out
    value = F.concat(head, F.when(F.expr("sym % 11 != 6"), F.concat(F.coalesce(bad, line), F.lit("\n"))).otherwise(""))
    path = scratch(spark, "csv-lines")
    csvfiles.write_files(bars.select("sym", "d", value.alias("value")).sortWithinPartitions("sym", "d").where("value != ''").select("sym", "value"), path)
    return path


def scan_csv_files(spark, root):
    """Whole bars of all files; see csv_file_report for the rest."""
    df = csvfiles.read_csv_per_symbol(spark, _csv_lines(spark, root))
    return _money(df.withColumn("sym", F.col("sym").cast("bigint")))


def csv_file_report(spark, root):
    """Outcome per symbol of reading its files, with the date of the first line that is no bar."""
    report = csvfiles.csv_report(spark, _csv_lines(spark, root))
    return report.select(F.col("sym").cast("bigint").alias("sym"), "rows", "broken", F.substring_index("first_broken", ",", 1).alias("first_broken"), "status")


def _table(spark, root, name, bars=None):
    path = scratch(spark, name)
    bartable.create(views.bars(spark, root) if bars is None else bars, path)
    return path


def replace_partition(spark, root):
    """Every tenth symbol gets new rows, every tenth moves to a new symbol, all others stay."""
    path = _table(spark, root, "replace")
    rows = bartable.read(spark, path).where("sym % 10 in (3, 4)").withColumn("close", F.col("close") + 1)
    moved = rows.withColumn("sym", F.when(F.col("sym") % 10 == 4, F.col("sym") + 1_000_000).otherwise(F.col("sym")))
    bartable.replace(spark, path, rows.select("sym"), moved)
    return _money(bartable.read(spark, path))


def scan_one_symbol(spark, root):
    """The bars of one symbol, the largest; bucket and key reach the scan."""
    path = _table(spark, root, "symbol")
    return _money(m.min_history(bartable.read_symbol(spark, path, bartable.read(spark, path).agg(F.max("sym")).scalar()), 10))


def delete_symbol(spark, root):
    path = _table(spark, root, "delete")
    bartable.replace(spark, path, views.universe(spark, root).where("sym % 10 = 3").select("sym"))
    return _money(bartable.read(spark, path))


def merge_into_table(spark, root):
    """New rows of a few symbols written over the stored ones of the same date; other buckets are not read."""
    path = _table(spark, root, "merged", _old(spark, root))
    bartable.merge(spark, path, _new(spark, root).where("sym % 10 = 7"))
    return _money(bartable.read(spark, path))


def append_to_table(spark, root):
    """Rows of a few symbols that are newer than the stored ones, added as files."""
    path = _table(spark, root, "appended", _old(spark, root))
    bartable.append_newer(spark, path, _new(spark, root).where("sym % 10 = 7"))
    return _money(bartable.read(spark, path))


def _raw_files(spark, root):
    """Raw bars of one folder of CSV files per symbol: some with few rows, some with stopped days only."""
    short = F.row_number().over(m.by_day()) <= 5
    raw = views.bars(spark, root).withColumn("short", short).where("sym % 7 != 0 or short").drop("short")
    path = scratch(spark, "csv-raw")
    csvfiles.write_csv(raw.withColumn("volume", F.when(F.col("sym") % 11 == 5, 0.0).otherwise(F.col("volume"))), path)
    once = scratch(spark, "csv-read")  # rows are counted and cleaned in two passes; each file is opened in one only
    csvfiles.read_csv(spark, path).write.parquet(once)
    return spark.read.parquet(once)


def _enough(raw, rows=10):
    return raw.groupBy("sym").agg(F.count(F.lit(1)).alias("rows")).withColumn("enough", F.col("rows") >= rows)


def migrate_table(spark, root):
    """Raw files read, cleaned and written into the bar table; symbols with too few rows are left out."""
    raw = _raw_files(spark, root)
    path = _table(spark, root, "migrated", m.clean(raw).join(_enough(raw).where("enough"), "sym", "left_semi"))
    return _money(bartable.read(spark, path))


def migrate_report(spark, root):
    """Outcome per symbol of moving raw files into the table, counted."""
    raw = _raw_files(spark, root)
    kept = m.clean(raw).groupBy("sym").agg(F.count(F.lit(1)).alias("kept"))
    status = F.when(~F.col("enough"), "skipped").when(F.coalesce("kept", F.lit(0)) == 0, "failed").otherwise("migrated")
    return _enough(raw).join(kept, "sym", "left").groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("kept"), F.lit(0)).alias("rows_kept"))


def cache_stats(spark, root):
    per = views.bars(spark, root).groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("a"), F.max("d").alias("b"))
    return per.agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("rows"), F.min("a").alias("first"), F.max("b").alias("last"))


def latest_date_per_symbol(spark, root):
    return m.latest_dates(_old(spark, root))


def latest_close_per_symbol(spark, root):
    return m.latest_rows(views.bars(spark, root)).select("sym", "d", F.round("close", 4).alias("close"))


def stale_symbols(spark, root):
    return m.stale(_old(spark, root), day("2000-02-01"))


def backfill_dates(spark, root):
    return m.backfill_dates(_old(spark, root), day("2000-03-31"))


def incremental_merge(spark, root):
    return _money(m.merge_last(_old(spark, root), _new(spark, root)))


def append_newer_only(spark, root):
    return _money(m.append_newer(_old(spark, root), _new(spark, root)))


def exrights_check(spark, root):
    return m.adjustment_check(_old(spark, root), _new(spark, root))


def history_gaps(spark, root):
    return m.history_gaps(views.bars(spark, root), day("1995-01-02"))


def _day(spark, root):
    """One raw trading day after the cached table, with raw previous closes."""
    last = m.latest_rows(_new(spark, root)).select("sym", F.col("close").alias("c"))
    c = F.col("c")
    return last.select("sym", day("2001-12-03").alias("d"), (c * 2).alias("open"), (c * 2.2).alias("high"), (c * 1.9).alias("low"),
                       (c * 2.1).alias("close"), (F.col("sym") % 50 + 1).cast("double").alias("volume"),
                       F.when(F.col("sym") % 9 == 4, 0.0).otherwise(c * 2).alias("pre_close"))


def merge_day_adjusted(spark, root):
    return _money(m.merge_day(_old(spark, root).where("sym % 8 != 2"), _day(spark, root)))


def forward_adjust(spark, root):
    """Factors known on some dates only, also between bars; every fifth symbol has none."""
    bars = views.bars(spark, root)
    factor = (F.year("d") - 1990 + F.col("sym") % 3).cast("double").alias("adj_factor")
    factors = bars.where("sym % 5 != 4 and day(d) % 4 = 1").select("sym", F.date_add("d", 2).alias("d"), factor)
    return _money(m.forward_adjust(bars, factors))


def splice_realtime_bar(spark, root):
    """Two quotes for every symbol: one on its latest date or a new one, and one three weeks later."""
    last = m.latest_rows(views.bars(spark, root))
    quotes = _day(spark, root).drop("d").join(last.select("sym", F.col("d").alias("last")), "sym")
    first = F.when(F.col("sym") % 2 == 0, F.col("last")).otherwise(day("2001-12-03"))
    later = F.date_add(day("2001-12-03"), 21)
    quotes = quotes.withColumn("d", F.explode(F.array(first, later))).drop("last")
    return _money(m.splice_quotes(views.bars(spark, root), quotes))


def missing_trade_dates(spark, root):
    """Open days of the calendar that the cached activity series lacks."""
    cached = views.market_daily(spark, root).where(F.dayofmonth("d") != 15).select("d")
    return trading_calendar(spark, root).where("is_open").select("d").join(cached, "d", "left_anti")


def amv_coalesce(spark, root):
    rows = views.market_daily(spark, root).select(
        "d", F.when(F.dayofmonth("d") % 2 == 0, F.col("amv")).alias("amv"),
        F.when(F.dayofmonth("d") % 3 == 0, F.col("amv") * 2).alias("amv_circ"))
    return rows.select("d", F.coalesce("amv", "amv_circ").alias("amv")).dropna()


def retention_window(spark, root):
    return m.retention(views.market_daily(spark, root), 730).select("d", "amv")


def trading_calendar(spark, root):
    span = table(spark, root, "orders").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("d"))
    overrides = days.where("dayofmonth(d) = 1 or (weekday(d) = 5 and dayofmonth(d) between 8 and 14)").select(
        "d", (F.dayofmonth("d") != 1).alias("is_open"))
    return m.calendar(span, overrides)


def freshness_gate(spark, root):
    """Is the newest bar as new as the calendar expects, after hours and intraday?"""
    latest = views.bars(spark, root).agg(F.max("d")).scalar()
    open_days = trading_calendar(spark, root).where("is_open")
    expected = open_days.agg(F.max("d").alias("last_open"), F.sort_array(F.collect_set("d"), False)[1].alias("open_before"))
    return expected.withColumn("latest", latest).select(
        "latest", "last_open", "open_before", (F.col("latest") >= F.col("last_open")).alias("fresh_after_hours"),
        (F.col("latest") >= F.col("open_before")).alias("fresh_intraday"))


def snapshot_sufficiency(spark, root):
    per = views.bars(spark, root).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("symbols")).select(
        "rows", "symbols", (F.col("rows") >= 1000).alias("enough_rows"), (F.col("symbols") >= 1000).alias("enough_symbols"))


def report_json(spark, root):
    """Nested report rows as JSON files, read back as text."""
    df = feature_frame(spark, root).where("signal_v64").join(views.universe(spark, root).select("sym", "industry"), "sym")
    per = df.groupBy("sym", "industry").agg(F.count(F.lit(1)).alias("signals"), F.max("d").alias("last"))
    path = scratch(spark, "report")
    per.select("industry", F.struct("sym", "signals", "last").alias("item")).write.json(path)
    back = spark.read.schema("industry string, item struct<sym: bigint, signals: bigint, last: date>").json(path)
    return back.select("industry", "item.*")


def grid_csv(spark, root):
    path = scratch(spark, "grid")
    regime_grid_fine(spark, root).write.option("header", True).csv(path)
    schema = "smooth int, cost int, upper double, lower double, total_days bigint, bull_days bigint, bear_days bigint, transitions bigint"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


# ---- cleaning ---------------------------------------------------------------------------


def clean_bars(spark, root):
    return _money(m.drop_bad(_dirty(spark, root)))


def clean_jump_rows(spark, root):
    return _money(m.drop_jumps(m.drop_bad(_dirty(spark, root))))


def ffill_dropna(spark, root):
    return _money(m.fill_forward(_dirty(spark, root)))


def normalize_columns(spark, root):
    vendor = views.bars(spark, root).selectExpr("sym", "d", "open as OPEN", "high as High", "low as Low", "close as last_price", "volume as Vol")
    return _money(m.rename_columns(vendor, {"close": ["latest", "last_price", "CLOSE"], "volume": ["Vol"]}))


# ---- universe ---------------------------------------------------------------------------


def _listing(spark, root):
    """Universe with codes, names with status marks, listing dates and last prices."""
    lead = F.element_at(F.array(*[F.lit(x) for x in "60389"]), (F.col("sym") % 5 + 1).cast("int"))
    name = F.col("name")
    marked = (F.when(F.col("sym") % 11 == 0, F.concat(F.lit("ST"), name)).when(F.col("sym") % 11 == 1, F.concat(F.lit("*ST"), name))
              .when(F.col("sym") % 11 == 2, F.concat(F.lit("N"), name)).when(F.col("sym") % 11 == 3, F.concat(name, F.lit("退"))).otherwise(name))
    df = views.universe(spark, root).select(
        "sym", F.concat(lead, (F.col("sym") + 10000).cast("string")).alias("code"), marked.alias("name"), "industry",
        F.date_add(day("2016-01-01"), (F.col("sym") * 37 % 2000).cast("int")).alias("list_date"),
        (F.col("balance") / 500).alias("last"), (F.col("sym") % 4).cast("double").alias("volume"), "balance")
    return df


def normalize_codes(spark, root):
    df = _listing(spark, root).withColumn("symbol", u.exchange_code(F.col("code")))
    df = df.withColumn("vendor", u.vendor_code(F.col("symbol")))
    return df.select("sym", "code", "symbol", "vendor", u.from_vendor(F.col("vendor")).alias("back"))


def universe_filter(spark, root):
    df = _listing(spark, root).withColumn("symbol", F.coalesce(u.exchange_code(F.col("code")), F.concat("code", F.lit(".BJ"))))
    return u.eligible(df, day("2020-01-01")).select("sym", "symbol", "name", "list_date")


def spot_prefilter(spark, root):
    return u.tradable(_listing(spark, root)).select("sym", "symbol", "name")


def sample_symbols(spark, root):
    return u.sample(views.universe(spark, root), 20, "42:").select("sym", "key")


def prefilter_median_industry(spark, root):
    changes = views.universe(spark, root).groupBy("industry").agg(F.avg("balance").alias("change"))
    strong = u.strong_industries(changes)
    return u.tradable(_listing(spark, root)).join(strong, "industry", "left_semi").select("sym", "industry")


def universe_literal_semi(spark, root):
    """A curated list of symbols as a literal table."""
    curated = spark.range(1).select(F.explode(F.expr("sequence(0L, 95L, 5L)")).alias("sym"))
    bars = views.bars(spark, root).join(curated, "sym", "left_semi")
    return bars.groupBy("sym").agg(F.count(F.lit(1)).alias("rows"))


def latest_signals(spark, root):
    df = feature_frame(spark, root)
    last = df.groupBy("sym").agg(F.max_by(F.struct("d", "white_line", "yellow_line", "signal_v64", "close"), "d").alias("r")).select("sym", "r.*")
    return last.where("white_line is not null and yellow_line is not null and signal_v64").select("sym", "d", F.round("close", 4).alias("close"))


def universe_semi_prefilter(spark, root):
    return views.universe(spark, root).join(u.tradable(_listing(spark, root)).select("sym"), "sym", "left_semi").select("sym", "name")


def resume_anti(spark, root, since=None):
    """Symbols still to be scanned: those without a bar since the given date, by default in the table's last 7 days."""
    bars = views.bars(spark, root)
    since = since or bars.agg(F.date_sub(F.max("d"), 7)).scalar()
    done = bars.where(F.col("d") >= since).select("sym").distinct()
    return views.universe(spark, root).join(done, "sym", "left_anti").select("sym", "name")


def filter_allowed_dates(spark, root):
    states = regime.daily_state(views.market_daily(spark, root), **regime_settings())
    days = states.where("state = 1").select("d")
    return feature_frame(spark, root).where("signal_v64").select("sym", "d").join(days, "d", "left_semi").select("sym", "d")


def filter_industry_allow(spark, root):
    df = industry_gate(spark, root, feature_frame(spark, root).where("signal_v64").select("sym", "d"), BEST)
    return df.where("allow").select("sym", "d")


def gate_market_regime(spark, root):
    return market_gate(spark, root, feature_frame(spark, root).where("signal_v64").select("sym", "d"), BEST).select("sym", "d", "allow")


def dates_intersect(spark, root):
    return views.market_daily(spark, root).select("d").intersect(views.index_daily(spark, root).select("d"))


def distinct_codes(spark, root):
    a = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("sym"))
    return a.unionByName(views.universe(spark, root).select("sym")).distinct()


def scan_counters(spark, root):
    """Outcome counters of one scan over all symbols."""
    per = feature_frame(spark, root).groupBy("sym").agg(F.max_by("signal_v64", "d").alias("hit"), F.count(F.lit(1)).alias("n"))
    rows = views.universe(spark, root).join(per, "sym", "left")
    status = F.when(F.col("n").isNull(), "cache_miss").when(F.col("n") < 290, "too_short").when(F.col("hit"), "signal").otherwise("processed")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("symbols"))


def queries() -> dict:
    return {f.__name__: f for f in (
        scan_symbol_bars, bars_min_history, scan_csv_bars, sink_csv_bars, scan_one_symbol, replace_partition, delete_symbol, migrate_table,
        scan_csv_files, csv_file_report, merge_into_table, append_to_table, migrate_report, cache_stats,
        latest_date_per_symbol, latest_close_per_symbol, stale_symbols, backfill_dates, incremental_merge, append_newer_only,
        exrights_check, history_gaps, merge_day_adjusted, forward_adjust, splice_realtime_bar, missing_trade_dates, amv_coalesce,
        retention_window, trading_calendar, freshness_gate, snapshot_sufficiency, report_json, grid_csv, clean_bars, clean_jump_rows,
        ffill_dropna, normalize_columns, normalize_codes, universe_filter, spot_prefilter, sample_symbols, prefilter_median_industry,
        universe_literal_semi, latest_signals, universe_semi_prefilter, resume_anti, filter_allowed_dates, filter_industry_allow,
        gate_market_regime, dates_intersect, distinct_codes, scan_counters)}

