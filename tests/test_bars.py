"""Indicators, tags, cleaning and maintenance on small literal fixtures."""

from __future__ import annotations

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sparkbars.functions.recurrences import center_of_mass, ewm, span
from sparkbars.functions.windows import BLOCK, close_mean, sequence
from sparkbars.operators import maintenance as m
from sparkbars.operators import records
from sparkbars.operators.indicators import indicators
from sparkbars.operators.signals import signals
from sparkbars.params import BEST, V60, V64
from sparkbars.plans.market import exact_median
from sparkbars.sources import bartable, csvfiles

SCHEMA = "sym bigint, d date, open double, high double, low double, close double, volume double"
START = dt.date(2024, 1, 1)


def frame(spark, rows, sym=1):
    return spark.createDataFrame([(sym, START + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def walk(n, seed, sym=1, drift=0.001):
    rng = random.Random(seed)
    price, rows = 20.0, []
    for i in range(n):
        open_ = price
        price = round(price * (1 + rng.gauss(drift, 0.025)), 2)
        rows.append((sym, START + dt.timedelta(days=i), open_, round(max(open_, price) * 1.01, 2), round(min(open_, price) * 0.99, 2),
                     price, float(rng.randint(100000, 5000000))))
    return rows


def test_indicator_ranges(spark):
    bars = spark.createDataFrame(walk(200, 42), SCHEMA)
    rows = indicators(bars).orderBy("d").collect()
    assert len(rows) == 200
    for r in rows[-50:]:
        assert r.atr14 >= 0 and 0 <= r.j <= 100
        assert 0.8 < r.white_line / r.close < 1.2 and 0.7 < r.yellow_line / r.close < 1.3


def test_short_single_and_flat_series(spark):
    short = [(10.0, 10.5, 9.8, 10.2, 100e3), (10.5, 11.0, 10.2, 10.8, 200e3), (11.0, 11.5, 10.5, 11.2, 150e3),
             (10.8, 11.2, 10.3, 10.5, 180e3), (10.6, 11.0, 10.2, 10.4, 120e3)]
    last = indicators(frame(spark, short)).orderBy(F.desc("d")).first()
    assert None not in (last.white_line, last.yellow_line, last.atr14, last.j)
    assert indicators(frame(spark, short[:1])).count() == 1
    flat = indicators(frame(spark, [(15.0, 15.0, 15.0, 15.0, 500e3)] * 50)).collect()
    assert all(r.atr14 == 0 and r.j == 0 and r.white_line == 15.0 and r.yellow_line == 15.0 for r in flat)


def test_recurrence_over_block_borders(spark):
    n = 3 * BLOCK + 17
    rows = walk(n, 5) + walk(40, 6, sym=2)
    df = sequence(spark.createDataFrame(rows, SCHEMA))
    df = ewm(df, ["sym"], {"slow": ("close", span(26)), "fast": ("close", center_of_mass(2))})
    got = {(r.sym, r.d): r for r in df.collect()}
    for sym in (1, 2):
        slow = fast = None
        for s, d, *_, close, _v in [r for r in rows if r[0] == sym]:
            slow = close if slow is None else slow + 2 / 27 * (close - slow)
            fast = close if fast is None else fast + (close - fast) / 3
            assert got[s, d].slow == pytest.approx(slow, rel=1e-12)
            assert got[s, d].fast == pytest.approx(fast, rel=1e-12)


@pytest.mark.parametrize("n", [1, 1.2, 2, 30, 200, 5000])
def test_recurrence_of_any_span(spark, n):
    rows = walk(2 * BLOCK + 5, 7)
    df = ewm(sequence(spark.createDataFrame(rows, SCHEMA)), ["sym"], {"x": ("close", span(n))})
    e = None
    for r, row in zip(df.orderBy("d").collect(), rows):
        e = row[5] if e is None else e + span(n) * (row[5] - e)
        assert r.x == pytest.approx(e, rel=1e-10)


def test_average_of_prices_beyond_long(spark):
    rows = [(1, START + dt.timedelta(days=k), *[3e9 + k] * 4, 1.0) for k in range(30)]
    got = sequence(spark.createDataFrame(rows, SCHEMA)).withColumn("mean", close_mean(5)).orderBy("d").collect()
    assert got[-1]["mean"] == pytest.approx(3e9 + 27) and got[0]["mean"] == 3e9


def test_scores_are_bounded_and_add_up(spark):
    bars = spark.createDataFrame(walk(200, 200, drift=0.002) + walk(200, 100, sym=2, drift=-0.002), SCHEMA)
    for r in signals(indicators(bars), V64).collect():
        parts = (r.eq_j, r.eq_volume, r.eq_candle, r.eq_ma, r.eq_support)
        assert all(0 <= p <= 2 for p in parts) and r.score == min(sum(parts), 8)
        assert r.signal_v64 in (True, False)
    falling = signals(indicators(bars.where("sym = 2")), V60).where("signal_v60").count()
    assert falling <= 5


def test_first_row_counts_as_seen(spark):
    first = signals(indicators(spark.createDataFrame(walk(10, 1), SCHEMA)), V60).orderBy("d").first()
    assert first.dry_recent and first.anchor_recent


def test_money_flow_structure(spark):
    rows = []  # strong days on rising volume, each followed by a shallow, quiet pull-back
    for n in range(5):
        low = 40.0 + 1.8 * n
        rows.append((low, low + 2.2, low - 0.2, low + 2.0, 520.0 + 30 * n))
        rows.append((low + 1.9, low + 2.3, low + 1.4, low + 1.6 if n < 4 else low + 2.2, 310.0 + 10 * n))
    last = signals(indicators(frame(spark, rows)), replace(V64, smart_money=True)).orderBy(F.desc("d")).first()
    assert last.sm_strong_up and last.sm_pullback_shrink and last.sm_dominance and last.sm_no_distribution and last.flow_ok
    rows = [(50.0 + n, 51.3 + n, 49.8 + n, 51.0 + n, 400.0 + 20 * n) for n in range(9)]
    rows.append((59.4, 59.9, 57.6, 57.9, 900.0))  # a heavy fall from the high
    rules = replace(V64, flow_near_high=0.96, flow_heavy_drop=0.01)
    assert not signals(indicators(frame(spark, rows)), rules).orderBy(F.desc("d")).first().sm_no_distribution


def test_cleaning(spark):
    rows = [[20.0 + i * 0.01] * 4 + [1000.0] for i in range(50)]
    for i in (5, 15):
        rows[i][4] = 0.0
    rows[20][0] = 0.0
    rows[30][3] *= 2
    df = frame(spark, rows).withColumn("close", F.when(F.col("d") == START + dt.timedelta(days=10), F.lit(None).cast("double")).otherwise(F.col("close")))
    kept = {(r.d - START).days for r in m.clean(df).collect()}
    assert kept == set(range(50)) - {5, 10, 15, 20, 30}
    many = [[20.0] * 4 + [1000.0] for _ in range(50)]
    for i in (5, 15, 25, 35, 45):
        many[i][3] = 40.0
    assert m.clean(frame(spark, many)).count() == 50
    assert m.clean(frame(spark, rows).drop("close")).count() == 0
    upper = frame(spark, many).withColumnsRenamed({"open": "Open", "close": "CLOSE"})
    assert m.clean(upper).count() == 50


def test_splice_ratio(spark):
    quote = spark.createDataFrame([(1, START + dt.timedelta(days=2), 7.6, 8.2, 7.5, 8.1, 900.0, 8.0)], SCHEMA + ", pre_close double")
    history = [(9.0, 9.0, 9.0, 9.0, 1.0), (10.0, 10.0, 10.0, 10.0, 1.0)]
    for extra in ([], [(10.4, 10.4, 10.4, 10.4, 1.0)]):
        rows = m.splice_quotes(frame(spark, history + extra), quote).orderBy("d").collect()
        assert len(rows) == 3
        assert rows[-1].close == pytest.approx(8.1 * 1.25) and rows[-1].volume == 900.0


def test_dynamic_score_filter(spark):
    rows = [("good", 2.5, 7, 0.35), ("bull only", 4.5, 5, 0.45), ("hot", 8.0, 8, 0.25), ("weak", 1.5, 3, 0.5), ("lost", 0.5, 1, 0.1), ("four", 3.0, 4, 0.52),
            ("four, loud", 3.0, 4, 0.75)]
    df = spark.createDataFrame(rows, "code string, j double, score int, ratio double")
    rules = replace(BEST, j_cap=5.0, bull_min_score=5, bear_min_score=6, score4_j_max=5.0, score4_volume_max=0.60)

    def kept(r, bull):
        cond = records.dynamic_score(r, F.lit(bull).cast("boolean"), F.col("j"), F.col("score"), F.col("ratio"))
        return {x.code for x in df.where(cond).collect()}

    assert kept(rules, True) == {"good", "bull only"}
    assert kept(rules, False) == {"good"} == kept(rules, None)
    assert kept(replace(rules, score4_exception=True), True) == {"good", "bull only", "four"}


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, rng.gauss(0, 0.1)])) for k in (1, 2, 3) for _ in range(301 if k == 1 else 200)]
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    import statistics

    for k in (1, 2, 3):
        assert got[k] == pytest.approx(statistics.median(v for kk, v in rows if kk == k), abs=1e-15)


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("part-*")}


def test_table_replace_and_delete(spark, tmp_path):
    path = str(tmp_path / "table")
    bars = spark.createDataFrame([r for s in range(6) for r in walk(12, s, sym=s)], SCHEMA)
    bartable.create(bars, path)
    bartable.replace(spark, path, spark.createDataFrame([(2,)], "sym bigint"))
    assert {r.sym for r in bartable.read(spark, path).select("sym").distinct().collect()} == {0, 1, 3, 4, 5}
    bartable.replace(spark, path, spark.createDataFrame([(3,)], "sym bigint"), bars.where("sym = 3").withColumn("close", F.lit(7.0)))
    assert {r.close for r in bartable.read(spark, path).where("sym = 3").collect()} == {7.0}
    assert bartable.read(spark, path).count() == 60 and bartable.read_symbol(spark, path, 3).count() == 12
    bartable.replace(spark, path, spark.createDataFrame([(s,) for s in range(6)], "sym bigint"))
    assert bartable.read(spark, path).count() == 0
    bartable.merge(spark, path, bars.where("sym = 1"))
    assert bartable.read(spark, path).count() == 12


def test_table_changes_touch_their_own_buckets_only(spark, tmp_path):
    path = tmp_path / "table"
    bars = spark.createDataFrame([r for s in range(200) for r in walk(3, s, sym=s)], SCHEMA)
    bartable.create(bars, str(path))
    before = files(path)
    new = bars.where("sym in (2, 17)").withColumn("close", F.lit(9.0)).withColumn("d", F.date_add("d", 2))
    plan = bartable.touched(spark, str(path), new)[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    bartable.merge(spark, str(path), new)
    after = files(path)
    buckets = {r.b for r in new.select(bartable.bucket(F.col("sym")).alias("b")).distinct().collect()}
    assert {p.parent.name for p in before if after.get(p) != before[p]} == {f"bucket={b}" for b in buckets}
    rows = bartable.read(spark, str(path))
    assert rows.count() == 600 + 4 and rows.where("close = 9").count() == 6
    newer = bars.where("sym = 5").withColumn("d", F.date_add("d", 1))
    bartable.append_newer(spark, str(path), newer)
    assert rows.sparkSession.read.parquet(str(path)).where("sym = 5").count() == 4 and all(files(path).get(p) == t for p, t in after.items())


def test_table_moves_symbols_and_ignores_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "table")
    bars = spark.createDataFrame([r for s in range(12) for r in walk(3, s, sym=s)], SCHEMA)
    bartable.create(bars, path)
    fresh = spark.createDataFrame([r for s in range(100, 108) for r in walk(1, s, sym=s)], SCHEMA)
    for _ in range(2):  # symbols of the new rows are replaced too
        bartable.replace(spark, path, spark.createDataFrame([(2,)], "sym bigint"), fresh)
        assert bartable.read(spark, path).count() == 36 - 3 + 8
    before = sorted(bartable.read(spark, path).collect())
    with pytest.raises(Exception):
        bartable.replace(spark, path, bars.select("sym"), bars.withColumn("close", F.raise_error(F.lit("broken")).cast("double")))
    assert sorted(bartable.read(spark, path).collect()) == before
    bartable.create(bars.where("sym = 1"), path)
    assert bartable.read(spark, path).count() == 3


def test_splice_of_several_quotes_uses_the_close_before_each(spark):
    history = spark.createDataFrame([(1, f"2024-01-0{n}", *[float(n)] * 4, 1.0) for n in (1, 2, 5)], "sym long, d string, open double, high double, low double, close double, volume double")
    history = history.withColumn("d", F.to_date("d"))
    quotes = spark.createDataFrame([(1, f"2024-01-0{n}", *[1.0] * 4, 1.0, 1.0) for n in (3, 6)], "sym long, d string, open double, high double, low double, close double, volume double, pre_close double")
    ratios = m.quote_ratio(quotes.withColumn("d", F.to_date("d")), history).orderBy("d").collect()
    assert [r.ratio for r in ratios] == [2.0, 5.0]


def test_adjustment_carries_factors_and_keeps_bars_without(spark):
    raw = spark.createDataFrame([(s, n, *[10.0] * 4, 1.0) for s in (1, 2) for n in (1, 2, 5, 9)], "sym long, n int, open double, high double, low double, close double, volume double")
    raw = raw.withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n"))).drop("n")
    factors = spark.createDataFrame([(1, 2, 1.0), (1, 7, 4.0)], "sym long, n int, adj_factor double")
    factors = factors.withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n"))).drop("n")
    got = m.forward_adjust(raw, factors).orderBy("sym", "d").collect()
    assert [r.close for r in got] == [10.0, 2.5, 2.5, 10.0] + [10.0] * 4


def test_csv_per_symbol_and_what_is_wrong_with_it(spark, tmp_path):
    head = "d,open,high,low,close,volume\n"
    good = "2024-01-02,1,2,0.5,1.5,100\n2024-01-03,1,2,0.5,1.6,100\n"
    for name, text in {"600519.SH": head + good, "000001.SZ": head + "2024-01-04,1,x,0.5,1.5,100\n" + good + "2024-01-05,1,2\n", "1.SZ": head, "2.SZ": "",
                       "3.SZ": head + "no date,1,2,0.5,1.5,100\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = csvfiles.read_csv_per_symbol(spark, str(tmp_path)).collect()
    assert sorted(r.sym for r in got) == ["000001.SZ"] * 2 + ["600519.SH"] * 2 and {r.close for r in got} == {1.5, 1.6}
    assert sorted(map(tuple, csvfiles.csv_report(spark, str(tmp_path)).collect())) == [
        ("000001.SZ", 2, 2, "2024-01-04,1,x,0.5,1.5,100", "broken"), ("1.SZ", 0, 0, None, "empty"), ("2.SZ", 0, 0, None, "empty"),
        ("3.SZ", 0, 1, "no date,1,2,0.5,1.5,100", "broken"), ("600519.SH", 2, 0, None, "complete")]


def test_market_activity_covers_all_dates_of_the_table(spark, monkeypatch):
    from datetime import date

    from sparkbars.plans import market

    days = [date(1990, 1, 2), date(1998, 1, 5), date(2015, 6, 1)]
    bars = spark.createDataFrame([(1, d, 2.0, 3.0) for d in days], "sym long, d date, close double, volume double")
    monkeypatch.setattr(market.views, "bars", lambda spark, root: bars)
    assert sorted(r.d for r in market.market_amv(spark, "").collect()) == days
    assert [r.d for r in market.market_amv(spark, "", date(1995, 1, 1), date(2001, 12, 31)).collect()] == days[1:2]


def test_csv_folders_are_written_and_listed_by_a_few_tasks(spark, tmp_path):
    rows = [r for s in range(40) for r in walk(12, s, sym=s)]
    spark.conf.set(csvfiles.LISTING, "10000")
    csvfiles.write_csv(spark.createDataFrame(rows, SCHEMA).select("sym", "d", "open", "high", "low", "close", "volume"), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("sym=*/*.csv"))) == 40
    got = csvfiles.read_csv(spark, str(tmp_path / "csv"))
    assert got.count() == 480 and int(spark.conf.get(csvfiles.LISTING)) < 100


def test_files_per_symbol_are_whole_however_their_lines_come(spark, tmp_path):
    """One file a symbol and no other, with all of its lines in order, also where a symbol's lines come in several batches."""
    rows = [(s, i, ("d,open\n" if i == 0 else "") + (f"{s},{i}\n" if s else "")) for s in range(12) for i in range(7 if s else 1)] + [(None, 0, "d,open\n")]
    lines = spark.createDataFrame(rows, "sym bigint, n int, value string").repartition(3, "sym").sortWithinPartitions("sym", "n").select("sym", "value")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        csvfiles.write_files(lines, str(tmp_path / "files"))
        csvfiles.write_files(lines.where("false"), str(tmp_path / "none"))
        csvfiles.write_folders(lines, str(tmp_path / "folders"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    want = {str(s): "d,open\n" + "".join(f"{s},{i}\n" for i in range(7) if s) for s in range(12)}
    assert {f.name: f.read_text() for f in (tmp_path / "files").iterdir()} == {f"{s}.csv": text for s, text in (want | {"null": "d,open\n"}).items()}
    assert not list((tmp_path / "none").iterdir())
    assert {f.parent.name[4:]: f.read_text() for f in (tmp_path / "folders").glob("sym=[0-9]*/*.txt")} == want


def test_files_per_symbol_are_made_and_listed_by_a_few_tasks(spark, tmp_path):
    """Bars are dealt to tasks that make the files, one a symbol in one folder, and folders are not listed by a task each."""
    from sparkbars.plans import maintenance
    from tests.test_queries import ROOT

    made = maintenance._csv_lines(spark, ROOT)
    syms = {r.sym for r in maintenance.views.bars(spark, ROOT).select("sym").distinct().collect()}
    names = spark.read.format("binaryFile").load(made).select("path").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in names) == sorted(f"{s}.csv" for s in syms)
    spark.conf.set(csvfiles.LISTING, "10000")
    for s in range(40):
        (tmp_path / f"sym={s}").mkdir()
        (tmp_path / f"sym={s}" / "a.b.csv").write_text("d,open,high,low,close,volume\n2024-01-02,1,1,1,1,9\n")
    report = csvfiles.csv_report(spark, str(tmp_path))
    assert int(spark.conf.get(csvfiles.LISTING)) < 100
    assert sorted(map(tuple, report.collect())) == sorted((str(s), 1, 0, None, "complete") for s in range(40))


@pytest.mark.parametrize("file,sym", [("file:/a/7.csv", "7"), ("/a/x.y.csv", "x.y"), ("/a/sym=5/part-0.c000.txt", "5"), ("/a/sym=/7.csv", "7"),
                                      ("/a/plain", ""), ("/a/.csv", ""), ("/a.b/plain", ""), ("/a/tail.", "tail"), ("/sym=3/b/8.csv", "8")])
def test_symbol_of_a_file(spark, file, sym):
    df = spark.createDataFrame([(file,)], "file string").select(csvfiles._symbol(F.col("file")))
    assert df.first()[0] == sym


def test_lines_longer_than_the_buffer_are_read_whole(spark, tmp_path):
    head, good, long = "d,open,high,low,close,volume", "2024-01-02,1,1,1,1,9", "2024-01-03,1,1,1,1,9," + "x" * 200_000
    (tmp_path / "7.csv").write_text("\n".join([head, good, long, "2024-01-04,2,2,2,2," + " " * 100_000 + "9", good]) + "\n")
    report = csvfiles.csv_report(spark, str(tmp_path)).first()
    assert (report.sym, report.broken, report.first_broken, report.status) == ("7", 4 - report.rows, long, "broken")
