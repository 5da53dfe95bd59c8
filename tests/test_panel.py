"""Panel operators against pandas and against their properties, on small frames with gaps and ties."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import scans
from panelforge.functions import windows as W
from panelforge.operators import asof, book, clean, crosssec, fundamentals, labels, timeseries
from panelforge.sources import panels, tables

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * i) for i in range(60)]


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(np.exp(np.cumsum(rng.normal(0, 0.02, (60, 4)), axis=0)) * 100, index=DAYS, columns=list("ABCD"))
    frame.loc[DAYS[10:13], "B"] = np.nan  # a gap of 3 and a gap of 4
    frame.loc[DAYS[20:24], "C"] = np.nan
    frame.loc[DAYS[30], ["A", "D"]] = 50.0  # a tie
    return frame


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(d, t, float(p), 100.0) for d in wide.index for t, p in wide.loc[d].items() if not math.isnan(p)]
    dense = panels.fill(panels.grid(spark.createDataFrame(rows, "date date, ticker string, price double, volume double")), "price", "volume")
    return dense.withColumn("lr", F.ln(F.try_divide("price", F.lag("price").over(W.by_key())))).cache()


def _wide(df, column):
    got = df.select("date", "ticker", column).toPandas().pivot(index="date", columns="ticker", values=column).astype(float)
    return got.sort_index()


def _same(got, want):
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-8, atol=1e-11, equal_nan=True)


def test_fill_limit_and_momentum(panel, wide):
    filled = wide.ffill(limit=3)
    _same(_wide(panel, "price"), filled)
    lr = np.log(filled / filled.shift(1))
    _same(_wide(timeseries.momentum(panel, 5), "mom_5"), lr.rolling(5).sum())
    _same(_wide(timeseries.volatility(panel, 21), "vol_21"), lr.rolling(21).std() * math.sqrt(252))
    _same(_wide(timeseries.shape(panel, 21), "skew_21"), lr.rolling(21).skew())
    _same(_wide(timeseries.shape(panel, 21), "kurt_21"), lr.rolling(21).kurt())


def test_exponential_means(panel, wide):
    filled = wide.ffill(limit=3)
    lr = np.log(filled / filled.shift(1))
    _same(_wide(scans.with_ewm(panel, "e", "lr", W.halflife(10)), "e"), lr.ewm(halflife=10).mean())
    _same(_wide(scans.with_ewm(panel, "e", "price", 0.1, adjust=False), "e"), filled.ewm(alpha=0.1, adjust=False).mean())


def test_exponential_means_over_many_blocks_and_long_gaps(spark, monkeypatch):
    rng = np.random.default_rng(6)
    series = pd.DataFrame({"a": rng.normal(size=3000), "b": np.where(rng.random(3000) < 0.7, np.nan, rng.normal(5, 1, 3000)), "c": np.nan})
    series.loc[100:2500, "a"] = np.nan  # older weights are under any double's range beside the next value
    rows = [(i, t, None if math.isnan(v) else float(v)) for t in series for i, v in enumerate(series[t])]
    df = spark.createDataFrame(rows, "date int, ticker string, x double")
    for reach in (300.0, 45.0):
        monkeypatch.setattr(scans, "REACH", reach)
        for alpha, adjust in ((0.02, True), (0.6, True), (0.02, False), (0.6, False)):
            _same(_wide(scans.with_ewm(df, "e", "x", alpha, adjust), "e"), series.ewm(alpha=alpha, adjust=adjust).mean())


def test_sliding_shares(spark):
    rng = np.random.default_rng(8)
    series = pd.DataFrame({"a": rng.integers(0, 9, 400) / 3, "b": rng.normal(size=400), "c": np.nan})
    series.loc[rng.random(400) < 0.2, "b"] = np.nan
    series.loc[3, "b"] = np.inf
    rows = [(i, t, None if math.isnan(v) else float(v), "x") for t in series for i, v in enumerate(series[t])]
    df = spark.createDataFrame(rows, "date int, ticker string, x double, other string").repartition(3)
    for n, least, above in ((50, 20, False), (7, 7, True), (1000, 1, False)):
        got = _wide(scans.with_shares(df, {"s": "x"}, n, least, above), "s")
        for t in series:
            for i in range(400):
                part, v = series[t].iloc[max(0, i - n + 1) : i + 1].dropna(), series[t].iloc[i]
                want = np.nan if math.isnan(v) or len(part) < least else ((part >= v) if above else (part <= v)).mean()
                assert (math.isnan(want) and math.isnan(got[t].iloc[i])) or got[t].iloc[i] == pytest.approx(want)
    assert scans.with_shares(df.where("false"), {"s": "x"}, 5, 1).count() == 0


def test_ranks(panel, wide):
    filled = wide.ffill(limit=3)
    _same(_wide(panel.withColumn("r", W.rank_pct("price")), "r"), filled.rank(axis=1, pct=True))
    _same(_wide(crosssec.ranks(panel, "price"), "cs_price"), filled.rank(axis=1, pct=True))


def test_forward_return(panel, wide):
    filled = wide.ffill(limit=3)
    lr = np.log(filled / filled.shift(1))
    _same(_wide(labels.forward_return(panel, 5), "fwd"), lr.shift(-5).rolling(5).sum())


def test_no_look_ahead(panel):
    cut = DAYS[40]
    for op in (lambda p: timeseries.momentum(p, 21).select("date", "ticker", F.col("mom_21").alias("x")), lambda p: timeseries.market_beta(p, 21).select("date", "ticker", F.col("beta_21").alias("x")), lambda p: crosssec.ranks(p, "price").select("date", "ticker", F.col("cs_price").alias("x"))):
        full = op(panel).where(F.col("date") <= F.lit(cut))
        part = op(panel.where(F.col("date") <= F.lit(cut)))
        assert sorted(map(str, full.collect())) == sorted(map(str, part.collect()))


def test_as_of_ties_and_gaps(spark):
    day = lambda n: dt.date(2024, 1, n)
    grid = spark.createDataFrame([(t, day(n)) for t in "AB" for n in range(1, 8)], "ticker string, date date")
    facts = spark.createDataFrame([("A", day(3), 1, 10.0), ("A", day(3), 2, 20.0), ("A", day(6), 3, None), ("B", day(9), 1, 5.0)], "ticker string, filed date, period int, x double")
    got = {(r.ticker, r.date.day): r.x for r in asof.as_of(grid, facts, "filed", "x", tie="period").collect()}
    assert got == {("A", 1): None, ("A", 2): None, ("A", 3): 20.0, ("A", 4): 20.0, ("A", 5): 20.0, ("A", 6): None, ("A", 7): None} | {("B", n): None for n in range(1, 8)}


def test_membership(spark):
    d = dt.date
    changes = spark.createDataFrame([(d(2024, 2, 10), "X", None), (d(2024, 3, 10), None, "Y"), (d(2024, 4, 10), "Y", None)], "date date, added string, removed string")
    current = spark.createDataFrame([("X",), ("Y",), ("Z",)], "ticker string")
    months = spark.createDataFrame([(d(2024, m, 1),) for m in (1, 2, 3, 4, 5)], "month date")
    got = {(r.month.month, r.ticker) for r in asof.membership(current, changes, months).collect()}
    assert got == {(m, "Z") for m in range(1, 6)} | {(m, "X") for m in (3, 4, 5)} | {(m, "Y") for m in (1, 2, 3, 5)}


def test_member_intervals_and_gate(spark):
    d = dt.date
    rows = [(d(2024, 2, 10), "X", None), (d(2024, 3, 10), None, "Y"), (d(2024, 4, 10), "Y", None), (d(2024, 4, 10), None, "W"), (d(2024, 5, 2), "W", "W")]
    changes = spark.createDataFrame(rows, "date date, added string, removed string")
    current = spark.createDataFrame([("X",), ("Y",), ("Z",), ("W",)], "ticker string")

    def member(ticker, day):  # walk back over the changes
        later = sorted((c, added != ticker) for c, added, removed in rows if ticker in (added, removed) and c >= day)
        return later[0][1] if later else True

    days = [d(2024, 1, 1) + dt.timedelta(days=i) for i in range(0, 150)]
    grid = spark.createDataFrame([(day, t, float(i % 7)) for i, day in enumerate(days) for t in "XYZWQ"], "date date, ticker string, price double")
    want = {(day, t) for day in days for t in "XYZW" if member(t, day)}
    assert {(r.date, r.ticker) for r in asof.members_at(grid, current, changes).collect()} == want
    spans = [tuple(r) for r in asof.member_intervals(current, changes).collect()]
    assert {(day, t) for t, a, b in spans for day in days if (a is None or day >= a) and (b is None or day < b)} == want and len(spans) == len(set(spans))
    snapshots = spark.createDataFrame([(d(2024, 2, 1), "X"), (d(2024, 2, 1), "Q"), (d(2024, 4, 1), "Z"), (d(2024, 4, 1), "Z")], "date date, ticker string")
    got = {(r.date, r.ticker) for r in clean.tradable(grid, 3.0, snapshots).collect()}
    gate = lambda day, t: day < d(2024, 2, 1) or t in ("XQ" if day < d(2024, 4, 1) else "Z")
    assert got == {(day, t) for i, day in enumerate(days) for t in "XYZWQ" if i % 7 >= 3 and gate(day, t)}
    assert clean.tradable(grid, 0, snapshots.where("false")).count() == grid.count()


def test_weights_respect_gross(panel):
    scored = timeseries.volatility(timeseries.momentum(panel, 5), 5)
    made = book.weights(book.select_book(scored, "mom_5", 1, 1), "vol_5")
    for r in made.groupBy("date", "side").agg(F.sum("weight").alias("w")).collect():
        assert abs(r.w) < 1e-12 or math.isclose(r.w, 0.45 if r.side == 1 else -0.25, rel_tol=1e-9)


def test_clean_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.5,), (None,)], "x double")
    assert [r.x for r in clean.finite(df, "x").collect()] == [None, None, None, 1.5, None]


def test_sources(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("date,A,B\n2024-01-01,1.5,\n2024-01-02,x,2\n")
    got = {(str(r.date), r.ticker): r.value for r in tables.read_wide_csv(spark, f"{tmp_path}/wide.csv").collect()}
    assert got == {("2024-01-01", "A"): 1.5, ("2024-01-01", "B"): None, ("2024-01-02", "A"): None, ("2024-01-02", "B"): 2.0}
    (tmp_path / "keyed.json").write_text('{"_meta": {"v": 1}, "A": [{"date": "2024-01-01", "x": 1.0}], "B": []}')
    assert [tuple(r) for r in tables.read_keyed_json(spark, f"{tmp_path}/keyed.json", "struct<date:string,x:double>").collect()] == [("A", "2024-01-01", 1.0)]
    (tmp_path / "day1.json").write_text('{"date": "2024-01-01", "predictions": {"A": 0.5}}')
    (tmp_path / "day2.json").write_text("{broken")
    assert [(str(r.date), r.ticker, r.score) for r in tables.read_predictions(spark, f"{tmp_path}/day*.json").collect()] == [("2024-01-01", "A", 0.5)]
    tables.write_json_lines(spark.createDataFrame([(float("nan"), "2024-01-05")], "x double, day string"), f"{tmp_path}/lines")
    assert [tuple(r) for r in tables.read_json_lines(spark, f"{tmp_path}/lines", "x double, day string", "day").collect()] == [(None, dt.date(2024, 1, 5))]


def test_writers_are_read_back(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(day, "A", 1.5), (day, "B", None), (day + dt.timedelta(days=1), "B", 2.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, value double")
    tables.write_wide_csv(df, f"{tmp_path}/wide", "value")
    assert {tuple(r) for r in tables.read_wide_csv(spark, f"{tmp_path}/wide").collect()} == {*rows, (day + dt.timedelta(days=1), "A", None)}
    tables.write_keyed_json(df, f"{tmp_path}/keyed", "date", "value")
    got = tables.read_keyed_json(spark, f"{tmp_path}/keyed", "struct<date:date,value:double>", lines=True)
    assert {(r.date, r.ticker, r.value) for r in got.collect()} == set(rows)
    tables.write_predictions(df.withColumnRenamed("value", "score"), f"{tmp_path}/scores")
    assert {(r.date, r.ticker, r.score) for r in tables.read_predictions(spark, f"{tmp_path}/scores").collect()} == set(rows)
    named = spark.createDataFrame([("^GSPC",), ("SPY",), ("other",)], "name string")
    there = tables.remap(named, "name", tables.SERIES, "fund")
    assert sorted(r.fund for r in there.collect()) == ["SPY", "SPY", "other"] and len(tables.SERIES) == 24
    back = tables.remap_back(there.select("fund").distinct(), "fund", tables.SERIES, "original")
    assert sorted(r.original for r in back.collect()) == ["SPY", "^GSPC"]
    vendor = spark.createDataFrame([(1, None, "2.5", "x")], "id int, enterpriseValueMultiple string, evToEBITDA string, marketCap string")
    assert tables.canonical_fields(vendor, tables.RATIOS, tables.KEY_METRICS).first().asDict() == {"id": 1, "enterpriseToEbitda": 2.5, "marketCap": None}


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "date date, ticker string, price double, volume double, lr double")
    assert crosssec.ranks(timeseries.momentum(empty, 5), "mom_5").count() == 0


def test_garch_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    sets = {"short": rng.normal(0, 0.02, 30), "flat": np.zeros(60), "none": np.array([])}
    for name, a, b in (("slow", 0.06, 0.92), ("fast", 0.18, 0.72)):
        h, out = 4e-4, []
        for _ in range(300):
            out.append(rng.normal() * math.sqrt(h))
            h = 4e-4 * (1 - a - b) + a * out[-1] ** 2 + b * h
        sets[name] = np.array(out)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(300)]
    rows = [(d, t, float(x)) for t, xs in sets.items() for d, x in zip(days, xs)] + [(days[0], "none", None)]
    got = {r.ticker: r for r in book.garch(spark.createDataFrame(rows, "date date, ticker string, lr double")).collect()}
    assert set(got) == set(sets)
    for name in ("slow", "fast"):
        x, best = sets[name], None
        v = np.var(x)
        for a in np.arange(1, 10) * 0.02:
            for b in 0.7 + np.arange(14) * 0.02:
                if a + b < 0.999:
                    h, ll = v, 0.0
                    for r in x:
                        ll -= 0.5 * (math.log(h) + r * r / h)
                        h = v * (1 - a - b) + a * r * r + b * h
                    best = max(best or (ll, a, b, h), (ll, a, b, h))
        ll, a, b, h = best
        assert np.allclose([got[name].alpha, got[name].beta, got[name].ll, got[name].vol], [a, b, ll, math.sqrt(h * 252)], rtol=1e-9)
        ahead = [h]
        for _ in range(9):
            ahead.append(v * (1 - a - b) + (a + b) * ahead[-1])
        assert np.allclose(got[name].forecast, np.sqrt(np.array(ahead) * 252))
    short = np.std(sets["short"][-21:]) * math.sqrt(252)
    assert got["short"].alpha is None and np.allclose(got["short"].forecast, short) and np.isclose(got["short"].vol, short)
    assert got["flat"].vol == 0 and got["none"].vol is None


def test_garch_goes_along_all_series_at_once(spark, monkeypatch):
    """Series of many lengths in blocks; a step of one series and one pair at a time would not fit the limits."""
    calls = []
    monkeypatch.setattr(book.np, "log", lambda x, log=np.log: calls.append(x.shape) or log(x))
    rng = np.random.default_rng(1)
    alphas, betas = np.array([0.02, 0.1]), np.array([0.9, 0.8])
    sets = [rng.normal(0, 0.02, n) for n in (7, 90, 1, 90, 33)]
    place, found = book.garch_fit(sets, np.array([x.var() + 1e-6 for x in sets]), alphas, betas)
    assert len(calls) == 90 and calls[0] == (5, 2) and calls[-1] == (2, 2)
    for x, p, (h, ll) in zip(sets, place, found):
        v, each = x.var() + 1e-6, []
        for a, b in zip(alphas, betas):
            each.append([0.0, v])
            for r in x:
                each[-1] = [each[-1][0] - 0.5 * (math.log(each[-1][1]) + r * r / each[-1][1]), v * (1 - a - b) + a * r * r + b * each[-1][1]]
        assert round(each[p][0], 9) == max(round(e[0], 9) for e in each) and np.allclose([ll, h], each[p])
    even = book.garch_fit([np.zeros(3)], np.array([1.0]), np.array([0.1, 0.1]), np.array([0.9, 0.9]))[0]
    assert even[0] == 1  # of equal ones the last


def test_day_queries_write_the_panel_once(spark, monkeypatch):
    from panelforge.plans import books, risk

    made, plain = [], books.written
    monkeypatch.setattr(books, "written", lambda df, tag: made.append(tag) or plain(df, tag))
    for run in (risk._days, books._daily, books._in_context, books._with_bench):
        made.clear()
        run(spark, "/root/testdata/sf0.001")
        assert sorted(made) == ["book", "panel"]


def test_wide_csv_of_more_columns_than_a_table_has(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    tickers = [f"T{i}" for i in range(21000)] + ['a,"b"']
    rows = [(day, t, float(i)) for i, t in enumerate(tickers)] + [(day + dt.timedelta(days=1), "T5", 2.5)]
    tables.write_wide_csv(spark.createDataFrame(rows, "date date, ticker string, value double"), f"{tmp_path}/wide", "value")
    got = {(r.date, r.ticker): r.value for r in tables.read_wide_csv(spark, f"{tmp_path}/wide").collect()}
    assert len(got) == 2 * len(tickers) and {k: v for k, v in got.items() if v is not None} == {(d, t): v for d, t, v in rows}


def _sorts(df):
    return df._jdf.queryExecution().executedPlan().toString().count(" Sort [")


def test_means_and_ranks_sort_no_more_for_more_columns(spark, panel):
    """Each sort of a task holds its rows, so their number bounds a task's memory."""
    made = scans.with_ewms(panel, {"a": (F.col("price"), 0.2), "b": (F.col("lr"), 0.07)}, {"c": (F.col("a") - F.col("b"), 0.1)})
    plain = panel
    for name, x, alpha in (("a", "price", 0.2), ("b", "lr", 0.07)):
        plain = scans.with_ewm(plain, name, x, alpha)
    plain = scans.with_ewm(plain.withColumn("m", F.col("a") - F.col("b")), "c", "m", 0.1)
    for c in "abc":
        _same(_wide(made, c), _wide(plain, c))
    # The same with blocks of about 20 rows, whose slowest weight fades over a block.
    fast = {"a": (F.col("price"), 1 - math.exp(-15.0)), "b": (F.col("lr"), 1 - math.exp(-2.2))}
    short = scans.with_ewms(panel, fast)
    for name, (_, alpha) in fast.items():
        _same(_wide(short, name), _wide(scans.with_ewm(panel, name, {"a": "price", "b": "lr"}[name], alpha), name))
    with pytest.raises(ValueError, match="too far apart"):
        scans.with_ewms(panel, {"a": (F.col("price"), 0.9), "b": (F.col("price"), 0.001)})
    assert _sorts(timeseries.macd(panel)) <= _sorts(panel) + 2 and _sorts(timeseries.decay_momentum(panel, 10, 21)) <= _sorts(panel) + 2
    pairs = [("price", "volume"), ("-lr", "price"), ("lr", "-volume")]
    crossed = crosssec.interactions(panel, *pairs)
    assert _sorts(crossed) <= _sorts(panel) + 2 and _sorts(crosssec.ranks(panel, "price", "lr", "volume")) <= _sorts(panel) + 1
    ranked = panel.withColumns({"p": W.rank_pct("price"), "v": W.rank_pct("volume"), "l": W.rank_pct("lr")})
    _same(_wide(crossed.select("date", "ticker", "x1"), "x1"), _wide(ranked.withColumn("x1", (1 - F.col("l")) * F.col("p")), "x1"))
    _same(_wide(crossed, "xr2"), _wide(ranked.withColumn("x", F.col("l") * (1 - F.col("v"))).withColumn("xr2", W.rank_pct("x")), "xr2"))
    assert _sorts(fundamentals.quality_ranks(panel, ["price", "lr"], ["volume"])) <= _sorts(panel) + 1
