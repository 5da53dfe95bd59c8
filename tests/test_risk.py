"""Labels, walk-forward plans, replay, factor risk and forensics against pandas and numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates, book, crosssec, forensics, fundamentals, labels, modeling, registry, risk, text

N = 130
DAYS = [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in range(N)]
NAMES = list("ABCDEFGH")


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(9)
    frame = pd.DataFrame(np.exp(np.cumsum(rng.normal(0, 0.02, (N, len(NAMES))), axis=0)) * 50, index=DAYS, columns=NAMES)
    frame.loc[DAYS[40], "B"] = np.nan
    frame.loc[DAYS[:30], "C"] = np.nan
    return frame


@pytest.fixture(scope="module")
def panel(spark, prices):
    rows = [(d, t, None if math.isnan(p) else float(p), 10.0) for d in prices.index for t, p in prices.loc[d].items()]
    df = spark.createDataFrame(rows, "date date, ticker string, price double, volume double")
    from panelforge.functions.windows import lag

    return df.withColumn("lr", F.ln(F.try_divide("price", lag("price")))).repartition(2).cache()


def _pandas(df, *index):
    return df.toPandas().set_index(list(index)).sort_index()


def test_triple_barrier(panel, prices):
    got = _pandas(labels.triple_barrier(panel).select("date", "ticker", "label", "ret"), "date", "ticker")
    want = {}
    for t in NAMES:
        px = prices[t].dropna()
        for i, (day, entry) in enumerate(px.items()):
            before = px.iloc[max(0, i - 63) : i]
            vol = 0.02 if len(before) < 20 else max(before.pct_change().dropna().std(), 0.005)
            last = min(i + 10, len(px) - 1)
            label, ret = 0, px.iloc[last] / entry - 1
            for k in range(1, last - i + 1):
                move = px.iloc[i + k] / entry - 1
                if abs(move) >= 2 * vol * math.sqrt(k):
                    label, ret = int(np.sign(move)), move
                    break
            want[day, t] = label, ret
    assert len(got) == len(want)
    for key, (label, ret) in want.items():
        assert got.loc[key, "label"] == label and got.loc[key, "ret"] == pytest.approx(ret, abs=1e-12)


def test_uniqueness(spark):
    days = [DAYS[i] for i in (0, 1, 5, 20, 21, 60, 60, 60, 100)]
    rows = [(d, f"t{i}") for i, d in enumerate(days)]
    got = {r.ticker: r.weight for r in labels.uniqueness(spark.createDataFrame(rows, "date date, ticker string")).collect()}
    dates = pd.Series(pd.to_datetime(days))
    raw = np.array([1 / max(((dates - d).abs() <= pd.Timedelta(days=10)).sum() / dates.nunique(), 0.1) for d in dates])
    want = raw * len(raw) / raw.sum()
    assert [got[f"t{i}"] for i in range(len(days))] == pytest.approx(list(want)) and len(set(want.round(9))) > 2


def test_walk_forward_and_splits(panel):
    got = [tuple(r) for r in modeling.walk_forward(panel, 110, 7, 2, 3, least=90).orderBy("window").collect()]
    want = []
    for i in range(0, N - 110, 7):
        end = i + 110 - 2 - 5 - 3
        pred = end + 2 + 5 + 3
        want.append((len(want) + 1, DAYS[i], DAYS[end - 1], DAYS[end + 2], DAYS[end + 6], DAYS[pred], DAYS[min(pred + 7, N) - 1]))
    assert got == want and got[-1][-1] == DAYS[-1]
    assert modeling.walk_forward(panel, 110, 7, 2, 3, least=101).count() == modeling.walk_forward(panel, 200, 7, 2, 3).count() == 0
    splits = [tuple(r) for r in modeling.cv_splits(panel, 3, 60).orderBy("split").collect()]
    size = max(15, (N - 60) // 4)
    assert splits == [(i, DAYS[60 + i * size - 10 - 60] if 60 + i * size - 70 > 0 else DAYS[0], DAYS[60 + i * size - 11], DAYS[60 + i * size + 12], DAYS[min(60 + (i + 1) * size, N) - 1]) for i in range(3)]


def test_stability_selection(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, d in enumerate(DAYS[:95]):
        for t in range(6):
            y = float(rng.normal())
            rows.append((d, f"t{t}", y, y + float(rng.normal()), float(rng.normal()), y if i < 31 else -y, None if i > 10 else y))
    names = ["good", "noise", "turns", "thin"]
    df = spark.createDataFrame(rows, "date date, ticker string, y double, good double, noise double, turns double, thin double")
    got = {r.feature: r for r in modeling.select_features(modeling.stability_ic(df, "y", names), few=2, instead=1).collect()}
    pdf = df.toPandas()
    dates = sorted(pdf["date"].unique())
    for name in names:
        ics = []
        for p in range(3):
            part = pdf[pdf["date"].isin(dates[p * 31 : (p + 1) * 31 if p < 2 else len(dates)])]
            both = part[part[name].notna()]
            if len(part) >= 100 and len(both) >= 50:
                ics.append(both[name].rank().corr(both["y"].rank()))
        if len(ics) < 2:
            assert name not in got
            continue
        signs = [np.sign(x) for x in ics if x != 0]
        share = sum(s == np.sign(sum(signs)) for s in signs) / len(signs)
        assert got[name].mean_ic == pytest.approx(np.mean(np.abs(ics))) and got[name].agree == pytest.approx(share)
    assert got["good"].selected and got["turns"].agree == pytest.approx(2 / 3)


def test_pooled_ranks_and_buckets(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": rng.integers(-20, 20, 400) / 7.0, "y": rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    got = aggregates.pooled_ranks(df, {"x": "r"}, "g").toPandas().sort_values(["g", "x", "y"])["r"].to_numpy()
    pdf["r"] = pdf.groupby("g")["x"].rank()
    assert np.allclose(got, pdf.sort_values(["g", "x", "y"])["r"])
    by = aggregates.quantile_buckets(df, "x", "y", 4).orderBy("bucket").toPandas()
    want = pdf.groupby(pd.qcut(pdf["x"], 4, duplicates="drop"), observed=True)["y"].agg(["count", "mean", "std", "sum"])
    assert np.allclose(by[["n", "mean", "sd", "total"]].to_numpy(float), want.to_numpy(float))


@pytest.fixture(scope="module")
def weights(spark, prices):
    rng = np.random.default_rng(5)
    rows = [(d, t, float(w), 1 if w > 0 else -1, "x" if t < "D" else "y") for d in DAYS[35:-5:2] for t, w in zip(NAMES, rng.normal(0, 0.1, len(NAMES))) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "date date, ticker string, weight double, side int, sector string").cache()


def test_replay_and_metrics(panel, prices, weights):
    got = _pandas(book.replay(weights, panel), "date")
    wide = weights.toPandas().pivot(index="date", columns="ticker", values="weight")
    own = list(wide.index)
    rows = []
    for before, day in zip(own, own[1:]):
        held, target = wide.loc[before].dropna(), wide.loc[day].dropna()
        r = (prices / prices.shift(1) - 1).loc[day].reindex(held.index)
        ok = r[r.notna()].index
        turnover = (target.reindex(ok).fillna(0) - held[ok]).abs().sum()
        rows.append((day, (held[ok] * r[ok]).sum(), turnover, (held > 0).sum(), held.abs().sum(), (held[ok] * r[ok]).sum() - turnover * 7e-4))
    want = pd.DataFrame(rows, columns=["date", "gross", "turnover", "n_long", "gross_exposure", "net"]).set_index("date")
    assert list(got.index) == list(want.index)
    for c in want:
        assert np.allclose(got[c].astype(float), want[c].astype(float))
    m = book.metrics(book.replay(weights, panel)).first()
    curve = (1 + want["net"]).cumprod()
    assert m.total == pytest.approx(curve.iloc[-1] - 1) and m.max_dd == pytest.approx((curve / curve.cummax() - 1).min()) and m.n == len(want)
    scales = _pandas(book.risk_scales(book.replay(weights, panel)), "date")
    for i, day in enumerate(want.index):
        past = want["net"].iloc[: i + 1]
        recent, long = past.iloc[-5:], past.iloc[-63:]
        tail = 1.0
        if len(past) >= 10:
            if (recent < -0.03).any():
                tail = 0.5
            elif len(long) >= 20 and np.std(recent) / np.std(long) > 2:
                tail = 0.6
            elif (past.iloc[-3:] < 0).all():
                tail = 0.7
        assert scales.loc[day, "tail_scale"] == tail


ROWS, LEAST = 60, 30


def _facts(spark):
    """Facts as known on each date: two tickers change theirs later."""
    rows = []
    for i, day in enumerate(DAYS):
        own = {"market_cap": [10.0, 200.0, None, 50.0, 7.0, 90.0, 0.0, 30.0], "pe": [5.0, -1.0, 8.0, None, 12.0, 4.0, 9.0, 20.0], "roe": [0.1, 0.2, None, 0.05, -0.1, 0.3, 0.15, 0.0]}
        if i >= 90:
            own["market_cap"][3], own["roe"][5] = 500.0, -0.4
        rows += [(day, t, own["market_cap"][k], own["pe"][k], own["roe"][k]) for k, t in enumerate(NAMES)]
    return rows, spark.createDataFrame(rows, "date date, ticker string, market_cap double, pe double, roe double")


def _estimate(prices, rows, day):
    """Exposures, factor returns, covariance and specific variance as of a day, from a slice of prices."""
    end = DAYS.index(day)
    part = prices.iloc[max(0, end - ROWS) : end + 1]
    lr = np.log(part / part.shift(1)).dropna()
    own = {t: (cap, pe, roe) for d, t, cap, pe, roe in rows if d == day}
    mkt, raw = lr.mean(axis=1), pd.DataFrame(0.0, index=NAMES, columns=risk.FACTORS)
    for t in NAMES:
        cap, pe, roe = own[t]
        raw.loc[t] = [lr[t].cov(mkt) / mkt.var(), np.log(cap) if cap and cap > 0 else 0.0, 1 / pe if pe and pe > 0 else 0.0, lr[t].iloc[:-21].sum() if len(lr) > 21 else 0.0, roe or 0.0, lr[t].std() * math.sqrt(252)]
    z = raw.apply(lambda x: (x - x.mean()) / x.std() if x.std() > 0 else x)
    found = pd.DataFrame(lr.to_numpy() @ z.to_numpy() @ np.linalg.pinv(z.T.to_numpy() @ z.to_numpy()).T, index=lr.index, columns=risk.FACTORS)
    if len(found) > 20:
        w = 0.5 ** (np.arange(len(found))[::-1] / 63)
        centred = (found - found.mean()).to_numpy()
        cov = (centred.T * (w / w.sum())) @ centred * 252
    else:
        cov = found.cov().to_numpy() * 252
    return z, found, cov, (lr**2).mean() * 252


def test_factor_risk_as_of_each_date(spark, panel, prices, weights, monkeypatch):
    monkeypatch.setattr(risk, "TASK_ROWS", 300)  # tickers are spread over several tasks
    rows, known = _facts(spark)
    exposed = risk.exposures(panel, known, ROWS, LEAST).cache()
    estimates = risk.factor_estimates(panel, exposed, ROWS).cache()
    specific = risk.specific_variance(panel, ROWS, LEAST)
    z_all, spec_all = _pandas(exposed, "date", "ticker"), _pandas(specific, "date", "ticker")
    returns, cov_all = _pandas(risk.factor_returns(estimates), "date"), risk.factor_covariance(estimates).toPandas()
    assert z_all.index.get_level_values(0).min() == DAYS[LEAST - 1]
    books = _pandas(risk.portfolio_risk(weights, exposed, estimates, specific), "date")
    for day in [DAYS[i] for i in (33, 50, 52, 61, 62, 90, 91, 129)]:
        z, found, cov, spec = _estimate(prices, rows, day)
        assert np.allclose(z_all.loc[day][risk.FACTORS].loc[NAMES], z), day
        got = cov_all[cov_all["date"] == day].pivot(index="a", columns="b", values="cov")
        if len(found) > 1:
            assert np.allclose(got.loc[risk.FACTORS, risk.FACTORS], cov)
        assert np.allclose(spec_all.loc[day]["spec_var"].loc[NAMES], spec)
        assert (day in returns.index) == (len(found) > 0 and found.index[-1] == day)
        if day in returns.index:
            assert np.allclose(returns.loc[day, risk.FACTORS].astype(float), found.loc[day])
        held = weights.where(F.col("date") == F.lit(day)).toPandas().set_index("ticker")["weight"]
        if len(held) and len(found) > 1:
            x = held.to_numpy() @ z.loc[held.index].to_numpy()
            assert books.loc[day, "factor_vol"] == pytest.approx(math.sqrt(max(x @ cov @ x, 0)), abs=1e-7) and books.loc[day, "total_vol"] == pytest.approx(math.sqrt(max(x @ cov @ x, 0) + (held**2 * spec[held.index]).sum()))
    daily = _pandas(risk.attribution(risk.held_returns(weights, panel), exposed), "date")
    held = risk.held_returns(weights, panel).toPandas()
    for day in list(daily.index)[::9]:
        part = held[held["date"] == day].set_index("ticker")
        before = part["before"].iloc[0]
        b = z_all.loc[before][risk.FACTORS].loc[part.index].to_numpy() if before >= DAYS[LEAST - 1] else np.zeros((len(part), 6))
        f = np.linalg.lstsq(b, part["r"].to_numpy(), rcond=None)[0]
        assert np.allclose(daily.loc[day, risk.FACTORS].astype(float), f * (part["w"].to_numpy() @ b), atol=1e-7)
        assert daily.loc[day, "alpha"] == pytest.approx((part["w"] * part["r"]).sum() - (f * (part["w"].to_numpy() @ b)).sum(), abs=1e-7)
        assert daily.loc[day, "gross_exposure"] == pytest.approx(part["w"].abs().sum()) and daily.loc[day, "net_exposure"] == pytest.approx(part["w"].sum())
    one = risk.attribution_summary(risk.attribution(risk.held_returns(weights, panel), exposed)).first()
    assert one.n_days == len(daily) and one.alpha_annual == pytest.approx(daily["alpha"].mean() * 252) and one.best_factor == daily[risk.FACTORS].sum().idxmax()


def test_later_rows_change_no_estimate(spark, panel):
    _, known = _facts(spark)
    cut = F.col("date") <= F.lit(DAYS[80])
    whole = risk.exposures(panel, known, ROWS, LEAST)
    early = risk.exposures(panel.where(cut), known.where(cut), ROWS, LEAST)
    assert np.array_equal(_pandas(whole.where(cut), "date", "ticker"), _pandas(early, "date", "ticker"))
    a, b = (_pandas(risk.factor_covariance(risk.factor_estimates(p, e, ROWS)).where(cut), "date", "a", "b") for p, e in ((panel, whole), (panel.where(cut), early)))
    assert len(a) > 1000 and np.allclose(a, b, atol=1e-12)


def test_counterfactual(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"date": DAYS[:50], "gross_return": rng.normal(0, 0.02, 50), "stress": rng.uniform(10, 40, 50)})
    got = forensics.counterfactual(spark.createDataFrame(pdf), [("s", F.col("stress") > 25, 0.5), ("none", F.col("stress") > 99, 0.0)])
    rows = {r.scenario: r for r in got.collect()}
    hit = pdf["stress"] > 25
    new = pdf["gross_return"].where(~hit, pdf["gross_return"] * 0.5)

    def measure(r):
        cum = (1 + r).cumprod()
        return cum.iloc[-1] - 1, r.mean() / (r.std() + 1e-12) * math.sqrt(252), (cum / cum.cummax() - 1).min()

    base, moved = measure(pdf["gross_return"]), measure(new)
    assert (rows["s"].base_total, rows["s"].base_sharpe, rows["s"].base_mdd) == pytest.approx(base)
    assert (rows["s"].delta_total, rows["s"].delta_sharpe, rows["s"].delta_mdd) == pytest.approx([b - a for a, b in zip(base, moved)])
    assert rows["s"].matched_mean == pytest.approx(pdf["gross_return"][hit].mean()) and rows["none"].matched_mean is None and rows["none"].delta_total == 0


def test_garch_against_a_direct_fit(panel, prices):
    got = {r.ticker: r for r in book.garch(panel).collect()}
    for t in ("A", "C"):
        r = np.log(prices[t] / prices[t].shift(1)).dropna().to_numpy()
        v = r.var()
        best = None
        for a in np.round(np.arange(0.02, 0.181, 0.02), 2):
            for b in np.round(np.arange(0.70, 0.961, 0.02), 2):
                if a + b < 0.999:
                    h, ll = v, 0.0
                    for x in r:
                        ll -= 0.5 * (math.log(h) + x * x / h)
                        h = v * (1 - a - b) + a * x * x + b * h
                    if best is None or ll > best[0]:
                        best = (ll, a, b, math.sqrt(h * 252))
        assert got[t].ll == pytest.approx(best[0]) and (got[t].alpha, got[t].beta, got[t].vol) == pytest.approx(best[1:])


def test_window_trees_stop_on_validation_dates(spark):
    rng = np.random.default_rng(8)
    rows = [(d, f"t{t}", float(x := rng.normal()), float(z := rng.normal()), float(np.sin(2 * x) + x * z + 0.1 * rng.normal()), float(rng.normal())) for d in DAYS[:70] for t in range(10)]
    ml = spark.createDataFrame(rows, "date date, ticker string, a double, b double, y double, noise double")
    windows = modeling.walk_forward(ml, 50, 10, 2, 5, least=20)
    scores, found = modeling.window_trees(ml, windows, spark.createDataFrame([(1, "a")], "window int, feature string"), ["a", "b"], "y", seeds=(1, 2), most=40, step=0.3)
    pdf, weights_ = scores.toPandas(), found.toPandas()
    plan = {w.window: w for w in windows.collect()}
    for part, lo, hi in (("val", "val_start", "val_end"), ("predict", "predict_start", "predict_end")):
        for w in plan:
            days = pdf[(pdf["part"] == part) & (pdf["window"] == w)]["date"]
            assert (days.min(), days.max()) == (plan[w][lo], plan[w][hi]) and len(days) == 10 * ((days.max() - days.min()).days + 1)
    assert {tuple(x) for x in weights_[["window", "seed", "feature"]].to_numpy()} == {(1, s, "a") for s in (1, 2)} | {(2, s, f) for s in (1, 2) for f in "ab"}
    last = pdf[(pdf["part"] == "predict") & (pdf["window"] == 2)]
    assert last["score"].corr(last["target"]) > 0.8 and weights_["rounds"].nunique() > 1 and weights_["rounds"].max() > 5
    by = modeling.window_ic(scores.where("part = 'val'"), "score", "target").toPandas().set_index("window")
    own = pdf[(pdf["part"] == "val") & (pdf["window"] == 1)]
    assert by.loc[1, "pearson"] == pytest.approx(own["score"].corr(own["target"])) and by.loc[1, "spearman"] == pytest.approx(own["score"].rank().corr(own["target"].rank()))
    # Noise is not learnt for long: the validation dates stop it.
    _, idle = modeling.window_trees(ml, windows.where("window = 1"), found.select("window", "feature").where("false"), ["a", "b"], "noise", seeds=(1,), most=40, step=0.3)
    assert max(r.rounds for r in idle.collect()) < 10
    assert modeling.window_trees(ml, windows.where("false"), found.select("window", "feature"), ["a"], "y")[0].count() == 0


def test_registry_plans_two_exchanges_and_drops_sparse_features(spark, panel, prices):
    cfg = registry.Config(momentum=(5, 21, 100), horizon=3)
    own = registry.Registry(dict(registry.STANDARD.features))

    @own.register("double", "date", lambda cfg: ["twice"])
    def _(df, cfg):
        return df.withColumn("twice", 2 * F.col("price"))

    with pytest.raises(ValueError):
        own.register("double", "date", lambda cfg: [])
    with pytest.raises(ValueError):
        own.register("other", "sector", lambda cfg: [])
    rows = spark.createDataFrame([(r.date, r.ticker, r.price, r.volume, r.lr, "xy"[ord(r.ticker) % 2]) for r in panel.collect()], "date date, ticker string, price double, volume double, lr double, sector string")
    table, columns = own.build(rows, cfg)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "twice" in columns and "cs_mom_21" in columns and "cs_twice" not in columns
    got = table.toPandas().set_index(["date", "ticker"])
    lr = np.log(prices / prices.shift(1))
    mom, fwd = lr.rolling(21).sum(), lr.rolling(3).sum().shift(-3)
    for name, want in (("mom_21", mom), ("cs_mom_21", mom.rank(axis=1, pct=True)), ("target", fwd.rank(axis=1, pct=True))):
        assert np.allclose(got[name].unstack("ticker").loc[DAYS[5:], NAMES].astype(float), want.loc[DAYS[5:], NAMES], equal_nan=True), name
    ml, stay = registry.ml_table(table, columns, cfg)
    pdf = ml.toPandas().set_index(["date", "ticker"])
    known = got[got["target"].notna()]
    shares = known[columns].astype(float).isna().mean()
    assert stay == [c for c in columns if shares[c] <= 0.3] and "mom_100" not in stay and len(pdf) == len(known)
    for c in ("mom_21", "vol_21", "twice"):
        x = known[c].astype(float)
        want = x.fillna(x.groupby(level="date").transform("median")).fillna(0.0)
        assert np.allclose(pdf[c].sort_index(), want.sort_index())


def test_pooled_ranks_move_rows_once_a_column(spark, monkeypatch):
    """Ranks inside cells of the value: no join of rows with counted values, whatever nulls, ties and parts there are."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "x": np.round(rng.normal(size=500), 1), "y": np.where(rng.random(500) < 0.6, 2.0, rng.normal(size=500))})
    pdf.loc[pdf["g"] == 2, "x"] = 1.5  # one value
    pdf.loc[rng.random(500) < 0.1, "x"] = np.nan
    rows = [(None if g == 1 else int(g), None if math.isnan(x) else float(x), float(y), i) for i, (g, x, y) in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, "g int, x double, y double, i int")
    for bins in (4096, 3):
        monkeypatch.setattr(aggregates, "BINS", bins)
        for part in (["g"], []):
            made = aggregates.pooled_ranks(df, {"x": "a", "y": "b"}, *part)
            got = made.toPandas().sort_values("i")
            for x, m in (("x", "a"), ("y", "b")):
                want = pdf.groupby("g")[x].rank() if part else pdf[x].rank()
                assert np.allclose(got[m].astype(float), want, equal_nan=True), (bins, part, m)
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("strategy=broadcast") >= plan.count("Join ")


def test_long_momentum_and_missing_shares_without_ranks(spark, panel, prices):
    """Long windows are made of months, so no row goes through 126 others, and shares need no cross-sections."""
    from panelforge.operators import clean, timeseries

    made = timeseries.momentum(panel, 5, 21, 63, 84, 126, 50)
    assert made.columns == [*panel.columns, *[f"mom_{n}" for n in (5, 21, 63, 84, 126, 50)]]
    assert "specifiedwindowframe(RowFrame, -125" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.toPandas().set_index(["date", "ticker"])
    lr = np.log(prices / prices.shift(1))
    for n in (5, 21, 63, 84, 126, 50):
        assert np.allclose(got[f"mom_{n}"].unstack("ticker").loc[DAYS, NAMES].astype(float), lr.rolling(n).sum(), equal_nan=True), n
    cfg = registry.Config(momentum=(5, 21, 84), horizon=3)
    rows = panel.withColumn("sector", F.lit("x"))
    table, columns = registry.STANDARD.build(rows, cfg)
    want = {r.feature: r.missing for r in clean.missing_shares(table, *columns, target="target").collect()}
    shares = registry.STANDARD.missing(rows, cfg)
    assert {r.feature: r.missing for r in shares.collect()} == want
    assert "InArrow" not in shares._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_small_and_large_groups_together(spark, monkeypatch):
    """Small groups take one exchange and no table of bins; a group over the bound is never sorted in one task."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.concatenate([np.arange(300) % 60, np.full(200, 99)]), "x": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(aggregates, "GROUP", 50)
    seen = []
    for name in ("_of_places", "_of_counts"):
        own = getattr(aggregates, name)
        monkeypatch.setattr(aggregates, name, lambda rows, x, shares, *by, own=own, name=name: seen.append((name, {r.g for r in rows.select("g").distinct().collect()})) or own(rows, x, shares, *by))
    got = aggregates.moments(df, "x", "g").toPandas().set_index("g").sort_index()
    assert dict(seen) == {"_of_places": set(range(60)), "_of_counts": {99}}
    for name, q in (("med", 0.5), ("p10", 0.1), ("p90", 0.9)):
        assert np.allclose(got[name], pdf.groupby("g")["x"].quantile(q))
    assert np.allclose(got["sd"], pdf.groupby("g")["x"].std())


def test_quantiles_of_groups_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 900), "x": rng.integers(-9, 9, 900) / 3.0})
    pdf.loc[pdf["g"] == 3, "x"] = pdf["x"].where(pdf.index < 5)  # a group with few values or none
    rows = [(int(g), None if math.isnan(x) else float(x)) for g, x in pdf.itertuples(index=False)]
    for bins in (4096, 3):
        monkeypatch.setattr(aggregates, "BINS", bins)
        df = spark.createDataFrame(rows, "g int, x double")
        got = aggregates.quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 1.0}, "g").toPandas().set_index("g")
        for g, part in pdf.dropna().groupby("g"):
            assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), part["x"].quantile([0.1, 0.5, 1.0]))
        assert aggregates.quantiles(df, "x", {"m": 0.5}).first().m == pytest.approx(pdf["x"].median())
    filled = df.withColumn("m", F.col("x"))
    from panelforge.functions.windows import with_medians

    both = with_medians(filled.drop("m"), {"m": "x"}, "g").select("g", "m").distinct().toPandas().set_index("g")["m"]
    assert np.allclose(both.sort_index().astype(float), pdf.groupby("g")["x"].median(), equal_nan=True)


def test_position_context_is_carried_to_the_close(spark):
    d = DAYS
    book_ = spark.createDataFrame([(d[1], "A", 1), (d[2], "A", 1), (d[3], "A", -1), (d[5], "A", 1), (d[2], "B", -1)], "date date, ticker string, side int")
    prices_ = spark.createDataFrame([(d[i], t, 10.0 + i if t == "A" else 20.0 - i) for i in range(7) for t in "AB"], "date date, ticker string, price double")
    context = prices_.withColumn("score", F.col("price") * 2)
    got = {(r.ticker, r.date, r.kind): r for r in book.position_context(book.position_events(book_, prices_), context, "score").collect()}
    assert len(got) == 8
    flip = got["A", d[3], "close"]
    assert (flip.side, flip.entry_date, flip.entry_price, flip.entry_score, flip.exit_price) == (1, d[1], 11.0, 22.0, 13.0) and flip.pnl == pytest.approx(13 / 11 - 1)
    short = got["A", d[4], "close"]
    assert (short.side, short.entry_date) == (-1, d[3]) and short.pnl == pytest.approx(-(14 / 13 - 1))
    assert got["A", d[3], "open"].pnl is None and got["B", d[3], "close"].pnl == pytest.approx(-(17 / 18 - 1))


def test_post_earnings_estimates_and_news(spark, panel, prices):
    lr = np.log(prices / prices.shift(1))
    days = {"A": [DAYS[10] - dt.timedelta(days=400), DAYS[50], DAYS[90]], "B": [DAYS[40]], "C": [DAYS[12]]}
    events = spark.createDataFrame([(t, d) for t, own in days.items() for d in own] + [("A", None), ("D", DAYS[-1] + dt.timedelta(days=1))], "ticker string, date date")
    got = _pandas(fundamentals.post_earnings(panel, events), "date", "ticker")
    since, ret, first = (pd.DataFrame(np.nan, index=DAYS, columns=NAMES) for _ in range(3))
    first[:] = 0.0
    for t, own in days.items():
        for d in DAYS:
            past = [e for e in own if e <= d]
            if past:
                since.loc[d, t] = (d - max(past)).days
                if max(past) in DAYS:
                    ret.loc[d, t], first.loc[d, t] = prices.loc[d, t] / prices.loc[max(past), t] - 1, lr.loc[max(past), t]
    for name, want in (("days_since", since), ("ret_since", ret), ("earn_day", first)):
        assert np.allclose(got[name].unstack("ticker")[NAMES].astype(float), want, equal_nan=True), name
        assert np.allclose(got[f"cs_{name}"].unstack("ticker")[NAMES].astype(float), want.rank(axis=1, pct=True), equal_nan=True), name
    assert (got["recent"].unstack("ticker")[NAMES] == (since < 5).astype(int)).all().all()
    rows = [("A", 1, 2.0, 3.0, 1.0, 10.0, 4.0), ("A", 2, -1.0, None, -2.0, 0.0, None), ("B", 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("C", 1, 0.0, 1.0, 0.0, 0.0, 2.0), ("C", 2, 0.0, 1.0, 0.5, 5.0, 3.0)]
    made = {r.ticker: r for r in fundamentals.estimates(spark.createDataFrame(rows, "ticker string, k int, eps_avg double, eps_high double, eps_low double, revenue_avg double, analysts double"), "k").collect()}
    assert set(made) == {"A", "C"} and (made["A"].eps_revision, made["A"].revenue_revision, made["A"].dispersion, made["A"].analysts) == (-1.5, -1.0, 2.0, 0.0)
    assert (made["C"].eps_revision, made["C"].revenue_revision, made["C"].dispersion) == (None, None, None)
    news = spark.createDataFrame([("X", 1.0, 1.0, 0.5, "ma"), ("X", -1.0, 0.5, 1.0, None), ("Y", 1.0, 0.0, 1.0, "other")], "symbol string, s double, decay double, m double, kind string")
    by = {r.symbol: r for r in text.news_features(news, "s", "m", "kind").collect()}
    assert (by["X"].sentiment, by["X"].magnitude, by["X"].volume, by["X"].event_ma, by["X"].event_earnings) == (0.0, 0.75, 0.2, 1, 0) and by["Y"].sentiment == 0.0


def test_grades_insiders_and_calendar(spark):
    texts = ["Buy", "outperform", " Market Outperform ", "in-line", "Reduce", "StrongSell", "top pick", "perform", "what"]
    rows = [("t", t, None) for t in texts]
    got = [r.score for r in fundamentals.grade_scores(spark.createDataFrame(rows, "ticker string, grade string, previous string").coalesce(1)).collect()]
    assert got == [5, 5, 4, 3, 2, 1, 5, 3, None]
    raw = spark.createDataFrame([("t", DAYS[0], "A", 2.0, 3, "Common Stock", "r", "CEO"), ("t", DAYS[0], "D", 2.0, 3, "", "r", ""), ("t", DAYS[0], "M", 2.0, 3, "", "r", ""), ("t", DAYS[0], "A", 0.0, 3, "", "r", ""), ("t", DAYS[0], "A", 1.0, 3, "Preferred", "r", "")], "ticker string, date date, code string, price double, shares int, security string, reporter string, owner string")
    assert sorted((r.is_buy, r.usd, r.is_exec) for r in fundamentals.insider_clean(raw).collect()) == [(False, 6.0, False), (True, 6.0, True)]
    calendar = spark.createDataFrame([(d,) for d in DAYS[:5]], "date date")
    series = spark.createDataFrame([(DAYS[1], 1.0, None), (DAYS[3], None, 7.0)], "date date, a double, b double")
    assert [tuple(r)[1:] for r in crosssec.on_calendar(calendar, series, "a", "b").orderBy("date").collect()] == [(None, None), (1.0, None), (1.0, None), (1.0, 7.0), (1.0, 7.0)]
    assert [tuple(r)[1:] for r in crosssec.on_calendar(calendar, series, "a", "b", back=True).orderBy("date").collect()] == [(1.0, 7.0)] * 5


def test_metrics_of_a_run_that_lost_more_than_all(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, 1 + i), x, "a") for i, x in enumerate([0.1, -3.0, 0.2, 0.1, 0.1])], "date date, net double, run string")
    m = book.metrics(daily).first()
    assert m.total < -1 and all(np.isnan(m[c]) for c in ("annual", "sharpe", "calmar"))


def test_no_estimates_without_a_full_cross_section(spark):
    """C starts on the seventh date: before that no date has a return of every ticker, so nothing is known."""
    days = [dt.date(2024, 1, 1 + i) for i in range(12)]
    rows = [(d, t, None if t == "C" and i < 6 else 0.01 * (i + 1) * k) for i, d in enumerate(days) for k, t in enumerate("ABC", 1)]
    df = spark.createDataFrame(rows, "date date, ticker string, lr double")
    known = df.select("date", "ticker", F.lit(1.0).alias("market_cap"), F.lit(1.0).alias("pe"), F.lit(1.0).alias("roe"))
    for made in (risk.exposures(df, known, rows=4, least=3, skip=1, full=1), risk.specific_variance(df, rows=4, least=3, full=1)):
        assert sorted({r.date for r in made.select("date").collect()}) == days[6:]


def test_window_trees_fit_small_windows_in_one_task(spark):
    rng = np.random.default_rng(9)
    rows = [(d, f"t{t}", float(x := rng.normal()), float(np.sin(2 * x))) for d in DAYS[:70] for t in range(10)]
    ml = spark.createDataFrame(rows, "date date, ticker string, a double, y double").repartition(8)
    windows = modeling.walk_forward(ml, 50, 30, 2, 5, least=20)
    none = spark.createDataFrame([], "window int, feature string")
    status = spark.sparkContext.statusTracker()

    def widest(**kw):
        """Most tasks of the tree levels' stages (all but reading and writing the table)."""
        seen = set(status.getJobIdsForGroup(None))
        modeling.window_trees(ml, windows, none, ["a"], "y", seeds=(1,), most=5, step=0.3, **kw)
        stages = [status.getStageInfo(i) for j in set(status.getJobIdsForGroup(None)) - seen for i in status.getJobInfo(j).stageIds]
        return max(x.numTasks for x in stages if x and x.name.startswith("collectAsMap"))

    assert widest() == 1
    assert 1 < widest(task_rows=100) <= 7


def test_tree_table_equals_the_whole_modelling_table():
    from pyspark.sql import SparkSession

    from panelforge.plans import risk as plans

    spark = SparkSession.getActiveSession()
    sf_dir = "/root/testdata/sf0.001"
    columns = ["date", "ticker", "target", *plans.TREE_FEATURES]
    own = plans._tree_table(spark, sf_dir).select(columns).toPandas().sort_values(["date", "ticker"]).reset_index(drop=True)
    whole = plans._ml_all(spark, sf_dir)[0].select(columns).toPandas().sort_values(["date", "ticker"]).reset_index(drop=True)
    assert len(own) > 0 and own.equals(whole)


def test_window_trees_are_the_same_in_one_task_and_in_many(spark):
    rng = np.random.default_rng(10)
    rows = [(d, f"t{t}", float(x := rng.normal()), float(z := rng.normal()), float(np.sin(2 * x) + x * z + 0.1 * rng.normal()), float(rng.integers(1, 4))) for d in DAYS[:70] for t in range(10)]
    ml = spark.createDataFrame(rows, "date date, ticker string, a double, b double, y double, w double").repartition(3, "ticker")
    windows = modeling.walk_forward(ml, 50, 10, 2, 5, least=20)
    none = spark.createDataFrame([], "window int, feature string")
    kept = modeling.written(ml, "ml")

    def run(**kw):
        scores, found = modeling.window_trees(kept, windows, none, ["a", "b"], "y", seeds=(1, 2), most=13, step=0.3, weight="w", **kw)
        return scores.toPandas().sort_values(["window", "part", "date", "ticker"]).reset_index(drop=True), found.toPandas().sort_values(["window", "seed", "feature"]).reset_index(drop=True)

    (scores, found), (many, more) = run(), run(task_rows=120)
    assert len(scores) and found["rounds"].max() > 10 and found.equals(more) and scores.equals(many)
    assert found.groupby(["window", "seed"])["importance"].sum().round(9).eq(1).all()


def test_trees_find_a_step_and_stop():
    from panelforge.functions import trees

    rng = np.random.default_rng(11)
    x = rng.normal(size=(2, 4000))
    splits = [trees.thresholds([trees.sketch(c[:1000]), trees.sketch(c[1000:])], [1000, 3000]) for c in x]
    assert all(len(s) == 31 and abs((c <= s[15]).mean() - 0.5) < 0.02 for c, s in zip(x, splits))
    y = np.where(x[0] > splits[0][9], 3.0, -1.0)
    codes = np.stack([trees.coded(c, s) for c, s in zip(x, splits)])
    block = trees.Block(codes, y, np.ones(4000), np.arange(4000) % 5 == 0, rng.integers(0, 2**32, 4000, dtype=np.uint32))
    made, gains = trees.fitted_block(block, 1, 2, trees.units(3.0, 1.0), 0.7, most=20, step=0.1, depth=1, columns=1.0)
    assert made[0].feature[0] == 0 and made[0].bin[0] == 9 and np.allclose(made[0].leaf, [-1, 3]) and np.allclose(trees.predicted(codes, made), y) and gains[1] == 0


def test_rank_correlations_of_small_and_large_parts(spark, monkeypatch):
    """Parts over the bound go through cells of x and y, in several jobs; ties, a value that fills cells, and nulls included."""
    rng = np.random.default_rng(12)
    n = 3000
    pdf = pd.DataFrame({"p": rng.choice([0, 1, 1, 1, 1, 1], n), "y": rng.integers(-50, 50, n) / 7.0, "a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.6, 2.0, rng.integers(0, 9, n)), "c": 1.0})
    pdf["a"] += pdf["y"] / 9
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "p int, y double, a double, b double, c double").repartition(5)
    monkeypatch.setattr(aggregates, "PAIRS", 3500)
    for bound in (100_000, 600, 150):
        monkeypatch.setattr(aggregates, "GROUP", bound)
        got = {(p, f): (k, ic) for p, f, k, ic in aggregates.rank_correlations(df, "p", "y", ["a", "b", "c"])}
        for p in (0, 1):
            for i, f in enumerate("abc"):
                own = pdf[(pdf["p"] == p) & pdf[f].notna()]
                k, ic = got[p, i]
                assert k == len(own) and (ic is None if f == "c" else ic == pytest.approx(own[f].rank().corr(own["y"].rank()), abs=1e-12))


def test_registry_moves_blocks_where_no_feature_needs_a_table(spark, panel):
    """Blocks give what rows give, ranks and filled columns included; the modelling table is not written on its way."""
    cfg = registry.Config(momentum=(5, 21, 100), horizon=3)
    rows = panel.withColumn("sector", F.when(F.col("ticker") < "D", "x").when(F.col("ticker") < "H", "y")).withColumn("volume", F.when(F.col("ticker") != "B", F.col("volume")))
    slow = registry.Registry(dict(registry.STANDARD.features))
    slow.register("other", "date", lambda cfg: [])(lambda df, cfg: df)
    tables = [r.build(rows, cfg) for r in (registry.STANDARD, slow)]
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for t, _ in tables]
    assert "block" in plans[0] and "block" not in plans[1] and tables[0][1] == tables[1][1]
    assert tables[0][0].columns == tables[1][0].columns and tables[0][0].dtypes == tables[1][0].dtypes
    frames = [t.toPandas().sort_values(["date", "ticker"]).reset_index(drop=True) for t, _ in tables]
    for c in tables[0][1] + ["fwd", "target"]:
        assert np.allclose(*[f[c].astype(float) for f in frames], equal_nan=True, atol=1e-12), c
    (own, stay), (want, kept) = registry.STANDARD.modelling(rows, cfg), registry.ml_table(*tables[1], cfg)
    assert stay == kept and "mom_100" not in stay and "cs_mom_21" in stay and "Scan parquet" not in own._jdf.queryExecution().executedPlan().toString()
    frames = [t.select("date", "ticker", "target", *stay).toPandas().sort_values(["date", "ticker"]).reset_index(drop=True) for t in (own, want)]
    assert len(frames[0]) == len(frames[1]) > 0
    for c in ["target", *stay]:
        assert np.allclose(*[f[c].astype(float) for f in frames], atol=1e-12), c


def test_blocks_give_rows_back(spark):
    from panelforge.functions import blocks

    rng = np.random.default_rng(13)
    values = [None, float("nan"), float("inf"), -1e300, 1e-300, 0.1, 2.0**60, 123456789.1234567]
    rows = [(int(rng.integers(0, 3)), i, None if i % 7 == 0 else "st"[i % 2], round(float(rng.normal()), 7), values[i % len(values)], None if i % 5 else 12.5, bool(i % 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i long, s string, a double, b double, c double, t boolean").repartition(3)
    got = sorted(tuple(r) for r in blocks.over_blocks(df, "k", df.schema, lambda table: table).collect())
    assert str(got) == str(sorted(rows))
    plan = blocks.over_blocks(df, "k", df.schema, lambda table: table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    sizes = [len(r.block) for r in blocks.packed(spark.createDataFrame([(1, round(float(x), 7)) for x in rng.normal(size=20000)], "k int, x double").coalesce(1), "k").collect()]
    assert sum(sizes) < 20000 * 4.5
