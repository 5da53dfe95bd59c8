"""Queries for cleaning (C), cross-sections (X) and targets (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import asof as J
from panelforge.operators import clean as C
from panelforge.operators import crosssec as X
from panelforge.operators import labels as L
from panelforge.operators import timeseries as T
from panelforge.plans.base import FACTS, MACRO, PANEL, SECTORS, add, gated, lagged, sql_rank
from panelforge.sources import panels as P
from panelforge.sources.panels import facts, macro, panel, sectors, table, with_sector

K = "date ticker"
E = "1e-8"
M21 = f"m AS (SELECT *, {gated('sum(lr)', 'lr', 21)} AS mom_21, {gated('stddev_samp(lr)', 'lr', 21)} * sqrt(252) AS vol_21 FROM panel)"
PS = f"{PANEL}, {SECTORS}, ps AS (SELECT p.*, coalesce(s.sector, 'Unknown') AS sector FROM panel p LEFT JOIN sectors s ON s.ticker = p.ticker)"


def _mv(s, d):
    return T.volatility(T.momentum(panel(s, d), 21), 21)


def _ps(s, d):
    return with_sector(panel(s, d), sectors(s, d))


add("c01_finite", K, "x", lambda s, d: C.finite(panel(s, d).withColumn("x", F.when(F.col("volume") > 100, F.lit(float("inf"))).when(F.col("volume") > 50, F.lit(float("nan"))).otherwise(F.col("price"))), "x"),
    f"WITH {PANEL} SELECT date, ticker, CASE WHEN volume > 100 THEN NULL WHEN volume > 50 THEN NULL ELSE price END AS x FROM panel")
add("c02_fill", K, "price volume", lambda s, d: P.fill(P.grid(P.prices(s, d)), "price", "volume"), f"WITH {PANEL} SELECT date, ticker, price, volume FROM f")
add("c03_grid", K, "price", lambda s, d: P.grid(P.prices(s, d)), f"WITH {PANEL} SELECT date, ticker, p0 AS price FROM g")
add("c05_liquid_tickers", "ticker n", "gap adv", lambda s, d: C.liquid_tickers(panel(s, d), 252, 0.1, 30000.0),
    f"WITH {PANEL} SELECT ticker, count(price) AS n, 1 - count(price) / count(*) AS gap, avg(price * volume) AS adv FROM panel GROUP BY ticker HAVING count(price) >= 252 AND 1 - count(price) / count(*) <= 0.1 AND count(price * volume) >= 252 AND avg(price * volume) >= 30000")
add("c06_c09_missing", "feature", "missing", lambda s, d: C.missing_shares(_mv(s, d), "mom_21", "vol_21", "price", target="lr"),
    f"WITH {PANEL}, {M21}, k AS (SELECT * FROM m WHERE lr IS NOT NULL) SELECT unnest(['mom_21', 'vol_21', 'price']) AS feature, unnest([avg((mom_21 IS NULL)::INT), avg((vol_21 IS NULL)::INT), avg((price IS NULL)::INT)]) AS missing FROM k")
add("c07_fill_median", K, "mom_21", lambda s, d: C.fill_median(T.momentum(panel(s, d), 21), "mom_21"), f"WITH {PANEL}, {M21} SELECT date, ticker, coalesce(mom_21, median(mom_21) OVER (PARTITION BY date), 0) AS mom_21 FROM m")
add("c08_with_target", K, "fwd", lambda s, d: L.forward_return(panel(s, d), 5).where("fwd is not null"),
    f"WITH {PANEL}, t AS (SELECT *, CASE WHEN count(lr) OVER w = 5 AND row_number() OVER (PARTITION BY ticker ORDER BY date) >= 5 THEN sum(lr) OVER w END AS fwd FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) SELECT * FROM t WHERE fwd IS NOT NULL")
add("c09_quality_gate", "n_warn failed", "total_missing", lambda s, d: C.quality_gate(_mv(s, d), "mom_21", "vol_21", "price"),
    f"WITH {PANEL}, {M21}, k AS (SELECT avg((mom_21 IS NULL)::INT) AS a, avg((vol_21 IS NULL)::INT) AS b, avg((price IS NULL)::INT) AS c FROM m) SELECT (a > .5)::BIGINT + (b > .5)::BIGINT + (c > .5)::BIGINT AS n_warn, (a + b + c) / 3 > .3 AS failed, (a + b + c) / 3 AS total_missing FROM k")
add("c10_clip", K, "lr", lambda s, d: C.clipped(panel(s, d), "lr", -0.2, 0.2), f"WITH {PANEL} SELECT date, ticker, CASE WHEN lr IS NOT NULL THEN greatest(-0.2, least(0.2, lr)) END AS lr FROM panel")
add("c11_first_positions", "l_suppkey first_at", "", lambda s, d: C.first_positions(table(s, d, "lineitem"), "l_suppkey", "l_orderkey"), "SELECT l_suppkey, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1")
add("c12_clean_symbols", "p_partkey clean", "", lambda s, d: C.clean_symbols(table(s, d, "part").withColumn("sym", F.concat("p_brand", F.lit(" "), "p_name")), "sym", "p_size", [1, 2, 3, 4, 5, 6, 7, 8]),
    "SELECT p_partkey, replace(upper(trim(p_brand || ' ' || p_name)), '.', '-') AS clean FROM part WHERE p_size BETWEEN 1 AND 8 AND NOT suffix(upper(trim(p_brand || ' ' || p_name)), 'W') AND NOT contains(upper(trim(p_brand || ' ' || p_name)), '.')")
add("c12_listed_symbols", "p_partkey clean", "", lambda s, d: C.clean_symbols(table(s, d, "part").withColumns({"sym": F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("a.")).otherwise(F.lit(" b")), F.when(F.col("p_partkey") % 5 == 0, F.lit("w")).otherwise(F.lit("x ")))
    , "tradable": F.col("p_partkey") % 2 == 0, "shortable": F.when(F.col("p_size") % 2 == 0, True)}), "sym", "p_size", [1, 2, 3, 4, 5, 6, 7, 8], "tradable", "shortable"),
    "SELECT p_partkey, 'BX' AS clean FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_size BETWEEN 1 AND 8 AND p_partkey % 2 = 0 AND p_size % 2 = 0")
add("c12_dashed_symbols", "p_partkey clean", "", lambda s, d: C.dashed_symbols(table(s, d, "part").withColumn("sym", F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit(".")), F.lit(".B"))), "sym"), "SELECT p_partkey, replace(replace(p_brand, '#', '.') || '.B', '.', '-') AS clean FROM part")
add("c13_capped_universe", "c_custkey c_name", "", lambda s, d: C.capped_universe(table(s, d, "customer"), "c_name", F.col("c_acctbal") > 5000, 50), "SELECT c_custkey, c_name FROM customer ORDER BY CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END, c_name LIMIT 50")
add("c14_tradable", K, "price", lambda s, d: C.tradable(panel(s, d), 1500.0), f"WITH {PANEL} SELECT * FROM panel WHERE price >= 1500")
add("c15_source_coverage", "usable", "coverage", lambda s, d: C.source_coverage(T.momentum(panel(s, d), 252), "mom_252"), f"WITH {PANEL}, m AS (SELECT ticker, {gated('sum(lr)', 'lr', 252)} AS v FROM panel), k AS (SELECT ticker, count(v) AS n FROM m GROUP BY 1) SELECT avg((n > 0)::INT) AS coverage, avg((n > 0)::INT) > .3 AS usable FROM k")
add("c16_business_days", "date", "", lambda s, d: C.business_days(P.prices(s, d)), f"WITH {PANEL} SELECT date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM px) WHERE isodow(date) < 6")
add("c17_long", "date ticker feature", "value", lambda s, d: C.to_long(panel(s, d), "price", "volume"), f"WITH {PANEL} SELECT date, ticker, 'price' AS feature, price AS value FROM panel UNION ALL SELECT date, ticker, 'volume', volume FROM panel")
add("c17_wide", K, "price volume", lambda s, d: C.to_wide(C.to_long(panel(s, d), "price", "volume"), "price", "volume"), f"WITH {PANEL} SELECT date, ticker, price, volume FROM panel")
add("c18_align_columns", K, "volume absent price", lambda s, d: C.align_columns(panel(s, d), ["date", "ticker"], ["volume", "absent", "price"]), f"WITH {PANEL} SELECT date, ticker, volume, NULL::DOUBLE AS absent, price FROM panel")

add("x01_ranks", K, "cs_mom_21 cs_vol_21", lambda s, d: X.ranks(_mv(s, d), "mom_21", "vol_21"), f"WITH {PANEL}, {M21} SELECT date, ticker, {sql_rank('mom_21')} AS cs_mom_21, {sql_rank('vol_21')} AS cs_vol_21 FROM m")
add("x02_sector_relative", K, "rel", lambda s, d: X.sector_relative(_ps(s, d), "lr"), f"WITH {PS} SELECT date, ticker, lr - CASE WHEN count(ticker) OVER w > 1 THEN avg(lr) OVER w ELSE 0 END AS rel FROM ps WINDOW w AS (PARTITION BY date, sector)")
for _n, _pop, _fn in (("x03", False, "stddev_samp"), ("x04", True, "stddev_pop")):
    add(f"{_n}_sector_z", K, "sector_z", lambda s, d, p=_pop: X.sector_z(_ps(s, d), "price", p), f"WITH {PS} SELECT date, ticker, CASE WHEN count(price) OVER w >= 3 AND sector <> 'Unknown' THEN (price - avg(price) OVER w) / nullif({_fn}(price) OVER w, 0) END AS sector_z FROM ps WINDOW w AS (PARTITION BY date, sector)")
add("x05_x06_factor_returns", "date", "factor fm_5 fm_21", lambda s, d: X.factor_returns(T.momentum(panel(s, d), 21), "mom_21"),
    f"WITH {PANEL}, {M21}, r AS (SELECT *, {sql_rank('mom_21')} AS r FROM m), k AS (SELECT date, 'all' AS ticker, coalesce(avg(lr) FILTER (r > .8) - avg(lr) FILTER (r < .2), 0) AS factor FROM r GROUP BY date) SELECT date, factor, {gated('sum(factor)', 'factor', 5)} AS fm_5, {gated('sum(factor)', 'factor', 21)} AS fm_21 FROM k")
add("x07_calendar", "date opex", "dow_sin dow_cos month_sin month_cos turn", lambda s, d: X.calendar(C.business_days(P.prices(s, d))),
    f"WITH {PANEL}, b AS (SELECT date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM px) WHERE isodow(date) < 6) SELECT date, (day(date) BETWEEN 15 AND 21)::INTEGER AS opex, sin((isodow(date) - 1) * 2 * pi() / 5) AS dow_sin, cos((isodow(date) - 1) * 2 * pi() / 5) AS dow_cos, sin(month(date) * 2 * pi() / 12) AS month_sin, cos(month(date) * 2 * pi() / 12) AS month_cos, exp(-least(day(date) - 1, day(last_day(date)) - day(date)) / 2.0) AS turn FROM b")
add("x08_breadth", "date", "above_21 above_50", lambda s, d: X.breadth(panel(s, d), 21, 50), f"WITH {PANEL}, m AS (SELECT date, coalesce(price > {gated('avg(price)', 'price', 21)}, false)::INT AS a, coalesce(price > {gated('avg(price)', 'price', 50)}, false)::INT AS b FROM panel) SELECT date, avg(a) AS above_21, avg(b) AS above_50 FROM m GROUP BY date")
add("x09_market_state", "date", "mean_21 disp_21", lambda s, d: X.market_state(panel(s, d), 21), f"WITH {PANEL}, {M21} SELECT date, avg(mom_21) AS mean_21, stddev_samp(mom_21) AS disp_21 FROM m GROUP BY date")
add("x10_x13_macro", "date", "stress_change_5 stress_change_21 slope slope_change rate_change spread spread_change gold_mom dollar_mom oil_mom", lambda s, d: X.macro_features(macro(s, d), "stress", "s_america", "s_europe", "s_asia", "s_africa", {"gold": "s_mideast", "dollar": "mkt", "oil": "s_asia"}),
    f"WITH {MACRO}, b AS (SELECT *, s_america - s_europe AS slope, ln(s_asia / s_africa) AS spread FROM macro) SELECT date, stress / {lagged('stress', 5)} - 1 AS stress_change_5, stress / {lagged('stress', 21)} - 1 AS stress_change_21, slope, slope - {lagged('slope', 5)} AS slope_change, s_america - {lagged('s_america', 5)} AS rate_change, spread, spread - {lagged('spread', 5)} AS spread_change, ln(s_mideast / {lagged('s_mideast', 21)}) AS gold_mom, ln(mkt / {lagged('mkt', 21)}) AS dollar_mom, ln(s_asia / {lagged('s_asia', 21)}) AS oil_mom FROM b")
add("c04_on_calendar", "date", "mkt stress", lambda s, d: X.on_calendar(C.business_days(P.prices(s, d)), macro(s, d).where("month(date) % 2 = 0").withColumn("stress", F.when(F.col("stress") > 0.05, F.col("stress"))), "mkt", "stress"),
    f"WITH {MACRO}, b AS (SELECT date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM px) WHERE isodow(date) < 6), e AS (SELECT date, mkt, CASE WHEN stress > .05 THEN stress END AS stress FROM macro WHERE month(date) % 2 = 0), fa AS (SELECT b.date, e.date AS d, mkt FROM b ASOF LEFT JOIN e ON b.date >= e.date) SELECT fa.date, fa.mkt, ge.stress FROM fa ASOF LEFT JOIN (SELECT * FROM e WHERE stress IS NOT NULL) ge ON fa.date >= ge.date")
_em = f"e AS (SELECT date, sector, avg(price) AS p FROM ps GROUP BY 1, 2), e2 AS (SELECT *, ln(p / {lagged('p', 1, 'sector')}) AS r FROM e), e3 AS (SELECT *, {gated('sum(r)', 'r', 21, key='sector')} AS etf_mom FROM e2), e4 AS (SELECT *, {sql_rank('etf_mom')} AS etf_rank FROM e3)"
add("x14_x15_sector_momentum", K, "etf_mom etf_rank", lambda s, d: X.sector_momentum(_ps(s, d), 21), f"WITH {PS}, {_em} SELECT ps.date, ps.ticker, etf_mom, etf_rank FROM ps LEFT JOIN e4 ON e4.date = ps.date AND e4.sector = ps.sector")


add("x16_risk_composite", "date", "risk_on", lambda s, d: X.risk_composite(macro(s, d), ["mkt", "s_asia"], ["stress", "s_europe"]),
    f"WITH {MACRO}, l AS (SELECT date, " + ", ".join(f"{c}, list({c}) OVER (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS l_{c}" for c in ("mkt", "s_asia", "stress", "s_europe")) + " FROM macro) SELECT date, CASE WHEN len(l_mkt) >= 63 THEN (" + " + ".join(f"{a}len([v for v in l_{c} if v <= {c}]) / len(l_{c}){b}" for c, a, b in (("mkt", "", ""), ("s_asia", "", ""), ("stress", "(1 - ", ")"), ("s_europe", "(1 - ", ")"))) + ") / 4 END AS risk_on FROM l")
add("x17_broadcast_series", K, "stress", lambda s, d: X.broadcast_series(panel(s, d), macro(s, d), "stress"), f"WITH {MACRO} SELECT p.date, p.ticker, stress FROM panel p LEFT JOIN macro m ON m.date = p.date")
add("x18_composite", K, "c", lambda s, d: X.composite(_mv(s, d), "c", "mom_21", "vol_21", "lr"), f"WITH {PANEL}, {M21} SELECT date, ticker, list_avg([v for v in [mom_21, vol_21, lr] if v IS NOT NULL]) AS c FROM m")
# Value and momentum, quality and value, momentum and low volatility, small and value, earnings and momentum, sentiment and
# momentum, credit and beta, volume and momentum, volatility and distance from the mean, acceleration and breadth.
_ten = (("pe", "mom_21"), ("roe", "pe"), ("mom_21", "-vol_21"), ("-cap", "pe"), ("roa", "mom_21"), ("lr", "mom_21"), ("price", "vol_21"), ("volume", "mom_21"), ("vol_21", "far"), ("cr", "volume"))


def _ten_columns(s, d):
    # The prices ride along with the dates that look for facts, so panel and facts meet without a join.
    known = J.as_of(panel(s, d), facts(s, d), "filing_date", "revenue", "shares", "cost", "tax", tie="period_date", keep=("price", "volume", "lr"))
    made = T.volatility(T.momentum(known, 21), 21).withColumns({"pe": F.try_divide("cost", "revenue"), "roe": F.try_divide("cost", "shares"), "roa": F.try_divide("tax", "shares"), "cr": F.try_divide("revenue", "tax"), "cap": F.col("revenue"), "far": F.abs("lr")})
    # Sums in another order differ in their last digits, which would order ties.
    return made.select("date", "ticker", *[F.round(c, 9).alias(c) for c in ("pe", "roe", "roa", "cr", "cap", "far", "mom_21", "vol_21", "lr", "price", "volume")])


_tr = lambda c: f"(1 - ({sql_rank(c[1:])}))" if c[0] == "-" else f"({sql_rank(c)})"
add("x19_interactions", K, " ".join(f"x{i} xr{i}" for i in range(10)), lambda s, d: X.interactions(_ten_columns(s, d), *_ten),
    f"WITH {PANEL}, {M21}, {FACTS}, j AS (SELECT m.date, m.ticker, {', '.join(f'round({x}, 9) AS {n}' for n, x in (('mom_21', 'mom_21'), ('vol_21', 'vol_21'), ('lr', 'lr'), ('price', 'price'), ('volume', 'volume'), ('cap', 'f.revenue'), ('pe', 'f.cost / f.revenue'), ('roe', 'f.cost / f.shares'), ('roa', 'f.tax / f.shares'), ('cr', 'f.revenue / nullif(f.tax, 0)'), ('far', 'abs(lr)')))} FROM m ASOF LEFT JOIN facts f ON f.ticker = m.ticker AND m.date >= f.filing_date), k AS (SELECT date, ticker, {', '.join(f'{_tr(a)} * {_tr(b)} AS x{i}' for i, (a, b) in enumerate(_ten))} FROM j) SELECT *, {', '.join(f'{sql_rank(f"x{i}")} AS xr{i}' for i in range(10))} FROM k", digits=10)
_rs = " + ".join(f"CASE WHEN r{i} IS NULL THEN 0 ELSE {w} * greatest(-.1, least(.1, r{i} - 1)) END" for i, (a, la, b, lb, w) in enumerate(((5, 5, 20, 15, 0.2), (20, 15, 50, 30, 0.3), (50, 30, 200, 100, 0.5))))
_rr = ", ".join(f"({gated('avg(mkt)', 'mkt', a, la)}) / ({gated('avg(mkt)', 'mkt', b, lb)}) AS r{i}" for i, (a, la, b, lb) in enumerate(((5, 5, 20, 15), (20, 15, 50, 30), (50, 30, 200, 100))))
add("x20_regime_score", "date", "score", lambda s, d: X.regime_score(macro(s, d)), f"WITH {MACRO}, r AS (SELECT *, {_rr} FROM macro) SELECT date, greatest(-.1, least(.1, {_rs})) AS score FROM r")
_z = lambda c: f"({c} - ({gated(f'avg({c})', c, 252, 63)})) / (({gated(f'stddev_samp({c})', c, 252, 63)}) + {E})"
_obs = ("o_return", "o_vol", "o_credit", "o_curve", "o_stress")
_o = f"a AS (SELECT *, ln(mkt / {lagged('mkt')}) AS r, s_africa / s_asia AS cr, s_america / s_europe AS ts FROM macro), b AS (SELECT date, ticker, ln(mkt / {lagged('mkt', 21)}) AS o_return, {gated('stddev_samp(r)', 'r', 21)} * sqrt(252) AS o_vol, cr / {lagged('cr', 21)} - 1 AS o_credit, ts / {lagged('ts', 21)} - 1 AS o_curve, stress AS o_stress FROM a), b2 AS (SELECT * FROM b WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _obs)}), c AS (SELECT date, ticker, {', '.join(f'{_z(c)} AS {c}' for c in _obs)} FROM b2), ob AS (SELECT * FROM c WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _obs)})"
_observed = lambda s, d: X.regime_observations(macro(s, d), "mkt", "s_africa", "s_asia", "s_america", "s_europe", "stress")
add("x21_observations", "date", " ".join(_obs), _observed, f"WITH {MACRO}, {_o} SELECT * FROM ob")
add("x21_regimes", "date label duration", "score", lambda s, d: X.regimes(_observed(s, d)),
    f"WITH {MACRO}, {_o}, e0 AS (SELECT *, o_return - o_vol + o_credit + o_curve - o_stress AS score FROM ob), e AS (SELECT *, sign(round(score, 9))::INTEGER AS label FROM e0), h AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM {lagged('label')} THEN 0 ELSE 1 END AS fresh FROM e), i AS (SELECT *, sum(fresh) OVER (ORDER BY date) AS run FROM h) SELECT date, label, row_number() OVER (PARTITION BY run ORDER BY date)::INTEGER AS duration, score FROM i")
add("x22_latest_static", K, "static", lambda s, d: X.latest_static(panel(s, d), "price"), f"WITH {PANEL}, l AS (SELECT ticker, max_by(price, date) AS static FROM panel WHERE price IS NOT NULL GROUP BY 1) SELECT p.date, p.ticker, static FROM panel p LEFT JOIN l ON l.ticker = p.ticker")

_fwd = lambda h, source="panel": f"CASE WHEN count(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} AND row_number() OVER (PARTITION BY ticker ORDER BY date) >= {h} THEN sum(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END"
add("t01_forward_return", K, "fwd", lambda s, d: L.forward_return(panel(s, d), 10), f"WITH {PANEL} SELECT date, ticker, {_fwd(10)} AS fwd FROM panel")
add("t02_rank_target", K, "target", lambda s, d: L.rank_target(panel(s, d), 5), f"WITH {PANEL}, t AS (SELECT *, {_fwd(5)} AS fwd FROM panel) SELECT date, ticker, {sql_rank('fwd')} AS target FROM t")
add("t03_risk_target", K, "target", lambda s, d: L.risk_target(panel(s, d), 5, 21),
    f"WITH {PANEL}, t AS (SELECT *, {_fwd(5)} AS fwd, nullif({gated('stddev_samp(lr)', 'lr', 21)}, 0) AS v FROM panel), u AS (SELECT *, fwd / (last_value(v IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) + {E}) AS x FROM t) SELECT date, ticker, {sql_rank('x')} AS target FROM u")
add("t04_sector_target", K, "target", lambda s, d: L.sector_target(_ps(s, d), 5), f"WITH {PS}, t AS (SELECT *, {_fwd(5)} AS fwd FROM ps), u AS (SELECT *, CASE WHEN count(ticker) OVER w > 1 THEN fwd - avg(fwd) OVER w ELSE fwd END AS x FROM t WINDOW w AS (PARTITION BY date, sector)) SELECT date, ticker, {sql_rank('x')} AS target FROM u")
TB = f"""own AS (SELECT *, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS sr FROM panel WHERE price IS NOT NULL),
tb AS (SELECT *, CASE WHEN count(price) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) >= 20
         THEN greatest(coalesce(stddev_samp(sr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND 1 PRECEDING), .005), .005) ELSE .02 END AS vol,
  [{', '.join(f'lead(price, {k}) OVER (PARTITION BY ticker ORDER BY date)' for k in range(1, 11))}] AS ahead FROM own),
tc AS (SELECT *, [{{'i': i, 'r': ahead[i] / price - 1}} for i in range(1, 11) if ahead[i] IS NOT NULL] AS steps FROM tb),
td AS (SELECT *, [x for x in steps if abs(x.r) >= 2 * vol * sqrt(x.i)][1] AS hit FROM tc),
te AS (SELECT date, ticker, lr, coalesce(sign(hit.r), 0)::INTEGER AS label, coalesce(hit.r, steps[-1].r, 0) AS ret FROM td)"""
add("t05_triple_barrier", "date ticker label", "ret", lambda s, d: L.triple_barrier(panel(s, d)), f"WITH {PANEL}, {TB} SELECT date, ticker, label, ret FROM te")
add("t06_meta_label", K, "meta", lambda s, d: L.meta_label(L.triple_barrier(panel(s, d)), "lr"), f"WITH {PANEL}, {TB} SELECT date, ticker, CASE WHEN lr IS NULL THEN NULL WHEN label = 0 THEN .5 WHEN sign(lr) = label THEN 1 ELSE 0 END AS meta FROM te")
add(
    "t07_uniqueness", K, "weight", lambda s, d: L.uniqueness(panel(s, d).where("abs(lr) > 0.3")),
    f"""WITH {PANEL}, r AS (SELECT * FROM panel WHERE abs(lr) > .3), u AS (SELECT count(DISTINCT date) AS dates, count(*) AS samples FROM r),
n AS (SELECT a.date, count(*) AS near FROM (SELECT DISTINCT date FROM r) a JOIN r b ON b.date BETWEEN a.date - INTERVAL 10 DAY AND a.date + INTERVAL 10 DAY GROUP BY 1),
w AS (SELECT r.date, r.ticker, 1 / greatest(n.near / u.dates, .1) AS raw, u.samples FROM r JOIN n ON n.date = r.date CROSS JOIN u)
SELECT date, ticker, raw * samples / sum(raw) OVER () AS weight FROM w""",
)
add("t08_decay_weight", K, "weight", lambda s, d: L.decay_weight(panel(s, d)),
    f"WITH {PANEL}, n AS (SELECT date, count(*) AS n FROM panel GROUP BY 1), k AS (SELECT date, n, sum(n) OVER (ORDER BY date) - n AS before, sum(n) OVER () AS total FROM n), w AS (SELECT *, exp(before / greatest(total - 1, 1) - 1) AS raw FROM k), z AS (SELECT date, raw / (sum(raw * n) OVER () / total) AS weight FROM w) SELECT r.date, r.ticker, weight FROM panel r JOIN z ON z.date = r.date")
add("t09_regime_weight", "date", "weight", lambda s, d: L.regime_weight(macro(s, d), "stress", 0.049, 0.052), f"WITH {MACRO} SELECT date, 1 - greatest(0, least(1, (stress - .049) / (.052 - .049))) * .7 AS weight FROM macro")
