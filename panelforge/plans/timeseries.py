"""Queries W01-W37: per-entity windows on the weekly panel."""

from __future__ import annotations

from panelforge.functions import windows as W
from panelforge.operators import timeseries as T
from panelforge.plans.base import MACRO, PANEL, add, gated, lagged, over, sql_rank
from panelforge.sources.panels import macro, panel

KEYS = "date ticker"
A = "sqrt(252)"
E = "1e-8"


def _p(name: str, columns: str, op, select: str, before: str = "") -> None:
    add(name, KEYS, columns, lambda s, d: op(panel(s, d)), f"WITH {PANEL}{before} SELECT date, ticker, {select} FROM {'b' if before else 'panel'}")


def _sum(n: int) -> str:
    return gated("sum(lr)", "lr", n)


def _sd(n: int, x: str = "lr") -> str:
    return gated(f"stddev_samp({x})", x, n)


_p("w01_log_return", "lr", lambda p: p, "lr")
_p("w02_pct_change", "c1 c5", lambda p: p.withColumn("c1", W.change("price")).withColumn("c5", W.change("price", 5)), f"price / {lagged('price')} - 1 AS c1, price / {lagged('price', 5)} - 1 AS c5")
_p("w03_momentum", "mom_5 mom_21 mom_63 mom_252", lambda p: T.momentum(p, 5, 21, 63, 252), ", ".join(f"{_sum(n)} AS mom_{n}" for n in (5, 21, 63, 252)))
_skip = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"
_p("w04_skip_momentum", "skip_10 skip_21", lambda p: T.skip_momentum(p, 10, 21), ", ".join(f"CASE WHEN count(lr) {_skip.format(n - 1, 1)} = {n - 1} THEN sum(lr) {_skip.format(n - 1, 1)} END AS skip_{n}" for n in (10, 21)))
_p("w05_year_less_month", "mom_12m_1m", T.year_less_month, f"CASE WHEN count(lr) {_skip.format(251, 21)} = 231 THEN sum(lr) {_skip.format(251, 21)} END AS mom_12m_1m")
_p("w06_acceleration", "accel_21 accel_63", lambda p: T.acceleration(p, 21, 63), ", ".join(f"m{n} - {lagged(f'm{n}', n)} AS accel_{n}" for n in (21, 63)), f", b AS (SELECT *, {_sum(21)} AS m21, {_sum(63)} AS m63 FROM panel)")
_p("w07_w08_mean_reversion", "to_mean_5 to_mean_21 z_5 z_21", lambda p: T.mean_reversion(p, 5, 21), ", ".join([f"price / {gated('avg(price)', 'price', n)} - 1 AS to_mean_{n}" for n in (5, 21)] + [f"(lr - {gated('avg(lr)', 'lr', n)}) / ({_sd(n)} + {E}) AS z_{n}" for n in (5, 21)]))
_p("w09_range_distance", "to_high_21 to_low_21 to_high_63 to_low_63", lambda p: T.range_distance(p, 21, 63), ", ".join(f"price / {gated('max(price)', 'price', n)} - 1 AS to_high_{n}, price / {gated('min(price)', 'price', n)} - 1 AS to_low_{n}" for n in (21, 63)))
_p("w10_volatility", "vol_5 vol_21 vol_63", lambda p: T.volatility(p, 5, 21, 63), ", ".join(f"{_sd(n)} * {A} AS vol_{n}" for n in (5, 21, 63)))
_p("w11_vol_ratio", "vol_ratio", T.vol_ratio, f"{_sd(5)} / ({_sd(63)} + {E}) AS vol_ratio")
_p("w12_shape", "skew_21 kurt_21", lambda p: T.shape(p, 21), f"{gated('skewness(lr)', 'lr', 21)} AS skew_21, {gated('kurtosis(lr)', 'lr', 21)} AS kurt_21")
_ud = ", b AS (SELECT *, CASE WHEN lr IS NOT NULL THEN greatest(lr, 0) END AS u, CASE WHEN lr IS NOT NULL THEN least(lr, 0) END AS w FROM panel)"
_p("w13_up_down_vol", "updown_21", lambda p: T.up_down_vol(p, 21), f"{_sd(21, 'u')} / ({_sd(21, 'w')} + {E}) AS updown_21", _ud)
_p("w14_w15_w17_volume", "surprise_5 log_dollar_5 surprise_21 log_dollar_21 trend", lambda p: T.volume_features(p, 5, 21),
   ", ".join(f"volume / ({gated('avg(volume)', 'volume', n)} + 1) - 1 AS surprise_{n}, ln(1 + {gated('avg(price * volume)', 'price * volume', n)}) AS log_dollar_{n}" for n in (5, 21)) + f", {gated('avg(volume)', 'volume', 5)} / ({gated('avg(volume)', 'volume', 21)} + 1) - 1 AS trend")
_il = ", b AS (SELECT *, abs(lr) / (price * volume + 1) AS q FROM panel)"
_p("w16_illiquidity", "illiq_21 illiq_63", lambda p: T.illiquidity(p, 21, 63), ", ".join(f"ln(1 + 1e6 * ({gated('avg(q)', 'q', n)})) AS illiq_{n}" for n in (21, 63)), _il)


def _ewm_sql(x: str, a: float, adjust: bool, source: str, name: str) -> str:
    """CTE adding ``name``: the weighted mean by scaled running sums (an independent form)."""
    k = repr(1 - a)
    run = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    if adjust:
        value = f"sum({x} * pow({k}, -i)) {run} / nullif(sum(CASE WHEN {x} IS NOT NULL THEN pow({k}, -i) END) {run}, 0)"
    else:
        states = f"list({{'m': coalesce({x}, 0)::DOUBLE, 'w': CASE WHEN {x} IS NULL THEN 0 ELSE 1 END::DOUBLE}}) {run}"
        old = f"(s.w * {k})"
        value = f"list_reduce({states}, lambda s, v: CASE WHEN v.w = 0 THEN {{'m': s.m, 'w': {old}}} WHEN s.w = 0 THEN v ELSE {{'m': ({old} * s.m + {a!r} * v.m) / ({old} + {a!r}), 'w': 1.0::DOUBLE}} END)"
        return f"SELECT * EXCLUDE (st), CASE WHEN st.w > 0 THEN st.m END AS {name} FROM (SELECT *, {value} AS st FROM {source})"
    return f"SELECT *, {value} AS {name} FROM {source}"


_num = ", n0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM panel)"
_p("w18_smoothing_residual", "resid_5 resid_10", lambda p: T.smoothing_residual(p, 0.05, 0.1), f"(price - s5) / (s5 + {E}) AS resid_5, (price - s10) / (s10 + {E}) AS resid_10",
   f"{_num}, n1 AS ({_ewm_sql('price', 0.05, False, 'n0', 's5')}), b AS ({_ewm_sql('price', 0.1, False, 'n1', 's10')})")
_p("w19_decay_momentum", "decay_10 decay_21", lambda p: T.decay_momentum(p, 10, 21), f"d10 * {A} AS decay_10, d21 * {A} AS decay_21",
   f"{_num}, n1 AS ({_ewm_sql('lr', W.halflife(10), True, 'n0', 'd10')}), b AS ({_ewm_sql('lr', W.halflife(21), True, 'n1', 'd21')})")
_dd = f", c AS (SELECT *, price - {lagged('price')} AS d FROM panel), b AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS u, CASE WHEN d IS NOT NULL THEN -least(d, 0) END AS w FROM c)"
_p("w20_rsi", "rsi", T.rsi, f"100 - 100 / (1 + {gated('avg(u)', 'u', 14)} / ({gated('avg(w)', 'w', 14)} + {E})) AS rsi", _dd)
_bl = f", b AS (SELECT *, {gated('avg(price)', 'price', 20)} AS m, {_sd(20, 'price')} AS sd FROM panel)"
_p("w21_bollinger", "boll_pos boll_width", T.bollinger, f"(price - (m - 2 * sd)) / (4 * sd + {E}) AS boll_pos, 4 * sd / (m + {E}) AS boll_width", _bl)
_p("w22_macd", "macd", T.macd, "(m - s) / price AS macd",
   f"{_num}, n1 AS ({_ewm_sql('price', W.span(12), True, 'n0', 'a1')}), n2 AS ({_ewm_sql('price', W.span(26), True, 'n1', 'a2')}), n3 AS (SELECT *, a1 - a2 AS m FROM n2), b AS ({_ewm_sql('m', W.span(9), True, 'n3', 's')})")
_p("w23_risk_adjusted_momentum", "ram_21 ram_63", lambda p: T.risk_adjusted_momentum(p, 21, 63), ", ".join(f"{_sum(n)} * 252 / {n} / ({_sd(n)} * {A} + {E}) AS ram_{n}" for n in (21, 63)))
_p("w24_positive_share", "up_21 up_63", lambda p: T.positive_share(p, 21, 63), ", ".join(f"{gated('avg(u)', 'u', n)} AS up_{n}" for n in (21, 63)), ", b AS (SELECT *, CASE WHEN lr > 0 THEN 1.0::DOUBLE ELSE 0 END AS u FROM panel)")
_p("w25_momentum_drawdown", "dd_63", lambda p: T.momentum_drawdown(p, 63), f"m - {gated('max(m)', 'm', 63, 1)} AS dd_63", f", b AS (SELECT *, {_sum(63)} AS m FROM panel)")
_p("w26_trend_slope", "slope_63", lambda p: T.trend_slope(p, 63), gated("regr_slope(y, i)", "y", 63) + " AS slope_63", f"{_num}, b AS (SELECT *, ln(CASE WHEN price IS NOT NULL THEN greatest(price, 1e-6) END) AS y FROM n0)")
_p("w27_reversal", "rev_1 rev_3 rev_5", lambda p: T.reversal(p, 1, 3, 5), ", ".join(f"-({_sum(n)}) AS rev_{n}" for n in (1, 3, 5)))
_p("w28_volume_weighted_reversal", "vw_rev", T.volume_weighted_reversal, f"-({_sum(3)}) * ({sql_rank('volume')}) AS vw_rev")
_p("w29_volume_price_divergence", "divergence", T.volume_price_divergence, f"({sql_rank('cp')}) - ({sql_rank('cv')}) AS divergence", f", b AS (SELECT *, price / {lagged('price', 5)} - 1 AS cp, volume / {lagged('volume', 5)} - 1 AS cv FROM panel)")
_bt = f", c AS (SELECT *, avg(lr) OVER (PARTITION BY date) AS mkt FROM panel), c2 AS (SELECT *, lr * mkt AS xy FROM c), c3 AS (SELECT *, ({gated('avg(xy)', 'xy', 21)} - {gated('avg(lr)', 'lr', 21)} * {gated('avg(mkt)', 'mkt', 21)}) / nullif({gated('var_samp(mkt)', 'mkt', 21)}, 0) AS beta_21 FROM c2), b AS (SELECT *, lr - beta_21 * mkt AS r FROM c3)"
_p("w30_market_beta", "beta_21 idio_21", lambda p: T.market_beta(p, 21), f"beta_21, {_sd(21, 'r')} * {A} AS idio_21", _bt)
_ec = f", b AS (SELECT *, {_sd(63)} * {A} AS v, {_sum(126)} AS m, price / {gated('max(price)', 'price', 252, 60)} - 1 AS h FROM panel)"
_p("w31_entry_context", "vol_63 mom_126 near_high", T.entry_context, f"{lagged('v')} AS vol_63, {lagged('m')} AS mom_126, {lagged('h')} AS near_high", _ec)
_w = "list(price) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
_sh = f", b AS (SELECT *, [v for v in {_w} if v IS NOT NULL] AS vs FROM panel)"
_p("w32_rolling_share", "pct", lambda p: T.rolling_share(p, "price"), "CASE WHEN price IS NOT NULL AND len(vs) >= 63 THEN len([v for v in vs if v <= price]) / len(vs) END AS pct", _sh)
add("w33_stress_share", "date", "pct", lambda s, d: T.rolling_share(macro(s, d), "stress", 63, 63, above=True), f"WITH {MACRO}, b AS (SELECT date, stress, list(stress) OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS vs FROM macro) SELECT date, CASE WHEN len(vs) >= 63 THEN len([v for v in vs if v >= stress]) / len(vs) END AS pct FROM b")
_p("w34_rolling_z", "z", lambda p: T.rolling_z(p, "price"), f"(price - {gated('avg(price)', 'price', 252, 63)}) / ({gated('stddev_samp(price)', 'price', 252, 63)} + {E}) AS z")
_fw = T.frac_weights(0.4, 1e-2)
_p("w35_frac_diff", "frac", lambda p: T.frac_diff(p, "price", 0.4, 1e-2), f"CASE WHEN count(price) {over(len(_fw))} = {len(_fw)} THEN " + " + ".join(f"{w!r} * {lagged('price', k) if k else 'price'}" for k, w in enumerate(_fw)) + " END AS frac")
add("w36_difference", "date", "diff", lambda s, d: T.difference(macro(s, d), "stress", 4), f"WITH {MACRO} SELECT date, stress - lag(stress, 4) OVER (ORDER BY date) AS diff FROM macro")
_p("w37_running", "cum peak", T.running, "cum, max(cum) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak", ", b AS (SELECT *, exp(sum(coalesce(lr, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS cum FROM panel)")
