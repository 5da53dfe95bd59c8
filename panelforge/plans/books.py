"""Queries for books (B), returns (R), factors (F), forensics (D) and modelling (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.windows import rank_pct
from panelforge.operators import book as B
from panelforge.operators import clean as C
from panelforge.operators import labels as L
from panelforge.operators import modeling as M
from panelforge.operators import timeseries as T
from panelforge.plans.base import ORACLES, PANEL, SECTORS, add, gated, lagged, sql_rank
from panelforge.sources.panels import panel, sectors, stress, with_sector
from panelforge.sources.scratch import written

K = "date ticker"
NL, NS = 8, 5
M21 = f"m AS (SELECT *, {gated('sum(lr)', 'lr', 21)} AS mom_21, {gated('stddev_samp(lr)', 'lr', 21)} * sqrt(252) AS vol_21 FROM panel)"
BOOK = f"""{PANEL}, {M21}, b0 AS (SELECT *, {sql_rank('mom_21')} AS rank, row_number() OVER (PARTITION BY date ORDER BY mom_21 DESC, ticker) AS u, row_number() OVER (PARTITION BY date ORDER BY mom_21, ticker) AS w FROM m WHERE mom_21 IS NOT NULL),
b1 AS (SELECT *, CASE WHEN u <= {NL} THEN 1 WHEN w <= {NS} THEN -1 END::INTEGER AS side FROM b0), b2 AS (SELECT * FROM b1 WHERE side IS NOT NULL),
b3 AS (SELECT *, greatest(CASE WHEN side = 1 THEN rank - .5 ELSE .5 - rank END / greatest(coalesce(vol_21, median(vol_21) OVER (PARTITION BY date)), .05), 0) AS raw FROM b2),
book AS (SELECT *, coalesce(raw / nullif(sum(raw) OVER (PARTITION BY date, side), 0), 0) * CASE WHEN side = 1 THEN .45 ELSE -.25 END AS weight FROM b3)"""
SB = f"{BOOK}, {SECTORS}, sb AS (SELECT k.*, coalesce(s.sector, 'Unknown') AS sector FROM book k LEFT JOIN sectors s ON s.ticker = k.ticker)"
DAILY = f"""{BOOK}, dt AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM book)),
sr AS (SELECT date, ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM panel),
rw AS (SELECT dt.date, h.ticker, h.weight AS w0, coalesce(t.weight, 0) AS w1, sr.r FROM dt JOIN book h ON h.date = dt.before LEFT JOIN sr ON sr.date = dt.date AND sr.ticker = h.ticker LEFT JOIN book t ON t.date = dt.date AND t.ticker = h.ticker),
dd AS (SELECT date, coalesce(sum(w0 * r), 0) AS gross, coalesce(sum(abs(w1 - w0)) FILTER (r IS NOT NULL), 0) AS turnover, coalesce(sum(w0 * r) FILTER (w0 > 0), 0) AS long_pnl, coalesce(sum(w0 * r) FILTER (w0 < 0), 0) AS short_pnl,
  count(*) FILTER (w0 > 0) AS n_long, count(*) FILTER (w0 < 0) AS n_short, sum(abs(w0)) AS gross_exposure, sum(w0) AS net_exposure FROM rw GROUP BY 1),
daily AS (SELECT 'book' AS run, *, turnover * 7e-4 AS tc, gross - turnover * 7e-4 AS net FROM dd)"""


def _panel(s, d):
    """The panel, written once: book queries read it several times."""
    return written(panel(s, d), "panel")


def _scored(p):
    """Momentum and volatility of 21 rows on a panel."""
    return T.volatility(T.momentum(p, 21), 21)


def _mv(s, d):
    return _scored(_panel(s, d))


def _booked(p):
    """The book of a panel, written once."""
    return written(B.weights(B.select_book(_scored(p), "mom_21", NL, NS), "vol_21"), "book")


def _book(s, d):
    return _booked(_panel(s, d))


def _both(s, d):
    """The book and the panel that it was made from, each written once."""
    p = _panel(s, d)
    return _booked(p), p


def _sb(s, d):
    return with_sector(_book(s, d), sectors(s, d))


def _daily(s, d):
    return B.replay(*_both(s, d))


def _with_bench(s, d):
    """The replay, and the mean return of all tickers on each date."""
    book, p = _both(s, d)
    return B.replay(book, p), p.groupBy("date").agg(F.coalesce(F.avg("lr"), F.lit(0.0)).alias("bench"))


add("b01_eligible", K + " can_short", "", lambda s, d: B.eligible(with_sector(_mv(s, d), sectors(s, d)), {"vol_21": 5.0, "mom_21": 0.5}, {"volume": 20.0}, ["ASIA"]),
    f"WITH {PANEL}, {M21}, {SECTORS} SELECT date, m.ticker, NOT (coalesce(vol_21 > 5, false) OR coalesce(mom_21 > .5, false) OR coalesce(volume <= 20, false) OR coalesce(s.sector, 'Unknown') = 'ASIA') AS can_short FROM m LEFT JOIN sectors s ON s.ticker = m.ticker")
add("b02_select", K + " side", "rank", lambda s, d: B.select_book(_mv(s, d), "mom_21", NL, NS), f"WITH {BOOK} SELECT * FROM b2")
_hy = f"h0 AS (SELECT *, CASE WHEN mom_21 IS NOT NULL THEN row_number() OVER (PARTITION BY date ORDER BY mom_21 DESC NULLS LAST, ticker) END AS place FROM m), h1 AS (SELECT *, CASE WHEN place <= 8 THEN 1 WHEN place IS NULL OR place > 16 THEN 0 END AS e FROM h0)"
add("b03_hysteresis", K + " held", "", lambda s, d: B.hysteresis(_mv(s, d), "mom_21", 8), f"WITH {PANEL}, {M21}, {_hy} SELECT date, ticker, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS held FROM h1")
add("b04_b05_weights", K, "weight", _book, f"WITH {BOOK} SELECT * FROM book")
_sc = "k AS (SELECT *, sum(abs(weight)) OVER (PARTITION BY date, sector) / sum(abs(weight)) OVER (PARTITION BY date) AS sh FROM sb), kc AS (SELECT date, ticker, weight * CASE WHEN sector <> 'Unknown' AND sh > .15 THEN .15 / sh ELSE 1 END AS capped FROM k)"
add("b06_sector_cap", K, "capped", lambda s, d: B.sector_cap(_sb(s, d)), f"WITH {SB}, {_sc} SELECT * FROM kc")
_tg = "kp AS (SELECT date, ticker, greatest(-.02, least(.02, capped)) AS w FROM kc), kg AS (SELECT date, ticker, w * coalesce(CASE WHEN w > 0 THEN .45 ELSE .25 END / nullif(sum(abs(w)) OVER (PARTITION BY date, sign(w)), 0), 1) AS weight FROM kp)"
add("b05_to_gross", K, "weight", lambda s, d: B.to_gross(B.position_cap(B.sector_cap(_sb(s, d)).withColumn("weight", F.col("capped")))), f"WITH {SB}, {_sc}, {_tg} SELECT * FROM kg")
add("b07_position_cap", K, "weight", lambda s, d: B.position_cap(_book(s, d)), f"WITH {BOOK} SELECT date, ticker, greatest(-.02, least(.02, weight)) AS weight FROM book")
_pv = "pv AS (SELECT p.date, h.ticker, h.weight FROM book h JOIN (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM panel)) p ON p.before = h.date)"


def _with_previous(s, d):
    """The book, and the book before of each date of the panel."""
    from pyspark.sql.window import Window

    book, p = _both(s, d)
    dates = p.select("date").distinct().withColumn("before", F.lag("date").over(Window.orderBy("date")))
    return book, book.withColumnRenamed("date", "before").join(F.broadcast(dates), "before")


def _traded(s, d):
    book, previous = _with_previous(s, d)
    return B.trade_list(book.where("price is not null"), previous, 1e6)


add("b08_turnover_limit", K, "weight", lambda s, d: B.turnover_limit(*_with_previous(s, d), 0.2), f"WITH {BOOK}, {_pv}, j AS (SELECT coalesce(a.date, b.date) AS date, coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.weight, 0) AS t, coalesce(b.weight, 0) AS p FROM book a FULL JOIN pv b ON a.date = b.date AND a.ticker = b.ticker), k AS (SELECT *, sum(abs(t - p)) OVER (PARTITION BY date) AS mv FROM j) SELECT date, ticker, p + (t - p) * CASE WHEN mv > .2 THEN .2 / mv ELSE 1 END AS weight FROM k")
add("b09_drop_dust", K, "weight", lambda s, d: B.drop_dust(_book(s, d)), f"WITH {BOOK}, k AS (SELECT *, greatest(1e-5, least(.002, .1 * avg(abs(weight)) OVER (PARTITION BY date))) AS f FROM book) SELECT * FROM k WHERE abs(weight) >= f")
add("b10_trade_list", K + " shares", "delta notional", _traded, f"WITH {BOOK}, {_pv}, j AS (SELECT a.date, a.ticker, a.price, a.weight - coalesce(b.weight, 0) AS delta FROM book a LEFT JOIN pv b ON a.date = b.date AND a.ticker = b.ticker WHERE a.price IS NOT NULL), k AS (SELECT *, CASE WHEN delta < 0 THEN floor(abs(delta) * 1e6 / price)::BIGINT END AS shares, CASE WHEN delta > 0 THEN delta * 1e6 END AS notional FROM j WHERE abs(delta) > .005) SELECT * FROM k WHERE shares IS NULL OR shares >= 1", 4)
_rn = "ROWS UNBOUNDED PRECEDING"
_dc = f"c0 AS (SELECT *, product(1 + net) OVER (ORDER BY date {_rn}) AS cum FROM daily), c1 AS (SELECT *, cum / greatest(max(cum) OVER (ORDER BY date {_rn}), 1) - 1 AS dd FROM c0)"
add("b11_drawdown_scale", "date", "dd scale", lambda s, d: B.drawdown_scale(_daily(s, d)), f"WITH {DAILY}, {_dc} SELECT date, dd, coalesce(1 - CASE WHEN lag(dd) OVER (ORDER BY date) IS NOT NULL THEN greatest(0, least(1, (-.03 - lag(dd) OVER (ORDER BY date)) / .03)) END * .5, 1) AS scale FROM c1")
add("b12_risk_scales", "date", "vol_scale dd_scale tail_scale", lambda s, d: B.risk_scales(_daily(s, d)),
    f"""WITH {DAILY}, {_dc}, k AS (SELECT *, count(*) OVER (ORDER BY date {_rn}) AS n, stddev_samp(net) OVER (ORDER BY date ROWS 62 PRECEDING) * sqrt(252) AS v,
      stddev_pop(net) OVER (ORDER BY date ROWS 4 PRECEDING) / nullif(stddev_pop(net) OVER (ORDER BY date ROWS 62 PRECEDING), 0) AS lively, min(net) OVER (ORDER BY date ROWS 4 PRECEDING) AS m5, max(net) OVER (ORDER BY date ROWS 2 PRECEDING) AS m3 FROM c1)
    SELECT date, CASE WHEN n >= 63 AND v > 0 THEN greatest(.3, least(2, .1 / v)) ELSE 1 END AS vol_scale, CASE WHEN dd < -.08 THEN greatest(.5, 1 - (dd / -.08 - 1) * .5) ELSE 1 END AS dd_scale,
      CASE WHEN n < 10 THEN 1 WHEN m5 < -.03 THEN .5 WHEN n >= 20 AND lively > 2 THEN .6 WHEN m3 < 0 THEN .7 ELSE 1 END AS tail_scale FROM k""")  # fmt: skip
add("b13_sector_neutral", K, "neutral", lambda s, d: B.sector_neutral(_sb(s, d)), f"WITH {SB} SELECT date, ticker, weight - (sum(weight) OVER w - greatest(-.03, least(.03, sum(weight) OVER w))) / count(*) OVER w AS neutral FROM sb WINDOW w AS (PARTITION BY date, sector)")
_fn = "n0 AS (SELECT *, weight AS n FROM book)" + "".join(f", n{i + 1} AS (SELECT * EXCLUDE (n), CASE WHEN abs(sum(n * vol_21) OVER (PARTITION BY date)) > .3 THEN n - .3 * sum(n * vol_21) OVER (PARTITION BY date) * vol_21 / sum(vol_21 * vol_21) OVER (PARTITION BY date) ELSE n END AS n FROM n{i})" for i in range(5))
add("b14_factor_neutral", K, "neutral", lambda s, d: B.factor_neutral(_book(s, d), "vol_21"), f"WITH {BOOK}, {_fn} SELECT date, ticker, greatest(-.1, least(.1, n)) AS neutral FROM n5")
add("b15_regime_tilt", K, "tilted", lambda s, d: B.regime_tilt(_book(s, d), "mom_21"), f"WITH {BOOK}, k AS (SELECT *, CASE WHEN abs(mom_21) < .01 THEN 0 ELSE least(2 * abs(mom_21), .15) END * sign(mom_21) AS b FROM book) SELECT date, ticker, weight * CASE WHEN weight > 0 THEN 1 + b ELSE 1 - b END AS tilted FROM k")
add("b16_gross_cap", K, "neutral", lambda s, d: B.gross_cap(_book(s, d)), f"WITH {BOOK}, k AS (SELECT *, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) OVER (PARTITION BY date) AS l, -sum(CASE WHEN weight < 0 THEN weight ELSE 0 END) OVER (PARTITION BY date) AS s FROM book) SELECT date, ticker, CASE WHEN weight > 0 THEN weight * least(l, s, .8) / nullif(l, 0) ELSE weight * least(l, s, .8) / nullif(s, 0) END AS neutral FROM k")
add("b17_risk_parity", K, "parity", lambda s, d: B.risk_parity(_book(s, d), "vol_21"), f"WITH {BOOK}, k AS (SELECT *, 1 / greatest(coalesce(vol_21, .05), .05) AS i FROM book) SELECT date, ticker, side * i / sum(i) OVER (PARTITION BY date, side) AS parity FROM k")
add("b18_garch", "ticker", "alpha beta vol ll vol_10", lambda s, d: B.garch(_panel(s, d)).withColumn("vol_10", F.element_at("forecast", 10)))
add("b19_pretrade_checks", "date over_gross flat_scores too_few", "", lambda s, d: B.pretrade_checks(_book(s, d), 0.6, NL + NS), f"WITH {BOOK} SELECT date, sum(abs(weight)) > .6 AS over_gross, coalesce(stddev_samp(rank) < 1e-6, true) AS flat_scores, count(*) < {NL + NS} AS too_few FROM book GROUP BY 1")
add("r01_replay", "date n_long n_short", "gross tc net turnover gross_exposure net_exposure", _daily, f"WITH {DAILY} SELECT * FROM daily")
_mt = f"{DAILY}, v0 AS (SELECT *, product(1 + net) OVER (ORDER BY date {_rn}) AS c FROM daily), v1 AS (SELECT *, c / max(c) OVER (ORDER BY date {_rn}) - 1 AS d FROM v0), v2 AS (SELECT run, count(*) AS n, product(1 + net) - 1 AS total, stddev_samp(net) * sqrt(252) AS vol, stddev_samp(net) FILTER (net < 0) * sqrt(252) AS down, min(d) AS max_dd, avg((net > 0)::INT) AS win, sum(net) FILTER (net > 0) / -sum(net) FILTER (net < 0) AS profit_factor FROM v1 GROUP BY 1), mt AS (SELECT *, pow(1 + total, 252 / n) - 1 AS annual FROM v2)"
add("r02_metrics", "run n", "total annual vol sharpe sortino max_dd calmar win profit_factor", lambda s, d: B.metrics(_daily(s, d)), f"WITH {_mt} SELECT *, annual / vol AS sharpe, annual / down AS sortino, annual / abs(max_dd) AS calmar FROM mt")
add("r03_r05_summary", "run", "mean_gross mean_turnover costs long_pnl short_pnl best_month worst_month up_months", lambda s, d: B.summary(_daily(s, d)), f"WITH {DAILY}, mo AS (SELECT run, date_trunc('month', date) AS m, product(1 + net) - 1 AS r FROM daily GROUP BY 1, 2), mb AS (SELECT run, max(r) AS best_month, min(r) AS worst_month, avg((r > 0)::INT) AS up_months FROM mo GROUP BY 1), a AS (SELECT run, avg(gross_exposure) AS mean_gross, avg(turnover) AS mean_turnover, sum(tc) AS costs, sum(long_pnl) AS long_pnl, sum(short_pnl) AS short_pnl FROM daily GROUP BY 1) SELECT * FROM a JOIN mb USING (run)")
add("r04_drawdown_spells", "run longest", "mean", lambda s, d: B.drawdown_spells(_daily(s, d)), f"WITH {DAILY}, a AS (SELECT *, round(product(1 + net) OVER (ORDER BY date {_rn}), 9) AS c FROM daily), b AS (SELECT *, c < max(c) OVER (ORDER BY date {_rn}) AS u FROM a), c AS (SELECT *, sum((NOT u)::INT) OVER (ORDER BY date {_rn}) AS g FROM b), e AS (SELECT run, g, count(*) AS n FROM c WHERE u GROUP BY 1, 2) SELECT run, max(n) AS longest, avg(n) AS mean FROM e GROUP BY 1")
add("r06_compare", "metric best", "value", lambda s, d: B.compare(B.metrics(_daily(s, d)), "total", "vol", "win"), f"WITH {_mt} SELECT unnest(['total', 'vol', 'win']) AS metric, run AS best, unnest([total, vol, win]) AS value FROM mt")
add("r07_excess", "date", "excess", lambda s, d: B.excess(*_with_bench(s, d)), f"WITH {DAILY}, bm AS (SELECT date, coalesce(avg(lr), 0) AS bench FROM panel GROUP BY 1) SELECT daily.date, net - bench AS excess FROM daily JOIN bm ON bm.date = daily.date")
add("r08_rolling", "date", "sharpe cum dd", lambda s, d: B.rolling_performance(_daily(s, d)), f"WITH {DAILY}, k AS (SELECT *, {gated('avg(net)', 'net', 63, key='run')} * sqrt(252) / nullif({gated('stddev_samp(net)', 'net', 63, key='run')}, 0) AS sharpe, product(1 + net) OVER (ORDER BY date {_rn}) - 1 AS cum FROM daily) SELECT date, sharpe, cum, (1 + cum) / max(1 + cum) OVER (ORDER BY date {_rn}) - 1 AS dd FROM k")

_pr = f"{DAILY}, bm AS (SELECT date, coalesce(avg(lr), 0) AS bench FROM panel GROUP BY 1), pr AS (SELECT daily.*, bench FROM daily LEFT JOIN bm ON bm.date = daily.date WHERE daily.date BETWEEN '1997-01-01' AND '1999-12-31')"
add("r09_period_report", "run n", "total bench_total relative worst best win exposure worst_five best_five win_week win_month", lambda s, d: B.period_report(*_with_bench(s, d), "1997-01-01", "1999-12-31"),
    f"""WITH {_pr}, a AS (SELECT run, count(*) AS n, sum(net) AS total, sum(bench) AS bench_total, min(net) AS worst, max(net) AS best, avg((net > 0)::INT) AS win, avg(net_exposure) AS exposure, list_sum(list_sort(list(net))[1:5]) AS worst_five, list_sum(list_reverse_sort(list(net))[1:5]) AS best_five FROM pr GROUP BY 1),
    wk AS (SELECT run, avg((r > 0)::INT) AS win_week FROM (SELECT run, date_trunc('week', date) AS u, sum(net) AS r FROM pr GROUP BY 1, 2) GROUP BY 1), mo AS (SELECT run, avg((r > 0)::INT) AS win_month FROM (SELECT run, date_trunc('month', date) AS u, sum(net) AS r FROM pr GROUP BY 1, 2) GROUP BY 1)
    SELECT *, total - bench_total AS relative FROM a JOIN wk USING (run) JOIN mo USING (run)""")  # fmt: skip
add("r09_period_months", "run month", "total bench_total", lambda s, d: B.period_months(*_with_bench(s, d)), f"WITH {DAILY}, bm AS (SELECT date, coalesce(avg(lr), 0) AS bench FROM panel GROUP BY 1) SELECT run, date_trunc('month', daily.date)::DATE AS month, sum(net) AS total, sum(bench) AS bench_total FROM daily LEFT JOIN bm ON bm.date = daily.date GROUP BY 1, 2")
EV = f"{BOOK}, e0 AS (SELECT p.date, p.ticker, p.price, coalesce(k.side, 0)::INTEGER AS held FROM panel p LEFT JOIN book k ON k.date = p.date AND k.ticker = p.ticker), e1 AS (SELECT *, coalesce({lagged('held')}, 0)::INTEGER AS prior FROM e0), ev AS (SELECT date, ticker, price, 'close' AS kind, prior AS side FROM e1 WHERE held <> prior AND prior <> 0 UNION ALL SELECT date, ticker, price, 'open', held FROM e1 WHERE held <> prior AND held <> 0)"
add("d02_position_events", K + " kind side", "price", lambda s, d: B.position_events(*_both(s, d)), f"WITH {EV} SELECT * FROM ev")
_ctx = ("score", "rank", "weight", "sector", "vol_63", "mom_126", "stress")


def _context(s, d, book, p):
    """What is known of a name on a book's date: score, rank, weight, sector, and the row before's volatility and momentum, and the date's stress."""
    scored = _scored(p).withColumns({"score": F.col("mom_21"), "rank": rank_pct("mom_21")}).select("date", "ticker", "score", "rank")
    before = T.entry_context(p).select("date", "ticker", "vol_63", "mom_126")
    dated = stress(s, d).select("date", (F.col("stress") * 600).alias("stress"))
    return with_sector(book, sectors(s, d)).select("date", "ticker", "weight", "sector").join(scored, ["date", "ticker"]).join(before, ["date", "ticker"]).join(dated, "date", "left")


def _in_context(s, d):
    book, p = _both(s, d)
    return B.position_context(B.position_events(book, p), _context(s, d, book, p), *_ctx)


_e = "PARTITION BY ticker ORDER BY date"
CTX = f"""{EV}, {SECTORS}, cx AS (SELECT date, ticker, mom_21 AS score, {sql_rank('mom_21')} AS rank, lag(v63) OVER ({_e}) AS vol_63, lag(m126) OVER ({_e}) AS mom_126
  FROM (SELECT *, {gated('stddev_samp(lr)', 'lr', 63)} * sqrt(252) AS v63, {gated('sum(lr)', 'lr', 126)} AS m126 FROM m)), st AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, avg(l_discount) * 600 AS stress FROM lineitem GROUP BY 1),
op AS (SELECT ev.*, score, cx.rank, book.weight, coalesce(s.sector, 'Unknown') AS sector, vol_63, mom_126, stress FROM ev JOIN cx ON cx.date = ev.date AND cx.ticker = ev.ticker JOIN book ON book.date = ev.date AND book.ticker = ev.ticker LEFT JOIN sectors s ON s.ticker = ev.ticker LEFT JOIN st ON st.date = ev.date WHERE kind = 'open'),
cl AS (SELECT ev.*, (SELECT max(o.date) FROM op o WHERE o.ticker = ev.ticker AND o.date < ev.date) AS entered FROM ev WHERE kind = 'close')"""
add("d02_position_context", K + " kind side entry_date entry_sector", "entry_price entry_score entry_rank entry_weight entry_vol_63 entry_mom_126 entry_stress exit_price pnl", _in_context,
    f"""WITH {CTX}, al AS (SELECT op.*, op.date AS entered, NULL::DOUBLE AS exit_price FROM op UNION ALL SELECT cl.date, cl.ticker, cl.price, 'close', cl.side, o.score, o.rank, o.weight, o.sector, o.vol_63, o.mom_126, o.stress, cl.entered, cl.price FROM cl JOIN op o ON o.ticker = cl.ticker AND o.date = cl.entered)
    SELECT al.date, al.ticker, kind, side, entered AS entry_date, sector AS entry_sector, o.price AS entry_price, score AS entry_score, rank AS entry_rank, weight AS entry_weight, vol_63 AS entry_vol_63, mom_126 AS entry_mom_126, stress AS entry_stress, exit_price, side * (exit_price / o.price - 1) AS pnl
    FROM al JOIN (SELECT ticker, date, price FROM op) o ON o.ticker = al.ticker AND o.date = al.entered""")  # fmt: skip
TR = f"{EV}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM ev WHERE kind = 'open'), c AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM ev WHERE kind = 'close'), tr AS (SELECT o.ticker, o.side, o.date AS entry, c.date AS exit, o.side * (c.price / o.price - 1) AS pnl, datediff('day', o.date, c.date)::INTEGER AS hold_days FROM o JOIN c ON c.ticker = o.ticker AND c.n = o.n)"
add("d03_match_trades", "ticker side entry exit hold_days", "pnl", lambda s, d: B.match_trades(B.position_events(*_both(s, d))), f"WITH {TR} SELECT * FROM tr")
_fwd = lambda h: f"CASE WHEN count(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} AND row_number() OVER (PARTITION BY ticker ORDER BY date) >= {h} THEN sum(lr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END"
IC = f"{PANEL}, {M21}, i0 AS (SELECT *, {_fwd(5)} AS fwd FROM m), i1 AS (SELECT * FROM i0 WHERE mom_21 IS NOT NULL AND fwd IS NOT NULL), i2 AS (SELECT *, {sql_rank('mom_21')} AS a, {sql_rank('fwd')} AS b FROM i1), ic AS (SELECT date, 'all' AS ticker, corr(a, b) AS ic, count(*) AS n FROM i2 GROUP BY 1)"
add("d10_track_predictions", "date n", "ic ic_mean", lambda s, d: B.track_predictions(_mv(s, d), "mom_21", 5), f"WITH {IC}, k AS (SELECT * FROM ic WHERE n >= 10) SELECT date, n, ic, {gated('avg(ic)', 'ic', 20, 5)} AS ic_mean FROM k")


def _allowed(s, d):
    book, p = _both(s, d)
    return B.without_barred(book, B.stop_losses(book, p, 0.15))


add("d11_stop_losses", "ticker spell stop barred_until", "", lambda s, d: B.stop_losses(*_both(s, d), 0.15),
    f"WITH {EV}, s0 AS (SELECT *, (held = -1)::INT AS h FROM e0), s1 AS (SELECT *, (h = 1 AND coalesce({lagged('h')}, 0) = 0)::INT AS f FROM s0), s2 AS (SELECT *, (sum(f) OVER (PARTITION BY ticker ORDER BY date {_rn}))::BIGINT AS spell FROM s1), s3 AS (SELECT *, first_value(price) OVER (PARTITION BY ticker, spell ORDER BY date) AS p0 FROM s2 WHERE h = 1), sl AS (SELECT ticker, spell, min(date) AS stop, (min(date) + INTERVAL 21 DAY)::DATE AS barred_until FROM s3 WHERE price > p0 * 1.15 GROUP BY 1, 2) SELECT * FROM sl")
add("d11_without_barred", K + " side", "weight", _allowed, ORACLES["d11_stop_losses"].split("FROM (\n", 1)[1].rsplit("SELECT * FROM sl", 1)[0] + "SELECT k.date, k.ticker, k.side, k.weight FROM book k WHERE k.side <> -1 OR NOT EXISTS (SELECT 1 FROM sl WHERE sl.ticker = k.ticker AND k.date > sl.stop AND k.date <= sl.barred_until)")


def _ml(s, d):
    made = L.rank_target(_mv(s, d), 5).where("target is not null")
    return C.fill_median(made, "mom_21", "vol_21")


add("m02_ml_table", K, "target mom_21 vol_21", _ml, f"WITH {IC}, k AS (SELECT *, {sql_rank('fwd')} AS target FROM i0), t AS (SELECT * FROM k WHERE target IS NOT NULL) SELECT date, ticker, target, coalesce(mom_21, median(mom_21) OVER (PARTITION BY date), 0) AS mom_21, coalesce(vol_21, median(vol_21) OVER (PARTITION BY date), 0) AS vol_21 FROM t")
add("m06_m08_ic_metrics", "one", "ic sd ir objective", lambda s, d: M.ic_metrics(L.forward_return(_mv(s, d), 5), "mom_21", "fwd").withColumn("one", F.lit(1)), f"WITH {IC} SELECT 1 AS one, avg(ic) AS ic, stddev_samp(ic) AS sd, avg(ic) / stddev_samp(ic) AS ir, avg(ic) - .5 * stddev_pop(ic) AS objective FROM ic")
add("m09_sequences", K + " missing", "first_lr", lambda s, d: M.sequences(_mv(s, d), ["lr", "mom_21"]).withColumn("first_lr", F.element_at(F.element_at("sequence", 1), 1)), f"WITH {PANEL}, {M21}, k AS (SELECT date, ticker, list(lr) OVER w AS a, list(mom_21) OVER w AS b FROM m WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)), c AS (SELECT date, ticker, a, (len([x for x in a if x IS NULL]) + len([x for x in b if x IS NULL]))::INTEGER AS missing FROM k WHERE len(a) = 21) SELECT date, ticker, missing, coalesce(a[1], 0) AS first_lr FROM c WHERE missing <= 21")


def _scores(s, d):
    m = _mv(s, d)
    return m.select("date", "ticker", F.lit("a").alias("model"), F.col("mom_21").alias("score")).unionByName(m.select("date", "ticker", F.lit("b").alias("model"), F.col("volume").alias("score")))


add("m10_j10_rank_ensemble", K, "ensemble", lambda s, d: M.rank_ensemble(_scores(s, d), {"a": 3.0, "b": 1.0}), f"WITH {PANEL}, {M21}, a AS (SELECT date, ticker, {sql_rank('mom_21')} AS r FROM m), b AS (SELECT date, ticker, {sql_rank('volume')} AS r FROM m) SELECT a.date, a.ticker, .75 * a.r + .25 * b.r AS ensemble FROM a JOIN b ON a.date = b.date AND a.ticker = b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL", 10)
add("m11_single_split", K + " part", "", lambda s, d: M.single_split(_panel(s, d)), f"WITH {PANEL}, k AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM panel)) SELECT p.date, ticker, CASE WHEN k <= 21 THEN 'val' WHEN k <= 33 THEN 'gap' ELSE 'train' END AS part FROM panel p JOIN k ON k.date = p.date")
add("m12_latest_slice", K, "price", lambda s, d: M.latest_slice(_panel(s, d)), f"WITH {PANEL} SELECT date, ticker, price FROM panel WHERE date = (SELECT max(date) FROM panel)")
