"""Queries for point-in-time joins (J), fundamentals (V), text (N), aggregates (G), top-k and sets (K), sources (S)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.windows import rank_pct
from panelforge.operators import aggregates as G
from panelforge.operators import asof as J
from panelforge.operators import clean as C
from panelforge.operators import fundamentals as V
from panelforge.operators import text as N
from panelforge.operators import risk as R
from panelforge.plans.base import ARTICLES, EARNINGS, FACTS, GRADES, MACRO, PANEL, SECTORS, TRADES, add, sql_rank
from panelforge.sources import panels as P
from panelforge.sources import tables as S
from panelforge.sources.panels import articles, earnings, facts, grades, panel, sectors, table, trades, with_sector

K = "date ticker"


def _known(s, d):
    return J.as_of(panel(s, d), facts(s, d), "filing_date", "revenue", "shares", "cost", "tax", tie="period_date")


AS = f"{PANEL}, {FACTS}, kn AS (SELECT p.date, p.ticker, p.price, p.lr, f.revenue, f.shares, f.cost, f.tax FROM panel p ASOF LEFT JOIN facts f ON p.ticker = f.ticker AND p.date >= f.filing_date)"

add("s05_scan", "l_orderkey l_linenumber", "l_discount", lambda s, d: S.scan(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_discount"], F.col("l_quantity") > 49), "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_quantity > 49")
add("s08_bars", "event_id", "close vwap", lambda s, d: S.bars_from_json(table(s, d, "events").select("event_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("value").alias("c"), (F.col("value") * 2).alias("vw"))).alias("payload")), "payload"), "SELECT event_id, value AS close, value * 2 AS vwap FROM events")
add("s09_remap", "n_name series", "", lambda s, d: S.remap(table(s, d, "nation"), "n_name", {"FRANCE": "EWQ", "GERMANY": "EWG"}, "series"), "SELECT n_name, CASE n_name WHEN 'FRANCE' THEN 'EWQ' WHEN 'GERMANY' THEN 'EWG' ELSE n_name END AS series FROM nation")
add("s10_first_source", "p_partkey", "best", lambda s, d: S.first_source(table(s, d, "part").withColumns({"a": F.when(F.col("p_size") > 30, F.col("p_retailprice")), "b": F.when(F.col("p_size") > 10, F.col("p_size") * 1.0)}), "best", "a", "b", "p_partkey"), "SELECT p_partkey, coalesce(CASE WHEN p_size > 30 THEN p_retailprice END, CASE WHEN p_size > 10 THEN p_size END, p_partkey) AS best FROM part")

add("j01_as_of", K, "revenue shares", _known, f"WITH {AS} SELECT date, ticker, revenue, shares FROM kn")
add("j02_snap_forward", "ticker date slot", "", lambda s, d: J.snap_forward(earnings(s, d), P.prices(s, d).select("date").distinct(), "date"), f"WITH {PANEL}, {EARNINGS} SELECT e.ticker, e.date, (SELECT min(x.date) FROM (SELECT DISTINCT date FROM px) x WHERE x.date >= e.date) AS slot FROM earnings e")
add("j03_on_grid", K + " buyers", "buy_usd", lambda s, d: J.on_grid(P.trade_calendar(trades(s, d)), V.insider_daily(trades(s, d)), "buy_usd", "buyers"),
    f"WITH {TRADES}, c AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM trades) t CROSS JOIN (SELECT DISTINCT date FROM trades) d), y AS (SELECT ticker, date, sum(CASE WHEN is_buy THEN usd ELSE 0 END) AS buy_usd, count(DISTINCT CASE WHEN is_buy THEN reporter END) AS buyers FROM trades GROUP BY 1, 2) SELECT c.date, c.ticker, coalesce(buy_usd, 0) AS buy_usd, coalesce(buyers, 0) AS buyers FROM c LEFT JOIN y ON y.ticker = c.ticker AND y.date = c.date")


def _changes(s, d):
    """A name is added with its first price and removed with its last; those of the last date are members today."""
    p = P.prices(s, d).groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    last = P.prices(s, d).agg(F.max("date").alias("m"))
    changes = p.select(F.col("a").alias("date"), F.col("ticker").alias("added"), F.lit(None).cast("bigint").alias("removed")).unionByName(p.select(F.col("b").alias("date"), F.lit(None).cast("bigint").alias("added"), F.col("ticker").alias("removed")))
    return p.join(last, F.col("b") == F.col("m")).select("ticker"), changes


def _member(s, d):
    current, changes = _changes(s, d)
    return J.membership(current, changes, P.prices(s, d).select(F.date_trunc("month", "date").cast("date").alias("month")).distinct())


def _snapshots(s, d):
    return _member(s, d).where("month(month) % 3 = 1").withColumnRenamed("month", "date")


CHANGES = "a AS (SELECT ticker, min(date) AS a, max(date) AS b FROM px GROUP BY 1), e AS (SELECT ticker, a AS date, 'added' AS kind FROM a UNION ALL SELECT ticker, b, 'removed' FROM a)"
_state = "CASE k.kind WHEN 'added' THEN false WHEN 'removed' THEN true ELSE a.b = (SELECT max(date) FROM px) END"
_at = "k AS (SELECT sl.date, sl.ticker, arg_min(e.kind, (e.date, e.kind)) AS kind FROM sl JOIN e ON e.ticker = sl.ticker AND e.date >= sl.date GROUP BY 1, 2), mb AS (SELECT sl.date, sl.ticker FROM sl LEFT JOIN k ON k.date = sl.date AND k.ticker = sl.ticker LEFT JOIN a ON a.ticker = sl.ticker WHERE {})".format(_state)
_quarters = f"sl AS (SELECT DISTINCT date_trunc('month', x.date)::DATE AS date, t.ticker FROM px x CROSS JOIN a t WHERE month(x.date) % 3 = 1), {_at}"
add("j04_members_at", K, "", lambda s, d: J.members_at(panel(s, d).select("date", "ticker"), *_changes(s, d)), f"WITH {PANEL}, {CHANGES}, sl AS (SELECT date, ticker FROM panel), {_at} SELECT * FROM mb")
add("j04_intervals", "ticker since until", "", lambda s, d: J.member_intervals(*_changes(s, d)),
    f"""WITH {PANEL}, {CHANGES}, n AS (SELECT ticker, date, min(kind) AS kind, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM e GROUP BY 1, 2),
    sp AS (SELECT x.ticker, (y.date + 1)::DATE AS since, (x.date + 1)::DATE AS until, x.kind = 'removed' AS m FROM n x LEFT JOIN n y ON y.ticker = x.ticker AND y.i = x.i - 1 UNION ALL SELECT ticker, (b + 1)::DATE, NULL, b = (SELECT max(date) FROM px) FROM a) SELECT ticker, since, until FROM sp WHERE m""")  # fmt: skip
add("j05_latest_snapshot", "date snapshot members", "", lambda s, d: J.latest_snapshot(panel(s, d), _snapshots(s, d)).join(_snapshots(s, d).groupBy(F.col("date").alias("snapshot")).agg(F.count("*").alias("members")), "snapshot", "left"),
    f"WITH {PANEL}, {CHANGES}, {_quarters}, sg AS (SELECT date, count(*) AS members FROM mb GROUP BY 1) SELECT p.date, sg.date AS snapshot, sg.members FROM (SELECT DISTINCT date FROM panel) p ASOF LEFT JOIN sg ON p.date >= sg.date")
add("c14_member_gate", K, "price", lambda s, d: C.tradable(panel(s, d), 1500.0, _snapshots(s, d)),
    f"WITH {PANEL}, {CHANGES}, {_quarters}, sg AS (SELECT DISTINCT date FROM mb), w AS (SELECT p.date, sg.date AS q FROM (SELECT DISTINCT date FROM panel) p ASOF LEFT JOIN sg ON p.date >= sg.date) SELECT p.* FROM panel p JOIN w ON w.date = p.date WHERE price >= 1500 AND (q IS NULL OR EXISTS (SELECT 1 FROM mb WHERE mb.date = q AND mb.ticker = p.ticker))")
add("j04_membership", "month ticker", "", _member,
    f"WITH {PANEL}, a AS (SELECT ticker, min(date) AS a, max(date) AS b FROM px GROUP BY 1), e AS (SELECT ticker, a AS date, 'added' AS kind FROM a UNION ALL SELECT ticker, b, 'removed' FROM a), mo AS (SELECT DISTINCT date_trunc('month', date)::DATE AS month FROM px), sl AS (SELECT month, ticker FROM mo CROSS JOIN (SELECT ticker FROM a) t), k AS (SELECT sl.month, sl.ticker, arg_min(e.kind, (e.date, e.kind)) AS kind FROM sl JOIN e ON e.ticker = sl.ticker AND e.date >= sl.month GROUP BY 1, 2) SELECT sl.month, sl.ticker FROM sl LEFT JOIN k ON k.month = sl.month AND k.ticker = sl.ticker LEFT JOIN a ON a.ticker = sl.ticker WHERE CASE k.kind WHEN 'added' THEN false WHEN 'removed' THEN true ELSE a.b = (SELECT max(date) FROM px) END")
add("j06_common_rows", K, "revenue price", lambda s, d: J.common_rows([_known(s, d).where("revenue is not null").select("date", "ticker", "revenue"), panel(s, d).where("price is not null").select("date", "ticker", "price")], ["date", "ticker"]), f"WITH {AS} SELECT date, ticker, revenue, price FROM kn WHERE revenue IS NOT NULL AND price IS NOT NULL")
add("j07_outer_align", "ticker", "volume_a volume_b", lambda s, d: J.outer_align(P.prices(s, d).where("date = '1996-01-01'"), P.prices(s, d).where("date = '1996-01-08'"), ["ticker"], "volume"), f"WITH {PANEL} SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.volume, 0) AS volume_a, coalesce(b.volume, 0) AS volume_b FROM (SELECT * FROM px WHERE date = '1996-01-01') a FULL JOIN (SELECT * FROM px WHERE date = '1996-01-08') b ON a.ticker = b.ticker")
add("j08_lookup", K + " sector", "price", lambda s, d: with_sector(P.prices(s, d), sectors(s, d).where("sector <> 'ASIA'")), f"WITH {PANEL}, {SECTORS} SELECT date, px.ticker, coalesce(s.sector, 'Unknown') AS sector, price FROM px LEFT JOIN (SELECT * FROM sectors WHERE sector <> 'ASIA') s ON s.ticker = px.ticker")
add("j09_semi_anti", "s_suppkey", "", lambda s, d: table(s, d, "supplier").join(table(s, d, "lineitem").where("l_quantity > 49").select("l_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").join(sectors(s, d).where("sector = 'ASIA'"), F.col("s_suppkey") == F.col("ticker"), "left_anti"), f"WITH {SECTORS} SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AND s_suppkey NOT IN (SELECT ticker FROM sectors WHERE sector = 'ASIA')")
add("j11_overlap_counts", "date n near", "", lambda s, d: J.overlap_counts(P.prices(s, d), 10), f"WITH {PANEL}, n AS (SELECT date, count(*) AS n FROM px GROUP BY 1) SELECT date, n, (sum(n) OVER (ORDER BY date RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 10 DAY FOLLOWING))::BIGINT AS near FROM n")


def _ratios(s, d):
    return _known(s, d).withColumns({"pe": F.try_divide("revenue", "cost"), "roe": F.try_divide("cost", "revenue") - 0.05, "roa": F.try_divide("tax", "revenue"), "cr": F.try_divide("cost", "tax")})


RT = f"{AS}, rt AS (SELECT *, revenue / nullif(cost, 0) AS pe, cost / nullif(revenue, 0) - .05 AS roe, tax / nullif(revenue, 0) AS roa, cost / nullif(tax, 0) AS cr FROM kn)"
add("v01_yields", K, "y_pe y_roe", lambda s, d: V.yields(_ratios(s, d), "pe", "roe"), f"WITH {RT} SELECT date, ticker, CASE WHEN pe <> 0 THEN greatest(-10, least(10, 1 / pe)) END AS y_pe, CASE WHEN roe <> 0 THEN greatest(-10, least(10, 1 / roe)) END AS y_roe FROM rt")
add("v02_v05_quality_ranks", K, "q_roe q_roa q_cr", lambda s, d: V.quality_ranks(_ratios(s, d), ["roe", "roa"], ["cr"]), f"WITH {RT} SELECT date, ticker, {sql_rank('roe')} AS q_roe, {sql_rank('roa')} AS q_roa, 1 - ({sql_rank('cr')}) AS q_cr FROM rt")
add("v03_size", K, "size", lambda s, d: V.size(_known(s, d), "revenue"), f"WITH {AS} SELECT date, ticker, CASE WHEN revenue IS NOT NULL THEN ln(greatest(revenue, 1)) END AS size FROM kn")
add("v04_target_upside", "ticker filing_date", "upside", lambda s, d: V.target_upside(facts(s, d), panel(s, d), "revenue"), f"WITH {PANEL}, {FACTS}, l AS (SELECT ticker, max_by(price, date) AS p FROM panel WHERE price IS NOT NULL GROUP BY 1) SELECT f.ticker, filing_date, revenue / p - 1 AS upside FROM facts f JOIN l ON l.ticker = f.ticker")
add("v06_piotroski", K + " piotroski", "", lambda s, d: V.piotroski(_ratios(s, d), "roe", "roa", "pe", "cr", 26), f"WITH {RT} SELECT date, ticker, (coalesce(roe > 0, false)::INT + coalesce(roe > lag(roe, 26) OVER w, false)::INT + coalesce(roa > 0, false)::INT + coalesce(pe > lag(pe, 26) OVER w, false)::INT + coalesce(cr > 1, false)::INT)::INTEGER AS piotroski FROM rt WINDOW w AS (PARTITION BY ticker ORDER BY date)")
SL = f"{PANEL}, {EARNINGS}, sl AS (SELECT DISTINCT ticker, (SELECT min(x.date) FROM (SELECT DISTINCT date FROM px) x WHERE x.date >= e.date) AS event FROM earnings e), sp AS (SELECT sl.ticker, sl.event, p.price AS p0 FROM sl LEFT JOIN panel p ON p.ticker = sl.ticker AND p.date = sl.event WHERE sl.event IS NOT NULL)"
add("v07_earnings_drift", K + " days_since recent", "ret_since", lambda s, d: V.earnings_drift(panel(s, d), earnings(s, d)), f"WITH {SL} SELECT p.date, p.ticker, datediff('day', e.event, p.date)::INTEGER AS days_since, (datediff('day', e.event, p.date) < 5)::INTEGER AS recent, p.price / e.p0 - 1 AS ret_since FROM panel p ASOF LEFT JOIN sp e ON e.ticker = p.ticker AND p.date >= e.event")
add("v07_post_earnings", K + " days_since recent", "ret_since earn_day cs_days_since cs_ret_since cs_earn_day", lambda s, d: V.post_earnings(_r9(panel(s, d)), earnings(s, d)),
    f"""WITH {PANEL}, {EARNINGS}, p9 AS (SELECT * REPLACE (round(price, 9) AS price, round(lr, 9) AS lr) FROM panel), ed AS (SELECT DISTINCT ticker, date AS event FROM earnings), ev AS (SELECT ed.*, p.price AS p0, p.lr AS r0, p.date IS NOT NULL AS traded FROM ed LEFT JOIN p9 p ON p.ticker = ed.ticker AND p.date = ed.event),
    k AS (SELECT p.date, p.ticker, datediff('day', e.event, p.date)::INTEGER AS days_since, coalesce(datediff('day', e.event, p.date) < 5, false)::INTEGER AS recent, CASE WHEN p0 > 0 THEN p.price / p0 - 1 END AS ret_since, CASE WHEN traded THEN r0 ELSE 0 END AS earn_day FROM p9 p ASOF LEFT JOIN ev e ON e.ticker = p.ticker AND p.date >= e.event)
    SELECT *, {sql_rank('days_since')} AS cs_days_since, {sql_rank('ret_since')} AS cs_ret_since, {sql_rank('earn_day')} AS cs_earn_day FROM k""")  # fmt: skip


def _r9(df):
    """Prices and returns rounded alike on both sides, so that ranks agree."""
    return df.withColumns({c: F.round(c, 9) for c in ("price", "lr")})


def _ratings(s, d):
    """Grades, targets and coverage of a ticker from its records; one ticker in seven has no target, one in five no grade."""
    by = facts(s, d).groupBy("ticker").agg(F.max_by(F.round(F.col("revenue") / F.col("shares"), 4), "period_date").alias("t"), F.count("*").alias("coverage"), F.max("shares").alias("m"))
    return by.select("ticker", F.when(F.col("ticker") % 5 != 0, F.pmod(F.floor("m"), F.lit(5)) + 1).alias("recommendation"), F.when(F.col("ticker") % 7 != 0, F.col("t")).alias("target"), (F.col("coverage") % 4).alias("coverage"), F.pmod(F.floor("m"), F.lit(10)).alias("piotroski_score"), F.round(F.col("m") / 100, 4).alias("altman_z"))


RA = f"""{FACTS}, rs AS (SELECT ticker, arg_max(round(revenue / shares, 4), period_date) AS t, count(*) AS n, max(shares) AS m FROM facts GROUP BY 1), ra AS (SELECT ticker, CASE WHEN ticker % 5 <> 0 THEN floor(m)::BIGINT % 5 + 1 END AS recommendation, CASE WHEN ticker % 7 <> 0 THEN t END AS target, n % 4 AS coverage, floor(m)::BIGINT % 10 AS piotroski_score, round(m / 100, 4) AS altman_z FROM rs),
lp AS (SELECT ticker, arg_max(round(price, 9), date) AS p FROM panel WHERE price IS NOT NULL GROUP BY 1), sk AS (SELECT x.date, x.ticker, ra.* EXCLUDE (ticker), CASE WHEN p > 0 AND target <> 0 THEN round(target / p - 1, 9) END AS upside FROM panel x LEFT JOIN ra ON ra.ticker = x.ticker LEFT JOIN lp ON lp.ticker = x.ticker)"""
add("v04_analyst_features", K, "recommendation upside coverage cs_rec cs_upside cs_coverage", lambda s, d: V.analyst_features(_r9(panel(s, d)), _ratings(s, d)), f"WITH {PANEL}, {RA} SELECT *, 1 - ({sql_rank('recommendation')}) AS cs_rec, {sql_rank('upside')} AS cs_upside, {sql_rank('coverage')} AS cs_coverage FROM sk")
add("v24_score_features", K, "piotroski_score altman_z cs_piotroski_score cs_altman_z", lambda s, d: V.score_features(panel(s, d), _ratings(s, d), "piotroski_score", "altman_z"), f"WITH {PANEL}, {RA} SELECT *, {sql_rank('piotroski_score')} AS cs_piotroski_score, {sql_rank('altman_z')} AS cs_altman_z FROM sk")


def _estimates(s, d):
    """Estimates of a ticker by quarter: mean, highest and lowest price of its lines, revenue, number of lines."""
    lines = table(s, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("ticker"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("quarter")).agg(
        F.avg("l_extendedprice").alias("eps_avg"), F.max("l_extendedprice").alias("eps_high"), F.min("l_extendedprice").alias("eps_low"), F.sum("l_extendedprice").alias("revenue_avg"), F.count("*").alias("analysts"))


add("v23_estimates", "ticker quarter analysts", "eps_revision revenue_revision dispersion", lambda s, d: V.estimates(_estimates(s, d), "quarter"),
    """WITH e AS (SELECT l_suppkey AS ticker, date_trunc('quarter', l_shipdate)::DATE AS quarter, avg(l_extendedprice) AS a, max(l_extendedprice) AS h, min(l_extendedprice) AS l, sum(l_extendedprice) AS r, count(*) AS analysts FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, lead(a) OVER w AS a0, lead(r) OVER w AS r0, row_number() OVER w AS n, count(*) OVER (PARTITION BY ticker) AS c FROM e WINDOW w AS (PARTITION BY ticker ORDER BY quarter DESC))
    SELECT ticker, quarter, (a - a0) / nullif(abs(a0), 0) AS eps_revision, (r - r0) / nullif(abs(r0), 0) AS revenue_revision, (h - l) / nullif(abs(a), 0) AS dispersion, analysts FROM k WHERE n = 1 AND c > 1""")  # fmt: skip


def _all_ratios(s, d):
    f = facts(s, d)
    w = Window.partitionBy("ticker").orderBy("period_date")
    grown = f.withColumns({f"g_{c}": F.round(F.try_divide(c, F.lag(c).over(w)) - 1, 9) for c in ("revenue", "cost", "tax")})
    columns = ("revenue", "shares", "cost", "tax", "g_revenue", "g_cost", "g_tax")
    known = J.as_of(panel(s, d), grown, "filing_date", *columns, tie="period_date")
    ratio = lambda a, b: F.round(F.try_divide(a, b), 9)
    return known.withColumns({"roe": ratio("cost", "shares"), "roa": ratio("tax", "shares"), "gross": ratio("cost", "revenue"), "operating": ratio("tax", "revenue"), "net": ratio(F.col("cost") - F.col("tax"), "revenue"), "current": ratio("cost", "tax"), "debt": ratio("revenue", "cost"), "short_ratio": ratio("shares", "tax"), "short_share": ratio("tax", "cost")})


_up, _down = ["roe", "roa", "gross", "operating", "net", "g_revenue", "g_cost", "g_tax", "current", "short_ratio", "short_share"], ["debt"]
add("v02_v05_all_ranks", K, " ".join(f"q_{c}" for c in _up + _down), lambda s, d: V.quality_ranks(_all_ratios(s, d), _up, _down),
    f"""WITH {PANEL}, {FACTS}, gr AS (SELECT *, {', '.join(f"round({c} / nullif(lag({c}) OVER w, 0) - 1, 9) AS g_{c}" for c in ('revenue', 'cost', 'tax'))} FROM facts WINDOW w AS (PARTITION BY ticker ORDER BY period_date)),
    kn AS (SELECT p.date, p.ticker, f.* EXCLUDE (ticker) FROM panel p ASOF LEFT JOIN gr f ON p.ticker = f.ticker AND p.date >= f.filing_date),
    rt AS (SELECT *, round(cost / nullif(shares, 0), 9) AS roe, round(tax / nullif(shares, 0), 9) AS roa, round(cost / nullif(revenue, 0), 9) AS gross, round(tax / nullif(revenue, 0), 9) AS operating, round((cost - tax) / nullif(revenue, 0), 9) AS net, round(cost / nullif(tax, 0), 9) AS current, round(revenue / nullif(cost, 0), 9) AS debt, round(shares / nullif(tax, 0), 9) AS short_ratio, round(tax / nullif(cost, 0), 9) AS short_share FROM kn)
    SELECT date, ticker, {', '.join(f'{sql_rank(c)} AS q_{c}' for c in _up)}, 1 - ({sql_rank('debt')}) AS q_debt FROM rt""")  # fmt: skip
add("v03_beta", K, "beta cs_beta", lambda s, d: V.score_features(panel(s, d), R.stress_betas(panel(s, d), panel(s, d).groupBy("date").agg(F.avg("price").alias("level"))).withColumn("beta", F.round("beta", 7)), "beta"),
    f"""WITH {PANEL}, lv AS (SELECT date, avg(price) AS level FROM panel GROUP BY 1), mm AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS m FROM lv), sr AS (SELECT date, ticker, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM panel),
    bo AS (SELECT sr.ticker, sr.r, mm.m, row_number() OVER (PARTITION BY sr.ticker ORDER BY sr.date DESC) AS k FROM sr JOIN mm ON mm.date = sr.date WHERE sr.r IS NOT NULL AND mm.m IS NOT NULL),
    be AS (SELECT ticker, round(CASE WHEN count(*) > 50 THEN covar_samp(r, m) FILTER (k <= 252) / (var_samp(m) FILTER (k <= 252) + 1e-10) ELSE 1 END, 7) AS beta FROM bo GROUP BY 1), x AS (SELECT p.date, p.ticker, beta FROM panel p LEFT JOIN be ON be.ticker = p.ticker)
    SELECT *, {sql_rank('beta')} AS cs_beta FROM x""", 7)  # fmt: skip
SU = f"{EARNINGS}, s1 AS (SELECT *, CASE WHEN eps_estimated = 0 THEN 0 ELSE (eps_actual - eps_estimated) / abs(eps_estimated) END AS surprise, coalesce(eps_actual > eps_estimated, false)::INT AS beat, lag(eps_estimated) OVER (PARTITION BY ticker ORDER BY date) AS pe FROM earnings), s2 AS (SELECT *, sum(1 - beat) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM s1), su AS (SELECT *, least(sum(beat) OVER (PARTITION BY ticker, run ORDER BY date ROWS UNBOUNDED PRECEDING), 8)::INTEGER AS streak, CASE WHEN pe <> 0 THEN (eps_estimated - pe) / abs(pe) END AS revision FROM s2)"
add("v08_surprise", "ticker date streak", "surprise revision", lambda s, d: V.surprise(earnings(s, d)), f"WITH {SU} SELECT * FROM su")
add("v09_earnings_alpha", K, "surprise cs_surprise", lambda s, d: V.earnings_alpha(panel(s, d), earnings(s, d)),
    f"WITH {PANEL}, {SU}, sn AS (SELECT ticker, surprise, (SELECT min(x.date) FROM (SELECT DISTINCT date FROM px) x WHERE x.date >= su.date) AS slot FROM su), pk AS (SELECT * FROM sn WHERE slot IS NOT NULL AND surprise IS NOT NULL), al AS (SELECT p.date, p.ticker, k.surprise FROM panel p ASOF LEFT JOIN pk k ON k.ticker = p.ticker AND p.date >= k.slot) SELECT date, ticker, surprise, {sql_rank('surprise')} AS cs_surprise FROM al")
add("v10_snapshot", "symbol", "price prev change_pct", lambda s, d: V.snapshot(P.prices(s, d).select(F.col("ticker").alias("symbol"), "date", F.col("price").alias("close"))), f"WITH {PANEL}, k AS (SELECT ticker AS symbol, price, lead(price) OVER w AS prev, row_number() OVER w AS n FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date DESC)) SELECT symbol, price, prev, coalesce((price / prev - 1) * 100, 0) AS change_pct FROM k WHERE n = 1")
add("v11_insider_daily", K + " buyers sellers exec_buy", "buy_usd sell_usd", lambda s, d: V.insider_daily(trades(s, d)), f"WITH {TRADES} SELECT ticker, date, max((is_buy AND is_exec)::INTEGER) AS exec_buy, sum(CASE WHEN is_buy THEN usd ELSE 0 END) AS buy_usd, sum(CASE WHEN is_buy THEN 0 ELSE usd END) AS sell_usd, count(DISTINCT CASE WHEN is_buy THEN reporter END) AS buyers, count(DISTINCT CASE WHEN NOT is_buy THEN reporter END) AS sellers FROM trades GROUP BY ALL", 4)
_id = f"{TRADES}, c AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM trades) t CROSS JOIN (SELECT DISTINCT date FROM trades) d), y AS (SELECT ticker, date, sum(CASE WHEN is_buy THEN usd ELSE -usd END) AS net, count(DISTINCT CASE WHEN is_buy THEN reporter END) AS buyers, count(DISTINCT CASE WHEN NOT is_buy THEN reporter END) AS sellers, max((is_buy AND is_exec)::INTEGER) AS eb FROM trades GROUP BY 1, 2), z AS (SELECT c.date, c.ticker, coalesce(eb, 0) AS eb, coalesce(net, 0) AS net, coalesce(buyers, 0) AS buyers, coalesce(sellers, 0) AS sellers FROM c LEFT JOIN y ON y.ticker = c.ticker AND y.date = c.date)"
add("v12_insider_features", K + " n_buyers n_sellers exec_flag", "net_usd net_log cs_net_log cs_net_count", lambda s, d: V.insider_features(P.trade_calendar(trades(s, d)), V.insider_daily(trades(s, d)).withColumns({c: F.round(c, 6) for c in ("buy_usd", "sell_usd")})).withColumn("net_usd", F.round("net_usd", 4)),
    f"WITH {_id}, u AS (SELECT date, ticker, sum(buyers) OVER w AS n_buyers, sum(sellers) OVER w AS n_sellers, sum(round(net, 6)) OVER w AS net_usd, max(eb) OVER (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING) AS exec_flag FROM z WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)), v AS (SELECT *, sign(net_usd) * ln(1 + abs(net_usd)) AS net_log, n_buyers - n_sellers AS net_count FROM u) SELECT date, ticker, n_buyers::BIGINT AS n_buyers, n_sellers::BIGINT AS n_sellers, exec_flag, net_usd, net_log, {sql_rank('net_log')} AS cs_net_log, {sql_rank('net_count')} AS cs_net_count FROM v", 4)
add("v13_insider_snapshot", "ticker n_buys n_sells buyers", "buy_usd buy_ratio buy_log", lambda s, d: V.insider_snapshot(trades(s, d)), f"WITH {TRADES}, k AS (SELECT ticker, count(*) FILTER (is_buy) AS n_buys, count(*) FILTER (NOT is_buy) AS n_sells, sum(CASE WHEN is_buy THEN usd ELSE 0 END) AS buy_usd, count(DISTINCT CASE WHEN is_buy THEN reporter END) AS buyers FROM trades GROUP BY 1) SELECT *, coalesce(n_buys / nullif(n_buys + n_sells, 0), .5) AS buy_ratio, ln(1 + buy_usd) AS buy_log FROM k", 4)
# Written out here, so that the operator's own table is not checked against itself.
_gs = """CASE WHEN lower(trim({0})) IN ('strong buy', 'buy', 'outperform', 'overweight', 'top pick') THEN 5 WHEN lower(trim({0})) IN ('accumulate', 'market outperform', 'moderate buy', 'add') THEN 4
  WHEN lower(trim({0})) IN ('hold', 'neutral', 'sector perform', 'in-line', 'peer perform', 'equal-weight') THEN 3 WHEN lower(trim({0})) IN ('underperform', 'reduce', 'underweight') THEN 2 WHEN lower(trim({0})) IN ('sell', 'strongsell') THEN 1 END"""
GS = f"{GRADES}, g1 AS (SELECT *, {_gs.format('grade')} AS score, {_gs.format('previous')} AS prev_score FROM grades), gs AS (SELECT *, coalesce(CASE WHEN prev_score IS NOT NULL THEN score > prev_score ELSE score >= 4 END, false) AS is_up, coalesce(CASE WHEN prev_score IS NOT NULL THEN score < prev_score ELSE score <= 2 END, false) AS is_down FROM g1)"
add("v14_grade_scores", "event_id is_up is_down", "score prev_score", lambda s, d: V.grade_scores(grades(s, d)), f"WITH {GS} SELECT * FROM gs")
add("v15_grade_features", K + " up_21 down_21 net_42", "consensus", lambda s, d: V.grade_features(P.trade_calendar(grades(s, d)), V.grade_scores(grades(s, d))),
    f"WITH {GS}, c AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM gs) t CROSS JOIN (SELECT DISTINCT date FROM gs) d), y AS (SELECT ticker, date, count(*) FILTER (is_up) AS u, count(*) FILTER (is_down) AS w, sum(score) AS t, count(score) AS n FROM gs GROUP BY 1, 2), z AS (SELECT c.date, c.ticker, coalesce(u, 0) AS u, coalesce(w, 0) AS w, coalesce(t, 0) AS t, coalesce(n, 0) AS n FROM c LEFT JOIN y ON y.ticker = c.ticker AND y.date = c.date) SELECT date, ticker, (sum(u) OVER (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))::BIGINT AS up_21, (sum(w) OVER (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING))::BIGINT AS down_21, (sum(u - w) OVER (PARTITION BY ticker ORDER BY date ROWS 41 PRECEDING))::BIGINT AS net_42, sum(t) OVER (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING) / nullif(sum(n) OVER (PARTITION BY ticker ORDER BY date ROWS 62 PRECEDING), 0) AS consensus FROM z")
add("v16_merge_statements", "ticker period_date", "revenue cost tax", lambda s, d: V.merge_statements(facts(s, d).where("revenue > 300000").select("ticker", "period_date", "revenue", "cost"), facts(s, d).where("revenue < 600000").select("ticker", "period_date", "revenue", "tax"), "revenue"), f"WITH {FACTS} SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.period_date, b.period_date) AS period_date, coalesce(nullif(a.revenue, 0), b.revenue, a.revenue) AS revenue, a.cost, b.tax FROM (SELECT * FROM facts WHERE revenue > 300000) a FULL JOIN (SELECT * FROM facts WHERE revenue < 600000) b ON a.ticker = b.ticker AND a.period_date = b.period_date", 4)
_eq = "CASE WHEN count(cost) OVER f4 = 4 THEN sum(cost + tax) OVER f4 END"
def _statements(s, d):
    return facts(s, d).select("ticker", "filing_date", "period_date", F.col("revenue").alias("net_income"), F.col("cost").alias("operating_cash_flow"), (F.col("revenue") * 2).alias("total_assets"), F.col("shares").alias("shares_out"), (-F.col("cost")).alias("dividends_paid"), F.when(F.col("shares") > 100, -F.col("tax")).alias("stock_repurchases"))


EQ = f"""{PANEL}, {FACTS}, q0 AS (SELECT ticker, filing_date, revenue, cost, revenue * 2 AS assets, shares, cost + CASE WHEN shares > 100 THEN tax ELSE 0 END AS given FROM facts),
q1 AS (SELECT *, lag(assets, 4) OVER (PARTITION BY ticker ORDER BY filing_date) AS a4, sum(given) OVER w AS returned, count(*) OVER w AS c FROM q0 WINDOW w AS (PARTITION BY ticker ORDER BY filing_date ROWS 3 PRECEDING)),
q2 AS (SELECT q1.*, x.price AS px FROM q1 ASOF LEFT JOIN (SELECT ticker, date, price FROM panel WHERE price IS NOT NULL) x ON x.ticker = q1.ticker AND q1.filing_date >= x.date),
q3 AS (SELECT *, CASE WHEN c = 4 AND returned > 0 AND shares > 0 AND px > 0 THEN returned / (px * shares) END AS hy FROM q2),
eq AS (SELECT ticker, filing_date, CASE WHEN assets > 0 THEN (revenue - cost) / assets END AS accruals, CASE WHEN a4 > 0 AND assets > 0 THEN assets / a4 - 1 END AS growth, CASE WHEN hy < 1 THEN hy END AS holder_yield FROM q3)"""
add("v17_v19_earnings_quality", "ticker filing_date", "accruals growth holder_yield", lambda s, d: V.earnings_quality(_statements(s, d), panel(s, d)), f"WITH {EQ} SELECT * FROM eq")
_v20 = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY -{c} NULLS LAST) + (count({c}) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) END"
add("v20_quality_as_of", K, "accruals growth r_accruals r_growth", lambda s, d: J.as_of(panel(s, d), V.earnings_quality(_statements(s, d), panel(s, d)), "filing_date", "accruals", "growth", tie="period_date").withColumns({f"r_{c}": rank_pct(-F.col(c)) for c in ("accruals", "growth")}),
    f"WITH {EQ}, q AS (SELECT p.date, p.ticker, accruals, growth FROM panel p ASOF LEFT JOIN eq ON eq.ticker = p.ticker AND p.date >= eq.filing_date) SELECT date, ticker, accruals, growth, {_v20('accruals')} AS r_accruals, {_v20('growth')} AS r_growth FROM q")


def _options(s, d):
    return table(s, d, "events").select((F.col("user_id") % 50).alias("ticker"), F.when(F.col("event_type") == "purchase", "put").otherwise("call").alias("kind"), F.col("value").alias("iv"), (F.col("event_id") % 100).cast("double").alias("vol"))


add("v21_option_skew", "ticker", "iv_skew pc_ratio call_iv", lambda s, d: V.option_skew(_options(s, d), "kind", "iv", "vol"), "WITH o AS (SELECT user_id % 50 AS ticker, event_type = 'purchase' AS put, value AS iv, (event_id % 100)::DOUBLE AS vol FROM events) SELECT ticker, median(iv) FILTER (put) - median(iv) FILTER (NOT put) AS iv_skew, sum(CASE WHEN put THEN vol ELSE 0 END) / greatest(sum(CASE WHEN put THEN 0 ELSE vol END), 1) AS pc_ratio, median(iv) FILTER (NOT put) AS call_iv FROM o GROUP BY 1")
add("v22_v23_latest_change", "ticker period_date", "revenue_rev shares_rev", lambda s, d: V.latest_change(facts(s, d), "period_date", "revenue", "shares"), f"WITH {FACTS}, k AS (SELECT *, (revenue - lead(revenue) OVER w) / nullif(abs(lead(revenue) OVER w), 0) AS revenue_rev, (shares - lead(shares) OVER w) / nullif(abs(lead(shares) OVER w), 0) AS shares_rev, row_number() OVER w AS n FROM facts WINDOW w AS (PARTITION BY ticker ORDER BY period_date DESC)) SELECT * FROM k WHERE n = 1")
add("v24_v25_weighted", K, "ws cs_ws", lambda s, d: V.weighted_sentiment(panel(s, d), "lr", "volume"), f"WITH {PANEL}, k AS (SELECT *, lr * volume AS ws FROM panel) SELECT date, ticker, ws, {sql_rank('ws')} AS cs_ws FROM k")

POS, NEG, NOT, VERY = ["the", "and", "reer", "to"], ["of", "in", "that"], ["is", "not"], ["a", "on"]
_l = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
HS = f"{ARTICLES}, h1 AS (SELECT *, regexp_extract_all(lower(coalesce(headline, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM articles), hs AS (SELECT *, greatest(-1, least(1, coalesce(list_sum([(CASE WHEN list_contains({_l(POS)}, t[i]) THEN 1.0 WHEN list_contains({_l(NEG)}, t[i]) THEN -1.0 ELSE 0 END)::DOUBLE * CASE WHEN coalesce(list_contains({_l(NOT)}, t[i - 1]) AND i > 1, false) OR coalesce(list_contains({_l(NOT)}, t[i - 2]) AND i > 2, false) THEN -.8 ELSE 1 END * CASE WHEN coalesce(list_contains({_l(VERY)}, t[i - 1]) AND i > 1, false) THEN 1.5 ELSE 1 END for i in range(1, len(t) + 1)]), 0) / (sqrt(len(t)) + 1e-8))) AS score FROM h1)"


def _scored(s, d):
    return N.headline_score(articles(s, d), "headline", POS, NEG, NOT, VERY)


add("n01_headline_score", "id", "score", _scored, f"WITH {HS} SELECT id, score FROM hs")
add("n02_bag_score", "id", "bag", lambda s, d: N.bag_score(articles(s, d), "summary", POS, NEG), f"WITH {ARTICLES}, t AS (SELECT id, list_distinct(regexp_split_to_array(lower(coalesce(summary, '')), '\\s+')) AS t FROM articles), k AS (SELECT id, len(list_intersect(t, {_l(POS)})) AS p, len(list_intersect(t, {_l(NEG)})) AS n FROM t) SELECT id, (p - n) / greatest(p + n, 1) AS bag FROM k")
ST = f"{HS}, sy AS (SELECT DISTINCT source AS symbol FROM documents), k AS (SELECT symbol, avg(score) AS mean, max(score) AS best, min(score) AS worst, stddev_pop(score) AS sd, count(*) AS n, avg((score > 0)::INT) AS pos, avg((score < 0)::INT) AS neg FROM hs GROUP BY 1), st AS (SELECT sy.symbol, coalesce(mean, 0) AS mean, coalesce(best, 0) AS best, coalesce(worst, 0) AS worst, coalesce(sd, 0) AS sd, coalesce(n, 0) AS n, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM sy LEFT JOIN k ON k.symbol = sy.symbol)"


def _stats(s, d):
    return N.sentiment_stats(_scored(s, d), table(s, d, "documents").select(F.col("source").alias("symbol")).distinct(), "score")


add("n03_sentiment_stats", "symbol n", "mean best worst sd pos neg", _stats, f"WITH {ST} SELECT * FROM st")
add("n04_newest", "symbol id place", "", lambda s, d: N.newest(articles(s, d)), f"WITH {ARTICLES}, k AS (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, id)::INTEGER AS place FROM articles) SELECT * FROM k WHERE place <= 10")
_n5 = ("mean", "best", "worst", "sd", "n", "pos")
add("n05_sentiment_features", "symbol", "mean sd pos " + " ".join(f"cs_{c}" for c in _n5) + " composite", lambda s, d: N.sentiment_features(_stats(s, d).withColumns({c: F.round(c, 9) for c in _n5 if c != "n"})),
    f"WITH {ST}, r AS (SELECT symbol, 0 AS date, n, {', '.join(f'round({c}, 9) AS {c}' for c in _n5 if c != 'n')} FROM st), q AS (SELECT symbol, mean, sd, pos, {', '.join(f'{sql_rank(c)} AS cs_{c}' for c in _n5)} FROM r) SELECT *, (cs_mean + cs_pos + cs_best) / 3 AS composite FROM q")
add("n06_unseen", "id hash", "", lambda s, d: N.unseen(articles(s, d), N.article_hash(articles(s, d).where("id % 3 = 0"))), f"WITH {ARTICLES}, h AS (SELECT id, substr(md5(headline || ':' || symbol), 1, 12) AS hash FROM articles) SELECT id, hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE id % 3 = 0)")
_dc = "greatest(.01, least(1, pow(.5, (epoch(TIMESTAMP '2024-01-02') - epoch(created_at)) / 3600.0 / 6)))"
add("n07_decay", "id", "decay", lambda s, d: N.decay(articles(s, d), "2024-01-02 00:00:00"), f"WITH {ARTICLES} SELECT id, {_dc} AS decay FROM articles")
add("n08_decayed_sentiment", "symbol", "sentiment magnitude volume", lambda s, d: N.decayed_sentiment(N.decay(_scored(s, d), "2024-01-02 00:00:00").withColumn("m", F.abs("score") + 0.1), "score", "m"), f"WITH {HS}, k AS (SELECT *, {_dc} AS decay, abs(score) + .1 AS m FROM hs) SELECT symbol, sum(score * decay * m) / nullif(sum(decay * m), 0) AS sentiment, avg(m) AS magnitude, least(count(*) / 10, 1) AS volume FROM k GROUP BY 1")
_kinds = ("earnings", "analyst", "regulatory", "ma", "product", None)
add("n08_news_features", "symbol event_earnings event_analyst event_regulatory event_ma", "sentiment magnitude volume",
    lambda s, d: N.news_features(N.decay(_scored(s, d), "2024-01-02 00:00:00").withColumns({"m": F.abs("score") + 0.1, "kind": F.get(F.array(*[F.lit(k) for k in _kinds]), (F.col("id") % 97 % 6).cast("int"))}), "score", "m", "kind"),
    f"WITH {HS}, k AS (SELECT *, {_dc} AS decay, abs(score) + .1 AS m, id % 97 % 6 AS e FROM hs) SELECT symbol, round(CASE WHEN sum(decay * m) > 0 THEN sum(score * decay * m) / sum(decay * m) ELSE 0 END, 4) AS sentiment, round(avg(m), 4) AS magnitude, least(count(*) / 10, 1) AS volume, max((e = 0)::INT) AS event_earnings, max((e = 1)::INT) AS event_analyst, max((e = 2)::INT) AS event_regulatory, max((e = 3)::INT) AS event_ma FROM k GROUP BY 1")
add("n09_title", "event_id title", "", lambda s, d: N.title(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("title "), "event_type").alias("title")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.struct(F.col("event_type").alias("title")).alias("content")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("headline")))).alias("payload")), "payload"), "SELECT event_id, CASE WHEN length(CASE WHEN event_id % 3 = 0 THEN 'title ' ELSE '' END || event_type) > 5 THEN CASE WHEN event_id % 3 = 0 THEN 'title ' ELSE '' END || event_type END AS title FROM events")

add("g01_counts", "ticker n kinds", "usd", lambda s, d: trades(s, d).groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("reporter").alias("kinds"), F.sum("usd").alias("usd")), f"WITH {TRADES} SELECT ticker, count(*) AS n, count(DISTINCT reporter) AS kinds, sum(usd) AS usd FROM trades GROUP BY 1", 4)
add("g02_moments", "ticker", "mean sd skew kurt med p10 p90", lambda s, d: G.moments(panel(s, d), "lr", "ticker"), f"WITH {PANEL} SELECT ticker, avg(lr) AS mean, stddev_samp(lr) AS sd, skewness(lr) AS skew, kurtosis(lr) AS kurt, median(lr) AS med, quantile_cont(lr, .1) AS p10, quantile_cont(lr, .9) AS p90 FROM panel GROUP BY 1")
add("g03_correlations", "date", "pearson spearman", lambda s, d: G.correlations(panel(s, d), "price", "volume", "date"), f"WITH {PANEL}, k AS (SELECT date, price, volume FROM panel WHERE price IS NOT NULL AND volume IS NOT NULL), r AS (SELECT *, {sql_rank('price')} AS a, {sql_rank('volume')} AS b FROM k) SELECT date, corr(price, volume) AS pearson, corr(a, b) AS spearman FROM r GROUP BY 1")
add("g04_sector_sums", "date top", "share", lambda s, d: G.top_sector(with_sector(P.prices(s, d), sectors(s, d)), "volume"), f"WITH {PANEL}, {SECTORS}, k AS (SELECT date, coalesce(s.sector, 'Unknown') AS sector, sum(volume) AS v FROM px LEFT JOIN sectors s ON s.ticker = px.ticker GROUP BY 1, 2) SELECT date, max_by(sector, (v, sector)) AS top, max(v) / sum(v) AS share FROM k GROUP BY 1")
for _u in ("month", "week"):
    add(f"g05_resample_{_u}", f"{_u} ticker", "comp total", lambda s, d, u=_u: G.resample(panel(s, d), u), f"WITH {PANEL} SELECT date_trunc('{_u}', date)::DATE AS {_u}, ticker, exp(sum(lr)) - 1 AS comp, sum(lr) AS total FROM panel WHERE lr IS NOT NULL GROUP BY 1, 2")
add("g06_ewm_cov", "a b", "cov", lambda s, d: G.ewm_covariance(P.macro(s, d), ["s_asia", "s_europe", "s_africa"], 63), f"WITH {MACRO}, w AS (SELECT *, pow(.5, (row_number() OVER (ORDER BY date DESC) - 1) / 63.0) AS w, " + ", ".join(f"{c} - avg({c}) OVER () AS d_{c}" for c in ("s_asia", "s_europe", "s_africa")) + " FROM macro) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, sum(w * d_{a} * d_{b}) / sum(w) AS cov FROM w" for i, a in enumerate(("s_asia", "s_europe", "s_africa")) for b in ("s_asia", "s_europe", "s_africa")[i:]), 4)
add("g07_weighted_mean", "l_suppkey", "wm", lambda s, d: G.weighted_mean(table(s, d, "lineitem"), "l_discount", "l_quantity", "l_suppkey"), "SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS wm FROM lineitem GROUP BY 1")
add("g08_buckets", "bucket n", "mean sd total", lambda s, d: G.quantile_buckets(panel(s, d).where("lr is not null"), "volume", "lr", 5), f"WITH {PANEL}, k AS (SELECT * FROM panel WHERE lr IS NOT NULL), q AS (SELECT list_distinct(quantile_cont(volume, [.2, .4, .6, .8])) AS cuts FROM k), b AS (SELECT len([c for c in cuts if c < volume])::INTEGER AS bucket, lr FROM k, q) SELECT bucket, count(*) AS n, avg(lr) AS mean, stddev_samp(lr) AS sd, sum(lr) AS total FROM b GROUP BY 1")
add("g09_item_frequency", "item n", "", lambda s, d: G.item_frequency(table(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("items")), "items"), "SELECT o_orderpriority AS item, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
add("k01_top", "o_orderkey", "o_totalprice", lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", 2)
for _end, _order in (("top", "DESC"), ("bottom", "ASC")):
    add(f"k02_k03_{_end}_by_date", "date ticker place", "lr", lambda s, d, e=_end: G.top_by_date(panel(s, d).where("lr is not null"), "lr", 5, e == "bottom"), f"WITH {PANEL}, k AS (SELECT date, ticker, lr, row_number() OVER (PARTITION BY date ORDER BY lr {_order}, ticker)::INTEGER AS place FROM panel WHERE lr IS NOT NULL) SELECT * FROM k WHERE place <= 5")
add("k04_set_operations", "k kind", "", lambda s, d: G.set_operations(table(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")), table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))), "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 5000) SELECT k, 'union' AS kind FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'except' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
add("k05_concat", K, "lr", lambda s, d: panel(s, d).where("date < '1997-01-01'").select("date", "ticker", "lr").unionByName(panel(s, d).where("date >= '2000-01-01'").select("lr", "ticker", "date")), f"WITH {PANEL} SELECT date, ticker, lr FROM panel WHERE date < '1997-01-01' OR date >= '2000-01-01'")
