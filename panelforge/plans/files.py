"""Queries of the readers and writers (S): each writes whole tables, reads them back, and gives what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import book as B
from panelforge.plans.base import FACTS, PANEL, add
from panelforge.plans.books import DAILY, K, _daily, _mv
from panelforge.sources import panels as P
from panelforge.sources import tables as S
from panelforge.sources.panels import facts, table
from panelforge.sources.scratch import new_path


def _wide(s, d):
    path = new_path(s, "wide")
    S.write_wide_csv(P.prices(s, d), path, "price")
    return S.read_wide_csv(s, path, "price")


add("s01_wide_csv", K, "price", _wide, f"WITH {PANEL} SELECT date, ticker::VARCHAR AS ticker, p0 AS price FROM g")


def _keyed(s, d):
    path = new_path(s, "keyed")
    S.write_keyed_json(facts(s, d), path, "period_date", "revenue", "shares")
    return S.read_keyed_json(s, path, "struct<period_date:date,revenue:double,shares:double>", lines=True)


add("s02_keyed_json", "ticker period_date", "revenue shares", _keyed, f"WITH {FACTS} SELECT ticker::VARCHAR AS ticker, period_date, revenue, shares FROM facts", 4)


def _lines(s, d):
    path, e = new_path(s, "lines"), table(s, d, "events")
    day = F.when(F.col("event_id") % 5 == 0, "not a day").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    S.write_json_lines(e.select("event_id", day.alias("day"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("value")).alias("value")), path)
    return S.read_json_lines(s, path, "event_id bigint, day string, value double", "day")


add("s03_s07_json_lines", "event_id day", "value", _lines, "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts::DATE END AS day, CASE WHEN event_id % 7 > 1 THEN value END AS value FROM events")


def _predictions(s, d):
    path = new_path(s, "predictions")
    S.write_predictions(_mv(s, d).where("mom_21 is not null").select("date", "ticker", F.col("mom_21").alias("score")), path)
    return S.read_predictions(s, path)


add("s04_predictions", K, "score", _predictions, f"WITH {PANEL}, k AS (SELECT date, ticker, CASE WHEN count(lr) OVER w >= 21 THEN sum(lr) OVER w END AS score FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING)) SELECT date, ticker::VARCHAR AS ticker, score FROM k WHERE score IS NOT NULL")


def _results(s, d):
    path, daily = new_path(s, "results"), _daily(s, d).withColumnRenamed("run", "model")
    both = daily.unionByName(daily.withColumns({"model": F.lit("half"), "net": F.col("net") / 2}))
    totals = both.groupBy("model").agg(F.sum("net").alias("total"), F.min("net").alias("worst"), F.count("*").cast("double").alias("days"))
    S.write_results(totals.unpivot("model", ["total", "worst", "days"], "metric", "value"), both.select("model", "date", "net"), path)
    wide = s.read.option("header", True).csv(f"{path}/comparison_table").unpivot("metric", ["book", "half"], "model", "value").select("model", "metric", F.col("value").cast("double").alias("value"))
    kept = s.read.schema("model string, metrics map<string,double>").json(f"{path}/summary").select("model", F.explode("metrics").alias("metric", "summary"))
    days = s.read.schema("date date, net double, model string").option("header", True).csv(f"{path}/returns").groupBy("model").agg(F.sum("net").alias("returns"))
    return wide.join(kept, ["model", "metric"]).join(days, "model")


add("s06_results", "model metric", "value summary returns", _results,
    f"""WITH {DAILY}, b AS (SELECT run AS model, net FROM daily UNION ALL SELECT 'half', net / 2 FROM daily), t AS (SELECT model, sum(net) AS total, min(net) AS worst, count(*)::DOUBLE AS days FROM b GROUP BY 1),
    l AS (SELECT model, unnest(['total', 'worst', 'days']) AS metric, unnest([total, worst, days]) AS value, total AS returns FROM t) SELECT model, metric, value, value AS summary, returns FROM l""")  # fmt: skip


def _renamed(s, d):
    named = table(s, d, "supplier").select("s_suppkey", F.get(F.array(*[F.lit(x) for x in (*S.SERIES, "none")]), (F.col("s_suppkey") % 25).cast("int")).alias("name"))
    there = S.remap(named, "name", S.SERIES, "fund").drop("name")
    return S.remap_back(there, "fund", S.SERIES, "original")


_pairs = ", ".join(f"('{a}', '{b}')" for a, b in S.SERIES.items())
add("s09_series_and_back", "s_suppkey fund original", "", _renamed, f"WITH n(name, fund) AS (VALUES {_pairs}), k AS (SELECT s_suppkey, [{', '.join(repr(a) for a in [*S.SERIES, 'none'])}][s_suppkey % 25 + 1] AS name FROM supplier) SELECT s_suppkey, n.fund, b.name AS original FROM k JOIN n ON n.name = k.name JOIN n b ON b.fund = n.fund")


def _fields(s, d):
    p = table(s, d, "part")
    vendor = p.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_retailprice")).cast("string").alias("enterpriseValueMultiple"), (F.col("p_size") * 1.5).alias("evToEBITDA"), F.col("p_size").alias("marketCap"), F.lit("n/a").alias("revenueGrowth"))
    return S.canonical_fields(vendor, S.RATIOS, S.KEY_METRICS, S.GROWTH)


add("s10_canonical_fields", "p_partkey", "enterpriseToEbitda marketCap revenueGrowth", _fields, "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE p_size * 1.5 END AS enterpriseToEbitda, p_size AS marketCap, NULL AS revenueGrowth FROM part")
