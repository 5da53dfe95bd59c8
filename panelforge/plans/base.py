"""Registry of queries and the SQL of the panels they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PANEL = """
px AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, l_suppkey AS ticker, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE / sum(l_quantity) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
g AS (SELECT d.date, t.ticker, px.price AS p0, px.volume AS v0 FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT ticker FROM px) t LEFT JOIN px ON px.date = d.date AND px.ticker = t.ticker),
f AS (SELECT date, ticker, coalesce(p0, lag(p0) OVER w, lag(p0, 2) OVER w, lag(p0, 3) OVER w) AS price, coalesce(v0, lag(v0) OVER w, lag(v0, 2) OVER w, lag(v0, 3) OVER w) AS volume
      FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date)),
panel AS (SELECT *, ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM f)"""
SECTORS = """
sectors AS (SELECT s_suppkey AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MACRO = (
    PANEL
    + ","
    + SECTORS
    + """,
macro AS (
  SELECT p.date, 'market' AS ticker, avg(p.price) AS mkt, avg(p.price) FILTER (s.sector = 'AFRICA') AS s_africa, avg(p.price) FILTER (s.sector = 'AMERICA') AS s_america, avg(p.price) FILTER (s.sector = 'ASIA') AS s_asia,
         avg(p.price) FILTER (s.sector = 'EUROPE') AS s_europe, avg(p.price) FILTER (s.sector = 'MIDDLE EAST') AS s_mideast, any_value(x.stress) AS stress
  FROM panel p LEFT JOIN sectors s ON s.ticker = p.ticker JOIN (SELECT date_trunc('week', l_shipdate)::DATE AS date, avg(l_discount) AS stress FROM lineitem GROUP BY 1) x ON x.date = p.date GROUP BY p.date)"""
)
FACTS = """
facts AS (
  SELECT ticker, last_day(start + INTERVAL 2 MONTH)::DATE AS period_date, (last_day(start + INTERVAL 2 MONTH) + INTERVAL 45 DAY)::DATE AS filing_date, revenue, shares, cost, tax
  FROM (SELECT l_suppkey AS ticker, date_trunc('quarter', l_shipdate)::DATE AS start, sum(l_extendedprice) AS revenue, sum(l_quantity) AS shares, sum(l_extendedprice * l_discount) AS cost, sum(l_extendedprice * l_tax) AS tax FROM lineitem GROUP BY 1, 2))"""
EARNINGS = FACTS + """,
earnings AS (SELECT ticker, filing_date AS date, revenue AS eps_actual, lag(revenue) OVER (PARTITION BY ticker ORDER BY period_date) AS eps_estimated FROM facts)"""
TRADES = """
recs AS (SELECT user_id % 50 AS ticker, ts::DATE AS date, CASE event_type WHEN 'purchase' THEN 'A' WHEN 'signup' THEN 'D' ELSE 'M' END AS code, CASE WHEN event_id % 11 > 0 THEN value END AS price, event_id % 97 AS shares,
  ['Common Stock', 'Class A', 'Preferred', ''][event_id % 4 + 1] AS security, event_id % 7 AS reporter, ['Director', 'officer: CEO', '10 percent owner', 'Vice President', ''][event_id % 5 + 1] AS owner FROM events),
trades AS (SELECT ticker, date, code = 'A' AS is_buy, price * shares AS usd, reporter, regexp_matches(lower(owner), 'chief|ceo|cfo|coo|president|chairman') AS is_exec FROM recs WHERE code <> 'M' AND coalesce(price, 0) <> 0 AND (security = '' OR regexp_matches(lower(security), 'common|class')))"""
GRADES = """
graded AS (SELECT user_id % 50 AS ticker, ts, event_id, ts::DATE AS date, ['Sell', 'Underperform', 'Hold', 'Buy', 'Strong Buy', 'Overweight', ' market outperform', 'Sector Perform', 'In-Line', 'Accumulate', 'Reduce', 'strongsell', 'Top Pick', 'Not Rated'][(props->>'$.k')::BIGINT % 14 + 1] AS grade FROM events),
grades AS (SELECT *, lag(grade) OVER (PARTITION BY ticker ORDER BY ts, event_id) AS previous FROM graded)"""
ARTICLES = """
articles AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS headline, text AS summary, source AS symbol, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents)"""


def over(n: int, key: str = "ticker", ahead: int = 0) -> str:
    """SQL frame of the last n rows of a key (ahead: up to that many rows later)."""
    return f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND {f'{ahead} FOLLOWING' if ahead else 'CURRENT ROW'})"


def gated(agg: str, x: str, n: int, least: int | None = None, key: str = "ticker") -> str:
    """SQL aggregate over the last n rows, null unless enough of them have a value."""
    return f"CASE WHEN count({x}) {over(n, key)} >= {n if least is None else least} THEN {agg} {over(n, key)} END"


def lagged(x: str, k: int = 1, key: str = "ticker") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {key} ORDER BY date)"


def sql_rank(x: str, part: str = "date") -> str:
    """SQL percent rank with average ties."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}) END"


def add(name: str, keys: str, doubles: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    """Register a query; both sides return the named columns, doubles rounded alike."""
    plain, real = keys.split(), doubles.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(*plain, *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in real])

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"SELECT {', '.join(plain + [f'round(({c})::DOUBLE, {digits}) + 0.0 AS {c}' for c in real])} FROM (\n{sql.strip()}\n) q"
