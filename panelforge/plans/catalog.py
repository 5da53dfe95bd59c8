"""All registered queries of the panel operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.windows import rank_pct
from panelforge.operators import timeseries as T
from panelforge.plans import base
from panelforge.plans import books as _books  # noqa: F401
from panelforge.plans import events as _events  # noqa: F401
from panelforge.plans import files as _files  # noqa: F401
from panelforge.plans import panelwise as _panelwise  # noqa: F401
from panelforge.plans import risk as _risk  # noqa: F401
from panelforge.plans import streams as _streams  # noqa: F401
from panelforge.plans import timeseries as _timeseries  # noqa: F401
from panelforge.sources.panels import panel


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly panel, momentum and volatility, per-date rank, five best names of each date."""
    ranked = T.volatility(T.momentum(panel(spark, sf_dir), 21), 21).withColumn("score", rank_pct("mom_21"))
    best = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    return ranked.where("score is not null").withColumn("place", F.row_number().over(best)).where("place <= 5")


base.add(
    "flagship", "date ticker place", "mom_21 vol_21 score", flagship,
    f"""WITH {base.PANEL}, m AS (SELECT *, {base.gated('sum(lr)', 'lr', 21)} AS mom_21, {base.gated('stddev_samp(lr)', 'lr', 21)} * sqrt(252) AS vol_21 FROM panel),
    r AS (SELECT *, {base.sql_rank('mom_21')} AS score FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker)::INTEGER AS place FROM r WHERE score IS NOT NULL)
    SELECT * FROM k WHERE place <= 5""",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
