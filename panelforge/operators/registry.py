"""Feature registry: named transforms of a panel, planned as one table.

A feature is a function ``fn(df, cfg) -> df`` that adds the columns it names.  It says what it needs together: the rows
of a ``ticker`` in date order, or the tickers of a ``date``.  ``build`` runs all features of the first kind, then
all of the second, so the whole table takes one exchange by ticker and one by date, whatever the number of features.
A feature of a date that needs a row only (``rowwise``) or says how it is made ``inside`` a cross-section leaves the rows free to
move as compressed blocks; ranks are made there as well.

``ml_table`` makes the modelling table of it: rows with a target, without columns that are too often missing,
what is still missing filled with the date's median, then with 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scans import fill_cross_section, filled, over_sections, pct_rank, with_ranks
from panelforge.operators import clean, crosssec, labels
from panelforge.operators import timeseries as T
from panelforge.sources.scratch import sweep, written

STAGES = ("ticker", "date")


@dataclass(frozen=True)
class Config:
    """Windows of the features and the horizon of the target, in rows of the calendar."""

    momentum: tuple[int, ...] = (5, 21, 63, 126, 252)
    reversion: tuple[int, ...] = (5, 21)
    volatility: tuple[int, ...] = (5, 21, 63)
    volume: tuple[int, ...] = (5, 21)
    reversal: tuple[int, ...] = (1, 5)
    consistency: tuple[int, ...] = (21, 63)
    horizon: int = 5
    missing: float = 0.3


@dataclass(frozen=True)
class Feature:
    name: str
    stage: str
    columns: Callable[[Config], list[str]]
    fn: Callable[[DataFrame, Config], DataFrame]
    rowwise: bool = False
    #: The columns that ``inside`` reads, as they are where the feature stands.
    inputs: Callable[[Config], list[str]] = lambda cfg: []
    #: read -> name: values of a cross-section, as in ``over_sections``; what ``fn`` gives.
    inside: Callable | None = None


@dataclass
class Registry:
    features: dict[str, Feature] = field(default_factory=dict)

    def register(self, name: str, stage: str, columns: Callable[[Config], list[str]], **how) -> Callable:
        """Decorator: add ``fn(df, cfg)`` under a new name; ``how``: rowwise, inputs or inside."""
        if stage not in STAGES:
            raise ValueError(f"stage {stage!r} is none of {STAGES}")
        if name in self.features:
            raise ValueError(f"feature {name!r} is registered already")

        def add(fn: Callable[[DataFrame, Config], DataFrame]) -> Callable[[DataFrame, Config], DataFrame]:
            self.features[name] = Feature(name, stage, columns, fn, **how)
            return fn

        return add

    def columns(self, cfg: Config, names: list[str] | None = None) -> list[str]:
        """Columns of the named features (all by default), without ranks."""
        return [c for name in names or self.features for c in self.features[name].columns(cfg)]

    def _by_ticker(self, panel: DataFrame, cfg: Config, chosen: list[Feature]) -> DataFrame:
        out = panel
        for feature in (f for f in chosen if f.stage == "ticker"):
            out = feature.fn(out, cfg)
        return labels.forward_return(out, cfg.horizon)

    def unranked(self, panel: DataFrame, cfg: Config = Config(), names: list[str] | None = None) -> DataFrame:
        """The panel with all features and ``fwd``, without ranks."""
        chosen = [self.features[n] for n in names or self.features]
        # Placed by date once, so that windows by date, or by date and sector, and ranks need no other exchange.
        out = self._by_ticker(panel, cfg, chosen).repartition("date")
        for feature in (f for f in chosen if f.stage == "date"):
            out = feature.fn(out, cfg)
        return out.select(*panel.columns, *self.columns(cfg, [f.name for f in chosen]), "fwd")

    def missing(self, panel: DataFrame, cfg: Config = Config(), names: list[str] | None = None) -> DataFrame:
        """feature, missing of all columns that ``build`` makes, among rows with a target.

        A rank is missing where its column is, so none is made for it.  What a row or a ticker gives is counted where it is made;
        other features of a date move with what they need only.
        """
        chosen = [self.features[n] for n in names or self.features]
        own = [c for f in chosen if f.stage == "ticker" for c in f.columns(cfg)]
        rows = self._by_ticker(panel, cfg, chosen)
        for feature in (f for f in chosen if f.rowwise):
            rows = feature.fn(rows, cfg)
        raw = clean.missing_shares(rows, *own, *[c for f in chosen if f.rowwise for c in f.columns(cfg)], target="fwd")
        dated = [c for f in chosen if f.stage == "date" and not f.rowwise for c in f.columns(cfg)]
        if dated:
            raw = raw.unionByName(clean.missing_shares(self.unranked(panel, cfg, names), *dated, target="fwd"))
        ranks = raw.where(F.col("feature").isin(own)).withColumn("feature", F.concat(F.lit("cs_"), "feature"))
        return raw.unionByName(ranks)

    def _sections(self, panel: DataFrame, cfg: Config, names: list[str] | None, plain: list[str], made: list[str], fill: list[str], known: str | None) -> DataFrame | None:
        """``plain`` columns of the panel, then ``made`` ones, with ``fill`` filled and rows with ``known``; None if a feature needs rows of a date as a table."""
        chosen = [self.features[n] for n in names or self.features]
        if any(f.stage == "date" and not f.rowwise and not f.inside for f in chosen):
            return None
        out, inside = self._by_ticker(panel, cfg, chosen), []
        for feature in (f for f in chosen if f.stage == "date"):
            if feature.rowwise:
                out = feature.fn(out, cfg)
            elif set(feature.columns(cfg)) & set(made):
                out = out.withColumns({f"__{feature.name}_{c}": F.col(c) for c in feature.inputs(cfg)})
                inside.append(feature)
        own = {f"cs_{c}": c for f in chosen if f.stage == "ticker" for c in f.columns(cfg)} | {"target": "fwd"}
        ranks = {c: own[c] for c in made if c in own}
        later = [c for f in inside for c in f.columns(cfg)]
        moved = dict.fromkeys([*plain, *[c for c in made if c not in ranks and c not in later], *ranks.values(), *[f"__{f.name}_{c}" for f in inside for c in f.inputs(cfg)]])

        def run(read) -> dict:
            found = {}
            for f in inside:
                found |= f.inside(lambda x, *a, f=f: read(f"__{f.name}_{x}", *a), cfg)
            found |= {name: pct_rank(*read(x)) for name, x in ranks.items()}
            if not known:
                return found
            rows = ~np.isnan(found[known])
            for c in fill:
                x, has = (np.nan_to_num(found[c], nan=0.0), ~np.isnan(found[c])) if c in found else read(c)
                at = np.full(len(rows), 0.0)
                at[rows] = filled(x[rows], has[rows])
                found[c] = at
            return found

        doubles = [c for c in made if c in ranks or c in later or c in fill]
        return over_sections(out.select(*moved), doubles, run, [*plain, *made], known).select(*plain, *made)

    def build(self, panel: DataFrame, cfg: Config = Config(), names: list[str] | None = None, ranked: bool = True, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """The panel (or its columns ``keep``) with all features, ``fwd`` and ``target`` (the rank of ``fwd``), and the names of the feature columns.

        ``ranked`` adds cs_x, the percent rank on its date, for each column x of the ticker stage.
        """
        keep = panel.columns if keep is None else keep
        chosen = [self.features[n] for n in names or self.features]
        own = [c for f in chosen if f.stage == "ticker" for c in f.columns(cfg)]
        ranks = {f"cs_{c}": c for c in own} if ranked else {}
        made = self.columns(cfg, [f.name for f in chosen]) + list(ranks)
        table = self._sections(panel, cfg, names, keep, [*made, "fwd", "target"], [], None)
        if table is None:
            table = with_ranks(self.unranked(panel, cfg, names), {**ranks, "target": "fwd"}).select(*keep, *made, "fwd", "target")
        return table, made

    def modelling(self, panel: DataFrame, cfg: Config = Config(), names: list[str] | None = None, columns: list[str] | None = None, sparse: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """``ml_table`` of ``build``, without writing the table of all features: the shares of missing values are counted first,
        and columns that stay are ranked, filled and cut to the rows with a target in one pass over a cross-section.

        ``columns``: the features to choose from, all and their ranks by default.  ``sparse``: those known to be missing too often.
        """
        chosen = [self.features[n] for n in names or self.features]
        columns = columns or [*self.columns(cfg, names), *[f"cs_{c}" for f in chosen if f.stage == "ticker" for c in f.columns(cfg)]]
        if sparse is None:
            sparse = [r.feature for r in self.missing(panel, cfg, names).where(F.col("missing") > cfg.missing).collect()]
            sweep(panel.sparkSession)
        stay = [c for c in columns if c not in sparse]
        table = self._sections(panel, cfg, names, ["date", "ticker"], ["target", *stay], stay, "target")
        if table is None:
            return ml_table(*self.build(panel, cfg, names), cfg)
        return table, stay


def ml_table(table: DataFrame, columns: list[str], cfg: Config = Config(), target: str = "target") -> tuple[DataFrame, list[str]]:
    """(date, ticker, target and features, the features that stay).

    The table is written once: the shares of missing values decide over columns before any is filled.
    """
    rows = written(table.where(F.col(target).isNotNull()).select("date", "ticker", target, *columns), "features")
    kept = clean.drop_sparse(rows, *columns, target=target, most=cfg.missing)
    stay = [c for c in columns if c in kept.columns]
    return fill_cross_section(kept, stay), stay


STANDARD = Registry()


@STANDARD.register("momentum", "ticker", lambda cfg: [f"mom_{n}" for n in cfg.momentum])
def _momentum(df: DataFrame, cfg: Config) -> DataFrame:
    return T.momentum(df, *cfg.momentum)


@STANDARD.register("mean_reversion", "ticker", lambda cfg: [f"{kind}_{n}" for kind in ("to_mean", "z") for n in cfg.reversion])
def _mean_reversion(df: DataFrame, cfg: Config) -> DataFrame:
    return T.mean_reversion(df, *cfg.reversion)


@STANDARD.register("volatility", "ticker", lambda cfg: [f"vol_{n}" for n in cfg.volatility] + ["vol_ratio"])
def _volatility(df: DataFrame, cfg: Config) -> DataFrame:
    return T.vol_ratio(T.volatility(df, *cfg.volatility))


@STANDARD.register("volume", "ticker", lambda cfg: [f"{kind}_{n}" for kind in ("surprise", "log_dollar") for n in cfg.volume] + ["trend"])
def _volume(df: DataFrame, cfg: Config) -> DataFrame:
    return T.volume_features(df, *cfg.volume)


@STANDARD.register("reversal", "ticker", lambda cfg: [f"rev_{n}" for n in cfg.reversal])
def _reversal(df: DataFrame, cfg: Config) -> DataFrame:
    return T.reversal(df, *cfg.reversal)


@STANDARD.register("consistency", "ticker", lambda cfg: [f"up_{n}" for n in cfg.consistency])
def _consistency(df: DataFrame, cfg: Config) -> DataFrame:
    return T.positive_share(df, *cfg.consistency)


def _relative(read, cfg: Config) -> dict[str, np.ndarray]:
    x, known = read(f"mom_{cfg.momentum[1]}")
    sector = read("sector", True)
    n, m = np.bincount(sector), np.bincount(sector, weights=known)
    mean = np.divide(np.bincount(sector, weights=np.where(known, x, 0.0)), m, out=np.zeros(len(n)), where=m > 0)
    return {"rel_mom": np.where(known, x - np.where(n > 1, mean, 0.0)[sector], np.nan)}


@STANDARD.register("sector_relative", "date", lambda cfg: ["rel_mom"], inputs=lambda cfg: [f"mom_{cfg.momentum[1]}", "sector"], inside=_relative)
def _sector_relative(df: DataFrame, cfg: Config) -> DataFrame:
    """Momentum of the second window less the sector's mean; needs a sector column."""
    return crosssec.sector_relative(df, f"mom_{cfg.momentum[1]}").withColumnRenamed("rel", "rel_mom")


@STANDARD.register("calendar", "date", lambda cfg: ["dow_sin", "dow_cos", "month_sin", "month_cos", "turn", "opex"], rowwise=True)
def _calendar(df: DataFrame, cfg: Config) -> DataFrame:
    return crosssec.calendar(df)
