"""Lexicon scores, decay and per-symbol sentiment over articles; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions import windows as W
from panelforge.operators.aggregates import pooled_ranks


def _words(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def headline_score(df: DataFrame, text: str, positive: list[str], negative: list[str], negators: list[str], intensifiers: list[str]) -> DataFrame:
    """score: signed lexicon hits, weakened and turned by a negator in the two words before, strengthened by an
    intensifier just before, over the root of the number of words, held in +-1."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"))

    def value(t: Column, i: Column) -> Column:
        base = F.when(F.array_contains(_words(*positive), t), 1.0).when(F.array_contains(_words(*negative), t), -1.0).otherwise(0.0)
        back = lambda k: F.coalesce(F.get("__t", i - k), F.lit(""))
        turned = F.array_contains(_words(*negators), back(1)) | F.array_contains(_words(*negators), back(2))
        strong = F.array_contains(_words(*intensifiers), back(1))
        return base * F.when(turned, -0.8).otherwise(1.0) * F.when(strong, 1.5).otherwise(1.0)

    made = df.withColumn("__t", tokens)
    total = F.aggregate(F.transform("__t", value), F.lit(0.0), lambda s, v: s + v)
    return made.withColumn("score", W.clip(total / (F.sqrt(F.size("__t")) + 1e-8), -1.0, 1.0)).drop("__t")


def bag_score(df: DataFrame, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """(pos - neg) / max(pos + neg, 1) over the set of white-space tokens."""
    tokens = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
    pos, neg = F.size(F.array_intersect(tokens, _words(*positive))), F.size(F.array_intersect(tokens, _words(*negative)))
    return df.withColumn("bag", (pos - neg) / F.greatest(pos + neg, F.lit(1)))


def sentiment_stats(df: DataFrame, symbols: DataFrame, score: str) -> DataFrame:
    """Statistics of each symbol; a symbol without articles gets a neutral row."""
    s = F.col(score)
    by = df.groupBy("symbol").agg(F.avg(s).alias("mean"), F.max(s).alias("best"), F.min(s).alias("worst"), F.stddev_pop(s).alias("sd"), F.count("*").alias("n"), F.avg((s > 0).cast("double")).alias("pos"), F.avg((s < 0).cast("double")).alias("neg"))
    return symbols.join(by, "symbol", "left").fillna(0)


def newest(df: DataFrame, k: int = 10) -> DataFrame:
    """The k latest articles of each symbol (a top-k report)."""
    w = Window.partitionBy("symbol").orderBy(F.desc("created_at"), "id")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def sentiment_features(stats: DataFrame) -> DataFrame:
    """Levels (mean, sd, pos), ranks over all symbols (of mean, best, worst, sd, n and pos) and the mean of three of the ranks."""
    names = ["mean", "best", "worst", "sd", "n", "pos"]
    long = stats.unpivot(["symbol"], [F.col(c).cast("double").alias(c) for c in names], "feature", "v")
    ranked = pooled_ranks(long, {"v": "r"}, "feature").groupBy("symbol").pivot("feature", names).agg(F.first("r"))
    whole = stats.agg(F.count("*").alias("all"))  # one row
    ranks = ranked.crossJoin(whole).select("symbol", *[(F.col(c) / F.col("all")).alias(f"cs_{c}") for c in names])
    return stats.join(ranks, "symbol").withColumn("composite", W.row_mean("cs_mean", "cs_pos", "cs_best"))


def article_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("hash", F.substring(F.md5(F.concat_ws(":", "headline", "symbol").cast("binary")), 1, 12))


def unseen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Articles whose hash has not been seen."""
    return article_hash(df).join(seen.select("hash"), "hash", "left_anti")


def decay(df: DataFrame, now: str, half_life: float = 6.0) -> DataFrame:
    """decay: 0.5 ** (age in hours / half_life), held in [0.01, 1]; 0.5 without a time."""
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("created_at")) / 3600.0
    return df.withColumn("decay", F.coalesce(W.clip(F.pow(F.lit(0.5), age / half_life), 0.01, 1.0), F.lit(0.5)))


def decayed_sentiment(df: DataFrame, score: str, magnitude: str) -> DataFrame:
    """Decay- and magnitude-weighted mean, mean magnitude and volume of each symbol."""
    w = F.col("decay") * F.col(magnitude)
    return df.groupBy("symbol").agg(F.try_divide(F.sum(F.col(score) * w), F.sum(w)).alias("sentiment"), F.avg(magnitude).alias("magnitude"), F.least(F.count("*") / 10, F.lit(1.0)).alias("volume"))


#: Kinds of news that set a flag (fixed values).
EVENT_KINDS = ("earnings", "analyst", "regulatory", "ma")


def news_features(df: DataFrame, score: str, magnitude: str, kind: str) -> DataFrame:
    """``decayed_sentiment`` with event_x, 1 if a symbol has news of kind x, else 0; the mean is 0 where all weights are, and both means have four digits."""
    w = F.col("decay") * F.col(magnitude)
    mean = F.when(F.sum(w) > 0, F.sum(F.col(score) * w) / F.sum(w)).otherwise(0.0)
    flags = [F.max(F.coalesce(F.col(kind) == k, F.lit(False)).cast("int")).alias(f"event_{k}") for k in EVENT_KINDS]
    return df.groupBy("symbol").agg(F.round(mean, 4).alias("sentiment"), F.round(F.avg(magnitude), 4).alias("magnitude"), F.least(F.count("*") / 10, F.lit(1.0)).alias("volume"), *flags)


def title(df: DataFrame, payload: str) -> DataFrame:
    """First title among the known shapes of a payload, if longer than 5 characters."""
    found = F.coalesce(F.get_json_object(payload, "$.title"), F.get_json_object(payload, "$.content.title"), F.get_json_object(payload, "$.headline"))
    return df.withColumn("title", F.when(F.length(found) > 5, found))
