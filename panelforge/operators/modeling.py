"""Walk-forward data path: windows, feature selection, sequences, ensembles, boosted trees."""

from __future__ import annotations

import pickle
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from panelforge.functions import trees as T
from panelforge.functions import windows as W
from panelforge.functions.blocks import column, gathered
from panelforge.functions.windows import rank_pct
from panelforge.operators.aggregates import pooled_ranks, rank_correlations
from panelforge.sources.scratch import written

DRAWN = 0.7  # share of a window's rows that a round of boosted trees draws


def _dates(df: DataFrame) -> DataFrame:
    """One row: d, the sorted dates, and their number n."""
    found = df.agg(F.array_sort(F.collect_set("date")).alias("d"))  # one entry per date
    return found.withColumn("n", F.size("d"))


def walk_forward(df: DataFrame, train: int, step: int, purge: int, embargo: int, least: int = 100) -> DataFrame:
    """window and first and last dates of training, validation and prediction.

    From each step on: training, ``purge`` dates, validation of max(embargo, 5) dates, ``embargo`` dates,
    prediction of up to ``step`` dates.  No windows if training has under ``least`` dates.
    """
    val = max(embargo, 5)
    size = train - purge - val - embargo
    if size < least:
        starts = _dates(df).where("false").select("d", "n", F.lit(0).alias("i"))
    else:
        starts = _dates(df).where(F.col("n") > train).select("d", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - train - 1, F.lit(0)), F.lit(step))).alias("i"))
    at = lambda k: F.get("d", F.col("i") + k)
    first_val = size + purge
    return starts.select(
        (F.col("i") / step + 1).cast("int").alias("window"), at(0).alias("train_start"), at(size - 1).alias("train_end"), at(first_val).alias("val_start"), at(first_val + val - 1).alias("val_end"),
        at(train).alias("predict_start"), F.get("d", F.least(F.col("i") + train + step, F.col("n")) - 1).alias("predict_end"),
    )


def cv_splits(df: DataFrame, n_splits: int, train: int, purge: int = 10, embargo: int = 12) -> DataFrame:
    """split and first and last dates of training and validation, purged and with an embargo, for tuning.

    With under train + 30 dates training takes two thirds (50 at least); no splits with under 20 dates left;
    splits of under 30 training or 5 validation dates are left out.
    """
    own = F.when(F.col("n") < train + 30, F.greatest(F.lit(50), F.floor(F.col("n") * 2 / 3))).otherwise(train).cast("int")
    sized = _dates(df).withColumn("t", own).where(F.col("n") - F.col("t") >= 20).withColumn("v", F.greatest(F.lit(15), F.floor((F.col("n") - F.col("t")) / (n_splits + 1))).cast("int"))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split")).withColumn("vs", F.col("t") + F.col("split") * F.col("v"))
    made = each.withColumns({"te": F.col("vs") - purge, "ve": F.least(F.col("vs") + F.col("v"), F.col("n"))}).withColumn("ts", F.greatest(F.lit(0), F.col("te") - F.col("t")))
    kept = made.where((F.col("te") >= 30) & (F.col("vs") + embargo < F.col("n")) & (F.col("te") - F.col("ts") >= 30) & (F.col("ve") - F.col("vs") - embargo >= 5))
    return kept.select("split", F.get("d", "ts").alias("train_start"), F.get("d", F.col("te") - 1).alias("train_end"), F.get("d", F.col("vs") + embargo).alias("val_start"), F.get("d", F.col("ve") - 1).alias("val_end"))


def in_windows(df: DataFrame, windows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of ``df`` with each window whose range of dates holds them (the ranges meet the dates first, and a row a date and window is broadcast)."""
    dated = df.select("date").distinct().join(windows.select("window", F.col(start).alias("lo"), F.col(end).alias("hi")), F.col("date").between(F.col("lo"), F.col("hi"))).select("date", "window")
    return df.join(F.broadcast(dated), "date")


def stability_ic(df: DataFrame, target: str, features: list[str], periods: int = 3, key: tuple[str, ...] = (), least_rows: int = 100, least_values: int = 50, least_dates: int = 30, cheap: bool = False) -> DataFrame:
    """key, feature, n_periods, mean_ic, agree, score = mean |ic| * share of the prevailing sign.

    The dates of a key are cut into ``periods`` equal parts (the last takes the rest); parts of under
    ``least_dates`` dates are cut again into n // least_dates parts, two at least.  ic is the rank correlation over
    the rows of a part; parts and features with too few rows or values are left out, and so are features with under
    two correlations or only zeros.  As many signs either way count as no agreement.  The rows of a key's dates are
    counted on the driver.  ``df`` is written once unless it is ``cheap`` to read several times.
    """
    spark, keys = df.sparkSession, list(key)
    rows = df.where(F.col(target).isNotNull()).select(*keys, "date", F.col(target).alias("__y"), *[F.col(f).alias(f"__x{i}") for i, f in enumerate(features)])
    rows = rows if cheap else written(rows, "parts")
    dates: dict = {}
    for r in rows.groupBy(*keys, "date").agg(F.count("*").alias("__n")).collect():
        dates.setdefault(tuple(r[k] for k in keys), []).append((r["date"], r["__n"]))
    parts, placed = [], []
    for name, days in dates.items():
        k = periods if len(days) // periods >= least_dates else max(2, len(days) // least_dates)
        own = [min(i // max(len(days) // k, 1), k - 1) for i in range(len(days))]
        days = sorted(days)
        for period in sorted(set(own)):
            held = [d for d, p in zip(days, own) if p == period]
            if sum(n for _, n in held) >= least_rows:
                placed += [(*name, d, len(parts)) for d, _ in held]
                parts.append((*name, period))
    fields = [df.schema[k] for k in keys]
    dated = spark.createDataFrame(placed, StructType([*fields, df.schema["date"], StructField("__part", IntegerType())]))
    found = rank_correlations(rows.join(F.broadcast(dated), [*keys, "date"]), "__part", "__y", [f"__x{i}" for i in range(len(features))]) if placed else []
    made = [(*parts[p], features[f], float(ic)) for p, f, n, ic in found if n >= least_values and ic is not None and ic == ic]
    ic = spark.createDataFrame(made, StructType([*fields, StructField("period", IntegerType()), StructField("feature", StringType()), StructField("ic", DoubleType())]))
    up, down = F.count_if(F.col("ic") > 0), F.count_if(F.col("ic") < 0)
    agree = F.when(up == down, 0.0).otherwise(F.greatest(up, down) / (up + down))
    by = ic.groupBy(*keys, "feature").agg(F.count("*").alias("n_periods"), F.avg(F.abs("ic")).alias("mean_ic"), agree.alias("agree"), (up + down).alias("signs")).where("n_periods > 1 and signs > 0").drop("signs")
    return by.withColumn("score", F.col("mean_ic") * F.col("agree"))


def select_features(scores: DataFrame, most: int = 50, least: float = 0.005, few: int = 15, instead: int = 30, key: tuple[str, ...] = ()) -> DataFrame:
    """``scores`` with selected: the ``most`` best of score ``least`` or more (0: all of them); if they are under ``few``, the ``instead`` best."""
    own = Window.partitionBy(*key)  # one row per feature of a key
    placed = scores.withColumns({"place": F.row_number().over(own.orderBy(F.desc("score"), "feature")), "passing": F.count_if(F.col("score") >= least).over(own)})
    n = F.least("passing", F.lit(most)) if most else F.col("passing")
    return placed.withColumn("selected", F.col("place") <= F.when(n < few, F.lit(instead)).otherwise(n)).drop("place", "passing")


def ic_metrics(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean, deviation and ratio of per-date rank correlations, and the objective mean - 0.5 * population deviation."""
    from panelforge.operators.aggregates import correlations

    daily = correlations(df, x, y, "date")
    return daily.agg(F.avg("spearman").alias("ic"), F.stddev_samp("spearman").alias("sd"), F.try_divide(F.avg("spearman"), F.stddev_samp("spearman")).alias("ir"), (F.avg("spearman") - 0.5 * F.stddev_pop("spearman")).alias("objective"))


def window_ic(df: DataFrame, x: str, y: str) -> DataFrame:
    """window, n, pearson, spearman over all rows of each window that have both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pooled_ranks(both, {x: "__a", y: "__b"}, "window")
    return ranked.groupBy("window").agg(F.count("*").alias("n"), W.safe_corr(x, y).alias("pearson"), W.safe_corr("__a", "__b").alias("spearman"))


def ic_over_windows(by_window: DataFrame) -> DataFrame:
    """One row: mean, deviation and ratio of each correlation over the windows."""
    return by_window.agg(*[e for c in ("pearson", "spearman") for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.try_divide(F.avg(c), F.stddev_samp(c)).alias(f"{c}_ir"))])


def sequences(df: DataFrame, features: list[str], n: int = 21) -> DataFrame:
    """The n rows before each row as array<array<double>>; skipped if over half is missing, missing is 0."""
    w = W.by_key().rowsBetween(-n, -1)
    made = df.withColumn("__s", F.collect_list(F.array(*features)).over(w)).where(F.size("__s") == n)
    missing = F.aggregate("__s", F.lit(0), lambda s, r: s + F.size(F.filter(r, lambda v: v.isNull())))
    kept = made.withColumn("missing", missing).where(F.col("missing") <= n * len(features) / 2)
    return kept.withColumn("sequence", F.transform("__s", lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit(0.0))))).drop("__s")


def rank_ensemble(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of per-date ranks over the models; rows that every model has."""
    total = sum(weights.values())
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, v / total)])
    ranked = scores.where(F.col("score").isNotNull()).withColumn("r", rank_pct("score", "date", "model"))
    return ranked.groupBy("date", "ticker").agg(F.sum(F.col("r") * w[F.col("model")]).alias("ensemble"), F.count("*").alias("n")).where(F.col("n") == len(weights))


def latest_slice(df: DataFrame) -> DataFrame:
    return df.join(df.agg(F.max("date").alias("date")), "date")


def single_split(df: DataFrame, val: int = 21, embargo: int = 12) -> DataFrame:
    """part: train, gap or val, by distinct dates counted from the end."""
    place = df.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("date"))))
    part = F.when(F.col("k") <= val, "val").when(F.col("k") <= val + embargo, "gap").otherwise("train")
    return df.join(place.select("date", part.alias("part")), "date")


def window_trees(
    ml: DataFrame, windows: DataFrame, chosen: DataFrame, features: list[str], target: str, seeds: tuple[int, ...] = (1, 2, 3), most: int = 800, step: float = 0.1, depth: int = 3, weight: str | None = None, task_rows: int = 150_000
) -> tuple[DataFrame, DataFrame]:
    """Boosted trees of each walk-forward window, averaged over seeds, stopped early on the window's validation dates.

    Returns (window, part, date, ticker, target, score), part being val or predict, and (window, seed, rounds, feature,
    importance), of the rounds that the validation error chose (``most`` at most).  ``ml`` has no missing features;
    ``chosen``: window, feature; a window without any uses all ``features``.  ``weight``: a column of sample weights.

    The plan of windows, the chosen names, the rows a date and sketches of the features (from which the splits come) are read on the
    driver.  Rows are coded once, in blocks of up to ``task_rows``.  A window that fits one block is fitted in one task a seed; the
    fits of larger windows go on together, a pass over the blocks a tree level, in which each task adds up histograms.  Both ways
    give the same trees.  Scores are made when they are read.
    """
    spark = ml.sparkSession
    rows, named = written(ml, "ml"), {}
    for row in chosen.select("window", "feature").distinct().orderBy("window", "feature").collect():
        named.setdefault(row.window, []).append(row.feature)
    by_date = [(r.date, r.n) for r in rows.groupBy("date").agg(F.count("*").alias("n")).collect()]
    plan = windows.orderBy("window").collect()
    ticker = rows.schema["ticker"].dataType.simpleString()
    schema, weights = f"part string, date date, ticker {ticker}, target double, score double, window int", "window int, seed int, rounds int, feature string, importance double"
    if not plan:
        return spark.createDataFrame([], schema), spark.createDataFrame([], weights)
    own = {w.window: named.get(w.window, features) for w in plan}
    size = {w.window: sum(n for day, n in by_date if w.train_start <= day <= w.val_end) for w in plan}
    day = lambda d: (d - date(1970, 1, 1)).days
    spans = {w.window: tuple(map(day, (w.train_start, w.train_end, w.val_start, w.val_end, w.predict_start, w.predict_end))) for w in plan}
    known = rows.where(F.col(target).isNotNull()).select("date", F.xxhash64("date", "ticker").alias("key"), F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *features)

    def inside(days: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d, _, _ = spans[w]
        return (days >= a) & (days <= b), (days >= c) & (days <= d)

    def sketched(batches):
        for table in gathered(batches, task_rows):
            days, y, w = table["date"].cast("int32").to_numpy(), table["y"].to_numpy(), table["w"].to_numpy()
            for name, columns in own.items():
                train, val = inside(days, name)
                if (train | val).any():
                    made = [T.sketch(column(table, f)[train]) for f in columns]
                    both = train | val
                    yield pa.RecordBatch.from_pydict({"window": [name], "rows": [int(train.sum())], "y": [float(np.abs(y[both]).max())], "w": [float(w[both].max())], "points": [pickle.dumps(made)]})

    found = known.mapInArrow(sketched, "window long, rows long, y double, w double, points binary").collect()
    sketches = {w: [(pickle.loads(r.points), r.rows) for r in found if r.window == w] for w in own}
    splits = {w: [T.thresholds([p[i] for p, _ in s], [n for _, n in s]) if any(n for _, n in s) else np.zeros(0) for i in range(len(own[w]))] for w, s in sketches.items()}
    unit = {w: T.units(max((r.y for r in found if r.window == w), default=1.0), max((r.w for r in found if r.window == w), default=1.0)) for w in own}

    def coded(batches):
        for table in gathered(batches, task_rows):
            days = table["date"].cast("int32").to_numpy()
            for name, columns in own.items():
                train, val = inside(days, name)
                at = np.flatnonzero(train | val)
                if len(at):
                    take = lambda c: table[c].to_numpy()[at]
                    codes = np.stack([T.coded(column(table, f)[at], splits[name][i]) for i, f in enumerate(columns)])
                    block = T.Block(codes, take("y"), take("w") if weight else np.zeros(0), val[at], take("key").astype(np.uint32))
                    yield pa.RecordBatch.from_pydict({"window": [name], "data": [pickle.dumps(tuple(block), protocol=5)]})

    tasks = max(1, -(-sum(size.values()) // task_rows))
    blocks = written(known.mapInArrow(coded, "window long, data binary").coalesce(tasks), "blocks")
    small = [w for w in own if size[w] <= task_rows]
    large = [w for w in own if size[w] > task_rows]
    members = {(w, s): (s, len(own[w])) for w in own for s in seeds}
    rounds = {"most": most, "step": step, "depth": depth, "columns": 0.6}
    fitted = {}
    if small:
        place = {m: i for i, m in enumerate(m for m in members if m[0] in small)}

        def fit(records):
            records = list(records)
            if records:
                m, data = list(place)[records[0][0]], [T.Block(*pickle.loads(d)) for _, d in records]
                yield m, T.fitted_block(T.joined(data), *members[m], unit[m[0]], DRAWN, **rounds)

        dealt = blocks.where(F.col("window").isin(small)).rdd.flatMap(lambda r: [(place[r.window, s], bytes(r.data)) for s in seeds])
        fitted |= dealt.partitionBy(len(place), lambda i: i).mapPartitions(fit).collectAsMap()
    if large:
        fitted |= _large_fits(blocks.where(F.col("window").isin(large)), {m: v for m, v in members.items() if m[0] in large}, unit, rounds)
    nothing = lambda m: ([], np.zeros(len(own[m[0]])))
    trees = {m: fitted.get(m, nothing(m)) for m in members}

    def scored(batches):
        for batch in batches:
            table, days = pa.table(batch), batch.column("date").cast("int32").to_numpy()
            for w, columns in own.items():
                _, _, c, d, e, f = spans[w]
                at = np.flatnonzero(((days >= c) & (days <= d)) | ((days >= e) & (days <= f)))
                if len(at):
                    codes = np.stack([T.coded(column(table, x)[at], splits[w][i]) for i, x in enumerate(columns)])
                    mean = sum(T.predicted(codes, trees[w, s][0]) for s in seeds) / len(seeds)
                    part = pa.array(np.where(days[at] <= d, "val", "predict").astype(object), pa.string())
                    own_rows = table.take(pa.array(at)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([part, *[own_rows[x].combine_chunks() for x in ("date", "ticker", "target")], pa.array(mean), pa.array(np.full(len(at), w, np.int32))], ["part", "date", "ticker", "target", "score", "window"])

    wanted = rows.where(F.col("date") >= F.lit(min(w.val_start for w in plan))).select("date", "ticker", F.col(target).cast("double").alias("target"), *[f for f in features if f != "target"])
    scores = wanted.mapInArrow(scored, schema)
    share = lambda g: g / (g.sum() or 1.0)
    return scores, spark.createDataFrame([(w, s, len(t), f, float(v)) for (w, s), (t, g) in trees.items() for f, v in zip(own[w], share(g))], weights)


def _large_fits(blocks: DataFrame, members: dict, unit: dict, rounds: dict, keep: int = 10) -> dict:
    """Fits of windows of many blocks: all members grow a level of a tree in one pass, in which tasks send one histogram a member to the driver.

    Every ``keep`` rounds what the trees give so far is kept beside the blocks, made from the blocks and all trees, so nothing
    hangs on the tables kept before.
    """
    state = {"rounds": 0, "rows": blocks.withColumn("known", F.lit(None).cast("binary")).persist(StorageLevel.MEMORY_AND_DISK)}

    def read(batch):
        for w, data, known in zip(batch.column("window").to_pylist(), batch.column("data"), batch.column("known")):
            yield w, T.Block(*pickle.loads(data.as_buffer())), pickle.loads(known.as_buffer()) if known.is_valid else {}

    def measure(asked: dict) -> dict:
        number = next(iter(asked.values())).number
        if number >= state["rounds"] + keep:
            trees = {m: x.trees for m, x in asked.items()}

            def known(batches):
                for batch in batches:
                    for w, block, _ in read(batch.append_column("known", pa.nulls(batch.num_rows, pa.binary()))):
                        made = {m: T.predicted(block.codes, t) for m, t in trees.items() if m[0] == w}
                        if made:
                            yield pa.RecordBatch.from_pydict({"window": [w], "data": [pickle.dumps(tuple(block), protocol=5)], "known": [pickle.dumps(made, protocol=5)]})

            before, state["rows"], state["rounds"] = state["rows"], blocks.mapInArrow(known, "window long, data binary, known binary").persist(StorageLevel.MEMORY_AND_DISK), number
            before.unpersist()
        short = {m: x._replace(trees=x.trees[state["rounds"] :]) for m, x in asked.items()}

        def add(batches):
            total = {}
            for batch in batches:
                for w, block, known in read(batch):
                    for m, x in short.items():
                        if m[0] == w:
                            got = T.measured(block, x, unit[w], DRAWN, known.get(m))
                            total[m] = tuple(a + b for a, b in zip(total[m], got)) if m in total else got
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "sums": [pickle.dumps(total)]})

        out = {}
        for sums in state["rows"].mapInArrow(add, "task long, sums binary").rdd.map(lambda r: (r.task, bytes(r.sums))).collectAsMap().values():
            for m, got in pickle.loads(sums).items():
                out[m] = tuple(a + b for a, b in zip(out[m], got)) if m in out else got
        return out

    try:
        return T.boosted(members, measure, **rounds)
    finally:
        state["rows"].unpersist()


def mean_importance(importances: DataFrame) -> DataFrame:
    """feature, mean importance over members, from the largest."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")
