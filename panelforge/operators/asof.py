"""Point-in-time alignment: as-of joins, calendar snapping, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(grid: DataFrame, facts: DataFrame, when: str, *columns: str, tie: str | None = None, key: str = "ticker", keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest fact published at or before each date of a key (on equal dates the largest ``tie``), beside the grid's columns ``keep``.

    Facts and dates are one stream per key, ordered by date: one shuffle by key, no range join.
    """
    order = F.col(tie) if tie else F.lit(0)
    f = facts.select(key, F.col(when).alias("date"), F.lit(0).alias("__kind"), order.alias("__tie"), F.struct(*columns).alias("__fact"), *[F.lit(None).cast(grid.schema[c].dataType).alias(f"__g_{c}") for c in keep])
    g = grid.select(key, "date", F.lit(1).alias("__kind"), F.lit(None).cast(f.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(f.schema["__fact"].dataType).alias("__fact"), *[F.col(c).alias(f"__g_{c}") for c in keep])
    w = Window.partitionBy(key).orderBy("date", "__kind", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    last = f.unionByName(g).withColumn("__last", F.last("__fact", ignorenulls=True).over(w)).where("__kind = 1")
    return last.select(key, "date", *[F.col(f"__g_{c}").alias(c) for c in keep], *[F.col(f"__last.{c}").alias(c) for c in columns])


def snap_forward(events: DataFrame, calendar: DataFrame, when: str) -> DataFrame:
    """slot: first calendar date at or after an event's date; the calendar has one row per date."""
    e = events.select(F.col(when).alias("date"), F.lit(None).cast("date").alias("__d")).distinct()
    c = calendar.select("date", F.col("date").alias("__d"))
    w = Window.orderBy("date", F.col("__d").isNull().desc()).rowsBetween(0, Window.unboundedFollowing)
    slots = e.unionByName(c).withColumn("slot", F.first("__d", ignorenulls=True).over(w)).where("__d is null").select(F.col("date").alias(when), "slot")
    return events.join(F.broadcast(slots), when)


def on_grid(grid: DataFrame, daily: DataFrame, *columns: str) -> DataFrame:
    """Exact-date lookup; dates off the grid are dropped, missing values are 0."""
    return grid.join(daily, ["date", "ticker"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def member_steps(current: DataFrame, changes: DataFrame) -> DataFrame:
    """ticker, since, until, member: half-open spans of dates of every name, from today's members and their changes.

    A change tells the state of the dates up to its own: an addition means out, a removal in (of several changes of a
    name on one day an addition counts); after the last change today's state stands.  The first span has a null
    ``since``, the last a null ``until``.  One shuffle of the changes by ticker.
    """
    events = changes.select(F.inline(F.filter(F.array(F.struct(F.col("added").alias("ticker"), F.lit(False).alias("member"), F.col("date").alias("last")), F.struct(F.col("removed").alias("ticker"), F.lit(True).alias("member"), F.col("date").alias("last"))), lambda e: e["ticker"].isNotNull())))
    daily = events.where("last is not null").groupBy("ticker", "last").agg(F.min("member").alias("member"))
    names = daily.select("ticker").union(current.select("ticker")).distinct()
    now = names.join(current.select("ticker", F.lit(True).alias("member")).distinct(), "ticker", "left").select("ticker", F.lit(None).cast("date").alias("last"), F.coalesce("member", F.lit(False)).alias("member"))
    spans = daily.select("ticker", "last", "member").unionByName(now)
    order = Window.partitionBy("ticker").orderBy(F.asc_nulls_last("last"))
    return spans.select("ticker", F.date_add(F.lag("last").over(order), 1).alias("since"), F.date_add("last", 1).alias("until"), "member")


def member_intervals(current: DataFrame, changes: DataFrame) -> DataFrame:
    """ticker, since, until: the spans in which a name is a member."""
    return member_steps(current, changes).where("member").drop("member")


def members_at(grid: DataFrame, current: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows (date, ticker) of ``grid`` whose name is a member on the date: one stream of spans and dates by ticker, no range join."""
    steps = member_steps(current, changes).withColumn("since", F.coalesce("since", F.to_date(F.lit("0001-01-01"))))
    return as_of(grid, steps, "since", "member").where("member").select("date", "ticker")


def membership(current: DataFrame, changes: DataFrame, months: DataFrame) -> DataFrame:
    """(month, ticker) members on each of the listed dates; the work is that of the rows it returns, not of names x months x changes."""
    listed = months.agg(F.array_sort(F.collect_set("month")).alias("months"))  # one row: a short list of dates
    spans = member_intervals(current, changes).crossJoin(F.broadcast(listed))
    inside = F.filter("months", lambda m: (F.col("since").isNull() | (m >= F.col("since"))) & (F.col("until").isNull() | (m < F.col("until"))))
    return spans.select(F.explode(inside).alias("month"), "ticker").distinct()


def latest_snapshot(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(date, snapshot): the latest snapshot at or before each date, null before the first; one row per date."""
    marks = snapshots.select(F.col("date").alias("snapshot")).distinct()
    both = marks.select(F.col("snapshot").alias("date"), "snapshot").unionByName(dates.select("date").distinct().withColumn("snapshot", F.lit(None).cast("date")))
    order = Window.orderBy("date", F.col("snapshot").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # one row per date and snapshot
    return both.withColumn("found", F.last("snapshot", ignorenulls=True).over(order)).where("snapshot is null").select("date", F.col("found").alias("snapshot"))


def outer_align(a: DataFrame, b: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Full outer join with missing values as 0; columns get the suffixes _a and _b."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, keys, "full").fillna(0.0)


def common_rows(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows that every frame has, columns side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys)
    return out


def overlap_counts(df: DataFrame, days: int) -> DataFrame:
    """Samples within +-days of each date, from counts per date (never a row-level self join)."""
    by = df.groupBy("date").agg(F.count("*").alias("n")).withColumn("__day", F.datediff("date", F.lit("1970-01-01")))
    return by.select("date", "n", F.sum("n").over(Window.orderBy("__day").rangeBetween(-days, days)).alias("near"))
