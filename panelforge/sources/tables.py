"""Readers, writers and payload mappings."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.scratch import written


def _fields(line: str) -> list[str | None]:
    """Fields of a CSV line as Spark writes it; an empty one is null."""
    if '"' not in line:
        return [x or None for x in line.split(",")]
    return [x or None for x in next(csv.reader([line], escapechar="\\"))]


def read_wide_csv(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """Wide CSV panel (first column is the date) as (date, ticker, value); an empty panel is an error.

    Lines are split in tasks, whatever the number of columns; a line whose first field is that of the header is a header.
    Only the header line is read on the driver, to check it.
    """
    lines = spark.read.text(path).where("value <> ''")
    if (first := lines.first()) is None:
        raise ValueError(f"no rows or no columns in {path}")
    top = first.value.removeprefix("\ufeff")
    tickers, mark = _fields(top)[1:], top.split(",", 1)[0] + ","
    header = F.col("value") == F.lit(first.value)
    if mark != ",":
        header = header | F.startswith("value", F.lit(mark)) | F.startswith("value", F.lit("\ufeff" + mark))
    rows = lines.where(~header)
    if not tickers or rows.isEmpty():
        raise ValueError(f"no rows or no columns in {path}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0):
                day, *values = _fields(line.as_py())
                values = (values + [None] * len(tickers))[: len(tickers)]
                yield pa.RecordBatch.from_arrays([pa.array([day] * len(values), pa.string()), pa.array(tickers, pa.string()), pa.array(values, pa.string())], ["day", "ticker", name])

    long = rows.mapInArrow(split, f"day string, ticker string, `{name}` string")
    return long.select(F.to_date("day").alias("date"), "ticker", F.col(name).try_cast("double").alias(name))


def write_wide_csv(df: DataFrame, path: str, value: str) -> None:
    """(date, ticker, value) as a wide CSV panel, a column per ticker in the order of their names.

    A line is built of a date's values with their places in the header, so no table of that many columns is planned.
    Spark's own committer makes the files visible at once, when all are whole; all carry the header.
    """
    quoted = lambda x: F.when(x.rlike(r'[",\\\r\n]'), F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r'\\$1'), F.lit('"'))).otherwise(x)
    rows = written(df.groupBy("date", F.col("ticker").cast("string").alias("ticker")).agg(F.first(value).cast("string").alias("v")), "wide")
    names = rows.where("ticker is not null").agg(F.array_sort(F.collect_set("ticker")).alias("names"))  # one row: the header
    placed = rows.join(names.select(F.posexplode("names").alias("k", "ticker")), "ticker", "left")
    cells = placed.groupBy("date").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", quoted(F.col("v")).alias("v"))))).alias("c"))
    n = F.size("names")
    # Each value after as many commas as it is places from the one before.
    body = F.array_join(F.transform("c", lambda x, i: F.concat(F.repeat(F.lit(","), x["k"] - F.coalesce(F.get("c", i - 1)["k"], F.lit(-1))), F.coalesce(x["v"], F.lit("")))), "")
    line = F.concat(F.coalesce(F.col("date").cast("string"), F.lit("")), body, F.repeat(F.lit(","), n - 1 - F.coalesce(F.get("c", F.size("c") - 1)["k"], F.lit(-1))))
    files = df.sparkSession.sparkContext.defaultParallelism
    lines = cells.crossJoin(F.broadcast(names.select("names"))).select(line.alias("value"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("date"), F.lit(files)).cast("int").alias("file"))
    header = names.select(F.concat(F.lit("date,"), F.array_join(F.transform("names", quoted), ",")).alias("value"), F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("file"))
    header.unionByName(lines).repartitionById(files, "file").sortWithinPartitions("kind").select("value").write.mode("overwrite").text(path)


def read_keyed_json(spark: SparkSession, path: str, record: str, lines: bool = False) -> DataFrame:
    """JSON of ticker -> list of records, an object a file or (``lines``) a line; keys that begin with ``_`` are left out."""
    raw = spark.read.option("wholetext", not lines).text(path)
    entries = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("ticker", "list")).where(~F.startswith("ticker", F.lit("_")))
    return entries.select("ticker", F.explode(F.from_json("list", f"array<{record}>")).alias("r")).select("ticker", "r.*")


def write_keyed_json(df: DataFrame, path: str, *columns: str) -> None:
    """Records of each ticker as one object a line: ticker -> list of records in the order of ``columns``."""
    lists = df.groupBy(F.col("ticker").cast("string").alias("ticker")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("r"))
    lists.select(F.to_json(F.create_map("ticker", "r")).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, *dates: str) -> DataFrame:
    """JSON Lines with a declared schema; dates that do not parse are null."""
    df = spark.read.schema(schema).json(path)
    return df.withColumns({d: F.try_to_timestamp(F.col(d)).cast("date") for d in dates})


def read_predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """(date, ticker, score) of daily prediction files; corrupt files are skipped."""
    df = spark.read.schema("date string, predictions map<string,double>").option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)
    return df.where("predictions is not null").select(F.to_date("date").alias("date"), F.explode("predictions").alias("ticker", "score"))


def write_predictions(df: DataFrame, path: str) -> None:
    """(date, ticker, score) as one JSON file a day, in a folder of its own: {date, predictions: {ticker: score}}."""
    daily = df.where("date is not null and ticker is not null").groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ticker").cast("string"), F.col("score").cast("double")))).alias("predictions"))
    made = daily.select(F.col("date").alias("day"), F.to_json(F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "predictions"), {"ignoreNullFields": "false"}).alias("value"))
    made.write.mode("overwrite").partitionBy("day").text(path)


def write_table(df: DataFrame, path: str, *partitions: str, kind: str = "parquet") -> None:
    """A table as parquet, csv (with a header) or json, in folders of ``partitions``."""
    writer = df.write.mode("overwrite").format(kind).options(**({"header": True} if kind == "csv" else {"ignoreNullFields": False} if kind == "json" else {}))
    (writer.partitionBy(*partitions) if partitions else writer).save(path)


def write_results(comparison: DataFrame, daily: DataFrame, path: str) -> None:
    """Artifacts of a comparison under ``path``.

    ``comparison``: metric, model, value; it is written as a JSON line a metric (comparison_json) and as a CSV table with
    a column per model (comparison_table), and as a JSON summary of each model (summary/model=...).  ``daily``:
    model and the columns of its returns, a CSV folder each (returns/model=...).
    """
    models = sorted(r.model for r in comparison.select("model").distinct().collect())  # a column each
    table = comparison.groupBy("metric").pivot("model", models).agg(F.first("value"))
    by_metric = comparison.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("model", "value"))).alias("values"))
    by_model = comparison.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
    write_table(by_metric, f"{path}/comparison_json", kind="json")
    write_table(table, f"{path}/comparison_table", kind="csv")
    write_table(by_model, f"{path}/summary", "model", kind="json")
    write_table(daily, f"{path}/returns", "model", kind="csv")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON Lines; NaN and infinite values are written as null."""
    real = [c for c, t in df.dtypes if t in ("double", "float")]
    clean = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in real})
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def bars_from_json(df: DataFrame, payload: str) -> DataFrame:
    """Short-keyed bar payloads as named columns."""
    made = df.withColumn("__b", F.from_json(payload, "t string, o double, h double, l double, c double, v double, vw double, n bigint"))
    names = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "trade_count"}
    return made.withColumns({"timestamp": F.try_to_timestamp(F.col("__b.t"))} | {v: F.col(f"__b.{k}") for k, v in names.items()}).drop("__b", payload)


# Index names of one vendor and the funds that stand for them.
SERIES = {
    "^VIX": "VIXY", "^TNX": "TLT", "^IRX": "SHV", "TLT": "TLT", "HYG": "HYG", "LQD": "LQD", "UUP": "UUP", "GLD": "GLD", "USO": "USO", "^GSPC": "SPY", "SPY": "SPY", "IWM": "IWM", "QQQ": "QQQ",
    "XLK": "XLK", "XLF": "XLF", "XLV": "XLV", "XLE": "XLE", "XLI": "XLI", "XLP": "XLP", "XLY": "XLY", "XLU": "XLU", "XLB": "XLB", "XLRE": "XLRE", "XLC": "XLC",
}
# Vendor fields and their canonical names; the first source that has a value counts.
RATIOS = {
    "priceToEarningsRatio": "trailingPE", "priceToBookRatio": "priceToBook", "priceToSalesRatio": "priceToSalesTrailing12Months", "enterpriseValueMultiple": "enterpriseToEbitda", "grossProfitMargin": "grossMargins",
    "operatingProfitMargin": "operatingMargins", "netProfitMargin": "profitMargins", "debtToEquityRatio": "debtToEquity", "currentRatio": "currentRatio", "quickRatio": "quickRatio", "dividendYield": "dividendYield", "dividendPayoutRatio": "payoutRatio",
}
KEY_METRICS = {"returnOnEquity": "returnOnEquity", "returnOnAssets": "returnOnAssets", "evToEBITDA": "enterpriseToEbitda", "evToSales": "enterpriseToRevenue", "earningsYield": "earningsYield", "marketCap": "marketCap"}
GROWTH = {"revenueGrowth": "revenueGrowth", "epsgrowth": "earningsGrowth", "netIncomeGrowth": "earningsQuarterlyGrowth"}


def remap(df: DataFrame, column: str, names: dict[str, str], out: str) -> DataFrame:
    """Names from a small table (its size is that of ``names``); others stay."""
    pairs = df.sparkSession.createDataFrame(list(names.items()), f"`{column}` string, __to string")
    return df.join(F.broadcast(pairs), column, "left").withColumn(out, F.coalesce("__to", column)).drop("__to")


def remap_back(df: DataFrame, column: str, names: dict[str, str], out: str) -> DataFrame:
    """A row for every original name that ``column`` stands for; rows of names that stand for none go."""
    pairs = df.sparkSession.createDataFrame([(b, a) for a, b in names.items()], f"`{column}` string, `{out}` string")
    return df.join(F.broadcast(pairs), column)


def canonical_fields(df: DataFrame, *maps: dict[str, str]) -> DataFrame:
    """Vendor columns under their canonical names, as doubles; of several sources of a name the first map that has a value counts.

    Other columns pass, unless they have the name of a canonical one.
    """
    sources: dict[str, list[str]] = {}
    for fields in maps:
        for vendor, name in fields.items():
            if vendor in df.columns:
                sources.setdefault(name, []).append(vendor)
    used = {v for vendors in sources.values() for v in vendors}
    rest = [c for c in df.columns if c not in used and c not in sources]
    return df.select(*rest, *[F.coalesce(*[F.col(v).try_cast("double") for v in vendors]).alias(name) for name, vendors in sources.items()])


def first_source(df: DataFrame, out: str, *columns: str) -> DataFrame:
    """The first source that has a value."""
    return df.withColumn(out, F.coalesce(*[F.col(c).cast("double") for c in columns]))


def scan(df: DataFrame, columns: list[str], where: Column) -> DataFrame:
    """Pruned columns and a filter that reaches the Parquet scan."""
    return df.where(where).select(*columns)
