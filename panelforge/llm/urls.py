"""URL filter: longest-prefix host and path rules, else logistic regression.

The regression reads hashed character n-grams of host and path and is trained from a
small labelled URL table.  Everything runs in the JVM: DataFrame functions and Spark ML's
hashing and logistic regression; no Python on the executors.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule
and is judged by the regression on an empty string; repeated urls get equal verdicts;
other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, rule): host before the first slash, then a path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DIMENSIONS = 1 << 12
NGRAM = 4
THRESHOLD = 0.5

#: Words of the labelled urls' hosts and paths (fixed values): unwanted sites, and sites to keep.
UNWANTED = (
    "casino slots", "poker jackpot", "betting odds", "roulette bonus", "lottery win", "viagra pills", "pharmacy meds", "adult cams", "xxx videos",
    "porn tube", "escort dating", "warez crack", "keygen serial", "torrent rip", "payday loan", "fast cash", "forex profit", "crypto doubler",
    "adserver banner", "ads click", "tracker pixel", "popunder traffic", "replica watches", "backlinks seo", "cheap followers", "diet miracle",
)
WANTED = (
    "university research", "library books", "news world", "docs guide", "museum paintings", "forum question", "school lessons", "city services",
    "recipes soup", "wiki physics", "health advice", "weather forecast", "travel notes", "garden plants", "history archive", "science journal",
    "music reviews", "football results", "railway timetable", "church parish", "photography lens", "software manual", "law court", "bank accounts",
    "theatre tickets", "hospital clinic", "morning things", "nation station", "northern letters", "mother kitchen", "heritage trust", "another thought",
    "reading nothing", "action painting", "theory teacher", "farm cheese", "village fair", "inland waters", "stone bridge", "paper maker",
    "winter coats", "short stories", "friends meeting", "honest answers", "children together", "street market", "brother johnson", "thunder valley",
    "shadow theatre", "island ferry", "tradition dance", "portable radio",
)
#: Shapes of urls; {a} and {b} are a site's two words, {n} a number.
SHAPES = (
    "http://{a}.example/{b}", "https://www.{a}.example.com/{b}/{n}", "http://{a}-{b}.example.net/", "https://m.{b}-{a}.example.org/en/{n}",
    "https://blog.{a}{b}.example.com/de/{n}.html", "http://example.org/{a}/{b}", "https://{b}{a}.example.net/fr/{n}/", "https://{a}.{b}.example/index.html",
    "http://www.{b}.example.com/{a}-{n}", "https://example.net/es/{b}/{a}?page={n}", "https://example{n}.example.com/{a}/{n}", "http://{a}{n}.example.org/",
)


def labelled() -> list[tuple[int, str]]:
    """The small labelled table, 1 = block: every site in every shape, and bare urls to keep."""
    table = []
    for block, sites in ((1, UNWANTED), (0, WANTED)):
        for i, site in enumerate(sites):
            a, b = site.split()
            table += [(block, shape.format(a=a, b=b, n=17 * i + 101 * k + 3)) for k, shape in enumerate(SHAPES)]
    return [*table, (0, ""), (0, "http://example.com/"), (0, "https://example.net/de/12345.html"), (0, "https://www.example.com/es/54321?page=2")]


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    at_host = (F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))
    return at_host & F.startswith(F.col("path"), F.lit(slash + rest))


def _with_grams(df: DataFrame, n: int = NGRAM) -> DataFrame:
    """All character n-grams of host and path, linear in their length; a shorter text is one gram.

    Which digit stands in a url says nothing, so all count as 0.
    """
    text = F.translate(F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$")), "123456789", "000000000")
    chars = df.withColumn("url_chars", F.split(text, ""))
    starts = F.sequence(F.lit(0), F.greatest(F.size("url_chars") - n, F.lit(0)))
    return chars.withColumn("url_grams", F.transform(starts, lambda i: F.concat_ws("", *[F.get(F.col("url_chars"), i + k) for k in range(n)])))


def train(spark: SparkSession, table: list[tuple[int, str]] | None = None) -> LogisticRegressionModel:
    """Fit the regression on a small labelled table (tens to thousands of urls)."""
    rows = [(float(y), u) for y, u in (labelled() if table is None else table)]
    table = spark.createDataFrame(rows, "label double, url string")
    table = _with_grams(table.select("label", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))).coalesce(1)
    hashed = HashingTF(inputCol="url_grams", outputCol="url_features", numFeatures=DIMENSIONS, binary=True).transform(table)
    return LogisticRegression(featuresCol="url_features", predictionCol="url_class", probabilityCol="url_probability", rawPredictionCol="url_raw", regParam=0.01, maxIter=40).fit(hashed)


def judge(pages: DataFrame, model: LogisticRegressionModel | None = None, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's block score.  No shuffle."""
    model = model or train(pages.sparkSession)
    parts = pages.select(pages[id_col].alias("page_id"), host(pages[url_col]).alias("host"), path(pages[url_col]).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        rule = F.when(_fits(name), F.lit(name)).otherwise(rule)
        verdict = F.when(_fits(name), F.lit(kind)).otherwise(verdict)
    hashed = HashingTF(inputCol="url_grams", outputCol="url_features", numFeatures=DIMENSIONS, binary=True).transform(_with_grams(parts))
    scored = model.transform(hashed)
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array(F.col("url_probability"))[1]
    by_score = F.when(score >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_score).alias("verdict"), score.alias("block_score"))
