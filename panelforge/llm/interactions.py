"""Filter interaction audit: what each filter removes in every order, by Lehmer-rank difference arrays.

A document's mask holds the filters that it fails.  In an order of filters it goes at the
first one in its mask.  Orders that begin with the same filters are neighbours in
lexicographic rank, so those in which a mask goes at a given step are a few intervals
of ranks: a mask's count is added where an interval begins, taken off where it ends, and one
running sum over the ranks gives the removals of all orders.  Documents are counted once per part and mask;
the number of orders never multiplies them.

Filters: A under 50 words; B distinct words under 65 % of words; C upper-case letters over 5 % of code
points; D any of ``#$%&*|``; E the text of a smaller id, in any part.  Words are maximal
runs outside ``[\\x20\\x09-\\x0D]``, with case.

Defined cases: a null text counts as empty (it fails A only, and E as a copy of an empty text); a null part
is the empty string; rows with a null id never fail E and have no labels; of repeated rows (equal id and text)
none fails E for another; a document is good or toxic if any of its label rows says so, null labels say
nothing; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.llm.store import save

FILTERS = "ABCDE"
_WORD = r"[^\x20\x09-\x0D]+"


def order_of(rank: int, letters: str = FILTERS) -> str:
    """The order of a lexicographic rank, from its Lehmer digits."""
    out = ""
    for left in range(len(letters), 0, -1):
        digit, rank = divmod(rank, factorial(left - 1))
        out += letters[digit]
        letters = letters[:digit] + letters[digit + 1 :]
    return out


def intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank past the last): the orders in which a mask goes at a step."""
    found = []

    def walk(mask: int, unused: tuple[int, ...], rank: int, step: int) -> None:
        width = factorial(len(unused) - 1)
        for digit, item in enumerate(unused):
            first = rank + digit * width
            if mask >> item & 1:
                found.append((mask, step, first, first + width))
            else:
                walk(mask, unused[:digit] + unused[digit + 1 :], first, step + 1)

    for mask in range(1, 1 << n):
        walk(mask, tuple(range(n)), 0, 1)
    return found


def text_failures(text: Column) -> list[Column]:
    """Failures of the filters A to D, which need one text only."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, digest of the text and mask of the filters A to D.  A map over rows."""
    text = F.coalesce(docs[text_col], F.lit(""))
    bits = [F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, fails in enumerate(text_failures(text))]
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        reduce(lambda a, b: a + b, bits).alias("mask"),
    )


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "good", "toxic")]


def mask_counts(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, at most 32 rows a part.

    Copies are counted by digest and part before the smallest id of a digest is looked up, so a
    text that makes up a third of the table is one row a part in that join.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    rows = masks(docs, **columns).join(known, "doc_id", "left").withColumns({"n": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    by_id = rows.groupBy("digest", "mask", "part", "doc_id").agg(*_sums())
    # Of each digest and part: all rows, those of its smallest id, those without an id.
    counted = F.struct("n", "good", "toxic")
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    groups = by_id.groupBy("digest", "mask", "part").agg(
        *_sums(),
        F.min("doc_id").alias("least"),
        F.coalesce(F.min_by(counted, "doc_id"), none).alias("first"),
        F.coalesce(F.max(F.when(F.col("doc_id").isNull(), counted)), none).alias("unnamed"),
    )
    groups = save(groups, "copies")
    smallest = groups.groupBy("digest").agg(F.min("least").alias("smallest"))
    placed = groups.join(smallest, "digest")
    stays = {c: F.when(F.col("least") == F.col("smallest"), F.col("first")[c]).otherwise(0) + F.col("unnamed")[c] for c in ("n", "good", "toxic")}
    copy = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask"), *[v.cast("bigint").alias(c) for c, v in stays.items()]),
        F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(c) - v).cast("bigint").alias(c) for c, v in stays.items()]),
    )
    return placed.select("part", F.inline(both)).where("n > 0").groupBy("part", "mask").agg(*_sums())


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``columns``: id_col, text_col and part_col of ``docs``, where they differ from doc_id, text, source.
    """
    spark = docs.sparkSession
    counts = save(mask_counts(docs, labels, **columns), "masks")
    n, ranks = len(FILTERS), factorial(len(FILTERS))
    # The table of intervals has a fixed size: it depends on the number of filters only.
    table = F.broadcast(spark.createDataFrame(intervals(), "mask int, step int, first int, past int"))
    ends = counts.join(table, "mask").select("part", "step", F.explode(F.array(*[F.struct(F.col(at).alias("rank"), *[(sign * F.col(c)).alias(c) for c in ("n", "good", "toxic")]) for at, sign in (("first", 1), ("past", -1))])).alias("e")).select("part", "step", "e.*")
    fails = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)]
    per_part = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(f, F.col("n")).otherwise(0)) for f in fails]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]).alias("alone"),
    )
    zero = F.lit(0).cast("bigint")
    steps, all_ranks = F.sequence(F.lit(1), F.lit(n)), F.sequence(F.lit(0), F.lit(ranks - 1))
    grid = per_part.select("part", F.explode(steps).alias("step")).select("part", "step", F.explode(all_ranks).alias("rank"), zero.alias("n"), zero.alias("good"), zero.alias("toxic"))
    # Difference arrays, one a part and step; the end past the last rank is not needed.
    changes = grid.unionByName(ends.where(F.col("rank") < ranks)).groupBy("part", "step", "rank").agg(*_sums())
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    at = changes.select("part", "step", "rank", *[F.sum(c).over(running).alias(c) for c in ("n", "good", "toxic")])
    orders = F.array(*[F.lit(order_of(r)) for r in range(ranks)])
    at = at.withColumn("filter_order", F.element_at(orders, F.col("rank") + 1)).withColumn("letter", F.ascii(F.expr("substring(filter_order, step, 1)")) - ord(FILTERS[0]) + 1)
    gone = F.sum("n").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    over_all = F.sum("n").over(Window.partitionBy("part", "letter"))
    at = at.withColumns({"gone": gone, "shapley": over_all}).join(per_part, "part")
    return at.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", F.col("letter")) - F.col("n")).alias("redundant"),
        F.element_at("alone", F.col("letter")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )
