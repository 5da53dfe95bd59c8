"""Line deduplication by an exact set-similarity join, with DataFrame functions only.

A line is the set of its five-word shingles (a line with fewer words is one shingle, a line
without words has no set and stays).  A line goes if an earlier line, by (id, row, line number),
has a Jaccard similarity of ``percent`` or more with it; the row is the hash of its text.

Lines of equal sets are one owner, their first line.  Owners are posted under the tokens of
their prefix, and the order of tokens is by rarity in two steps.  First all tokens that few
lines post are equally rare, in the order of their hashes: most stand in one line only, so they
need no finer order.  Two lines whose first common token is such a one meet in its posting.
Where that token is posted by more than ``HOT`` lines both lines are *crowded*, and the crowded
lines are joined once more among themselves with all tokens in the exact order of their
document frequency, so that what they share with many others comes last.

Pairs pass length and positional filters: the common tokens of two prefixes, and what may
still follow them, must reach the bound.  Jaccard is then verified on whole sets.  Crowded lines
meet the first line of a posting before those that it does not remove meet the others.

Defined cases: null and empty texts have one line without words, which stays; ties (equal lines)
go but for the first; repeated rows (equal id and text) have equal positions, so none is the
later one; rows of one id with other texts are ordered by the hash of the text; rows with a null
id keep their lines; an empty table gives an empty one; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.store import drop, save

WIDTH = 5
PERCENT = 80
#: Postings of more lines are joined again in the order of document frequency (no line is left out).
HOT = 32
BLANKS = " \t\x0b\f\r"


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))


def _tokens(words: Column) -> Column:
    """Sorted distinct hashes of the shingles."""

    def token(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)])

    return F.array_distinct(F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0))), token)))


def _sets(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and tokens of the lines, none for a line without words; ``lines`` has their text.

    No filter here: Spark would move it down and work out its columns twice.
    """
    plain = lines.select(*keep, F.btrim(F.lower("text"), F.lit(BLANKS)).alias("plain"))
    rough = F.contains("plain", F.lit(BLANKS[1]))
    for blank in BLANKS[2:]:
        rough = rough | F.contains("plain", F.lit(blank))
    cut = plain.select(*keep, F.when(rough, F.split("plain", r"[ \t\x0B\f\r]+")).otherwise(F.split("plain", " ")).alias("words"))
    full = cut.select(*keep, F.when(F.array_contains("words", ""), F.array_remove("words", "")).otherwise(F.col("words")).alias("words"))
    hashed = full.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    return hashed.select(*keep, F.when(F.size("words") > 0, _tokens(F.col("words"))).otherwise(F.array().cast("array<bigint>")).alias("tokens"))


def _line(number: Column) -> Column:
    return F.struct("doc_id", "row", number.alias("line_no")).alias("line")


def _probe(n: Column, percent: int) -> Column:
    """Prefix of a set of size n that meets every set similar to it."""
    return n - F.ceil(percent * n / 100).cast("int") + 1


def _head(n: Column, percent: int) -> Column:
    """Prefix that is enough on the side of the smaller set of a pair."""
    return n - F.ceil(2 * percent * n / (100 + percent)).cast("int") + 1


def _enough(common: Column, n: Column, m: Column, percent: int) -> Column:
    return (100 + percent) * common >= percent * (n + m)


def _ordered(percent: int) -> Column:
    """Each pair once, the smaller set on the left, within the length filter."""
    fits = 100 * F.col("n") >= percent * F.col("m")
    return fits & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") < F.col("y"))))


def _left(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("key", F.col("nth").alias("x"), "n", "i", *more)


def _right(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("key", F.col("nth").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), *[F.col(c).alias(f"y_{c}") for c in more])


def _opens(percent: int) -> Column:
    """The pair's first common token may be this one: in the head of the smaller set x, with enough behind it."""
    n, m, i, j = F.col("n"), F.col("m"), F.col("i"), F.col("j")
    return (i <= _head(n, percent)) & _enough(F.least(n - i, m - j) + 1, n, m, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nth, line, distinct: the later line of each pair (x, y) that is similar enough; ``sets``: nth, line, tokens."""
    left = sets.select(F.col("nth").alias("x"), F.col("line").alias("lx"), F.col("tokens").alias("s"))
    right = sets.select(F.col("nth").alias("y"), F.col("line").alias("ly"), F.col("tokens").alias("t"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("s", "t"))
    later = F.when(F.col("lx") > F.col("ly"), F.struct(F.col("x").alias("nth"), F.col("lx").alias("line"))).otherwise(F.struct(F.col("y").alias("nth"), F.col("ly").alias("line")))
    return both.where(_enough(common, F.size("s"), F.size("t"), percent)).select(later.alias("l")).select("l.nth", "l.line").distinct()


def _cold_pairs(cold: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of numbers that short postings leave possible, but for those of two crowded lines."""
    rows = cold.join(crowded.withColumn("crowd", F.lit(True)), "nth", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    met = _left(rows, "last", "crowd").join(_right(rows, "last", "crowd"), "key").where(_ordered(percent) & ~(F.col("crowd") & F.col("y_crowd")))
    pairs = met.groupBy("x", "y", "n", "m", "last", "y_last").agg(F.count("*").cast("int").alias("c"), F.min("i").alias("i"), F.min("j").alias("j"), F.max("i").alias("i_last"), F.max("j").alias("j_last"))
    n, m, c = F.col("n"), F.col("m"), F.col("c")
    follow = c + F.least(n - F.col("i_last"), m - F.col("j_last"))
    # All common tokens up to the nearer end of the two prefixes are among the c.
    beyond = c + F.when(F.col("last") <= F.col("y_last"), n - _probe(n, percent)).otherwise(m - _probe(m, percent))
    return pairs.where(_opens(percent) & _enough(F.least(follow, beyond), n, m, percent)).select("x", "y")


def _rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """Postings (key, nth, line, n, i) of the prefixes of sets with tokens in the order of document frequency.

    Tokens of one line only come first in any set: they are counted and not posted.
    """
    tokens = sets.select("nth", F.explode("tokens").alias("key"))
    common = tokens.withColumn("df", F.count("*").over(Window.partitionBy("key"))).where("df > 1")
    # A line's own tokens.
    ranked = common.groupBy("nth").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("common"))
    known = ranked.join(sets.select("nth", "line", F.size("tokens").alias("n")), "nth").withColumn("alone", F.col("n") - F.size("common"))
    posted = known.select("nth", "line", "n", "alone", F.posexplode(F.slice("common", F.lit(1), F.greatest(_probe(F.col("n"), percent) - F.col("alone"), F.lit(0)))).alias("i", "token"))
    return posted.select(F.col("token.key").alias("key"), "nth", "line", "n", (F.col("alone") + F.col("i") + 1).alias("i"))


def _meet(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    return _left(x, "line").join(_right(y, "line"), "key").where(_ordered(percent) & _opens(percent))


def _first_meetings(posted: DataFrame, percent: int) -> DataFrame:
    """For each line one earlier line: the first of a posting that may be similar, of those met most often."""
    first = posted.groupBy("key").agg(F.min(F.struct("line", "nth", "n", "i")).alias("f")).select("key", "f.*")
    met = _meet(posted, first, percent).unionByName(_meet(first, posted, percent)).where("line <> y_line")
    later = F.when(F.col("line") > F.col("y_line"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).otherwise(F.struct(F.col("y").alias("a"), F.col("x").alias("b")))
    return met.select(later.alias("l")).groupBy("l.a", "l.b").count().groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("y")).withColumnRenamed("a", "x")


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line (doc_id, row, line_no), distinct: the lines that an earlier line removes."""
    base = _base(docs, id_col, text_col)
    lines = base.where("doc_id is not null").select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).select(_line(F.col("line_no")), "text")
    n = F.size("tokens")
    facts = [n.alias("n"), F.xxhash64("tokens").alias("s1"), F.xxhash64(F.lit(1), F.col("tokens")).alias("s2")]
    stored = save(_sets(lines, "line").select("line", F.monotonically_increasing_id().alias("nth"), *facts, F.slice("tokens", F.lit(1), _probe(n, percent)).alias("prefix")), "prefixes")
    known = stored.where("n > 0")

    # Equal sets: all but the first line go, and only the first is posted.
    firsts = known.groupBy("s1", "s2").agg(F.count("*").alias("count"), F.min(F.struct("line", "nth")).alias("own")).where("count > 1")
    many = save(firsts.select("s1", "s2", F.col("own.line").alias("first"), F.col("own.nth").alias("own")), "many")
    copies = save(known.select("line", "nth", "s1", "s2").join(many, ["s1", "s2"]).where("nth <> own").select("line", (F.col("line") == F.col("first")).alias("again")), "copies")
    # Joined by sorting whatever the size, as a large table would be: what moves stays in proportion to the input.
    owners = known.join(many.select("s1", "s2", "own").hint("merge"), ["s1", "s2"], "left").where("own is null or own = nth")
    # A posting's row is a number and two small integers; the rest follows for the few that share a token.
    posted = owners.select("nth", "n", F.posexplode("prefix").alias("i", "key"))
    key = Window.partitionBy("key")
    counted = posted.select("*", F.count("*").over(key).alias("lines"), F.min("n").over(key).alias("least"), F.max("n").over(key).alias("most"))
    often = (F.col("lines") > 2) | (F.col("lines") > 1) & (100 * F.col("least") >= percent * F.col("most"))
    among = counted.where(often).select("key", "nth", "n", (F.col("i") + 1).alias("i"), (F.col("lines") > HOT).alias("hot"))
    shared = save(among.join(known.select("nth", F.element_at("prefix", -1).alias("last")), "nth"), "postings")
    crowded = save(shared.where("hot").select("nth").distinct(), "crowded")
    cold = save(_cold_pairs(shared.where("not hot"), crowded, percent), "pairs")

    # Whole sets of crowded lines and of lines in pairs, built again from their texts.
    ends = cold.select(F.explode(F.array("x", "y")).alias("nth"), F.lit(False).alias("crowd")).unionByName(crowded.withColumn("crowd", F.lit(True)))
    once = ends.groupBy("nth").agg(F.max("crowd").alias("crowd")).join(known.select("nth", "line"), "nth")
    wanted = save(once.groupBy("line.doc_id", "line.row").agg(F.collect_list(F.struct("line.line_no", "nth", "crowd")).alias("numbers")), "wanted")
    drop(stored, many, shared, crowded)
    texts = base.join(wanted.hint("merge"), ["doc_id", "row"])
    repeated = copies.where("again").select("line.doc_id", "line.row").distinct()
    if not repeated.isEmpty():
        first = texts.join(repeated, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
        texts = texts.join(repeated, ["doc_id", "row"], "left_anti").unionByName(first)
    # Only the wanted lines are copied out of a text; it is split below the generator, so once.
    split = texts.select("doc_id", "row", F.split("text", "\n").alias("all"), "numbers")
    pick = F.transform("numbers", lambda x: F.struct(x.nth.alias("nth"), x.crowd.alias("crowd"), x.line_no.alias("line_no"), F.get("all", x.line_no).alias("text")))
    chosen = split.select("doc_id", "row", F.inline(pick))
    known = save(_sets(chosen.select("nth", _line(F.col("line_no")), "text", "crowd"), "nth", "line", "crowd"), "sets")

    posts = save(_rare_first(known.where("crowd"), percent), "ordered")
    gone = save(_verified(cold.unionByName(_first_meetings(posts, percent)).distinct(), known, percent), "gone")

    # Those left meet the earlier lines of their postings, from either side of a pair's sizes.
    left = posts.join(gone.select("nth"), "nth", "left_anti")
    more = save(_meet(left, posts, percent).where("y_line < line").unionByName(_meet(posts, left, percent).where("line < y_line")).select("x", "y").distinct(), "more")
    # Few lines are in these pairs; the sets of the others stay where they are.
    few = more.select(F.explode(F.array("x", "y")).alias("nth")).distinct()
    later = _verified(more, known.join(few, "nth", "left_semi"), percent)
    out = save(copies.where("not again").select("line").unionByName(gone.select("line")).unionByName(later.select("line")).distinct(), "removed")
    drop(copies, cold, wanted, known, posts, gone, more)
    return out


def _per_row(gone: DataFrame) -> DataFrame:
    return gone.groupBy("line.doc_id", "line.row").agg(F.sort_array(F.collect_list("line.line_no")).alias("gone"))  # a text's own lines


def line_report(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the sorted numbers (from 0) of removed lines."""
    gone = _per_row(removed_lines(docs, percent, id_col, text_col))
    sizes = _base(docs, id_col, text_col).select("doc_id", "row", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    out = sizes.join(gone, ["doc_id", "row"], "left").withColumn("removed", F.coalesce("gone", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed")


def remove_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed lines; other columns and rows as they are, null texts too."""
    gone = _per_row(removed_lines(docs, percent, id_col, text_col))
    whole = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("row"), F.struct("*").alias("own"))
    joined = whole.join(gone, ["doc_id", "row"], "left")
    text = F.col("own").getField(text_col)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    changed = F.when(F.col("gone").isNull(), text).otherwise(kept)
    return joined.select(*[(changed if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns])
