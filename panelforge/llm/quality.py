"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text.  The ledger keeps the measurements and one
64-bit mask of failed rules; a policy is a versioned mask, so applying a policy or
measuring an ablation is bit arithmetic on the ledger and never reads a text again.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``.  Defined cases: a null text counts
as empty; an empty text has no words and fails ``few_words`` only (ratios of nothing
pass); repeated rows give repeated ledger rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm import words as W
from panelforge.llm.store import small_batches

#: name -> bit.  Bits are never reused; a new rule takes the next one.
RULES = {"few_words": 0, "repeated_windows": 1, "long_words": 2, "symbols": 3, "duplicate_lines": 4, "short_words": 5}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "long_words", "symbols", "duplicate_lines", "short_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def rule_columns() -> dict[str, Column]:
    """A Boolean column per rule, true where the text fails it."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": words < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * words,
        "long_words": (words > 0) & (chars > 25 * words),
        "symbols": (words > 0) & (10 * F.col("n_symbols") > 3 * words),
        "duplicate_lines": (F.col("n_lines") > 0) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        "short_words": (words > 0) & (chars < 2 * words),
    }


def mask_of(policy: str) -> int:
    return sum(1 << RULES[name] for name in POLICIES[policy])


def _repeats(windows: np.ndarray) -> np.ndarray:
    """Which windows of one text are found twice or more."""
    order = np.argsort(windows, kind="stable")
    sorted_ = windows[order]
    same = np.zeros(len(windows), dtype=bool)
    equal = sorted_[1:] == sorted_[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    out = np.zeros(len(windows), dtype=bool)
    out[order] = same
    return out


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = W.spans(data, offsets)
    n_words = np.diff(first)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    per_word = np.concatenate([[0], np.cumsum(leads[ends] - leads[starts])])
    word_chars = per_word[first[1:]] - per_word[first[:-1]]
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_symbols = marks[offsets[1:]] - marks[offsets[:-1]]
    hashed = W.hash_spans(data, starts, ends, lower=False)
    # Lines: between line feeds and text ends; only those that hold a word count.
    feeds = np.flatnonzero(data == 10)
    line_start = np.union1d(offsets[:-1], feeds + 1)
    line_start = line_start[line_start < len(data)]
    line_end = offsets[np.searchsorted(offsets, line_start, "right")] if len(line_start) else line_start
    if len(feeds):
        at = np.searchsorted(feeds, line_start, "left")
        line_end = np.minimum(line_end, np.where(at < len(feeds), feeds[np.minimum(at, len(feeds) - 1)], len(data)))
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_hash = W.hash_spans(data, line_start, line_end, lower=False)
    line_first = np.searchsorted(line_start, offsets)
    n_lines = np.diff(line_first)
    triples, begin = W.shingles(hashed, first, 3)
    n_dup = np.zeros(len(n_words), dtype=np.int64)
    n_repeat = np.zeros(len(n_words), dtype=np.int64)
    for i in range(len(n_words)):
        if n_lines[i] > 1:
            own = line_hash[line_first[i] : line_first[i + 1]]
            n_dup[i] = len(own) - len(np.unique(own))
        if n_words[i] > 3:
            twice = _repeats(triples[begin[i] : begin[i + 1]])
            if twice.any():
                covered = np.zeros(n_words[i], dtype=bool)
                covered[:-2] |= twice
                covered[1:-1] |= twice
                covered[2:] |= twice
                n_repeat[i] = covered.sum()
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines]


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the mask of failed rules.  A map over rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.blocks(batch.column(1)):
                columns = [pa.array(np.asarray(x), pa.int64()) for x in _measure(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *columns], ["doc_id", *MEASURES])

    measured = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = [F.when(fails, F.lit(1 << RULES[name])).otherwise(F.lit(0)) for name, fails in rule_columns().items()]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measured.withColumn("failed", mask.cast("bigint"))


def apply_policy(book: DataFrame, policy: str, column: str = "kept") -> DataFrame:
    """Add ``column``: true where no rule of the policy failed."""
    return book.withColumn(column, F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: texts it fails, and texts that only it rejects.

    One pass of bitwise counts over the ledger, whatever the number of rules.
    """
    mask = mask_of(policy)
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    names = POLICIES[policy]
    row = book.agg(
        F.count("*").alias("n"),
        *[F.count(F.when(hit.bitwiseAND(F.lit(1 << RULES[name])) != 0, 1)).alias(f"f_{name}") for name in names],
        *[F.count(F.when(hit == (1 << RULES[name]), 1)).alias(f"o_{name}") for name in names],
    )
    made = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col("n").alias("n_texts"), F.col(f"f_{name}").alias("n_failed"), F.col(f"o_{name}").alias("n_only")) for name in names]))
    return row.select(made.alias("x")).select("x.*")
