"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, LOWER, UPPER, WORD, let

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A name, and a condition on the measured columns that rejects a row; null doesn't."""

    name: str
    fails: Column


def repeated_words(w: Column, n: int) -> Column:
    """Words of array w inside n-word windows that occur twice or more in it, as a long.

    Windows are told apart by 64-bit hashes. Only an array with a repeated
    window is sorted by hash, to find which start where.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(2), F.size(starts)), lambda i: F.least(F.lit(n), F.element_at(starts, i) - F.element_at(starts, i - 1)))
        return F.when(F.size(starts) < 2, 0).otherwise(F.aggregate(gaps, F.lit(n), lambda a, x: a + x))

    def repeated(sorted_windows: Column) -> Column:
        same = lambda i, j: F.element_at(sorted_windows, i)["h"] == F.element_at(sorted_windows, j)["h"]
        size = F.size(sorted_windows)
        twice = F.filter(F.sequence(F.lit(1), size), lambda i: F.when(i > 1, same(i, i - 1)).otherwise(False) | F.when(i < size, same(i, i + 1)).otherwise(False))
        return let(F.array_sort(F.transform(twice, lambda i: F.element_at(sorted_windows, i)["i"])), covered)

    def of(hashes: Column) -> Column:
        every = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(every, repeated))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.when(F.size(w) <= n, 0).otherwise(let(hashes, of)).cast("long")


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, and the measures) for each row; a null text counts as empty."""

    def by_word(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w, 8).alias("n_repeat_words"))

    def by_line(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    w = let(F.array_remove(F.split("text", BLANK), ""), by_word)
    lines = let(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)), by_line)
    symbols = (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long")
    return rows.select("id", "text", w.alias("w"), lines.alias("l"), symbols.alias("n_symbols")).select("id", "text", "w.*", "l.*", "n_symbols")


def rules() -> list[Rule]:
    """Production rules. Capital letters are counted from the text only where no earlier rule rejects the row."""
    n, chars = F.col("n_words"), F.col("word_chars")
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    small = F.length("text") - F.length(F.translate("text", LOWER, ""))
    return [
        Rule("long_words", chars > 15 * n),
        Rule("short_words", chars < 2 * n),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("capitals", capitals > small),
    ]


def ordered(df: DataFrame, given: list[Rule], most: int = 2048, rounds: int = 2, repeats: int = 8) -> list[Rule]:
    """The rules by rejected share over cost, both measured on a sample.

    The sample is df, of which no more than `most` rows are taken; give it a
    random share of a table. A rule's cost is its time over `repeats` passes of the
    sample, the least of `rounds`, less that of a rule that never rejects; it
    counts in powers of 4, and from 10 microseconds a row on, so that rules whose
    times differ by chance cost the same. Ties keep the given order. The order decides how much work a row
    costs and which rule is named first; whether a row is kept is the same in any order.
    """
    rows = df.limit(most).persist()
    try:
        n = rows.count()
        if not n:
            return given
        again = rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

        def measure(fails: Column) -> tuple[int, float]:
            job, best = again.agg(F.count_if(F.coalesce(fails & (F.col("_again") > 0), F.lit(False)))), float("inf")
            for _ in range(rounds):
                began = time.perf_counter()
                rejected = job.first()[0]
                best = min(best, time.perf_counter() - began)
            return rejected // repeats, best

        measure(F.col("_again") < 0)
        idle = measure(F.col("_again") < 0)[1]
        gain = []
        for rule in given:
            rejected, seconds = measure(rule.fails)
            cost = 4.0 ** math.ceil(math.log(max(1e-5, (seconds - idle) / n / repeats), 4))
            gain.append((rejected + 0.5) / (n + 1) / cost)
    finally:
        rows.unpersist()
    return [rule for _, rule in sorted(zip(gain, given, strict=True), key=lambda x: -x[0])]


def cascade(df: DataFrame, given: list[Rule], out: Column) -> DataFrame:
    """df with rejected_by: the first of the rules, in their order, that rejects the row, else null; later rules aren't computed, and none is for rows that are `out` anyway."""
    verdict = F.when(out, F.lit(None).cast("string"))
    for rule in given:
        verdict = verdict.when(rule.fails, rule.name)
    return df.withColumn("rejected_by", verdict)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: list[Rule] | None = None, sample: int = 1024) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, rejected_by, kept) for each row of df.

    The base fails below 20 words, and where over 30 % of the words are in
    repeated 8-word windows; what passes it goes down the cascade, in an order
    measured on such rows among some `sample` of the table, drawn from all of its
    partitions alike, so that the order of a sorted table says nothing. Null, empty
    and blank texts have no words and fail the base. Rows are measured one by
    one, so nothing is shuffled and no group or hot source matters.
    """
    rows = measured(df, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    drawn = df.select(id_col, text_col).sample(min(1.0, sample / max(1, df.count())), 3)
    order = ordered(measured(drawn, id_col, text_col).where(~failed), rules() if given is None else given, 2 * sample)
    out = cascade(rows, order, failed).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return out.withColumn("kept", kept).select("id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
