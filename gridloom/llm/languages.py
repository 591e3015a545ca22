"""Languages of texts by n-gram filters: one Bloom filter a language, kept as slices of bits.

A row of the table has one bit for each language. An n-gram's rows, and-ed, give
all languages whose filters hold it; a text's counts by language, less what
false positives give on average, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .classifier import MIX, RADIX
from .common import LOWER_BYTES, per_text, pieces, written

#: Lengths of n-grams in bytes; a word has a blank before and after it.
ORDERS = (2, 3, 4, 5)
#: Positions that are worked on at a time, and n-grams that a task holds before it passes counts on.
SLICE, HELD = 1 << 20, 1 << 20
#: Bytes that belong to words: ASCII letters and all beyond ASCII; others become blanks.
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
LOWERED = np.frombuffer(LOWER_BYTES, np.uint8)
BLANK = 0x20


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in lower case, each run of others a single blank; where each text begins, and the end).

    A text begins with the blank before its first word; one more stands at the end.
    """
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    kept = LETTER[data]
    kept[1:] |= LETTER[data[:-1]]  # a blank stays where a word ends
    kept[starts] = True
    out = np.where(LETTER[data], LOWERED[data], BLANK).astype(np.uint8)[kept]
    return out, np.concatenate(([0], np.cumsum(np.add.reduceat(kept, starts, dtype=np.int64))))[:-1]


def ngrams(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, n-grams as numbers, text of each) in slices: windows that lie in one word and the blanks around it."""
    wide = np.concatenate((data, np.full(max(ORDERS), BLANK, np.uint8)))
    for lo in range(0, len(data), SLICE):
        hi = min(lo + SLICE, len(data))
        part = wide[lo : hi + max(ORDERS)]
        blank = part == BLANK
        text = np.searchsorted(starts, np.arange(lo, hi), "right") - 1
        code, inside = np.zeros(hi - lo, np.uint64), np.ones(hi - lo, bool)
        for n in range(1, max(ORDERS) + 1):
            last = slice(n - 1, n - 1 + hi - lo)
            code = code << np.uint64(8) | part[last]
            if n > 2:
                inside &= ~blank[n - 2 : n - 2 + hi - lo]
            if n in ORDERS:
                # a blank alone, or two of them, say nothing
                at = np.flatnonzero(inside & ~(blank[: hi - lo] & blank[last])) if n < 3 else np.flatnonzero(inside)
                yield n, code[at] | np.uint64(n) << np.uint64(56), text[at]


def counted(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(code, lang, n): how often each n-gram stands in a language's texts; tasks add up their own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                code, n = summed(found)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array([lang] * len(code), pa.string()), pa.array(n)], ["code", "lang", "n"])
            held.clear()

        for batch in batches:
            for first, texts in pieces(batch.column(1), SLICE):
                langs = batch.column(0).slice(first, len(texts)).to_pylist()
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs])
                for _, code, text in ngrams(*letters(texts)):
                    for i, name in enumerate(names):
                        own = code[of[text] == i] if len(names) > 1 else code
                        if len(own):
                            held.setdefault(name, []).append(np.unique(own, return_counts=True))
                for name in names:
                    if name in held:
                        held[name] = [summed(held[name])]
                if sum(len(found[0][0]) for found in held.values()) > HELD:
                    yield from given()
        yield from given()

    texts = df.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "code long, lang string, n long").groupBy("code", "lang").agg(F.sum("n").alias("n"))


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by code of several such pairs."""
    code, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return code, np.bincount(back, np.concatenate([n for _, n in found]), len(code)).astype(np.int64)


def rows_of(codes: np.ndarray, rows: int, hashes: int) -> list[np.ndarray]:
    """The rows of each n-gram."""
    with np.errstate(over="ignore"):
        x = (codes ^ (codes >> np.uint64(31))) * np.uint64(MIX)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(RADIX)
        step = x >> np.uint64(32) | np.uint64(1)
        return [((x + np.uint64(i) * step) & np.uint64(rows - 1)).astype(np.int64) for i in range(hashes)]


@dataclass
class Filters:
    """Bit-sliced filters of languages, in words of 64."""

    langs: list[str]
    slices: np.ndarray  # (words, rows)
    hashes: int
    false: np.ndarray  # chance that a filter claims an n-gram that it lacks
    first: int  # the language that has most texts

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the languages that hold it, as bits."""
        at = rows_of(codes, self.slices.shape[1], self.hashes)
        return [np.bitwise_and.reduce([word[i] for i in at]) for word in self.slices]

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, how many of them each language holds)."""
        hits, n = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        for _, codes, text in ngrams(*letters(texts)):
            n += np.bincount(text, minlength=len(texts))
            begin = np.flatnonzero(np.diff(text, prepend=-1))
            if not len(begin):
                continue
            for w, mask in enumerate(self.masks(codes)):
                for bit in range(min(64, len(self.langs) - 64 * w)):
                    hits[text[begin], 64 * w + bit] += np.add.reduceat((mask >> np.uint64(bit) & np.uint64(1)).astype(np.int64), begin)
        return n, hits

    def decide(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(index of each text's language, its share of what all languages hold)."""
        n, hits = self.counts(texts)
        held = np.maximum(hits - n[:, None] * self.false, 0) / (1 - self.false)
        total = held.sum(axis=1)
        best = np.where(total > 0, held.argmax(axis=1), self.first)
        share = held[np.arange(len(n)), best] / np.where(total > 0, total, 1)
        return best, np.where(total > 0, share, 1 / len(self.langs))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = 1e-5, beside: float = 0.25, rows: int = 1 << 20, hashes: int = 3) -> Filters | None:
    """Filters from all texts of df that have a language; None where no text has.

    A language holds an n-gram that makes up `share` or more of its n-grams of
    that length and `beside` or more of the share in the language that has most
    of it, so that stray passages in another language don't count. At most
    1 / share n-grams of each length come in for a language, whatever the corpus,
    and `rows` numbers for each 64 languages come to the driver.
    """
    texts = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.shiftright("code", 56)
    counts = written(counted(texts, text_col, lang_col).withColumn("size", order))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") >= share * F.col("total")).withColumn("own", F.col("n") / F.col("total"))
    chosen = shares.withColumn("most", F.max("own").over(W.partitionBy("code"))).where(F.col("own") >= beside * F.col("most"))
    many = df.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()
    if not many:
        return None
    langs = sorted((r[0] for r in many), key=str.encode)
    place = F.array_position(F.lit(langs), F.col("lang")) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = rows_of(batch.column(0).to_numpy().view(np.uint64), rows, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), *(pa.array(np.tile(batch.column(i).to_numpy(), hashes)) for i in (1, 2))], ["row", "word", "bit"])

    bits = chosen.select("code", F.shiftright(place, 6).cast("long").alias("word"), (place % 64).cast("long").alias("bit")).mapInArrow(run, "row long, word long, bit long")
    got = bits.groupBy("row", "word").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("mask")).toArrow()
    slices = np.zeros((-(-len(langs) // 64), rows), np.uint64)
    slices[got["word"].to_numpy(), got["row"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    filled = np.array([np.mean(slices[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))])
    most = max(many, key=lambda r: (r[1], [-b for b in r[0].encode()]))[0]
    return Filters(langs, slices, hashes, filled**hashes, langs.index(most))


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ("doc_id",), usable: Column | None = None, **how) -> DataFrame:
    """(row, lang_pred, score) for each row of df; row is a struct of the carried columns.

    Filters are trained on all rows with a language that `usable` (a condition on
    df's columns) allows. Whole texts are read. A text that is null or has no
    letter is 'und' with score 1; so is every text where nothing was learned,
    with score 0. A text whose n-grams no language holds gets the commonest
    language, with an equal share for a score; ties go to the first name.
    Repeated rows get equal results, and an empty table gives none.
    """
    learned = train(df.where(usable) if usable is not None else df, text_col, lang_col, **how)
    text = F.col(f"`{text_col}`").cast("string")
    plain = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("written"))
    model = df.sparkSession.sparkContext.broadcast(learned)

    def work():
        filters = model.value

        def run(texts: list[bytes]):
            if filters is None:
                return [["und"] * len(texts), [0.0] * len(texts)]
            best, share = filters.decide(texts)
            return [[filters.langs[i] for i in best], share]

        return run

    scored = per_text(plain, "text", ["carried", "written"], "lang string, share double", work)
    known = F.col("row.written")
    return scored.select(F.col("row.carried").alias("row"), F.when(known, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(known, F.col("share")).otherwise(1.0).alias("score"))
