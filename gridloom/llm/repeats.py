"""Repeated passages across documents, removed byte by byte.

Ranks of positions are refined at growing lengths, as in prefix doubling, and a
position leaves as soon as its rank is unique or settled. Two things keep that
within a few bytes of shuffle for each byte of text. Only anchors are ranked:
positions whose `K` bytes have the smallest hash among the `SPAN` starts of
some 50-byte string; equal strings have the same anchor at the same place, so
every string is spoken for. And a rank is a 64-bit hash, so that a position's
rank at any length comes from its own text, not from a join with another position.

  round 1   the K bytes at the anchor; in one document only: out
  round 2   (rank 1, rank of all 80 bytes that any string with the anchor can touch);
            equal to one in a smaller document: all strings of the anchor are repeats
  round 3   for what is left, rank 1 with the 15 bytes before the anchor, and with the
            16 after: each string with the anchor holds one of the two; not shared: out
  round 4   strings of 50 bytes, of the anchors or halves left over at the edges of
            passages, and of anchors that are too frequent to meet by rank 1:
            (rank 1, rank of the string)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .classifier import MIX, RADIX, powers
from .common import pieces, written

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1
HALF = 15  # strings that start HALF bytes or more before the anchor hold the left half, others the right one
SEGMENT = 1 << 21
LETTERS = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ID_MAX = (1 << 63) - 1
#: A row is (id, number): the number is 0 where the id is a row's own, else it tells the rows of one id apart.
ROWS = "key long, name long, id long, loc long, number long"
#: loc packs a position and two numbers: by how much the first and last string start before it (6 bits
#: each), or, where the name is null, the length of a span. Its sign is set for an anchor of a hot key, which has that key for its name.
HOT = -(1 << 63)
TYPES = pa.schema([(c, pa.int64()) for c in ("key", "name", "id", "loc", "number")])
FOUND = pa.schema([(c, pa.int64()) for c in ("id", "number", "key", "lo", "hi")])


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX)
        return (x ^ (x >> np.uint64(29))) * np.uint64(RADIX)


class Hasher:
    """Polynomial hashes, modulo 2^64, of ranges of a byte array, from running sums."""

    def __init__(self) -> None:
        self.up = self.down = powers(RADIX, 1)

    def load(self, data: np.ndarray) -> None:
        if len(data) + 1 > len(self.up):
            self.up, self.down = powers(RADIX, len(data) + 1), powers(pow(RADIX, -1, 1 << 64), len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS[data] * self.up[: len(data)], dtype=np.uint64)))

    def ranges(self, lo, hi) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """Runs of (text, offset, bytes, first and end of the string starts to look at), of bounded size; long texts are cut with a margin."""
    run, held = [], 0
    for i, text in enumerate(texts):
        for core in range(0, len(text) - LENGTH + 1, SEGMENT):
            lo, end = max(0, core - 2 * LENGTH), min(core + SEGMENT, len(text) - LENGTH + 1)
            part = text[lo : end + 3 * LENGTH]
            if run and held + len(part) > SEGMENT:
                yield run
                run, held = [], 0
            run.append((i, lo, part, core - lo, end - lo))
            held += len(part)
    if run:
        yield run


def anchors(hasher: Hasher, run: list[tuple[int, int, bytes, int, int]]) -> list[np.ndarray]:
    """key, name, text, position, and by how much the first and the last string start before it, of each anchor."""
    data = np.frombuffer(b"".join(x[2] for x in run), np.uint8)
    begin = np.cumsum([0, *(len(x[2]) for x in run)])
    hasher.load(data)
    key = hasher.ranges(np.arange(len(data) - K + 1), np.arange(K, len(data) + 1))
    bits = np.uint64((1 << 23) - 1)
    least = key & ~bits | np.arange(len(key), dtype=np.uint64)
    for step in (1, 2, 4, 8, SPAN - 16):
        least = np.minimum(least[:-step], least[step:])
    edge = np.zeros(len(data) + 1, np.int8)
    for at, (_, _, _, first, end) in zip(begin.tolist(), run, strict=False):
        edge[at + first] += 1
        edge[at + end] -= 1
    start = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    anchor = (least[start] & bits).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    first, last = start[cut], start[np.append(cut[1:], len(start)) - 1]
    anchor = anchor[cut]
    of = np.searchsorted(begin, anchor, "right") - 1
    lo, hi = np.maximum(anchor - (SPAN - 1), begin[of]), np.minimum(anchor + LENGTH, begin[of + 1])
    with np.errstate(over="ignore"):
        name = mix(hasher.ranges(lo, hi) + (anchor - lo).astype(np.uint64) * np.uint64(MIX) + (hi - anchor).astype(np.uint64))
        # 12 bits of each half's rank, and 40 of the whole's
        left = hasher.ranges(np.maximum(anchor - HALF, begin[of]), anchor + K)
        right = hasher.ranges(anchor, np.minimum(anchor + LENGTH - HALF + 1, begin[of + 1]))
        name = left >> np.uint64(52) << np.uint64(52) | right >> np.uint64(52) << np.uint64(40) | name >> np.uint64(24)
    text, offset = np.array([x[0] for x in run]), np.array([x[1] for x in run])
    return [key[anchor], name, text[of], anchor - begin[of] + offset[of], anchor - first, anchor - last]


def strings(hasher: Hasher, texts: list[bytes], wanted: list[list[dict]]) -> list[np.ndarray]:
    """As anchors(), for each single string of the wanted anchors of each text."""
    text, key, lo, hi = (np.array(c, np.int64) for c in zip(*[(i, x["key"], x["lo"], x["hi"]) for i, w in enumerate(wanted) for x in w], strict=True))
    data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)), np.uint8)
    hasher.load(data)
    size = hi - lo
    n = size - LENGTH + 1
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + inner
    zero = np.zeros(len(start), np.int64)
    return [np.repeat(key, n).view(np.uint64), hasher.ranges(start, start + LENGTH), np.repeat(text, n), np.repeat(lo, n) + inner, zero, zero]


def unsettled(found: list[list[np.ndarray]], ids: np.ndarray, numbers: np.ndarray, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows for Spark of what a chunk has found.

    Of equal names in the chunk only those in the smallest id go on; the
    others are repeats already, and go as spans. So a passage in very many texts
    has about a row for each chunk. Anchors of hot keys (sorted) aren't compared
    by key, which would bring them all to one task: spread over the tasks, they
    go on to the round of single strings.
    """
    if not found:
        return
    key, name, text, pos, o1, o2 = (np.concatenate(x) for x in zip(*found, strict=True))
    own = ids[text]
    order = np.lexsort((own, name, key))
    new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1])))
    least = np.empty(len(key), np.int64)
    least[order] = own[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    again = own > least
    on = np.flatnonzero(~again)
    loc = pos << 12 | o1 << 6 | o2
    if hot is not None and len(hot):
        very = on[hot[np.minimum(np.searchsorted(hot, key[on]), len(hot) - 1)] == key[on]]
        name[very] = key[very]
        key[very] = mix(own[very].view(np.uint64) ^ pos[very].astype(np.uint64) * np.uint64(RADIX))
        loc[very] |= np.int64(HOT)
    for i in range(0, len(on), 1 << 16):
        j = on[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(key[j].view(np.int64)), pa.array(name[j].view(np.int64)), pa.array(own[j]), pa.array(loc[j]), pa.array(numbers[text[j]])], schema=TYPES)
    again = np.flatnonzero(again)
    if len(again):
        t, lo, hi = merged(text[again], (pos - o1)[again], (pos - o2)[again] + LENGTH)
        n = -(-(hi - lo) // 4095)
        t, hi = np.repeat(t, n), np.repeat(hi, n)
        lo = np.repeat(lo, n) + 4095 * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        key = mix(ids[t].view(np.uint64) ^ lo.astype(np.uint64) * np.uint64(RADIX)).view(np.int64)  # spread over the tasks
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(t), pa.int64()), pa.array(ids[t]), pa.array(lo << 12 | np.minimum(hi - lo, 4095)), pa.array(numbers[t])], schema=TYPES)


def merged(of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of one length or rising ends, those of a text that touch or overlap made one."""
    order = np.lexsort((lo, of))
    of, lo, hi = of[order], lo[order], hi[order]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (lo[1:] > hi[:-1]))))
    return of[first], lo[first], np.maximum.reduceat(hi, first)


def settled(batches: Iterator[pa.RecordBatch], halves: bool, rows: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key, name and id to spans (key null) and, with `halves`, to what stays open (its key, and where its strings are).

    Rows are taken some `rows` at a time, with `halves` whole keys only, else whole
    names. The rows of a key that alone has more stay open, string by string,
    and of such a name the row with the least id stands for those before.
    """
    held: list[pa.RecordBatch] = []
    n, flood = 0, None
    for batch in batches:
        if flood is not None:
            end = int(np.searchsorted(batch.column(0).to_numpy(), flood, "right"))
            yield from opened(batch.slice(0, end))
            batch = batch.slice(end)
            if not len(batch):
                continue
            flood = None
        held.append(batch)
        n += len(batch)
        if n >= rows:
            whole = pa.Table.from_batches(held, TYPES).combine_chunks().to_batches()[0]
            keys = whole.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if not halves:
                last += int(np.searchsorted(whole.column(1).slice(last).fill_null(HOT).to_numpy(), whole.column(1)[-1].as_py() or HOT))
            if last:
                yield from judged(whole.slice(0, last), halves)
                held, n = [whole.slice(last)], len(whole) - last
            elif halves:
                yield from opened(whole)
                held, n, flood = [], 0, keys[-1]
            else:
                yield from judged(whole, halves)
                held, n = [whole.slice(0, 1)], 1
    if n:
        yield from judged(pa.Table.from_batches(held, TYPES).combine_chunks().to_batches()[0], halves)


def spot(ids: np.ndarray, numbers: np.ndarray, key: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers), key, pa.array(lo), pa.array(hi)], schema=FOUND)


def opened(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All strings of the rows' anchors, under their keys; spans stay spans."""
    named = batch.column(1).is_valid()
    ids, loc, numbers = (batch.column(i).filter(named).to_numpy() for i in (2, 3, 4))
    pos = (loc & ID_MAX) >> 12
    key = pc.if_else(pa.array(loc < 0), batch.column(1).filter(named), batch.column(0).filter(named))
    yield spot(ids, numbers, key, pos - (loc >> 6 & 63), pos - (loc & 63) + LENGTH)
    ids, loc, numbers = (batch.column(i).filter(pc.invert(named)).to_numpy() for i in (2, 3, 4))
    yield spot(ids, numbers, pa.nulls(len(ids), pa.int64()), loc >> 12, (loc >> 12) + (loc & 4095))


def shared(ids: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, largest id) among the rows that agree with each row in all parts."""
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    out = np.empty((2, len(ids)), np.int64)
    out[0, order] = np.minimum.reduceat(ids[order], first)[group]
    out[1, order] = np.maximum.reduceat(ids[order], first)[group]
    return out[0], out[1]


def judged(batch: pa.RecordBatch, halves: bool) -> Iterator[pa.RecordBatch]:
    """Spans and open strings of rows with whole keys."""
    plain = batch.column(1).is_valid().to_numpy(zero_copy_only=False) & (batch.column(3).to_numpy() >= 0)
    if not plain.all():
        yield from opened(batch.filter(pa.array(~plain)))
    batch = batch.filter(pa.array(plain))
    key = batch.column(0).to_numpy()
    if not len(key):
        return
    # most keys have one row
    several = np.zeros(len(key), bool)
    several[1:] = key[1:] == key[:-1]
    several[:-1] |= several[1:]
    key, name, ids, loc, numbers = (c.to_numpy()[several] for c in batch.columns)
    name = name.view(np.uint64)
    if not len(key):
        return
    least, _ = shared(ids, key, name)
    pos = loc >> 12
    lo, hi = pos - (loc >> 6 & 63), pos - (loc & 63) + LENGTH
    gone = ids > least
    if gone.any():
        yield spot(ids[gone], numbers[gone], pa.nulls(int(gone.sum()), pa.int64()), lo[gone], hi[gone])
    if not halves or gone.all():
        return
    key, ids, numbers, name, pos, lo, hi = (x[~gone] for x in (key, ids, numbers, name, pos, lo, hi))
    names = shared(name.view(np.int64), key)
    open_ = []
    for part, a, b in ((name >> np.uint64(52), lo, np.minimum(hi, pos - HALF + LENGTH)), (name >> np.uint64(40) & np.uint64(4095), np.maximum(lo, pos - HALF + 1), hi)):
        ends = shared(ids, key, part)
        open_.append(((ends[0] < ends[1]) & (names[0] < names[1]) & (b - a >= LENGTH), a, b))
    for on, a, b in open_:
        if on.any():
            yield spot(ids[on], numbers[on], pa.array(key[on]), a[on], b[on])


def hot_keys(docs: DataFrame, share: float = 1 / 16384, sample: int = 20_000, least: int = 8) -> np.ndarray:
    """Sorted keys of anchors that make up `share` or more of a sample of texts' anchors, `least` at least; 1 / share of them at most.

    It decides only how the work is dealt, never what is found.
    """
    n = docs.count()
    texts = docs.select("text") if n <= sample else docs.sample(sample / n, 5).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for _, part in pieces(batch.column(0), SEGMENT):
                keys = [anchors(hasher, cut)[0] for cut in segments(part)]
                if keys:
                    key, many = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([None, *key.view(np.int64).tolist()], pa.int64()), pa.array([many.sum(), *many])], ["key", "n"])

    counts = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = counts.orderBy(F.col("n").desc()).limit(int(1 / share) + 1).toArrow()
    key, many = top["key"], top["n"].to_numpy()
    whole = many[key.is_null().to_numpy()].sum()
    return np.sort(key.drop_null().to_numpy().view(np.uint64)[many[key.is_valid().to_numpy()] >= max(least, whole * share)])


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with a `number`: 0 for an id that one row has, else one of its own for each row, as for rows without an id.

    Only ids are counted, and only the rows that need a number are written with it.
    """
    ids = docs.groupBy("own").agg(F.count("*").alias("n")).where("n > 1 or own is null").select(F.col("own").alias("other"))
    several = written(ids)
    if several.isEmpty():
        return docs.withColumn("number", F.lit(0).cast("long"))
    same = F.col("own").eqNullSafe(F.col("other"))
    alone = docs.join(several, same, "left_anti").withColumn("number", F.lit(0).cast("long"))
    return alone.unionByName(written(docs.join(several, same, "left_semi").withColumn("number", F.monotonically_increasing_id() + 1)))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 1 << 18) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) for each row of df, whose ids are integers.

    A byte is removed if a 50-byte string that covers it also starts in a row
    with a smaller id; strings are judged on the input and lie within one text.
    removed has the maximal removed runs as byte ranges. A null text is empty;
    texts under 50 bytes keep all; rows of the same id, whatever their texts, don't
    make each other repeats; a null id counts as larger than any other.

    Anchors whose keys are very frequent, such as those in a line that many
    texts share, are left to the last round, which deals strings by their own hash;
    so are those of any key of which a task has more than `held` rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs = told_apart(df.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(ID_MAX)).alias("id"), text.alias("text")))

    hot = hot_keys(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                found = [anchors(hasher, run) for run in segments(texts)]
                yield from unsettled(found, hot=hot, *(batch.column(i).slice(first, len(texts)).to_numpy() for i in (0, 1)))

    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def ranked(rows: DataFrame, halves: bool) -> DataFrame:
        rows = rows.repartition(tasks, *(("key",) if halves else ("key", "name"))).sortWithinPartitions("key", *(() if halves else ("name", "id")))
        return rows.mapInArrow(lambda it: settled(it, halves, held), "id long, number long, key long, lo long, hi long")

    row = ["id", "number"]
    spans, open_ = (F.collect_list(F.when(c, F.struct(*f))) for c, f in ((F.col("key").isNull(), ("lo", "hi")), (F.col("key").isNotNull(), ("key", "lo", "hi"))))
    first = ranked(docs.select(*row, "text").mapInArrow(scan, ROWS), True)
    found = written(first.groupBy(*row).agg(spans.alias("spans"), open_.alias("open")))

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                own = batch.slice(first, len(texts))
                yield from unsettled([strings(hasher, texts, own.column(3).to_pylist())], own.column(0).to_numpy(), own.column(1).to_numpy())

    edges = found.where(F.size("open") > 0).select(*row, "open")
    again = ranked(docs.join(edges, row).select(*row, "text", "open").mapInArrow(rescan, ROWS), False)
    spans = found.where(F.size("spans") > 0).select(*row, "spans").unionByName(again.select(*row, F.array(F.struct("lo", "hi")).alias("spans")))
    spans = written(spans.groupBy(*row).agg(F.flatten(F.collect_list("spans")).alias("spans")))
    out = "own long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<lo: long, hi: long>>"
    types = to_arrow_schema(T._parse_datatype_string(out))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                own = batch.slice(first, len(texts))
                rows = [removed(x, s) for x, s in zip(texts, own.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(types)[1:], strict=True))], schema=types)

    placed = docs.join(spans, row, "left").select("own", "text", "spans")
    return placed.mapInArrow(cut, out).withColumnRenamed("own", "id")


def removed(text: bytes, spans: list[dict] | None) -> tuple[int, int, int, str, list[dict]]:
    """n_bytes, n_removed, n_spans, kept_sha256 and merged spans of one text."""
    merged: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    digest, at = hashlib.sha256(), 0
    for lo, hi in merged:
        digest.update(text[at:lo])
        at = hi
    digest.update(text[at:])
    return len(text), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"lo": a, "hi": b} for a, b in merged]
