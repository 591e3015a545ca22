"""Prediction by partial matching over bytes, and a unigram base, for whole documents."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .classifier import Tokenizer, parts
from .common import LOWER_BYTES, as_bytes, pieces, shared_folder, written

#: Two bytes that UTF-8 never has stand before a text's first byte and for its end.
START, END = 0xFE, 0xFF
SYMBOLS = 255
#: Bytes of text whose codes are held at a time.
PIECE = 1 << 20
#: Rows of some megabytes are written in row groups of a few, which bounds what a writer and a reader hold.
LARGE_ROWS = {"parquet.block.size": 1 << 25, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code of each symbol with its `order` bytes of context, number of symbols of each text); a text's symbols are its bytes and its end."""
    lead = bytes([START]) * order
    data = np.frombuffer(b"".join(lead + x + bytes([END]) for x in texts) or lead, np.uint8).astype(np.uint64)
    code = data[order:].copy()
    for k in range(1, order + 1):
        code |= data[order - k : len(data) - k] << np.uint64(8 * k)
    return code[data[order:] != START], np.fromiter(map(len, texts), np.int64, len(texts)) + 1


def distinct(texts: list[bytes], order: int) -> np.ndarray:
    """The codes of texts, each once and in order; codes with repeats are held for a piece of the texts only."""
    return np.unique(np.concatenate([np.unique(grams(piece, order)[0]) for piece in parts(texts, PIECE)]))


def at(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value in a sorted array that isn't empty."""
    place = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return place, sorted_[place] == wanted


def small(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(x.astype(np.float32) for x in arrays)


class Trie:
    """A trie of byte contexts of up to `order` bytes (7 at most), level by level in sorted arrays.

    A symbol costs an escape from each longer context that hasn't seen it; an
    escape's probability is the number of distinct symbols over that number
    plus the occurrences (method C). Symbols of a longer context are excluded
    from the shorter ones, down to equal shares for what was never seen. What
    exclusion leaves to a context depends only on the longer context that was
    escaped from, so each context keeps two pairs of (log10 of all that is left,
    log10 of the escape): its own, and its shorter context's after it.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, short: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Of (code, count) pairs; with `short`, those of all texts with one byte of context, codes may be all that share some last two bytes of context."""
        self.order, self.levels = order, []
        parent = None
        for k in range(order + 1):
            all_, many = short if short is not None and k < 2 else (codes, counts)
            gram, to = np.unique(all_ & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(to, many, len(gram))
            context, row = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(row, n, len(context)), np.bincount(row, minlength=len(context))
            after = (np.zeros(len(context)), np.zeros(len(context)))
            if k:
                shorter = at(parent["gram"], gram & np.uint64((1 << 8 * k) - 1))[0]
                above = at(parent["context"], context & np.uint64((1 << 8 * (k - 1)) - 1))[0] if k > 1 else np.zeros(len(context), int)
                left = parent["total"][above] - np.bincount(row, parent["n"][shorter], len(context))
                fresh = parent["kinds"][above] - kinds
                after = (np.log10(np.maximum(left + fresh, 1)), np.where(fresh > 0, np.log10(np.maximum(fresh, 1) / np.maximum(left + fresh, 1)), 0.0))
            parent = {"gram": gram, "context": context, "n": n, "total": total, "kinds": kinds}
            self.levels.append({"gram": gram, "log": np.log10(np.maximum(n, 1)).astype(np.float32), "row": row.astype(np.int32), "context": context, "own": small(np.log10(np.maximum(total + kinds, 1)), np.log10(np.maximum(kinds, 1) / np.maximum(total + kinds, 1))), "after": small(*after)})
        self.rest = float(np.log10(max(1, SYMBOLS - int(self.levels[0]["gram"].size))))

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out = np.zeros(len(code))
        todo, via = np.arange(len(code)), None  # via: row of the longer context that was escaped from, -1: none
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level["gram"]) or not len(todo):
                continue
            gram = code[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            place, seen = at(level["gram"], gram)
            row = np.where(seen, level["row"][place], -1)
            miss = np.flatnonzero(~seen)
            context, known = at(level["context"], gram[miss] >> np.uint64(8))
            row[miss] = np.where(known, context, -1)
            known = row >= 0
            left, escape = (np.where(known, x[row], 0.0) for x in level["own"])
            if via is not None:
                after = self.levels[k + 1]["after"]
                left, escape = (np.where(via >= 0, x[via], own) for x, own in zip(after, (left, escape), strict=True))
            out[todo] += np.where(seen, level["log"][place] - left, np.where(known, escape, 0.0))
            todo, via = todo[miss], row[miss]
        out[todo] -= self.rest
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        code, n = grams(texts, self.order)
        own, to = np.unique(code, return_inverse=True)  # each code is looked up once, and in order
        return np.add.reduceat(self.logs(own)[to], np.cumsum(n) - n)


def count_grams(df: DataFrame, text_col: str, order: int) -> DataFrame:
    """(code, n): how often each symbol follows each context of `order` bytes, over all texts; each task sends a row for each code at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            for _, texts in pieces(batch.column(0), 1 << 22):
                code, n = np.unique(grams(texts, order)[0], return_counts=True)
                codes.append(code)
                counts.append(n)
                if sum(map(len, codes[1:])) > max(1 << 21, len(codes[0])):
                    codes, counts = merged(codes, counts)
        codes, counts = merged(codes, counts)
        for i in range(0, len(codes[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[0][i : i + (1 << 16)].view(np.int64)), pa.array(counts[0][i : i + (1 << 16)])], ["code", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    code, to = np.unique(np.concatenate(codes), return_inverse=True)
    return [code], [np.bincount(to, np.concatenate(counts), len(code)).astype(np.int64)]


class Whole:
    """A trie of one part, of which every worker has a copy; the number of its codes bounds the broadcast."""

    def __init__(self, trie: Broadcast) -> None:
        self.parts, self.trie = [trie], trie

    @property
    def order(self) -> int:
        return self.trie.value.order

    def scored(self, rows: DataFrame) -> DataFrame:
        return rows

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.trie.value.score(texts)


class Parts:
    """A trie in parts by the last two bytes of context, which each context of two or more bytes shares with its longer ones.

    Every part has the whole of the contexts of none and one byte, so that its
    probabilities are the whole trie's. Parts are files in the shared folder;
    codes go to the tasks of their part, and each task reads one part at a time.
    """

    def __init__(self, parts: list[str], starts: np.ndarray, order: int) -> None:
        self.parts, self.starts, self.order = parts, starts, order

    def part_of(self, code: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, (code >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64), "right") - 1

    def scored(self, rows: DataFrame, size: int = 1 << 23, tasks_a_part: int = 8) -> DataFrame:
        """rows (id, text, held) with a score.

        Chunks of texts are written once. Each sends its distinct codes to the
        tasks of their parts, several for each part, which send back a
        logarithm for each; a chunk and its logarithms meet in a join. A task
        turns one megabyte of a chunk to codes at a time.
        """
        source = rows.schema
        types = to_arrow_schema(source)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 32
            for batch in batches:
                for first, texts in pieces(batch.column(1), size):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, types) as stream:
                        stream.write_batch(batch.slice(first, len(texts)).cast(types))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()])], ["chunk", "packed"])
                    chunk += 1

        def unpack(packed: pa.Scalar) -> pa.RecordBatch:
            return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks().to_batches()[0]

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = distinct(as_bytes(unpack(packed).column(1)), self.order)
                    part = self.part_of(own)
                    for i in np.unique(part).tolist():
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([chunk]), pa.array([own[part == i].tobytes()])], ["part", "chunk", "codes"])

        def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_, trie = None, None
            for batch in batches:
                for part, chunk, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part != at_:
                        trie = None
                        trie, at_ = loaded(self.parts[part]), part
                    logs = trie.logs(np.frombuffer(codes, np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([part]), pa.array([logs.tobytes()])], ["chunk", "part", "logs"])

        chunks = written(rows.mapInArrow(pack, "chunk long, packed binary"), **LARGE_ROWS)
        codes = chunks.mapInArrow(asked, "part long, chunk long, codes binary")
        slot = F.pmod(F.xxhash64("chunk"), F.lit(tasks_a_part))
        dealt = codes.repartition(len(self.parts) * tasks_a_part, "part", slot).sortWithinPartitions("part")
        logs = written(dealt.mapInArrow(answered, "chunk long, part long, logs binary"), **LARGE_ROWS)
        listed = logs.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "logs"))).alias("logs"))
        out = T.StructType([*source.fields, T.StructField("score", T.DoubleType())])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for packed, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    own = unpack(packed)
                    texts = as_bytes(own.column(1))
                    unique = distinct(texts, self.order)
                    # parts are ranges of the bytes before the symbol, so each part's codes are in their order among all
                    value, part = np.zeros(len(unique)), self.part_of(unique)
                    for f in found:
                        value[part == f["part"]] = np.frombuffer(f["logs"])
                    score = []
                    for piece in parts(texts, PIECE):
                        code, n = grams(piece, self.order)
                        score.append(np.add.reduceat(value[np.searchsorted(unique, code)], np.cumsum(n) - n))
                    score = np.concatenate(score)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(score)], schema=to_arrow_schema(out))

        return chunks.join(listed, "chunk").select("packed", "logs").mapInArrow(summed, out)


def loaded(path: str) -> Trie:
    store, name = files.FileSystem.from_uri(path)
    with store.open_input_file(name) as file:
        return pickle.loads(file.read())


def train(df: DataFrame, text_col: str, order: int = 5, size: int = 4_000_000) -> Whole | Parts:
    """The trie of all texts of df: of up to `size` distinct codes whole, of more in parts of a quarter of that.

    The order is the same at every size; only the number of parts grows. A
    whole trie is built by the driver and broadcast; parts are built by tasks, each
    of which holds one, and written as files. A part has one pair
    of last bytes of context at least, with all its codes.
    """
    spark = df.sparkSession
    found = count_grams(df, text_col, order)
    found = written(found.withColumn("last", F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")).sortWithinPartitions("last"))
    groups = found.groupBy("last").count().orderBy("last").toArrow()
    starts, held = [0], 0
    whole = sum(groups["count"].to_pylist()) <= size
    for last, n in zip(groups["last"].to_pylist(), groups["count"].to_pylist(), strict=True):
        if not whole and held and held + n > size // 4:
            starts.append(last)
            held = 0
        held += n
    low = found.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.sum("n").alias("n")).toArrow()
    short = low["code"].to_numpy().view(np.uint64), low["n"].to_numpy().astype(np.float64)
    if len(starts) == 1:
        table = found.select("code", "n").toArrow()
        return Whole(spark.sparkContext.broadcast(Trie(table["code"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64), order, short)))
    bounds, folder = np.array(starts), shared_folder(spark)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, batch.column(2).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], ["code", "n", "part"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not len(table):
            return
        trie = Trie(table["code"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64), order, short)
        # an attempt's file has its own name; only those of the attempts that count are listed
        path = f"{folder}/{uuid.uuid4().hex}"
        store, name = files.FileSystem.from_uri(path)
        store.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(name) as out:
            out.write(pickle.dumps(trie))
        yield pa.RecordBatch.from_arrays([table["part"].chunk(0).slice(0, 1), pa.array([path])], ["part", "path"])

    parts = found.select("code", "n", "last").mapInArrow(dealt, "code long, n long, part int").repartitionById(len(bounds), F.col("part"))
    paths = {r.part: r.path for r in written(parts.mapInArrow(build, "part int, path string")).collect()}
    return Parts([paths[i] for i in range(len(bounds))], bounds, order)


PAIR = np.dtype([("doc", "<u2"), ("n", "<u4")])
SUM = np.dtype([("doc", "<u2"), ("known", "<u4"), ("logs", "<f8")])
SENT = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("head", pa.bool_()), ("packed", pa.binary())])
SUMS = pa.schema([("chunk", pa.int64()), ("head", pa.bool_()), ("packed", pa.binary())])


def packed_runs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of consecutive runs of records; `ends` starts with where the first run starts."""
    offsets = ((ends - ends[0]) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[ends[0] : ends[-1]].tobytes())])


def unpacked(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(records, number of them in each value) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // kind.itemsize


def word_rows(chunk: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of a chunk: its number in each text."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], np.repeat(np.arange(len(n)), n)[order]
    change = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))))
    pairs = np.zeros(len(change), PAIR)
    pairs["doc"], pairs["n"] = owner[change], np.diff(np.append(change, len(keys)))
    keys = keys[change]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(first, len(pairs))
    for i in range(0, len(first), 1 << 16):
        j = min(i + (1 << 16), len(first))
        yield pa.RecordBatch.from_arrays([pa.array(keys[first[i:j]].view(np.int64)), pa.array(np.full(j - i, chunk)), pa.array(np.zeros(j - i, bool)), packed_runs(pairs, ends[i : j + 1])], schema=SENT)


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """(key, total): occurrences of each lower-cased word in all texts; a task sends its sums some two million words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, keys, counts = Tokenizer(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for _, texts in pieces(batch.column(0), 1 << 22):
                key, n = np.unique(cut([x.translate(LOWER_BYTES) for x in texts])[2], return_counts=True)
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 1 << 21:
                    keys, counts = merged(keys, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["key", "n"])
                    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        keys, counts = merged(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["key", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("total"))


def text_sums(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """From word rows with their totals, in any order, to sums by text: how many known tokens, and the log10 of their counts plus one.

    Rows are taken some 2^17 or 32 MB at a time and give one row for each chunk among them; heads go through as they are.
    """
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        heads = batch.filter(batch.column(1))
        for i in range(len(heads)):
            yield pa.RecordBatch.from_arrays([heads.column(0).slice(i, 1), heads.column(1).slice(i, 1), heads.column(2).slice(i, 1)], schema=SUMS)
        if len(heads):
            batch = batch.filter(pc.invert(batch.column(1)))
        held.append(batch)
        n, held_bytes = n + len(batch), held_bytes + batch.nbytes
        if n >= rows or held_bytes >= size:
            yield from word_sums(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, n, held_bytes = [], 0, 0
    if n:
        yield from word_sums(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def word_sums(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    chunk, c = batch.column(0).to_numpy(), batch.column(3).fill_null(0).to_numpy()
    pairs, size = unpacked(batch.column(2), PAIR)
    chunks, row = np.unique(chunk, return_inverse=True)
    cell, to = np.unique(np.repeat(row, size) << 16 | pairs["doc"], return_inverse=True)
    c = np.repeat(c, size)
    sums = np.zeros(len(cell), SUM)
    sums["doc"], sums["known"], sums["logs"] = cell & 0xFFFF, np.bincount(to, pairs["n"] * (c > 0), len(cell)), np.bincount(to, pairs["n"] * np.log10(c + 1.0), len(cell))
    yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(np.zeros(len(chunks), bool)), packed_runs(sums, np.searchsorted(cell >> 16, np.arange(len(chunks) + 1)))], schema=SUMS)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, order: int = 5, size: int = 4_000_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    `held` is a condition on `id`; rows for which it is null or false are
    learned from, and so are all without it. score is the trie's log10
    probability of the text's bytes and end. A trie of more than `size` codes is
    cut into parts, to which the texts' codes go in a shuffle, which changes no score. The base adds log10((c + 1) / (N +
    V + 1)) over the lower-cased words and one end, where c counts the token, N
    all tokens and V the distinct ones in the training texts. Null texts count as
    empty: one token, their end. Nothing to learn from leaves equal shares.
    Repeated rows are learned from and scored as often as they come.

    Words are told apart by 64-bit hashes. Their totals are a table of their
    own. Each task cuts its texts into chunks of at most 65,536 texts and sends
    one row for each distinct word of a chunk, with the texts that have it; a
    join brings the totals, and sums by text go back to their chunk. A frequent
    word has as many rows as there are chunks, not as texts, and the join may
    split them.
    """
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = named.withColumn("held", F.coalesce(held, F.lit(False)) if held is not None else F.lit(False))
    learned = rows.where(~F.col("held"))
    trie = train(learned, "text", order, size)
    totals = written(count_words(learned, "text"))
    kinds = totals.count()
    rows = trie.scored(rows)
    many = isinstance(trie, Parts)
    doc = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T._parse_datatype_string("held_out boolean, n_tokens long, score double").fields])
    doc_schema = to_arrow_schema(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Tokenizer()
        chunk = TaskContext.get().partitionId() << 32
        for batch in (b.slice(i, 1 << 16) for b in batches for i in range(0, len(b), 1 << 16)):
            for first, texts in pieces(batch.column(1), 1 << 24):
                own = batch.slice(first, len(texts))
                keys, n, total = [], [], []
                for part in parts(texts, PIECE):
                    _, _, code, start = cut([x.translate(LOWER_BYTES) for x in part])
                    keys.append(code)
                    n.append(np.diff(start))
                    if not many:
                        total.append(trie.score(part))
                keys, n = np.concatenate(keys), np.concatenate(n)
                total = own.column(3).to_numpy() if many else np.concatenate(total)
                docs = pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(n + 1), pa.array(total)], names=doc_schema.names).cast(doc_schema)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, doc_schema) as stream:
                    stream.write_batch(docs)
                yield pa.RecordBatch.from_arrays([pa.array([chunk * 7919]), pa.array([chunk]), pa.array([True]), pa.array([sink.getvalue().to_pybytes()])], schema=SENT)
                yield from word_rows(chunk, keys, n)
                chunk += 1

    sent = rows.mapInArrow(run, "key long, chunk long, head boolean, packed binary").join(totals, "key", "left")
    sums = sent.select("chunk", "head", "packed", "total").mapInArrow(text_sums, "chunk long, head boolean, packed binary")
    out = T.StructType([*doc.fields, *T._parse_datatype_string("n_known long, logs double").fields])

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        docs = pa.ipc.open_stream(table.filter(table["head"])["packed"][0].as_buffer()).read_all().combine_chunks()
        table = table.filter(pc.invert(table["head"])).combine_chunks()
        size = docs.num_rows
        known, logs = np.zeros(size, np.int64), np.zeros(size)
        if table.num_rows:
            sums, _ = unpacked(table["packed"].combine_chunks(), SUM)
            known = np.bincount(sums["doc"], sums["known"], size).astype(np.int64)
            logs = np.bincount(sums["doc"], sums["logs"], size)
        return pa.table([*(docs.column(i) for i in range(len(doc))), pa.array(known), pa.array(logs)], names=out.names)

    found = written(sums.groupBy("chunk").applyInArrow(gather, out))
    use = ~F.col("held_out")
    n, ends = found.agg(F.coalesce(F.sum(F.when(use, F.col("n_tokens"))), F.lit(0)), F.count_if(use)).first()
    kinds += ends > 0
    base = F.col("logs") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(n + kinds + 1))
    return found.select("id", "held_out", "n_tokens", (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
