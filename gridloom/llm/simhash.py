"""Near-duplicates by SimHash fingerprints, compared bit plane by bit plane."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, as_bytes, pieces, written
from .graph import connected_components

BITS = 64
#: The sign of a long: keys of prefixes have it, keys of sampled bits haven't.
MIN = np.int64(-(1 << 63))


def fingerprint(text: bytes, shingle: int = 5, seed: int = 42) -> int:
    """Unsigned SimHash of the word shingles of a UTF-8 text: bit set if over half of the shingles' XXH64 have it."""
    tokens = text.translate(LOWER_BYTES).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, seed: int = 42) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long, 0 for a text without words."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def unpacked(fps: np.ndarray) -> np.ndarray:
    """A row of bits for each fingerprint of one or more 64-bit words."""
    return np.unpackbits(np.ascontiguousarray(fps.reshape(len(fps), -1)).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def planes(fps: np.ndarray) -> np.ndarray:
    """Rows of bit planes: bit j of plane p is bit p of fingerprint j."""
    bits = unpacked(fps).T
    padded = np.zeros((len(bits), -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, targets: np.ndarray, radius: int) -> np.ndarray:
    """Boolean matrix of the pairs within the radius.

    Each query meets 64 targets a word. Differences are added to counter planes
    with carries; the block is abandoned once every pair exceeds the radius.
    """
    table, ones = planes(targets), np.uint64(0xFFFFFFFFFFFFFFFF)
    flip = np.where(unpacked(queries).astype(bool), ones, np.uint64(0)).T
    shape = (len(queries), table.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
    over, differ, carry = np.zeros(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, np.uint64)
    for p in range(len(table)):
        np.bitwise_xor(table[p][None, :], flip[p][:, None], out=differ)
        for c in counters:
            np.bitwise_and(c, differ, out=carry)
            np.bitwise_xor(c, differ, out=c)
            differ, carry = carry, differ
        np.bitwise_or(over, differ, out=over)
        if p > radius and p % 8 == 7 or p == len(table) - 1:
            beyond, equal = over.copy(), np.full(shape, ones)
            for i in range(len(counters) - 1, -1, -1):
                if radius >> i & 1:
                    equal &= counters[i]
                else:
                    beyond |= equal & counters[i]
                    equal &= ~counters[i]
            if (beyond == ones).all():
                return np.zeros((len(queries), len(targets)), bool)
    return np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little")[:, : len(targets)].astype(bool)


def forest(nodes: np.ndarray, fps: np.ndarray, radius: int, step: int = 512) -> list[tuple[int, int]]:
    """A link to the smallest node of its component for each node of the block that has one."""
    linked = np.zeros((len(fps), len(fps)), bool)
    for i in range(0, len(fps), step):
        linked[i : i + step] = near(fps[i : i + step], fps, radius)
    np.fill_diagonal(linked, False)
    out: list[tuple[int, int]] = []
    todo = linked.any(axis=1)
    while todo.any():
        member = np.zeros(len(fps), bool)
        edge = np.flatnonzero(todo)[:1]
        while len(edge):
            member[edge] = True
            edge = np.flatnonzero(linked[edge].any(axis=0) & ~member)
        todo &= ~member
        ids = nodes[member]
        root = int(ids.min())
        out += [(int(x), root) for x in np.unique(ids) if x != root]
    return out


def verified(nodes: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, step: int = 512) -> list[tuple[int, int]]:
    """Links between pairs of the block within the radius whose sets' Jaccard similarity reaches the given one, one for each two components that they join."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    for first in range(0, len(sets), step):
        linked = near(fps[first : first + step], fps, radius)
        for i in range(first, first + len(linked)):
            other = np.flatnonzero(linked[i - first, :i])
            small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            other = other[(small >= similarity * large - 1e-6) & (label[other] != label[i])]
            while len(other):
                j = int(other[0])
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both / max(1, size[i] + size[j] - both) >= similarity:
                    out.append((int(nodes[i]), int(nodes[j])))
                    label[label == label[j]] = label[i]
                    other = other[label[other] != label[i]]
                else:
                    other = other[1:]
    return out


def band_plan(n: int, radius: int, most: int = 256) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bounds of the bands, and the sets of bands that make a key.

    Any two fingerprints within the radius agree on all but `radius` bands, so
    every key plan finds all pairs; more bands make more selective keys, and
    the first plan whose expected bucket holds at most `most` is taken.
    """
    for bands in range(radius + 1, radius + 5):
        bounds = [BITS * i // bands for i in range(bands + 1)]
        if n / 2 ** (BITS * (bands - radius) // bands) <= most:
            break
    return bounds, list(combinations(range(bands), bands - radius))


def near_links(fps: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """(a, b) links, with the closure of all pairs of distinct fp within the radius; fp holds distinct longs."""
    bounds, keys = band_plan(fps.count(), radius)

    def key(i: int, chosen: tuple[int, ...]):
        value, width = F.lit(i).cast("long"), 0
        for band in chosen:
            size = bounds[band + 1] - bounds[band]
            value = F.shiftleft(value, size).bitwiseOR(F.shiftrightunsigned("fp", bounds[band]).bitwiseAND(F.lit((1 << size) - 1)))
            width += size
        return value

    keyed = fps.select(F.col("fp").alias("node"), "fp", F.explode(F.array(*[key(i, c) for i, c in enumerate(keys)])).alias("key"))
    return block_links(keyed, ["fp"], radius, block)


def block_links(keyed: DataFrame, columns: list[str], radius: int, block: int, similarity: float | None = None) -> DataFrame:
    """(a, b) links between the nodes of (node, key, fingerprint columns), with the closure of all pairs that share a key and are within the radius.

    Rows are sorted by key and compared in blocks that hold whole buckets. A
    bucket beyond `block` rows is cut into parts by hash, and each pair of parts
    becomes a block of its own, so that no task holds an unbounded bucket. A
    block gives links to its components' smallest members, not pairs, hence no
    more rows than it reads.

    With a similarity, keyed has the column `shingles` (sorted 64-bit hashes)
    too, and pairs count only if their sets are so similar; a bucket is then
    also cut into parts of about 32 MB of shingles.
    """
    extra = ["shingles"] if similarity is not None else []
    weight = F.count("*") / block if similarity is None else F.greatest(F.count("*") / block, F.sum(F.octet_length("shingles")) / (1 << 25))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("count"), F.ceil(weight).cast("int").alias("parts")).where("count > 1").select("key", "parts")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = keyed.join(sizes, "key").withColumn("part", part).select("key", "node", *columns, *extra, F.explode(F.transform(every, lambda x: F.least(x, F.col("part")) * 65536 + F.greatest(x, F.col("part")))).alias("pair"))
    tasks = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            held: list[tuple[np.ndarray, ...]] = []
            n, rest = 0, None
            for batch in batches:
                k, q, node = (batch.column(i).to_numpy() for i in range(3))
                f = np.stack([batch.column(i).to_numpy() for i in range(3, 3 + len(columns))], axis=1)
                own = (node, f, np.array([*batch.column(batch.num_columns - 1).to_pylist(), None], object)[:-1]) if extra else (node, f)
                if rest is not None:
                    k, q, *own = (np.concatenate(x) for x in zip(rest, (k, q, *own), strict=True))
                cuts = np.flatnonzero((k[1:] != k[:-1]) | (q[1:] != q[:-1])) + 1
                last = int(cuts[-1]) if len(cuts) else 0
                rest = (k[last:], q[last:], *(x[last:] for x in own))
                for group in zip(*(np.split(x[:last], cuts[:-1]) for x in own), strict=True) if last else ():
                    if n and n + len(group[0]) > 512:
                        yield tuple(map(np.concatenate, zip(*held, strict=True)))
                        held, n = [], 0
                    held.append(group)
                    n += len(group[0])
            if rest is not None:
                held.append(rest[2:])
            if held:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))

        for nodes, f, *sets in blocks():
            nodes, first = np.unique(nodes, return_index=True)
            fps = f[first].view(np.uint64)
            links = verified(nodes, fps, [np.frombuffer(x, np.uint64) for x in sets[0][first]], radius, similarity) if sets else forest(nodes, fps, radius)
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("key", "pair", "node", *columns, *extra).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for each row of df.

    fingerprint is 16 lowercase hex digits; rows link if their fingerprints
    differ in at most `radius` bits; component_id is the smallest id that can
    be reached, the row's own included. Null and wordless texts have
    fingerprint zero and link like any other. Null ids are reached but never
    chosen; a component with none but null ids has a null component_id. Rows
    repeated with the same id stay as often as they come.
    """
    own = written(with_fingerprints(df, id_col, text_col, shingle, seed))
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return own.join(member, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Words of the wide fingerprint, and shingles up to which a set's pairs are found for certain.
WIDE, SMALL = 4, 32


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct word shingles of a UTF-8 text as sorted XXH64; a shorter text is one shingle, one without words has none."""
    tokens = text.translate(LOWER_BYTES).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = ((ends - lengths)[: len(tokens) - shingle + 1], ends[shingle - 1 :]) if len(tokens) > shingle else (np.zeros(1, np.int64), ends[-1:])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts)))


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 256 bits of a set of shingles; each XXH64 is stretched to four words."""
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += unpacked(stretched(hashes[i : i + (1 << 14)])).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def wide_fingerprint(text: bytes, shingle: int) -> np.ndarray:
    """SimHash of 256 bits of the distinct word shingles."""
    return set_fingerprint(shingle_set(text, shingle))


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest of a set's hashes, so many that two sets of the similarity have one of theirs in common: all but those that must be shared, and one."""
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def stretched(hashes: np.ndarray) -> np.ndarray:
    """Four well-mixed words of each hash (the SplitMix64 finalizer)."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_plan(n: int, similarity: float, miss: float = 0.002, most: int = 64, seed: int = 17, beyond: float = 2.3) -> tuple[int, list[list[int]]]:
    """(radius, bits of each key) by which texts of that Jaccard similarity meet.

    Such texts differ in a share p of their bits, which follows from the angle
    between their shingle sets. The radius is `beyond` deviations over p; keys have
    as many bits as keep an expected bucket to `most`, and there are so many
    keys that all miss a pair at p with chance `miss`.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = 64 * WIDE
    radius = math.ceil(bits * p + beyond * math.sqrt(bits * p * (1 - p)))
    size = max(10, math.ceil(math.log2(max(1, n / most))))
    keys = math.ceil(math.log(miss) / math.log(1 - (1 - p) ** size))
    rng = random.Random(seed)
    return radius, [sorted(rng.sample(range(bits), size)) for _ in range(keys)]


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 2048) -> DataFrame:
    """(id, component_id) for each row of df: components of texts whose sets of word shingles are similar.

    Fingerprints of 256 bits and keys of sampled bits find candidates: a radius
    of 6 deviations, and keys that all miss a pair at the similarity with a
    chance of 0.0005 (0.0025 as measured for sets of 50 shingles). Sets of a few shingles differ in bits by more than
    that, so those of up to SMALL, and of their possible partners, have the hashes of
    prefix() for keys too, which miss no pair. Candidates' components are then cut into blocks in which
    pairs within the radius are verified by the sets' Jaccard similarity, so
    that no text is linked to one less similar (64-bit hashes stand for
    shingles). Equal sets always link. component_id, nulls and repeated rows
    are as in near_duplicates(); wordless texts link to each other.
    """
    words = [f"f{i}" for i in range(WIDE)]
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *[T.StructField(w, T.LongType()) for w in ("copy", "node", *words)], T.StructField("prefix", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in as_bytes(batch.column(2))]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            fps = np.array([set_fingerprint(x) for x in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), *[pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WIDE)], pa.array([prefix(x, similarity).tobytes() if 0 < len(x) <= SMALL / similarity else None for x in sets], pa.binary())], schema.names)

    text = F.col(text_col).cast("string")
    own = written(df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text")).mapInArrow(run, schema))
    distinct = written(own.groupBy("node", *words).agg(F.min("id").alias("first"), F.min("copy").alias("copy"), F.min("prefix").alias("prefix")))
    radius, plan = wide_plan(distinct.count(), similarity, miss=0.0005, beyond=6)
    chosen = np.array(plan)
    weight = np.int64(1) << np.arange(chosen.shape[1], dtype=np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                bits = unpacked(np.stack([part.column(j).to_numpy() for j in range(1, WIDE + 1)], axis=1))
                key = (bits[:, chosen].astype(np.int64) @ weight) + (np.arange(len(chosen), dtype=np.int64) << np.int64(32))
                short = [np.frombuffer(x or b"", np.int64) | MIN for x in part.column(WIDE + 1).to_pylist()]
                row = np.concatenate((np.repeat(np.arange(len(part)), len(chosen)), np.repeat(np.arange(len(part)), [len(x) for x in short])))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns[: WIDE + 1]), pa.array(np.concatenate((key.ravel(), *short)))], ["node", *words, "key"])

    keyed = distinct.select("node", *words, "prefix").mapInArrow(keys, ", ".join(f"{c} long" for c in ("node", *words, "key")))
    candidates = connected_components(block_links(keyed, words, radius, block)).withColumnRenamed("root", "key")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = [c not in seen and not seen.add(c) for c in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(fresh, pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(2)):
                part = batch.slice(first, len(texts))
                found = [shingle_set(x, shingle).tobytes() for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *part.columns[3:], pa.array(found, pa.binary())], ["key", "node", *words, "shingles"])

    texts = df.select(F.xxhash64(text).alias("copy"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(once, "copy long, text string")
    wanted = distinct.select("node", "copy", *words).join(candidates, "node")
    meant = texts.join(wanted, "copy").dropDuplicates(["copy"]).select("key", "node", "text", *words)
    kept = written(meant.mapInArrow(sets, ", ".join(f"{c} long" for c in ("key", "node", *words)) + ", shingles binary"))
    roots = connected_components(block_links(kept, words, radius, block, similarity))
    placed = distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.select("node", "root").join(least, "root").select("node", "component_id")
    return own.select("id", "node").join(member, "node").select("id", "component_id")
