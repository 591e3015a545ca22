"""Quality from random-indexing word vectors, pooled by document, under a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, pieces

WORDS, DIM, SHAPES, SHAPE_DIM = 1 << 14, 32, 512, 64
WIDTH = 2 * DIM + SHAPE_DIM + 3
#: Bytes of text, words of a text, that are worked on at a time.
SLICE, RUN = 1 << 20, 1 << 15
#: Word vectors are whole numbers of this fraction, so that sums are exact in any order.
UNIT = 4096
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Kinds of bytes: other, upper, lower, digit, beyond ASCII.
KIND = np.zeros(256, np.uint64)
for kind, (a, b) in enumerate((("A", "Z"), ("a", "z"), ("0", "9")), 1):
    KIND[ord(a) : ord(b) + 1] = kind
KIND[128:] = 4
MIX, RADIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class Tokenizer:
    """Words of many texts at once, as numbers; beyond a few bytes for each byte of text, memory is held for SLICE bytes only."""

    def __init__(self) -> None:
        self.up, self.down = powers(RADIX, SLICE + 1), powers(pow(RADIX, -1, 1 << 64), SLICE + 1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, bucket of its shape, 64-bit hash, first word of each text and the end)."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        edge = np.diff(np.concatenate(([False], ~BLANKS[data])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        del edge
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        code, shape = np.empty(len(start), np.uint64), np.empty(len(start), np.int16)
        i = 0
        while i < len(start):
            j = int(np.searchsorted(end, start[i] + SLICE, "right"))
            if j > i:
                code[i:j] = self.hashes(data[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i])
            else:  # a word that is longer than a slice
                j = i + 1
                code[i] = self.long_hash(data[start[i] : end[i]])
            shape[i:j] = shapes(data, start[i:j], end[i:j])
            i = j
        return (code >> np.uint64(65 - WORDS.bit_length())).astype(np.int32), shape, code, np.concatenate(([0], np.searchsorted(start, stops)))

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)))
            return finished((run[end] - run[start]) * self.down[start])

    def long_hash(self, word: np.ndarray) -> np.ndarray:
        total = 0
        for i in range(0, len(word), SLICE):
            part = word[i : i + SLICE]
            total += int(np.sum((part + np.uint64(1)) * self.up[: len(part)], dtype=np.uint64)) * pow(RADIX, i, 1 << 64)
        return finished(np.array([total % (1 << 64)], np.uint64))[0]


def finished(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (code ^ (code >> np.uint64(29))) * np.uint64(MIX)


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash bucket of each word's shape: kinds of its first two and last two bytes, and its length."""
    with np.errstate(over="ignore"):
        head, tail, before = data[start], data[end - 1], data[np.maximum(end - 2, start)]
        length = np.minimum(end - start, 15).astype(np.uint64) >> np.uint64(1)
        shape = ((KIND[head] * np.uint64(5) + KIND[data[np.minimum(start + 1, end - 1)]]) * np.uint64(5) + KIND[before]) * np.uint64(8) + length
        # a last byte that is no letter is told apart exactly
        shape = (shape << np.uint64(8)) | np.where(KIND[tail] == 0, tail, KIND[tail].astype(np.uint8)).astype(np.uint64)
        shape = (shape + np.uint64(1)) * np.uint64(MIX)
        return ((shape ^ (shape >> np.uint64(32))) * np.uint64(MIX) >> np.uint64(55)).astype(np.int16)


def index_places(code: np.ndarray) -> list[np.ndarray]:
    """Each word's index vector, seeded by its hash: +1 at the first two of four dimensions, -1 at the others; where they meet they add up."""
    with np.errstate(over="ignore"):
        x = (code ^ (code >> np.uint64(32))) * np.uint64(MIX)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(RADIX)
    return [(x >> np.uint64(59 - 8 * i) & np.uint64(DIM - 1)).astype(np.int64) for i in range(4)]


def shape_vectors(seed: int = 11, nonzero: int = 4) -> np.ndarray:
    """A sparse vector of +1 and -1 for each shape bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((SHAPES, SHAPE_DIM), np.int32)
    for row in out:
        row[rng.choice(SHAPE_DIM, nonzero, replace=False)] = rng.permutation([1, -1] * (nonzero // 2))
    return out


SHAPE_VECTORS = shape_vectors()


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """A unit vector for each of WORDS hash buckets of words, in parts of 1 / UNIT: the sum, over all occurrences in all texts, of the index vectors of the word and its neighbours.

    Each task adds up its texts and gives WORDS rows of sums; those are added
    by bucket, and WORDS x DIM numbers, whatever the corpus, come to the driver.
    """
    names = [f"c{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, sums = Tokenizer(), np.zeros(WORDS * DIM, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column(0), SLICE):
                bucket, _, code, first = cut(texts)
                inner = np.ones(len(code) + 1, bool)
                inner[first] = False  # a text's first word follows no other
                row = bucket * DIM
                for i in range(0, len(code), 1 << 17):
                    own = slice(i, i + (1 << 17))
                    right = i + np.flatnonzero(inner[:-1][own])
                    for k, place in enumerate(index_places(code[max(0, i - 1) : own.stop])):
                        shift = i - max(0, i - 1)
                        met = [row[own] + place[shift:], row[right] + place[right - 1 - i + shift], row[right - 1] + place[right - i + shift]]
                        np.add(sums, np.bincount(np.concatenate(met), minlength=len(sums)) * (1 if k < 2 else -1), out=sums)
        table = sums.reshape(WORDS, DIM)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, i]) for i in range(DIM)]], ["bucket", *names])

    parts = df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    got = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((WORDS, DIM))
    out[got["bucket"].to_numpy()] = np.stack([got[c].to_numpy() for c in names], axis=1)
    return np.round(out * (UNIT / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1))).astype(np.int32)


def pooled(cut: Tokenizer, vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """A row for each text: mean and spread of its word vectors, mean of its words' shapes, shares of words that differ from the one before and from all before, and length.

    Sums are of whole numbers, so a text's row doesn't depend on the texts beside it.
    """
    bucket, shape, code, first = cut(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    sums = np.zeros((len(texts), 2 * DIM + SHAPE_DIM), np.int64)
    for i in range(0, len(code), RUN):
        d = doc[i : i + RUN]
        at = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        own = vectors[bucket[i : i + RUN]]
        for j, values in zip((0, DIM, 2 * DIM), (own, own * own, SHAPE_VECTORS[shape[i : i + RUN]]), strict=True):
            sums[d[at], j : j + values.shape[1]] += np.add.reduceat(values, at, dtype=np.int64)
    by = np.maximum(n, 1)[:, None]
    out = np.zeros((len(texts), WIDTH))
    mean = sums[:, :DIM] / by / UNIT
    out[:, :DIM] = mean
    out[:, DIM : 2 * DIM] = np.sqrt(np.maximum(sums[:, DIM : 2 * DIM] / by / UNIT**2 - mean**2, 0))
    out[:, 2 * DIM : -3] = sums[:, 2 * DIM :] / by
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    out[:, -3] = np.bincount(doc, new, len(texts)) / by[:, 0]
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        out[i, -2] = len(np.unique(code[a:b])) / max(1, b - a)
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Standardised inputs, a tanh layer, a logit, and a temperature that calibrates it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on the log loss at a rate that falls to 0, both classes weighing alike; every fifth row is kept for the temperature. Without two classes every score is 0.5."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    if len(np.unique(y)) < 2:
        return Network(mean, scale, p[0], p[1], np.zeros(hidden), 0.0)
    held = np.arange(len(x)) % 5 == 4
    z, t = np.clip((x - mean) / scale, -8, 8)[~held], y[~held].astype(float)
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t[rows]) * weight[rows] / len(rows)
            back = np.outer(g, p[2]) * (1 - h**2)
            grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - pace * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, truth = net.logits(x[held]), y[held]
    tried = np.geomspace(0.25, 8, 41)
    loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / c).mean() if len(truth) else 0 for c in tried]
    net.temperature = float(tried[int(np.argmin(loss))]) if len(truth) else 1.0
    return net


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, sample: int = 6000) -> tuple[np.ndarray, Network]:
    """(word vectors from all texts, network from a bounded sample).

    The sample is the `sample` labelled ids, among those that `usable` (a
    condition on `id`) allows, with the smallest hashes. Rows without a label
    of 0 or 1, or without an id, teach nothing; an id labelled twice counts with
    its smaller label.
    """
    vectors = word_vectors(df, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(usable if usable is not None else F.lit(True)).groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def work():
        cut = Tokenizer()
        return lambda texts: [np.concatenate([pooled(cut, vectors, part) for part in parts(texts)]).tolist()]

    got = per_text(rows, "text", ["id", "label"], "x array<double>", work).select("row.id", "row.label", "x").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = np.array([r.x for r in got]).reshape(len(got), WIDTH)
    return vectors, fit(x, np.array([r.label for r in got], int))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), usable: Column | None = None, sample: int = 6000) -> DataFrame:
    """(row, score) for each row of df; row is a struct of the carried columns.

    score is the calibrated probability of label 1. Texts are scored whole;
    null, empty and wordless texts get the score of a text without words. An
    empty table gives an empty result; labels of one class only give 0.5.
    """
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, id_col, text_col, usable=usable, sample=sample))

    def work():
        cut, (vectors, net) = Tokenizer(), model.value

        def run(texts: list[bytes]):
            return [np.concatenate([net.scores(pooled(cut, vectors, part)) for part in parts(texts)])]

        return run

    return per_text(df, text_col, list(carry), "score double", work)


def parts(texts: list[bytes], most: int = SLICE) -> Iterator[list[bytes]]:
    """Runs of texts of about that many bytes; a longer text is a run of its own."""
    run, held = [], 0
    for x in texts:
        if run and held + len(x) > most:
            yield run
            run, held = [], 0
        run.append(x)
        held += len(x)
    yield run


def fold(id_col: Column, by: int) -> Column:
    """crc32 of the id's text, modulo `by`."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(by))
