"""Vector codes: each part of a vector by its nearest entry in that part's codebook.

Distances are screened by float32 matrix products with an interval for each,
from a rigorous bound of the rounding error. Where one interval ends below all
others' starts its entry is the nearest; every entry whose interval overlaps
the best is measured again in int64, and equal distances go to the lower index.
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

from .common import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Half the distance from 1 to the next float32.
UNIT = 2.0**-24
MOST = (1 << 63) - 1


def limit(dim: int) -> int:
    """The largest component for which a squared distance of two vectors stays below 2^62."""
    return int((2.0**62 / max(dim, 1)) ** 0.5 / 2)


def integers(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """floor(SCALE * x) as int64 of shape (rows, parts, width); zeros fill up the last part, and what is beyond limit() counts as that."""
    n, dim = vectors.shape
    most = limit(dim)
    whole = np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)
    wide = -(-dim // parts) * parts
    return np.pad(whole, ((0, 0), (0, wide - dim))).reshape(n, parts, wide // parts)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest of book's rows, squared distance) for each row of x, both int64 and exact.

    Compared is |c|^2 - 2 x.c. Its float32 value is off by at most (width + 8)
    roundings of |c|^2 + 2 |x| |c|, by Cauchy's inequality, in whichever order a
    product is summed.
    """
    a, c = x.astype(np.float32), book.astype(np.float32)
    square = (book * book).sum(axis=1)
    rough = (square.astype(np.float32) - np.float32(2) * (a @ c.T)).astype(np.float64)
    steps = (x.shape[1] + 8) * UNIT
    long = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(square.astype(np.float64))
    off = steps / (1 - steps) * (square + 2 * long) * (1 + 1e-6)
    open_ = rough - off <= (rough + off).min(axis=1, keepdims=True)
    best = np.argmax(open_, axis=1)
    row, entry = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(row):
        exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
        # by row, then distance, then index: the first of each row is its nearest
        order = np.lexsort((entry, exact, row))
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        best[row[order][first]] = entry[order][first]
    return best, ((x - book[best]) ** 2).sum(axis=1)


def matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that many components, whether each row of the column is among them)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column.filter(pa.array(fits))).to_numpy(zero_copy_only=False).reshape(int(fits.sum()), dim), fits


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows whose vector and components are all there and finite."""
    vector = F.col(f"`{vector_col}`")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector")).where(vector.isNotNull() & ~odd)


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, np.ndarray]:
    """(components of a vector, entries as int64 of shape (parts, entries, width)).

    Each round is one pass: tasks add up the parts of each entry, and parts x
    entries sums, whatever the table, come to the driver.
    """
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    dim = len(first[0].vector) if first else 0
    fit = [r.vector for r in first if len(r.vector) == dim]
    books = integers(np.array(fit, np.float64).reshape(len(fit), dim), parts).transpose(1, 0, 2).copy()
    width = books.shape[2]
    names = [f"s{i}" for i in range(width)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{s} long" for s in names)])
    for _ in range(rounds if width else 0):
        sums = kept.select("vector").mapInArrow(summed(dim, books.copy(), names), schema).groupBy("part", "entry")
        for r in sums.agg(F.sum("n").alias("n"), *(F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in names)).collect():
            books[r.part, r.entry] = [int(r[s]) // r.n for s in names]
    return dim, books


def summed(dim: int, books: np.ndarray, names: list[str]):
    """The work of a task: how many parts each entry is nearest to, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = integers(matrix(batch.column(0), dim)[0], len(books))
            for p in range(len(books) if len(x) else 0):
                near, _ = nearest(x[:, p], books[p])
                order = np.argsort(near, kind="stable")
                at = np.flatnonzero(np.diff(near[order], prepend=-1))
                sums[p, near[order[at]]] += np.add.reduceat(x[order, p], at, axis=0)
                many[p] += np.bincount(near, minlength=many.shape[1])
        part, entry = np.nonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(many[part, entry]), *map(pa.array, sums[part, entry].T)], ["part", "entry", "n", *names])

    return run


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error, codebooks_sha256) for each kept row of df; the codebooks).

    Rows whose vector is null or has a null or non-finite component are
    dropped. A codebook starts as the parts of the `entries` smallest ids' vectors
    (null ids last, equal ids by vector; fewer rows, fewer entries). Components
    whose integer lies beyond limit() count as that. The vector of the smallest
    id says how many components there are: rows with another number of them stay,
    with a null code and error. Fewer components than fill the parts are filled
    up with zeros. label_error is the sum over rows of the same label, null
    being one label, within 64 bits. An empty table gives no rows.
    """
    kept = whole_vectors(df, id_col, vector_col, label_col)
    dim, books = codebooks(kept, parts, entries, rounds)
    digits = np.array([f"{i:02x}" for i in range(256)])
    out = T.StructType([*kept.select("id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    types = to_arrow_schema(out)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, fits = matrix(batch.column(2), dim)
            x = integers(vectors, len(books))
            found = [nearest(x[:, p], books[p]) for p in range(len(books) if len(x) else 0)]
            code, error = np.full(len(fits), None, object), np.zeros(len(fits), np.int64)
            if found:
                code[fits] = ["".join(r) for r in digits[np.stack([b for b, _ in found], axis=1)]]
                error[fits] = sum(e for _, e in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, mask=~fits)], schema=types)

    rows = written(kept.select("id", "label", "vector").mapInArrow(coded, out))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = rows.groupBy("label").agg(F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    whole = rows.join(sums, rows["label"].eqNullSafe(sums["_label"])).select("id", "label", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
    return whole, books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in parts of 1 / SCALE."""
    return np.concatenate([books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(books))])
