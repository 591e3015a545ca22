"""Merkle manifests of tables: one tree a group, one tree over the groups' roots.

Digests meet in a sparse forest: a map of nodes whose run of siblings isn't
complete. Every tree's number of leaves is known beforehand, so is each run's,
and a run that becomes complete gives way to its parent. The union of two
forests is one again, whatever the order, which makes it a monoid: tasks fold
their rows, ``treeReduce`` merges what they leave open, and one root remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batched, written

ARITY = 16
#: The tree over the groups' roots; groups' own trees are numbered from 0.
TOP = -1
#: Leaves whose paths are worked out together: whole subtrees of LOW levels.
LOW = 3
#: Kinds of rows that a part of the table has: closed runs, leaves, open nodes.
RUN, LEAF, OPEN = range(3)
ROWS = "part int, kind int, tree long, leaves long, level int, at long, digests array<string>"

Key = tuple[int, int, int, int]


def digest(texts: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of the texts, concatenated."""
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """How many nodes a tree of so many leaves has at a level."""
    return -(-leaves // ARITY**level)


class Forest:
    """Digests of open runs, by (tree, its leaves, level, run), and of closed ones where keep() says so."""

    def __init__(self, trees: int, keep=lambda key: True) -> None:
        self.trees, self.keep = trees, keep
        self.open: dict[Key, dict[int, str]] = {}
        self.closed: dict[Key, tuple[str, ...]] = {}
        self.root: str | None = None

    def add(self, tree: int, leaves: int, level: int, index: int, node: str) -> None:
        """Puts a node in its place, and its ancestors as far as runs become complete."""
        while True:
            nodes = width(leaves, level)
            if nodes == 1 and tree == TOP:
                self.root = node
                return
            if nodes == 1:
                tree, leaves, level, index = TOP, self.trees, 0, tree
                continue
            run, place = divmod(index, ARITY)
            key = (tree, leaves, level, run)
            held = self.open.setdefault(key, {})
            held[place] = node
            if len(held) < min(ARITY, nodes - run * ARITY):
                return
            del self.open[key]
            digests = tuple(held[i] for i in range(len(held)))
            if self.keep(key):
                self.closed[key] = digests
            level, index, node = level + 1, run, digest(digests)

    def nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        """The open nodes, as add() takes them."""
        for (tree, leaves, level, run), held in self.open.items():
            for place, node in held.items():
                yield tree, leaves, level, run * ARITY + place, node

    def merged(self, other: Forest) -> Forest:
        """The union of both, which takes this one's place."""
        self.closed |= other.closed
        self.root = self.root or other.root
        for node in other.nodes():
            self.add(*node)
        return self


class Paths:
    """Ways from nodes to the root, as what stands left and right of each node in its run."""

    def __init__(self, trees: int, *runs: dict[Key, tuple[str, ...]]) -> None:
        self.trees, self.runs, self.known = trees, runs, {}

    def run(self, key: Key) -> tuple[str, ...]:
        return next(r[key] for r in self.runs if key in r)

    def up(self, tree: int, leaves: int, level: int, index: int) -> list[tuple[str, str]]:
        if width(leaves, level) == 1:
            return [] if tree == TOP else self.up(TOP, self.trees, 0, tree)
        key = (tree, leaves, level, index)
        if key not in self.known:
            run, place = divmod(index, ARITY)
            digests = self.run((tree, leaves, level, run))
            step = ("".join(digests[:place]), "".join(digests[place + 1 :]))
            self.known[key] = [step, *self.up(tree, leaves, level + 1, run)]
        return self.known[key]


def folded(leaf: str, path: Iterable[Sequence[str]]) -> str:
    """The root that a leaf leads to by its path of (left, right) siblings."""
    for left, right in path:
        leaf = digest((left, leaf, right))
    return leaf


def leaf_of(columns: Iterable[Column]) -> Column:
    """Digest of a row: '-' for each null value, else its length in UTF-8 bytes, ':' and its text."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def placed(leaves: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(leaves with part, tree, leaves of the tree and index in it; number of trees), for rows with group and id.

    Rows are sorted into parts by range; counts by (part, group) then give each
    row its place, so that a group may lie in any number of tasks.
    """
    # of equal rows, any may come first; a number keeps very many of them out of one task
    tie = F.monotonically_increasing_id()
    ranges = leaves.withColumn("tie", tie).repartitionByRange(parts, "group", "id", "leaf", "tie").sortWithinPartitions("group", "id", "leaf", "tie").drop("tie")
    numbered = ranges.withColumn("spot", F.monotonically_increasing_id())
    rows = written(numbered.withColumn("part", F.shiftright("spot", 33).cast("int")))
    counts = rows.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("spot").alias("first"))
    before = W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("part", "group", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy("group")).alias("leaves"))
    counts = counts.withColumn("begins", F.when(F.col("start") == 0, 1).otherwise(0).cast("long"))
    counts = written(counts.withColumn("own", F.sum("begins").over(W.partitionBy("part").orderBy("group").rowsBetween(W.unboundedPreceding, 0))))
    # one row a part, of which there is a set number
    starts = counts.groupBy("part").agg(F.sum("begins").alias("n"))
    starts = starts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("earlier"))
    trees = counts.agg(F.sum("begins")).first()[0] or 0
    counts = counts.join(starts, "part").select(F.col("part").alias("_part"), F.col("group").alias("_group"), "first", "start", "leaves", (F.col("earlier") + F.col("own") - 1).alias("tree"))
    out = rows.join(counts, (F.col("part") == F.col("_part")) & F.col("group").eqNullSafe(F.col("_group")))
    return out.select("part", "tree", "leaves", (F.col("spot") - F.col("first") + F.col("start")).alias("at"), "id", "leaf", "other"), trees


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), check: Column | None = None, paths: bool = False, rows_a_part: int = 1 << 20, most_parts: int = 4096) -> DataFrame:
    """(id, index, leaf, subroot, root, proof_sha256, folded_root, verified, and with `paths` path) for each row of df.

    Leaves are leaf_of(columns), numbered within their group by id; nulls come
    first, rows of equal id in order of their leaves, equal rows in any order.
    In each group, and then over the groups' roots in the order of their names'
    bytes (null first), runs of 16 nodes become their digest until one is left.

    proof_sha256 is the digest of all siblings, from the leaf up and left to
    right. folded_root is where the row's siblings lead from `check` (a digest,
    by default the leaf; null: the leaf), and verified whether that is the
    root. path has the siblings themselves, for folded(). A lone row is its own
    root, and an empty table gives no rows.

    What the driver and a broadcast hold is bounded by `most_parts`: some five
    runs of 16 digests where two parts meet, 40 MB at 4096 of them. A task
    holds 4096 leaves, and the runs from level 3 on of its part.
    """
    spark = df.sparkSession
    own = leaf_of(F.col(f"`{c}`") for c in columns)
    leaves = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("group"), own.alias("leaf"), (own if check is None else check).alias("other"))
    leaves = written(leaves.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most_parts, max(tasks, -(-leaves.count() // rows_a_part)))
    rows, trees = placed(leaves, parts)
    rows = rows.select("part", F.lit(LEAF).alias("kind"), "tree", "leaves", F.lit(0).alias("level"), "at", F.array_compact(F.array("leaf", "other")).alias("digests"), "id")
    by_part = ["part", "kind", "tree", "at"]
    schema = to_arrow_schema(T._parse_datatype_string(ROWS))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes():
            for part, own in groupby(tuples(batches), key=lambda r: r[0]):
                forest = Forest(trees, lambda key: key[0] == TOP or key[2] >= LOW)
                for _, _, tree, n, level, at, digests, _ in own:
                    forest.add(tree, n, level, at, digests[0])
                    yield from ((part, RUN, *key, run) for key, run in forest.closed.items())
                    forest.closed.clear()
                if forest.root:
                    yield part, OPEN, TOP, 1, 0, 0, (forest.root,)
                yield from ((part, OPEN, *node[:4], node[4:]) for node in forest.nodes())

        yield from batched(nodes(), schema)

    nodes = written(rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*by_part).mapInArrow(fold, ROWS))

    def gathered(own: Iterator[Row]) -> Iterator[Forest]:
        forest = Forest(trees)
        for r in own:
            forest.add(r.tree, r.leaves, r.level, r.at, r.digests[0])
        yield forest

    whole = nodes.where(F.col("kind") == OPEN).rdd.mapPartitions(gathered).treeReduce(Forest.merged) if trees else Forest(0)
    root, across = whole.root, spark.sparkContext.broadcast(whole.closed)

    id_type = rows.schema["id"].dataType
    out = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string("index long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", path array<struct<left: string, right: string>>" * paths).fields])

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(proofs(tuples(batches), trees, root, across.value, paths), to_arrow_schema(out))

    runs = nodes.where(F.col("kind") == RUN).withColumn("id", F.lit(None).cast(id_type))
    return rows.unionByName(runs).repartitionById(parts, F.col("part")).sortWithinPartitions(*by_part).mapInArrow(proven, out)


def tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def proofs(rows: Iterator[tuple], trees: int, root: str, across: dict[Key, tuple[str, ...]], paths: bool) -> Iterator[tuple]:
    """The result's rows for parts' closed runs and, after them, leaves in order."""
    below = ARITY**LOW
    for _, part in groupby(rows, key=lambda r: r[0]):
        upper: dict[Key, tuple[str, ...]] = {}
        for (kind, tree, n, _), own in groupby(part, key=lambda r: (r[1], r[2], r[3], r[5] // below if r[1] == LEAF else 0)):
            if kind == RUN:
                upper |= {r[2:6]: tuple(r[6]) for r in own}
                continue
            own = list(own)
            block = Forest(trees)
            for r in own:
                block.add(*r[2:6], r[6][0])
            ways = Paths(trees, block.closed, upper, across)
            subroot = ways.run((TOP, trees, 0, tree // ARITY))[tree % ARITY] if trees > 1 else root
            for _, _, _, _, _, at, digests, id_ in own:
                way = ways.up(tree, n, 0, at)
                found = folded(digests[-1], way)
                yield id_, at, digests[0], subroot, root, digest(x for step in way for x in step), found, found == root, *([[{"left": a, "right": b} for a, b in way]] if paths else [])
