"""Benchmark passages in documents, found by one Aho-Corasick automaton."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import LOWER_BYTES, pieces, written

#: In UTF-8 a word is a run of ASCII letters, digits and all bytes beyond ASCII.
IN_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_BYTES)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return text.translate(PLAIN).split()


class Machine:
    """One Aho-Corasick automaton for every window of every item.

    Words of items are numbers, spelt with a few signs each, and keys are
    `probe` words at every (window - probe + 1)th place of an item, so that each
    window holds one key. Where a key ends, the words around it tell whether a
    window is there. That takes some 20 bytes of memory for a byte of the items.

    A key of more than `many` places, such as the words that very many questions
    begin with, isn't tried place by place: the windows that go by it are
    looked up in a table of all such windows, a few for each place in a text.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int, probe: int = 5, many: int = 32) -> None:
        own = [tokens(text) for _, text in items]
        self.number = {w: i for i, w in enumerate(sorted({w for x in own for w in x}), 1)}
        self.signs = next(n for n in range(1, 5) if 64**n > len(self.number))
        digits = np.arange(len(self.number) + 1)[:, None] // 64 ** np.arange(self.signs) % 64
        self.spelt = (digits + 64 * np.arange(self.signs)).astype(np.uint8)  # each place has signs of its own, so that keys meet whole words only
        self.window = window
        gap = np.full(window + probe, -1, np.int32)
        line, item, places = [gap], [np.zeros(len(gap), np.int32)], {}
        size = len(gap)
        self.need = np.array([min(window, len(x)) for x in own], np.int64)
        begin = np.zeros(len(own), np.int64)
        for i, x in enumerate(own):
            ids = np.fromiter((self.number[w] for w in x), np.int32, len(x))
            k, begin[i] = min(probe, window, len(x)), size
            for at in range(0, len(x) - k + 1, min(window, len(x)) - k + 1) if k else ():
                places.setdefault(tuple(ids[at : at + k].tolist()), []).append(size + at)
            line += [ids, gap]
            item.append(np.full(len(x) + len(gap), i, np.int32))
            size += len(x) + len(gap)
        self.line, self.item = np.concatenate(line), np.concatenate(item)
        self.keys = ahocorasick.Automaton() if places else None
        self.windows: dict[bytes, set[int]] = {}
        for key, at in places.items():
            shapes = {(len(key), int(self.need[self.item[a]])) for a in at} if len(at) > many else None
            for a in at if shapes else ():
                i, w = self.item[a], int(self.need[self.item[a]])
                # the windows whose first key is this one
                for first in range(max(begin[i], a - w + len(key)), min(a, begin[i] + len(own[i]) - w) + 1):
                    self.windows.setdefault(self.line[first : first + w].tobytes(), set()).add(int(i))
            self.keys.add_word(self.text(np.array(key)), (len(key), None if shapes else np.array(at), shapes))
        if places:
            self.keys.make_automaton()

    def text(self, ids: np.ndarray) -> str:
        return self.spelt[ids].tobytes().decode("latin-1")

    def find(self, text: bytes) -> tuple[int, np.ndarray, set[int]]:
        """(words, hit flag of each word, indexes of the items) of a text, in one scan."""
        words = tokens(text)
        hit = np.zeros(len(words), bool)
        if self.keys is None or not words:
            return len(words), hit, set()
        ids = np.fromiter((self.number.get(x, 0) for x in words), np.int32, len(words))
        around, own, edge = None, set(), np.full(self.window, -2, np.int32)
        for end, (k, places, shapes) in self.keys.iter(self.text(ids)):
            if around is None:
                around = np.concatenate((edge, ids, edge))
            at = (end + 1) // self.signs - k
            if shapes:
                for _, w in shapes:
                    for first in range(max(0, at - w + k), min(at, len(words) - w) + 1):
                        if items := self.windows.get(ids[first : first + w].tobytes()):
                            own |= items
                            hit[first : first + w] = True
                continue
            before = np.arange(-1, -self.window, -1)
            after = np.arange(k, k + self.window - 1)
            left = runs_of_true(self.line[places[:, None] + before] == around[at + self.window + before])
            right = runs_of_true(self.line[places[:, None] + after] == np.append(around, edge)[at + self.window + after])
            found = left + k + right >= self.need[self.item[places]]
            if found.any():
                own.update(self.item[places[found]].tolist())
                hit[at - left[found].max() : at + k + right[found].max()] = True
        return len(words), hit, own


def runs_of_true(flags: np.ndarray) -> np.ndarray:
    """How many leading flags of each row hold."""
    return np.where(flags.all(axis=1), flags.shape[1], (~flags).argmax(axis=1)) if flags.shape[1] else np.zeros(len(flags), np.int64)


_built: dict[str, Machine] = {}


def built(name: str, items: list[tuple[str, bytes]], window: int) -> Machine:
    """The automaton of that name, made once in a Python process, which holds one at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = Machine(items, window)
    return _built[name]


def spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Byte offsets in the original text of each maximal run of hit words."""
    if not hit.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    at = [m.span() for m in IN_WORD.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """(row, n_words, n_hit, items, spans) for each row of df; row is a struct of the carried columns.

    A window is `window` consecutive words of an item, or all words of a
    shorter item; a word inside any occurrence of a window is hit. items has
    the ids, as sorted distinct strings, of the items with an occurring window;
    spans are byte ranges of the original text. Null and wordless texts have no
    words and no hits; items without words occur nowhere; a null item id counts
    as an empty one. Repeated rows and items count as they come.

    Documents are neither shuffled nor joined, and are scanned once by one
    automaton, of which each Python process makes one copy. Only a benchmark
    beyond `block_bytes`, some 300 MB of automaton, is dealt by hash to as many
    automata as that takes, each applied in a pass of its own.
    """
    own = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    blocks = max(1, -(-int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    state = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    for b in range(blocks):
        items = [(r.item, bytes(r.text)) for r in own.where(block == b).select("item", F.col("text").cast("binary").alias("text")).collect()]
        state = one_pass(state, df.sparkSession.sparkContext.broadcast(items), window, last=b == blocks - 1)
        if b < blocks - 1:
            state = written(state)
    return state


def one_pass(state: DataFrame, items, window: int, last: bool) -> DataFrame:
    """Adds one automaton's hits; the last pass counts words and places the spans."""
    kept = [state.schema["row"]] if last else [state.schema["row"], state.schema["text"]]
    results = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>" if last else "hit binary, items array<string>"
    schema = T.StructType(kept + T._parse_datatype_string(results).fields)
    types = to_arrow_schema(T._parse_datatype_string(results))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [i for i, _ in items.value]
        machine = built(name, items.value, window)
        for batch in batches:
            for first, texts in pieces(batch.column(1)):
                rows = []
                part = batch.slice(first, len(texts))
                for text, packed, had in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    n, hit, own = machine.find(text)
                    if packed:
                        hit = hit | np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
                    ids = sorted({*had, *(names[i] for i in own)})
                    rows.append((n, int(hit.sum()), ids, spans(text, hit)) if last else (np.packbits(hit).tobytes() if hit.any() else None, ids))
                arrays = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *arrays], schema.names)

    return state.select("row", "text", "hit", "items").mapInArrow(run, schema)


def items_digest(items):
    """Lower-case hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)
