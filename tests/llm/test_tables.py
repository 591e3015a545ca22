"""Language filters, Merkle manifests and vector codes against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.llm import languages, merkle, vectors
from tests.conftest import DATA

QUERIES = entry.queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, leaf string, row string, part int, score string"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns named like results."""
    text = "The Quick brown fox jumps over the lazy dog"
    texts = [None, "", " \t\n ", "123 --", text, text, text.upper(), "ÄÖ ẞ \x1f " + text, "word " * 60_000, "漢字", "x"]
    ids = [1, 2, 3, None, 5, 5, None, 7, 8, 9, 10]
    rows = [(i, t, lang, s, n, "a", "b", 0, "c") for i, t, lang, s, n in zip(ids, texts, ["en", None, "de"] * 4, [None, "a", "b", "a"] * 3, [0, None] * 6, strict=False)]
    return spark.createDataFrame([*rows, rows[4]], AWKWARD)


def h(texts) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_trees(docs: list[tuple]) -> list[tuple]:
    """Rows of the manifest by levels of whole lists; docs are (doc_id, source, lang, n_chars, text)."""

    def grown(nodes: list[str]) -> tuple[str, list[list[str]]]:
        """The root, and for each node its ways' siblings left and right."""
        ways = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
                ways[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            nodes = [h(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            at = [a // 16 for a in at]
        return nodes[0], ways

    groups = collections.defaultdict(list)
    for d in docs:
        changed = d[-1].translate(LOWER) if d[-1] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 else d[-1]
        groups[d[1]].append(((d[0] is not None, d[0] or 0, h(map(field, d))), d[0], h(map(field, (*d[:-1], changed)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    grown_groups = {s: grown([k[2] for k, _, _ in sorted(groups[s])]) for s in order}
    root, tops = grown([grown_groups[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        subroot, ways = grown_groups[s]
        for (key, id_, other), way in zip(sorted(groups[s]), ways, strict=True):
            way = way + top
            found = other
            for a, b in way:
                found = h((a, found, b))
            out.append((str(id_), key[2], subroot, root, h(x for step in way for x in step), found, found == root))
    return sorted(out)


def columns(rows) -> list[tuple]:
    return sorted((str(r[0]), *r[1:]) for r in rows)


def tampered(df):
    text = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.leaf_of([*map(F.col, ("doc_id", "source", "lang", "n_chars")), text])


RESULT = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_query(spark):
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = QUERIES["op12_merkle_manifest"](spark, DATA).collect()
    assert columns(got) == brute_trees(docs) and 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1, 1], [300, 1, 16, 4097, 17], [1] * 40, [700] * 3])
def test_manifest_in_parts(spark, sizes):
    """Trees of any size over parts of any size."""
    rows = [(random.Random(i).randrange(10**6), f"s{g:02d}" if g else None, None, j, f"Text {j}") for g, n in enumerate(sizes) for j, i in enumerate(range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    want = brute_trees(rows)
    for a_part in (37, 1000):
        assert columns(merkle.manifest(df, check=tampered(df), rows_a_part=a_part).select(*RESULT).collect()) == want


def test_manifest_of_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    assert columns(merkle.manifest(awkward, check=tampered(awkward)).select(*RESULT).collect()) == brute_trees(rows)
    empty = merkle.manifest(awkward.limit(0))
    assert empty.count() == 0 and empty.columns == merkle.manifest(awkward).columns


def test_paths_prove_rows(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = merkle.manifest(df, paths=True).collect()
    assert all(r.verified and merkle.folded(r.leaf, r.path) == r.root and merkle.folded(h(["x"]), r.path) != r.root for r in rows)
    per = collections.defaultdict(list)
    for r in rows:
        per[r.subroot].append(r["index"])
    assert all(sorted(x) == list(range(len(x))) for x in per.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 600), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_forest_is_a_monoid(sizes, rng):
    """Any dealing of leaves to forests, merged in any order and grouping, has the same root and nothing open."""
    leaves = [(t, n, 0, i, h([str(t), ":", str(i)])) for t, n in enumerate(sizes) for i in range(n)]
    want = merkle.Forest(len(sizes))
    for leaf in leaves:
        want.add(*leaf)
    forests = [merkle.Forest(len(sizes)) for _ in range(rng.randint(1, 9))]
    for leaf in rng.sample(leaves, len(leaves)):
        rng.choice(forests).add(*leaf)
    while len(forests) > 1:
        rng.shuffle(forests)
        a = forests.pop()
        forests[0] = a.merged(forests[0])
    assert forests[0].root == want.root is not None and not forests[0].open and forests[0].closed == want.closed


def brute_codes(rows: list[tuple], parts=8, entries=16, rounds=6):
    """Plain Python over (id, vector, label), for vectors of one length that the parts divide."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(float(np.float32(x)) * 4096)) for x in r[1]] for r in kept]
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((distance(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for v in cut:
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if own[i] else e for i, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    total = collections.Counter()
    for r, f in zip(kept, found, strict=True):
        total[r[2]] += sum(d for d, _ in f)
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), total[r[2]], name) for r, f in zip(kept, found, strict=True))


def coded(df):
    return columns(vectors.compressed(df)[0].collect())


VECTORS = "vec_id long, embedding array<float>, label int, code string"


def test_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), int(rng.integers(3)) if i % 5 else None, "x") for i in range(90)]
    rows += [(100, None, 1, "x"), (101, [None] * 16, 1, "x"), (102, [float("nan")] * 16, 1, "x"), (103, [float("inf")] * 16, None, "x"), (104, rows[7][1], 2, "x"), (7, rows[3][1], 2, "x"), (None, rows[1][1], 0, "x"), rows[9]]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = vectors.compressed(df)[0].select("id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert columns(got) == brute_codes([r[:3] for r in rows])


@pytest.mark.parametrize("values", [[0.0], [1 / 4096, -1 / 4096, 0.0], [-0.0001, 0.0001, 0.5]])
def test_codes_with_ties(spark, values):
    """Few different vectors: many equal distances, and entries that stay unused."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.choice(values, 8).tolist(), 1) for i in range(40)]
    got = vectors.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))[0]
    assert columns(got.select("id", "code", "error", "label_error", "codebooks_sha256").collect()) == brute_codes(rows)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.sampled_from([3, 4000, 1 << 20, 1 << 27]), st.integers(0, 2**32 - 1))
def test_screening_is_exact(width, most, seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-most, most + 1, (12, width))
    x = np.concatenate((rng.integers(-most, most + 1, (60, width)), (book[:6] + book[6:]) // 2, book))
    got, error = vectors.nearest(x, book)
    exact = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (got == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


def test_awkward_vectors(spark):
    many = "vec_id long, embedding array<double>, label int, error string"
    rows = [(1, [3e38, -3e38, 1.0], 1, ""), (2, [1.0, 2.0, 3.0], None, ""), (3, [1.0], None, ""), (4, [], 1, ""), (5, [0.1, 0.2, 0.3], None, "")]
    df = spark.createDataFrame(rows, many)
    got = {r.id: r for r in vectors.compressed(df)[0].collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[3].code is None is got[3].error and len(got[1].code) == 16
    assert all(r.label_error is None or r.label_error >= 0 for r in got.values())
    empty, books = vectors.compressed(df.limit(0))
    assert empty.count() == 0 and empty.columns == vectors.compressed(df)[0].columns
    codes, books = vectors.compressed(df.where("vec_id in (2, 5)"))
    for r in codes.collect():
        whole = np.floor(np.array(rows[r.id - 1][1]) * 4096)
        assert ((vectors.decoded(r.code, books)[:3] - whole) ** 2).sum() == r.error == 0


def test_languages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op11_language_id"](spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def brute_ngrams(text: str) -> collections.Counter:
    plain = "".join(chr(b) if chr(b).isascii() and chr(b).isalpha() or b > 127 else " " for b in text.translate(LOWER).encode())
    out = collections.Counter()
    for w in plain.split():
        w = f" {w} ".encode("latin-1")
        for n in languages.ORDERS:
            out.update((n, w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def test_ngrams(monkeypatch):
    random.seed(1)
    monkeypatch.setattr(languages, "SLICE", 97)
    texts = ["", " ", "a", "Ab c", "é", "--x--"] + ["".join(random.choice("abÉ .1Z") for _ in range(random.randrange(200))) for _ in range(20)]
    got = [collections.Counter() for _ in texts]
    for n, codes, text in languages.ngrams(*languages.letters([t.encode() for t in texts])):
        for c, t in zip(codes.tolist(), text.tolist(), strict=True):
            got[t][n, (c & (1 << 56) - 1).to_bytes(n, "big")] += 1
    assert got == [brute_ngrams(t) for t in texts]


def test_filters_hold_what_they_learned(spark):
    """Each chosen n-gram's mask has its languages, other n-grams' as good as none, and the choice equals brute force."""
    names = [f"l{i:02d}" for i in range(70)]
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(210)]
    rows = [(i, " ".join(words[i % 70 * 3 : i % 70 * 3 + 3] * 5), names[i % 70]) for i in range(210)] + [(900, "zzzz", None), (901, None, "l00")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    share, beside = 1e-2, 0.25
    filters = languages.train(df, share=share, beside=beside, rows=1 << 16)
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        if t and lang:
            counts[lang].update(brute_ngrams(t))
    totals = {(lang, n): sum(v for (m, _), v in c.items() if m == n) for lang, c in counts.items() for n in languages.ORDERS}
    shares = collections.defaultdict(dict)
    for lang, c in counts.items():
        for (n, g), v in c.items():
            if v >= share * totals[lang, n]:
                shares[n, g][lang] = v / totals[lang, n]
    extra = 0
    for (n, g), by in shares.items():
        code = np.array([int.from_bytes(g, "big") | n << 56], np.uint64)
        masks = filters.masks(code)
        held = {x for i, x in enumerate(filters.langs) if int(masks[i // 64][0]) >> i % 64 & 1}
        want = {x for x, s in by.items() if s >= beside * max(by.values())}
        assert want <= held
        extra += len(held - want)
    assert filters.langs == names and extra <= 5
    got = {r.row.doc_id: r for r in languages.languages(df, share=share, beside=beside).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:210]) and got[900].lang_pred in names and got[901].lang_pred == "und"


def test_awkward_languages(spark, awkward):
    got = languages.languages(awkward).collect()
    assert len(got) == awkward.count()
    und = {r.text for r in awkward.collect()} & {None, "", " \t\n ", "123 --"}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*und, "漢字", "x", "dog"])], "doc_id long, text string")
    taught = docs.withColumn("lang", F.when(F.col("text") == "dog", "en"))
    by = {r.row.doc_id: r for r in languages.languages(taught).collect()}
    assert [by[i].lang_pred for i in range(len(by))] == ["und"] * 4 + ["en"] * 3 and all(0 <= r.score <= 1 for r in by.values())
    assert {r.lang_pred for r in languages.languages(taught.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert languages.languages(awkward.limit(0)).count() == 0
    # a language without any text that teaches can't win
    assert by[6].score == 1


def test_filters_correct_false_positives():
    """With a table far too small, what a full filter claims by chance doesn't outweigh what a small one holds."""
    rng = np.random.default_rng(7)
    slices = np.zeros((1, 1 << 10), np.uint64)
    slices[0, rng.random(1 << 10) < 0.8] |= np.uint64(1)
    text = [b"quick brown foxes jump"]
    codes = np.concatenate([c for _, c, _ in languages.ngrams(*languages.letters(text))])
    for at in languages.rows_of(codes[::2], 1 << 10, 3):
        slices[0, at] |= np.uint64(2)
    filled = np.array([np.mean(slices[0] >> np.uint64(i) & np.uint64(1)) for i in range(2)])
    filters = languages.Filters(["full", "own"], slices, 3, filled**3, 0)
    n, hits = filters.counts(text)
    assert hits[0, 1] >= len(codes) // 2 and filters.decide(text)[0][0] == 1
