"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from gridloom.llm import classifier, decontamination, simhash
from tests.conftest import DATA
from tests.llm.test_corpus import LOWER

FOLDER = DATA.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = p.read(spark, FOLDER, "documents"), []
    for name, stage in p.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns
    assert {"shard", "grown_shard", "text"} <= set(steps[-1][2].columns)


def test_quality_stage(spark, steps):
    _, before, after = steps[0]
    labels = p.read(spark, FOLDER, "labels")
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    rows = before.select("doc_id").join(labels, "doc_id").collect()
    assert sum((r.doc_id in kept) == (r.quality == 1) for r in rows) > 0.97 * len(rows)


def shingles(text: str) -> set:
    w = text.translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicate_stage(steps):
    """No two similar texts stay."""
    _, before, after = steps[1]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    kept = {r.doc_id for r in after.collect()}
    sets = {i: shingles(t) for i, t in docs}
    by = collections.defaultdict(set)
    for i in kept:
        for g in sets[i]:
            by[g].add(i)
    for i in kept:
        common = collections.Counter(j for g in sets[i] for j in by[g] if j < i)
        assert all(n / (len(sets[i]) + len(sets[j]) - n) < 0.8 for j, n in common.items())


def test_decontamination_stage(spark, steps):
    _, before, after = steps[2]
    bench = [(str(r.item_id), (r.text or "").encode()) for r in p.read(spark, FOLDER, "benchmark").collect()]
    windows = set()
    for _, t in bench:
        w = decontamination.tokens(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = decontamination.tokens(text.encode())
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if clean(r.text))


def test_mixing_stage(steps):
    _, before, after = steps[3]
    size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    own = {r.source: r for r in before.groupBy("source").agg(F.sum(size).alias("n"), F.max(size).alias("most")).collect()}
    got = {r.source: r.n for r in after.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(own))}
    whole, free, target = sum(r.n for r in own.values()), dict(weights), {}
    while True:
        level = (whole - sum(target.values())) / max(1, sum(free.values()))
        full = [s for s, w in free.items() if level * w > 3 * own[s].n]
        if not full:
            break
        for s in full:
            target[s] = 3 * own[s].n
            del free[s]
    target |= {s: level * w for s, w in free.items()}
    assert all(abs(got.get(s, 0) - target[s]) <= own[s].most + 16 for s in own)


def test_sharding_stage(steps):
    _, before, after = steps[4]
    shard = collections.defaultdict(set)
    for r in after.collect():
        shard[r.doc_id].add((r.shard, r.grown_shard))
    assert after.count() == before.count() and all(len(s) == 1 for s in shard.values())


def test_stages_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, None), (None, "x y"), (3, "a b c"), (3, "a b c"), (4, "a b c")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for name, stage in p.STAGES:
        for df in (docs, docs.limit(0)):
            assert stage(spark, df, DATA).count() <= 3 * df.count(), name
    kept = p.one_of_near_copies(spark, docs, DATA).collect()
    assert [r.doc_id for r in kept if r.text == "a b c"] == [3]


def similar_components(docs: list[tuple]) -> dict:
    """The smallest id of each document's component, by the shingle sets of all pairs."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in by[g] if j < i)
        for j, n in common.items():
            if n / (len(s) + len(sets[j]) - n) >= 0.8 and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least: dict = {}
    for (i, _), r in zip(docs, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return {i: least[r] for (i, _), r in zip(docs, root, strict=True)}


def test_similar_documents_by_shingles(spark):
    """Chains at similarities around 0.8 (0.67 to 0.95), some of blocks that are cut into parts, against all pairs' shingle sets."""
    rows = []
    for g in range(12):
        w = [f"w{g}x{i}" for i in range(200)]
        for k in range(8):
            rows.append((len(rows), " ".join(w)))
            w[k * 24 : k * 24 + 1 + (g + k) % 8] = [f"v{g}x{k}x{i}" for i in range(1 + (g + k) % 8)]
            w[k * 24 + 12] = f"u{g}x{k}" if g % 2 else w[k * 24 + 12]
            w[k * 24 + 18] = f"t{g}x{k}" if g % 3 == 2 else w[k * 24 + 18]
            w[:: 199 if g % 4 else 60] = [f"s{g}x{k}x{i}" for i in range(len(w[:: 199 if g % 4 else 60]))]
    want = similar_components(rows)
    assert 12 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2048, 3):
        assert {r.id: r.component_id for r in simhash.similar_documents(df, block=block).collect()} == want


def test_near_duplicate_stage_by_shingles(steps):
    """What stays is the smallest doc_id of each component by shingle sets, nothing else."""
    _, before, after = steps[1]
    want = similar_components(sorted((r.doc_id, r.text) for r in before.collect()))
    assert {r.doc_id for r in after.collect()} == set(want.values())


def test_ids_win_over_missing_ids(spark):
    """Of equal texts the row with an id stays, whatever its id and the text's hash."""
    ids = [-(2**62), -5, 0, 7, 2**62, 9, 11, 13]
    rows = [(i, f"one two three four five six {i}") for i in ids] + [(None, f"one two three four five six {i}") for i in ids]
    docs = spark.createDataFrame([(i, t + " seven eight" * k, "en", "s", 0) for k, (i, t) in enumerate(rows[:8] * 1)] + [(None, rows[k][1] + " seven eight" * k, "en", "s", 0) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    assert None not in {r.doc_id for r in p.one_of_near_copies(spark, docs, DATA).collect()}


def test_quality_pools_alike_in_any_company():
    """A text's features don't depend on the texts beside it, nor on how many slices it is cut into."""
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 50, n)) for n in (0, 1, 5, 400, 40_000)]
    vectors = rng.integers(-4096, 4096, (classifier.WORDS, classifier.DIM)).astype(np.int32)
    cut = classifier.Tokenizer()
    alone = np.concatenate([classifier.pooled(cut, vectors, [t]) for t in texts])
    assert (alone == classifier.pooled(cut, vectors, texts)).all()
    bucket, _, code, first = cut([b"ab " * 10 + b"x" * (3 << 20) + b" ab " + b"x" * (3 << 20)])
    assert first.tolist() == [0, 13] and code[10] == code[12] and len({*code[:10].tolist(), code[11]}) == 1


def test_small_sets_lose_no_pair(spark, monkeypatch):
    """Sets of 1 to 20 shingles meet by their prefixes, even if no sampled bits are alike."""
    rng = random.Random(3)
    rows = []
    for g in range(150):
        w = [f"w{g}x{i}" for i in range(rng.randrange(5, 25))]
        rows.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            at = rng.choice([0, len(v) - 1])
            v[at] = f"v{g}x{rng.random()}"
            rows.append(" ".join(v if rng.random() < 0.7 else [*v, "more"]))
    docs = list(enumerate(rows))
    want = similar_components(docs)
    assert 150 < len(set(want.values())) < len(rows)
    monkeypatch.setattr(simhash, "wide_plan", lambda *a, **how: (256, [list(range(60))]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.id: r.component_id for r in simhash.similar_documents(df).collect()} == want


def test_prefixes_meet():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n, m = rng.integers(1, 33), rng.integers(0, 9)
        base = rng.integers(0, 1 << 62, n + m, dtype=np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[rng.integers(0, m + 1) :])
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= 0.8:
            assert len(np.intersect1d(simhash.prefix(a, 0.8), simhash.prefix(b, 0.8)))
