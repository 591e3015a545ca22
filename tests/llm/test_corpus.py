"""Corpus operators against brute force, on the smallest tables and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.llm import classifier, decontamination, graph, mixing, ppm, repeats, rules, sharding, simhash, warc
from tests.conftest import DATA

QUERIES = entry.queries()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, n_words string, id long, row string, score string"


def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns named like results."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    text = "The quick brown fox jumps over the lazy dog and runs far away from here today, again and again."
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, text), (5, text), (6, text), (None, text), (None, None), (7, long), (8, "ÄÖ ẞ \x1f " + text), (9, "x" * 5000), (10, text + " " + text)]
    return spark.createDataFrame([(i, t, "en", s, 0, "a", 0, "b", "c") for (i, t), s in zip(rows, [None, "a", "b"] * 5, strict=False)], AWKWARD)


def words(t: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def test_rules_measures(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, DATA).collect()}
    for i, t in documents(spark):
        w = words(t)
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {k for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_rules_leave_good_documents(spark):
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    rows = [r for r in QUERIES["op1_quality_rules"](spark, DATA).collect() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in rows) >= 0.98 * len(rows)


def test_rules_order(spark, awkward):
    given = rules.rules()
    df = rules.measured(awkward, "doc_id", "text")
    assert {r.name for r in rules.ordered(df, given)} == {r.name for r in given}
    kept = lambda g: sorted((str(r.id), r.kept) for r in rules.quality_rules(awkward, given=g).collect())
    assert kept(given) == kept(given[::-1])


def test_mixing(spark):
    rows = QUERIES["op2_mixing"](spark, DATA).collect()
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        p = per[source[r.doc_id]]
        p[0], p[1], p[2] = p[0] + r.taken, r.source_size, r.target
    assert all(abs(taken - target) <= 16 for taken, _, target in per.values())
    assert math.isclose(sum(t for *_, t in per.values()), sum(r.size for r in rows))
    assert sorted(rows) == sorted(QUERIES["op2_mixing"](spark, DATA).collect())


def test_targets_are_capped(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1000), (None, 500)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 3 and got["b"] == 3 and math.isclose(got["c"] / got[None], 3) and math.isclose(sum(got.values()), 1502)


def test_sainte_lague(spark):
    random.seed(4)
    for n in (1, 3, 40):
        targets = [(i, random.choice([0.0, 1.0, random.random() * 300])) for i in range(n)]
        got = {r["rank"]: r.blocks for r in mixing.quotas(spark.createDataFrame(targets, "rank long, target double"), 4).collect()}
        seats = math.ceil(sum(t for _, t in targets) / 4)
        best = sorted(((-t / (2 * k + 1), i, k) for i, t in targets for k in range(seats)))[:seats]
        want = collections.Counter(i for _, i, _ in best)
        assert got == {i: want[i] for i, _ in targets}


def test_shard_quotas(spark):
    random.seed(6)
    cells = [(s, i, h, random.choice([0, 5, random.randrange(400)]), b) for i, (s, b) in enumerate((("a", 37), ("b", 1), (None, 0))) for h in range(5)]
    got = {(r.source, r.shard): r.quota for r in mixing.shard_quotas(spark.createDataFrame(cells, "source string, rank long, shard int, held long, blocks long")).collect()}
    for s, b in (("a", 37), ("b", 1), (None, 0)):
        held = {h: n for x, _, h, n, _ in cells if x == s}
        best = sorted((-n / (2 * k + 1), h, k) for h, n in held.items() for k in range(b))[:b]
        want = collections.Counter(h for _, h, _ in best)
        assert {h: got[s, h] for h in held} == {h: want[h] for h in held}


def test_decontamination_blocks_and_spans(spark):
    text = "Intro words. ALPHA beta, gamma-delta epsilon zeta eta theta iota kappa lambda! And a short-item end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (8, "Short item"), (9, "..."), (None, "nothing here at all")], "item_id long, text string")
    results = []
    for size in (10, 1_000_000):
        got = {r.row.doc_id: r for r in decontamination.contamination(docs, bench, block_bytes=size).collect()}
        results.append({k: (r.n_words, r.n_hit, r["items"], r.spans) for k, r in got.items()})
    assert results[0] == results[1]
    n, hit, items, spans = results[0][1]
    assert (n, hit, items) == (18, 13, ["7", "8"])
    assert [text.encode()[s.start : s.end].decode() for s in spans] == ["ALPHA beta, gamma-delta epsilon zeta eta theta iota kappa lambda", "short-item"]
    assert results[0][2] == (0, 0, [], []) and results[0][3][1] == 0


def brute_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = QUERIES["op4_jump_sharding"](spark, DATA).collect()
    text = dict(documents(spark))
    slots = collections.defaultdict(list)
    for r in rows:
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (brute_jump(key, 40), brute_jump(key, 41))
        assert r.grown_shard in (r.shard, 40) and r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_fingerprint(text: str, k: int) -> int:
    w = words(text.translate(LOWER))
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids: list, fps: list[int], radius: int) -> dict:
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(least.get(root(i), x), x)
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, DATA).collect()}
    fps = [brute_fingerprint(t, 4) for _, t in docs]
    want = components([i for i, _ in docs], fps, 4)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, want, strict=True)}


@pytest.mark.parametrize("block", [2, 2048])
def test_links_of_dense_groups(spark, block):
    """Many fingerprints around a few centres, in buckets far beyond the block size; links join what brute force joins."""
    random.seed(9)
    fps = set()
    for centre in (0, (1 << 64) - 1, 0x0123456789ABCDEF):
        for _ in range(60):
            x = centre
            for b in random.sample(range(64), random.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in graph.connected_components(simhash.near_links(df, 4, block=block)).collect()}
    assert [root.get(s, s) for s in signed] == components(signed, fps, 4)


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 130, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(0b1011), base ^ np.uint64(0x8000000000000401)])
    want = np.array([[(int(a) ^ int(b)).bit_count() <= 4 for b in fps] for a in fps])
    assert (simhash.near(fps, fps, 4) == want).all()
    assert not simhash.near(np.zeros(3, np.uint64), np.full(70, (1 << 64) - 1, np.uint64), 4).any()
    wide = rng.integers(0, 1 << 63, (90, 4), dtype=np.uint64)
    wide[40:] = wide[:50] ^ (wide[40:] & np.roll(wide[40:], 1, axis=0) & np.roll(wide[40:], 1, axis=1))
    number = [int.from_bytes(x.tobytes(), "little") for x in wide]
    for radius in (0, 7, 31, 32, 52):
        assert (simhash.near(wide, wide, radius) == [[(a ^ b).bit_count() <= radius for b in number] for a in number]).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.connected_components(edges.limit(0)).count() == 0


def brute_removed(docs: list[tuple]) -> list[tuple]:
    first: dict[bytes, int] = {}
    big = 1 << 63
    for i, t in docs:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], big), big - 1 if i is None else i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < (big - 1 if i is None else i):
                gone[s] += 1
                gone[s + 50] -= 1
        hit = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~hit])
        runs = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out.append((str(i), len(t), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark):
    want = brute_removed([(i, t.encode()) for i, t in documents(spark)])
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op8_repeated_passages"](spark, DATA).collect()) == want


def test_repeats_planted(spark, monkeypatch):
    random.seed(2)
    syllables = ["".join(random.choice("abcdeé ") for _ in range(random.randint(1, 6))) for _ in range(60)]
    docs = [" ".join(random.choice(syllables) for _ in range(random.randint(0, 120))) for _ in range(50)]
    for _ in range(40):
        a, b = random.choice(docs), random.randrange(len(docs))
        j, p = random.randrange(len(a) + 1), random.randrange(len(docs[b]) + 1)
        docs[b] = docs[b][:p] + a[j : j + random.randint(20, 200)] + docs[b][p:]
    docs += [docs[3], docs[3], "x" * 300, "x" * 120, docs[5] * 3]
    ids = random.sample(range(1000), len(docs) - 1) + [None]
    df = spark.createDataFrame(list(zip(ids, docs, strict=True)), "doc_id long, text string").repartition(3)
    want = brute_removed([(i, t.encode()) for i, t in zip(ids, docs, strict=True)])
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()) == want


def test_long_texts_are_cut_with_a_margin(monkeypatch):
    random.seed(3)
    text = bytes(random.choice(b"abcdef ") for _ in range(5000))

    def found():
        h = repeats.Hasher()
        parts = [repeats.anchors(h, run) for run in repeats.segments([text, text[:40], text[100:900]])]
        key, name, doc, pos, o1, o2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        windows = [(d, s, k) for d, p, a, b, k in zip(doc.tolist(), pos.tolist(), o1.tolist(), o2.tolist(), key.tolist(), strict=True) for s in range(p - a, p - b + 1)]
        return sorted(windows)

    whole = found()
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    assert found() == whole and len(whole) == len({w[:2] for w in whole}) == 4951 + 751


def test_ppm_base_and_score(spark):
    docs = documents(spark)
    rows = {r.doc_id: r for r in QUERIES["op9_ppm"](spark, DATA).collect()}
    learn = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in learn for w in words(t.translate(LOWER)))
    n, kinds, ends = sum(count.values()) + len(learn), len(count) + 1, len(learn)
    codes, counts = np.unique(ppm.grams([t.encode() for t in learn], 5)[0], return_counts=True)
    trie = ppm.Trie(codes, counts.astype(float), 5)
    for i, t in docs:
        w = words(t.translate(LOWER))
        base = sum(math.log10((count[x] + 1) / (n + kinds + 1)) for x in w) + math.log10((ends + 1) / (n + kinds + 1))
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w) + 1, sum(x in count for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, trie.score([t.encode()])[0], rel_tol=1e-6)


def brute_ppm(learn: list[bytes], text: bytes, order: int) -> float:
    """log10 probability by the definition, escape by escape."""
    table: dict[bytes, collections.Counter] = collections.defaultdict(collections.Counter)
    pad = bytes([ppm.START]) * order
    for t in learn:
        x = pad + t + bytes([ppm.END])
        for i in range(order, len(x)):
            for k in range(order + 1):
                table[x[i - k : i]][x[i]] += 1
    total, x = 0.0, pad + text + bytes([ppm.END])
    for i in range(order, len(x)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            fresh = {s: c for s, c in table[x[i - k : i]].items() if s not in out}
            if not fresh:
                continue
            whole = sum(fresh.values()) + len(fresh)
            if x[i] in fresh:
                total += math.log10(fresh[x[i]] / whole)
                break
            total += math.log10(len(fresh) / whole)
            out |= set(fresh)
        else:
            total -= math.log10(ppm.SYMBOLS - len(out))
    return total


def test_ppm_is_exact():
    learn = [b"the cat sat on the mat", b"the dog sat", "das Öl".encode(), b""]
    codes, counts = np.unique(ppm.grams(learn, 5)[0], return_counts=True)
    trie = ppm.Trie(codes, counts.astype(float), 5)
    for text in (b"the cat sat", b"", b"zebra", "Öl the".encode(), b"the the the"):
        assert math.isclose(trie.score([text])[0], brute_ppm(learn, text, 5), rel_tol=1e-5)
    assert math.isclose(ppm.Trie(np.zeros(0, np.uint64), np.zeros(0), 5).score([b"ab"])[0], -3 * math.log10(255))


def test_ppm_beats_the_base_on_held_out_texts(spark):
    """With 10,000 texts to learn from; with 1,000 the words still say more than the bytes (README)."""
    rows = [r for r in QUERIES["op9_ppm"](spark, DATA.replace("0.001", "0.1")).collect() if r.held_out]
    assert np.mean([r.score > r.base_score for r in rows]) > 0.5


def test_classifier(spark):
    folder = DATA.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(rows[i].predicted, q) for i, q in labels.items() if rows[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_tokenizer_tells_words_apart():
    texts = [b"a bb  ccc\n", b"", b" \t ", b"bb\x0bccc a", "ü a".encode()]
    _, _, code, first = classifier.Tokenizer()(texts)
    flat = [w for t in texts for w in t.split()]
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
    assert len({(w, c) for w, c in zip(flat, code.tolist(), strict=True)}) == len(set(flat)) == len(set(code.tolist()))


def test_one_class_of_labels(spark, awkward):
    labels = spark.createDataFrame([(5, 1), (6, 1)], "doc_id long, quality int")
    assert {r.score for r in classifier.quality(awkward, labels).collect()} == {0.5}


def test_warc_roundtrip(spark, tmp_path):
    html = "<p>" + "z" * 200 + "ü</p>"
    rows = [(1, "http://a/", html), (2, "http://b/ x\n", html), (3, None, None), (4, "u", "s"), (5, "u", "s"), (None, "n", html), (1, "again", html), (6, "big", "".join(map(str, range(200_000))))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    typed = warc.with_types(df, "page_id", "url", "html")
    archives = warc.write_warc(typed, f"file://{tmp_path}/w", roll=300)
    assert archives.count() > 1
    for split in (7, 1000, 1 << 25):
        got = warc.read_warc(archives, split).collect()
        kinds = sorted((r.id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in got)
        n = len(html.encode())
        assert kinds == sorted([("", "revisit", "1", n), ("1", "response", "", n), ("1", "response", "", n), ("2", "revisit", "1", n), ("3", "response", "", 0), ("4", "response", "", 1), ("5", "response", "", 1), ("6", "response", "", len(rows[-1][2]))])
        assert {r.payload.decode() for r in got if r.payload is not None} == {html, "", "s", rows[-1][2]}


def test_warc_magic_inside_a_member():
    false = warc.MAGIC + b"\x00" * 30
    data = false + warc.record("1", "u", b"p" * 150, hashlib.sha256(b"p" * 150).hexdigest(), None, "d") + false
    for start, want in ((0, 1), (len(false), 1), (len(false) + 1, 0)):
        assert len(list(warc.records(io.BytesIO(data), start, len(data)))) == want
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.record("1", "u", b"p", "00", None, "d")), 0, 10))


OPERATORS = {
    "rules": lambda s, df: rules.quality_rules(df),
    "mixing": lambda s, df: mixing.mixture(df),
    "decontamination": lambda s, df: decontamination.contamination(df, s.createDataFrame([(1, "quick brown fox")], "item_id long, text string")),
    "sharding": lambda s, df: sharding.shard_rows(df),
    "warc": lambda s, df: warc.through_warc(df, "doc_id", "source", "text"),
    "simhash": lambda s, df: simhash.near_duplicates(df),
    "similar": lambda s, df: simhash.similar_documents(df),
    "repeats": lambda s, df: repeats.without_repeats(df),
    "ppm": lambda s, df: ppm.scores(df, held=F.col("id") == 5),
    "classifier": lambda s, df: classifier.quality(df, s.createDataFrame([(5, 1), (9, 0)], "doc_id long, quality int")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows(spark, awkward, name):
    """One row for each row, and none for an empty table."""
    assert OPERATORS[name](spark, awkward).count() == awkward.count()
    empty = OPERATORS[name](spark, awkward.limit(0))
    assert empty.count() == 0 and empty.columns == OPERATORS[name](spark, awkward).columns


def test_awkward_results(spark, awkward):
    near = [(r.id, r.component_id) for r in simhash.near_duplicates(awkward).collect()]
    by = collections.defaultdict(set)
    for i, c in near:
        by[i].add(c)
    assert by[1] == by[2] == by[3] == {1} and by[5] == by[6] == {5} and by[None] == {1, 5}
    gone = [(r.id, r.n_removed) for r in repeats.without_repeats(awkward).collect()]
    assert sorted(x for i, x in gone if i == 5) == [0, 0] and [x for i, x in gone if i == 6][0] > 0
    shards = sharding.shard_rows(awkward).collect()
    slots = collections.defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_values(spark, awkward):
    """What each operator gives for nulls, blanks, ties, repeats and long texts."""
    docs = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    run = lambda name: OPERATORS[name](spark, awkward).collect()
    sizes = sorted((str(i), len(words(t or ""))) for i, t, _ in docs)
    got = run("rules")
    assert sorted((str(r.id), r.n_words) for r in got) == sizes
    assert {r.id for r in got if r.kept} == {7, 8} and all(r.base_failed == (r.id not in (7, 8)) and r.rejected_by is None for r in got)
    assert [r.n_repeat_words for r in got if r.id == 10] == [38]
    got = run("mixing")
    assert sorted((str(r.id), r.size) for r in got) == sizes and all(0 <= r.taken <= 3 * r.size for r in got)
    per = collections.defaultdict(int)
    for r in got:
        per[r.source] += r.taken
    target = {r.source: r.target for r in got}
    assert set(per) == {None, "a", "b"} and all(abs(n - target[s]) <= 8 * 16 for s, n in per.items())
    hits = {5: 3, 6: 3, 8: 3, 10: 6}
    assert all((r.n_hit, r["items"]) == ((hits.get(r.row.doc_id, 0), ["1"] if r.row.doc_id in hits else []) if r.row.doc_id else (r.n_hit, r["items"])) for r in run("decontamination"))
    assert sorted(r.n_hit for r in run("decontamination") if r.row.doc_id is None) == [0, 3]
    got = run("warc")
    assert {r.record_type for r in got} == {"response"} and sorted((str(r.id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in docs)
    got = run("ppm")
    assert sorted((str(r.id), r.n_tokens - 1) for r in got) == sizes and {r.held_out for r in got if r.id == 5} == {True} and all(r.score <= 0 and math.isfinite(r.base_score) for r in got)
    assert {r.n_known for r in got if r.id in (1, 2, 3)} == {1} and len({r.score for r in got if r.id in (5, 6)}) == 1
    got = run("classifier")
    by = {r.row.doc_id: r.score for r in got}
    assert all(0 <= r.score <= 1 for r in got) and by[1] == by[2] == by[3] and by[5] == by[6]


def test_ppm_in_parts(spark):
    """A trie in many parts gives each text the score of the whole trie, of order 5."""
    df = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120")
    docs = sorted((r.doc_id, r.text or "") for r in df.collect())
    learn = [t.encode() for i, t in docs if i % 5]
    codes, counts = np.unique(ppm.grams(learn, 5)[0], return_counts=True)
    whole = ppm.Trie(codes, counts.astype(float), 5)
    parts = ppm.train(df.where("doc_id % 5 != 0"), "text", 5, 2000)
    assert parts.order == 5 and len(parts.parts) > 5
    got = {r.id: r.score for r in ppm.scores(df, held=F.col("id") % 5 == 0, size=2000).collect()}
    assert all(math.isclose(got[i], whole.score([t.encode()])[0], rel_tol=1e-6) for i, t in docs)


@pytest.mark.parametrize("least", [1, 3])
def test_repeats_with_hot_anchors(spark, monkeypatch, least):
    """Anchors that are left to the round of strings give what they give otherwise."""
    rng = np.random.default_rng(4)
    line = "a line that a great many texts have in the middle "
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 6, 90)) + line + "".join(chr(97 + c) for c in rng.integers(0, 6, 90)) for _ in range(30)]
    texts += [texts[3], texts[3][20:140], texts[7] + texts[8]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {tuple(r)[:5] for r in repeats.without_repeats(df).collect()} if least == 1 else None
    real = repeats.hot_keys
    monkeypatch.setattr(repeats, "hot_keys", lambda docs: real(docs, share=0.0001, least=least))
    got = {r.id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()}
    seen, want = {}, {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for at in range(len(t) - 49):
            if seen.setdefault(t[at : at + 50], i) < i:
                gone[at : at + 50] = True
        kept = "".join(c for c, g in zip(t, gone) if not g)
        want[i] = (int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept.encode()).hexdigest())
    assert got == want
    if plain:
        assert {(r[0], *r[2:5]) for r in plain} == {(i, *w) for i, w in want.items()}


@pytest.mark.parametrize("window", [3, 10])
def test_machine_against_brute_force(window):
    rng = np.random.default_rng(window)
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 5, 40]))]
        some = lambda n: [vocabulary[i] for i in rng.integers(0, len(vocabulary), n)]  # noqa: B023, E731
        items = [some(int(n)) for n in rng.choice([0, 1, 4, 5, 9, 10, 11, 25], 3)]
        text = some(int(rng.integers(0, 15))) + items[0][int(rng.integers(0, 9)) :] + some(int(rng.integers(0, 9)))
        hit, own = np.zeros(len(text), bool), set()
        for i, item in enumerate(items):
            k = min(window, len(item))
            for a in range(len(item) - k + 1 if k else 0):
                for b in range(len(text) - k + 1):
                    if item[a : a + k] == text[b : b + k]:
                        hit[b : b + k] = True
                        own.add(i)
        # keys of any number of places are tried place by place, or looked up in the table of windows
        for many in (0, 1, 32):
            machine = decontamination.Machine([(str(i), " ".join(x).encode()) for i, x in enumerate(items)], window, many=many)
            n, got, found = machine.find(" ".join(text).encode())
            assert (n, got.tolist(), found) == (len(text), hit.tolist(), own)


def test_warc_of_other_writers():
    """Records of other types and digests are read; what has no known digest isn't judged."""
    import base64
    import gzip

    def member(kind, block, **fields):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:7>", "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in fields.items()}}
        return gzip.compress(("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>body</p>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>body</p>").digest()).decode()
    kinds = {"Content_Type": "application/http; msgtype=response"}
    data = b"".join(
        [
            member("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
            member("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", **kinds),
            member("response", http, WARC_Payload_Digest=sha1, **kinds),
            member("response", http, WARC_Payload_Digest="sha1:AAAA", **kinds),
            member("resource", b"plain", WARC_Payload_Digest="crc:1"),
            member("revisit", b"HTTP/1.1 304\r\n\r\n", WARC_Payload_Digest=sha1, WARC_Refers_To="<urn:uuid:6>", **kinds),
        ]
    )
    rows = list(warc.records(io.BytesIO(data), 0, len(data)))
    assert [r[2] for r in rows] == ["warcinfo", "request", "response", "response", "resource", "revisit"]
    assert [r[-1] for r in rows] == [b"software: x\r\n", b"", b"<p>body</p>", b"<p>body</p>", b"plain", None]
    assert [r[-2] for r in rows] == [None, None, True, False, None, None]
    assert rows[2][5] == hashlib.sha256(b"<p>body</p>").hexdigest() and rows[5][5] == sha1 and rows[5][3] == "urn:uuid:6" and {r[6] for r in rows} == {"urn:uuid:7"}


def test_costly_rules_come_late(spark):
    """Of rules that reject alike the cheap one comes first, and of equally cheap ones the one that rejects more; two runs agree."""
    df = spark.range(4000).select(F.col("id"), F.repeat(F.lit("word and "), 40).alias("text"), (F.col("id") % 10).alias("n"))
    slow = F.length(F.regexp_replace("text", "(a|n|d|w|o|r)+ ?", "x")) + F.col("n") < 1
    given = [rules.Rule("slow", slow | (F.col("n") < 3)), rules.Rule("few", F.col("n") < 1), rules.Rule("more", F.col("n") < 3)]
    orders = [[r.name for r in rules.ordered(df, given)] for _ in range(2)]
    assert orders[0] == orders[1] == ["more", "few", "slow"] or orders[0] == orders[1] == ["more", "slow", "few"]


def removals(df, **how):
    return sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, **how).collect())


def test_repeats_by_row(spark):
    """Rows of one id, or of none, are cut each by its own text, however many there are."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [text(120) for _ in range(6)]
    rows = [(1, "".join(passages)), (2, passages[0]), (2, text(500)), (2, text(40) + passages[1] + text(9))]
    rows += [(None, text(rng.randrange(80)) + rng.choice(passages) + text(rng.randrange(80))) for _ in range(3000)]
    rows += [(7 + i % 5, text(rng.randrange(150)) + rng.choice(passages)[rng.randrange(60) :] + text(30)) for i in range(400)]
    rows += [(1000 + i, text(100) + rng.choice(passages)) for i in range(200)] + [rows[5], rows[5], rows[-1]]
    want = brute_removed([(i, t.encode()) for i, t in rows])
    assert removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_rows_of_one_id_are_told_apart_without_hashes(spark):
    """What tells rows of one id apart is their own number, so no two of them can clash."""
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (3, "c"), (4, "d")], "own long, text string").repartition(3)
    got = repeats.told_apart(docs).collect()
    assert [r.number for r in got if r.own == 4] == [0]
    for own in (None, 3):
        numbers = [r.number for r in got if r.own == own]
        assert 0 not in numbers and len(set(numbers)) == len(numbers) == (2 if own is None else 3)


def test_repeats_with_keys_of_many_rows(spark):
    """A task that may hold a few rows only gives what one that holds all does."""
    rng = random.Random(9)
    line = "this is the one line that stands in very many of the texts, word for word, here"
    rows = [(i, " ".join(str(rng.randrange(50)) for _ in range(rng.randrange(40))) + line[: rng.choice([45, 60, 80])] + str(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_removed([(i, t.encode()) for i, t in rows])
    for held in (3, 20, 1 << 18):
        assert removals(df, held=held) == want


def warc_member(*records: bytes) -> bytes:
    import gzip

    return gzip.compress(b"".join(records))


def plain_record(name: str, block: bytes, length: str | None = None, version: str = "WARC/1.0") -> bytes:
    return f"{version}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nContent-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_damaged_archives():
    """Whatever is wrong with a member is said, and the others are read; members of several records give all of them."""
    rng = random.Random(2)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    one, two, three = (warc_member(plain_record(n, noise(400))) for n in "abc")
    read = lambda data: [(r[6], r[7]) for r in warc.records(io.BytesIO(data), 0, len(data))]
    whole = [("urn:uuid:a", None), ("urn:uuid:b", None), ("urn:uuid:c", None)]
    assert read(one + two + three) == whole
    for cut in (5, 8, 100, len(three) - 150):
        assert read(one + two + three[:-cut]) == [*whole[:2], ("urn:uuid:c", "the archive ends within it" if cut <= 8 else read(three[:-cut])[0][1])]
    assert read(three[:-100])[0][1] is not None
    wrong = two[:-8] + bytes([two[-8] ^ 1]) + two[-7:]
    assert read(one + wrong + three) == [whole[0], ("urn:uuid:b", "its checksum differs"), whole[2]]
    many = warc_member(*(plain_record(n, n.encode() * 50) for n in "xyz"))
    assert [r for r, _ in read(one + many + three)] == ["urn:uuid:a", "urn:uuid:x", "urn:uuid:y", "urn:uuid:z", "urn:uuid:c"]
    bad = warc_member(plain_record("x", b"ok"), plain_record("y", b"some", length="four"))
    assert read(bad + one) == [("urn:uuid:x", None), ("urn:uuid:y", "its length is given as 'four'"), whole[0]]
    assert read(warc_member(plain_record("x", b"abc", length="-3")))[0][1] == "its length is given as '-3'"
    assert read(warc_member(plain_record("x", b"abc", length="99")))[0] == ("urn:uuid:x", "it has 7 of 99 bytes")
    assert read(warc_member(plain_record("x", b"abc"), b"rubbish")) == [("urn:uuid:x", None), (None, "7 bytes after a record are none")]
    assert read(warc_member(b"WARC/1.0\r\nWARC-Record-ID: <q>"))[0] == ("q", "its header has no end")
    broken = bytearray(zlib.compress(b"")) and bytearray(one)
    broken[len(one) // 2 : len(one) // 2 + 40] = b"\xff" * 40
    got = read(bytes(broken) + two)
    assert got[-1] == whole[1] and len(got) == 2 and got[0][1] is not None
    other = plain_record("x", b"abc").replace(b"Content-Length", b"WARC-Payload-Digest: sha256:00\r\nContent-Length")
    row = next(warc.records(io.BytesIO(warc_member(other)), 0, 1))
    assert row[7] is None and row[-2] is False and row[-1] == b"abc"


def test_lost_records_are_noticed(spark, tmp_path, monkeypatch):
    """What is read is held against what was written."""
    df = spark.createDataFrame([(i, "u", f"page {i}" * 40) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    assert warc.through_warc(df).count() == 20
    write = warc.write_warc

    def cut(typed, folder, **how):
        archives = write(typed, folder, **how)
        for r in archives.collect():
            path = r.path.removeprefix("file://").removeprefix("file:")
            with open(path, "rb+") as file:
                file.truncate(r.size - 9)
        return archives

    monkeypatch.setattr(warc, "write_warc", cut)
    with pytest.raises(ValueError, match="20 records were written"):
        warc.through_warc(df)


def test_items_that_begin_alike():
    """Very many items with one beginning cost a text that has it a few lookups."""
    import time

    start = "what is the most likely reason for the".split()
    items = [(str(i), " ".join([*start, *(f"w{(i * 7 + j * j) % 5000}" for j in range(12))]).encode()) for i in range(20_000)]
    machine = decontamination.Machine(items, 10)
    text = " ".join(["some text"] * 50 + start + ["something else"] * 50).encode()
    began = time.perf_counter()
    for _ in range(20):
        assert machine.find(text)[2] == set()
    assert (time.perf_counter() - began) / 20 < 0.01
    n, hit, own = machine.find(b"before " + items[777][1] + b" after")
    assert 777 in own and hit.tolist() == [False] + [True] * 20 + [False]


def test_slots_of_many_rows_without_an_id(spark):
    """A bucket that is dealt to parts still gives each shard's slots without gaps, each once."""
    rows = [(None if i % 3 == 0 else i % 50, f"text {i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for a_part in (1, 10, 1000):
        slots = collections.defaultdict(list)
        got = sharding.shard_rows(df, rows_a_part=a_part).collect()
        for r in got:
            slots[r.shard].append(r.slot)
        assert len(got) == 600 and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert len({r.shard for r in got if r.id is None}) == 1


BIG = 1 << 64


def plain_words(text: bytes) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", text) if w]


def plain_hash(word: bytes) -> int:
    """A word's 64 bits, letter by letter."""
    code = sum((b + 1) * pow(classifier.RADIX, i, BIG) for i, b in enumerate(word)) % BIG
    return (code ^ code >> 29) * classifier.MIX % BIG


def plain_places(code: int) -> list[int]:
    x = (code ^ code >> 32) * classifier.MIX % BIG
    x = (x ^ x >> 29) * classifier.RADIX % BIG
    return [x >> (59 - 8 * i) & (classifier.DIM - 1) for i in range(4)]


def plain_shape(word: bytes) -> int:
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b > 127 else 0
    shape = ((kind(word[0]) * 5 + kind(word[min(1, len(word) - 1)])) * 5 + kind(word[max(len(word) - 2, 0)])) * 8 + (min(len(word), 15) >> 1)
    shape = (shape << 8 | (word[-1] if kind(word[-1]) == 0 else kind(word[-1]))) + 1
    shape = shape * classifier.MIX % BIG
    return ((shape ^ shape >> 32) * classifier.MIX % BIG) >> 55


def plain_features(vectors: dict, text: bytes) -> list[float]:
    """A text's row by sums over its words, one after another."""
    w = plain_words(text)
    own = [vectors.get(plain_hash(x) >> 50, [0] * classifier.DIM) for x in w]
    n = max(len(w), 1)
    mean = [sum(v[i] for v in own) / n / classifier.UNIT for i in range(classifier.DIM)]
    spread = [math.sqrt(max(0.0, sum(v[i] ** 2 for v in own) / n / classifier.UNIT**2 - mean[i] ** 2)) for i in range(classifier.DIM)]
    shape = [sum(int(classifier.SHAPE_VECTORS[plain_shape(x)][i]) for x in w) / n for i in range(classifier.SHAPE_DIM)]
    new = sum(i == 0 or w[i] != w[i - 1] for i in range(len(w))) / n
    return [*mean, *spread, *shape, new, len(set(w)) / n, math.log1p(len(w))]


def plain_score(net, x: list[float]) -> float:
    z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, net.mean.tolist(), net.scale.tolist(), strict=True)]
    hidden = [math.tanh(sum(v * w for v, w in zip(z, net.w1[:, j].tolist(), strict=True)) + float(net.b1[j])) for j in range(len(net.b1))]
    logit = sum(h * w for h, w in zip(hidden, net.w2.tolist(), strict=True)) + net.b2
    return 1 / (1 + math.exp(-logit / net.temperature))


def test_classifier_by_plain_python(spark):
    """Word vectors, documents' features and scores, on small data, as sums and products of plain numbers."""
    rng = random.Random(6)
    words = ["the", "Of", "a", "x9", "&&", "naïve", "end.", "LONGER-word", "ß"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice(["", "\n", " \t x"])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    sums: dict = {}
    for _, t in rows:
        w = plain_words((t or "").encode())
        for i, x in enumerate(w):
            own = sums.setdefault(plain_hash(x) >> 50, [0] * classifier.DIM)
            for y in (x, *w[max(0, i - 1) : i], *w[i + 1 : i + 2]):
                for k, place in enumerate(plain_places(plain_hash(y))):
                    own[place] += 1 if k < 2 else -1
    vectors = {}
    for b, v in sums.items():
        size = max(1.0, math.sqrt(sum(x * x for x in v)))
        vectors[b] = [float(np.round(x * (classifier.UNIT / size))) for x in v]
    got = classifier.word_vectors(df)
    assert {b for b in range(classifier.WORDS) if got[b].any()} <= set(vectors)
    assert all(np.abs(got[b] - np.array(v)).max() <= 1 for b, v in vectors.items())
    exact = {b: got[b].tolist() for b in vectors}
    _, net = classifier.train(df, labels)
    scores = {r.row.doc_id: r.score for r in classifier.quality(df, labels).collect()}
    for i, t in rows:
        assert math.isclose(scores[i], plain_score(net, plain_features(exact, (t or "").encode())), rel_tol=1e-6, abs_tol=1e-9), i


def test_ppm_codes_of_a_chunk_by_pieces(spark):
    """A chunk's codes are found a piece at a time, and the parts of a trie are a quarter of what may be broadcast."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, 4096, dtype=np.uint8)) for _ in range(2048)]
    tracemalloc.start()
    own = ppm.distinct(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(own, np.unique(ppm.grams(texts, 5)[0])) and peak < 10 * sum(map(len, texts))
    df = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 20")
    n = ppm.count_grams(df, "text", 5).count()
    assert isinstance(ppm.train(df, "text", 5, n), ppm.Whole) and len(ppm.train(df, "text", 5, n - 1).parts) >= 4
