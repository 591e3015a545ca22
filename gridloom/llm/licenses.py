"""Licence notices in documents, by patience alignment with templates around each place that may hold one."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import LOWER_BYTES, per_text
from .license_forms import forms as all_forms

#: One notice of some licences; license_forms has all that are looked for.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
}
#: Words that tell a licence from its relatives; a notice isn't found without those that it names.
TELLING = re.compile(rb"v?[0-9]+|nc|nd|sa|noncommercial|noderivatives|noderivs|sharealike|lesser|library|affero|gnu|l?a?gplv?[0-9]*|apache|mozilla|mpl|creative|commons|cc0?|mit|bsd|isc")
#: First parts of names whose licences share wording: of their findings that overlap, one with a version counts first, then the one with most words.
FAMILY = {"agpl": "gnu", "gpl": "gnu", "lgpl": "gnu", "gfdl": "gnu"}
#: Words from which a template is a whole text, not a notice.
WHOLE = 100
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return WORDS.findall(text.translate(LOWER_BYTES))


def rising(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places in a and in b of a longest common subsequence (bit-parallel: a row of bits for each word of a)."""
    ones = (1 << len(b)) - 1
    where: dict[bytes, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    now, rows = ones, []
    for w in a:
        u = now & where.get(w, 0)
        now = (now + u | now - u) & ones
        rows.append(now)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def pairs(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places in text a and in template b that the alignment brings together: equal ends, then words unique to both in a longest rising order, then the gaps between them; a gap without such words gives a longest common subsequence."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        need = Counter(b[b0:b1])
        have = Counter(w for w in a[a0:a1] if w in need)
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if need[w] == 1 and have[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [anchors[i] for i in rising([j for _, j in anchors])]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


def aligned(a: list[bytes], b: list[bytes]) -> int:
    """Words of template b that the alignment finds in text a."""
    return len(pairs(a, b))


class Form:
    """One wording of a licence."""

    def __init__(self, name: str, text: str, least: float) -> None:
        self.name, self.words = name, words(text.encode())
        self.counts = Counter(self.words)
        self.kinds = frozenset(self.counts)
        self.size = len(self.words)
        self.need = max(1, int(np.ceil(least * self.size - 1e-9)))
        self.span = self.size + self.size // 4
        self.step = max(1, self.size // 16)
        self.vague = self.size < WHOLE and not re.search(r"[0-9]", text)
        self.telling = Counter(w for w in self.words if TELLING.fullmatch(w)) if self.size < WHOLE else Counter()
        self.must = frozenset(self.telling)

    def starts(self, own: list[bytes]) -> Iterator[int]:
        """Starts, `step` apart, of the stretches of span + step words in which enough of the form's words occur.

        No stretch of `span` words that holds an alignment is left out: it lies
        in one of these, and an alignment has no more words than both have in common.
        """
        width = self.span + self.step
        hits = np.flatnonzero(np.fromiter((w in self.kinds for w in own), bool, len(own)))
        if len(hits) < self.need:
            return
        begin = np.unique(hits // self.step) * self.step
        enough = np.searchsorted(hits, begin + width) - np.searchsorted(hits, begin) >= self.need
        have: Counter = Counter()
        lo = hi = both = 0
        for b in begin[enough].tolist():
            if b >= hi:
                have, both, lo, hi = Counter(), 0, b, b
            while lo < b:
                w = own[lo]
                if w in self.kinds:
                    have[w] -= 1
                    both -= have[w] < self.counts[w]
                lo += 1
            while hi < min(b + width, len(own)):
                w = own[hi]
                if w in self.kinds:
                    both += have[w] < self.counts[w]
                    have[w] += 1
                hi += 1
            if both >= self.need:
                yield b

    def found(self, own: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(words found, first place, place behind the last) of each stretch in which the form is."""
        for b in self.starts(own):
            stretch = own[b : b + self.span + self.step]
            got = pairs(stretch, self.words)
            if len(got) >= self.need and not self.telling - Counter(self.words[j] for _, j in got):
                yield len(got), b + got[0][0], b + got[-1][0] + 1


def licenses_of(own: list[bytes], kinds: set[bytes], forms: list[Form]) -> list[tuple[str, float]]:
    """(licence, coverage) of every licence in a text, the best one first; kinds has all of its words that forms have."""
    spots: dict[str, list[tuple]] = {}
    for f in forms:
        if f.must <= kinds and len(own) >= f.need and sum(f.counts[w] for w in f.kinds & kinds) >= f.need:
            first = f.name.split("-")[0]
            for n, a, b in f.found(own):
                spots.setdefault(FAMILY.get(first, first), []).append((f.vague, -n, -n / f.size, -f.size, f.name, a, b))
    texts = [x for all_ in spots.values() for x in all_ if -x[3] >= WHOLE]
    best: dict[str, tuple] = {}
    for all_ in spots.values():
        kept: list[tuple] = []
        for x in sorted(all_):
            name, begin, end = x[4:]
            if -x[3] < WHOLE and any(name != y[4] and y[5] <= begin and end <= y[6] for y in texts):
                continue
            if all(name == y[4] or end <= y[5] or y[6] <= begin for y in kept):
                if name not in best or x[2:4] < best[name]:
                    best[name] = x[2:4]
                if not any(name == y[4] and y[5] <= begin and end <= y[6] for y in kept):
                    kept.append(x)
    return [(name, -share) for share, _, name in sorted((*k, n) for n, k in best.items())]


def license_scan(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), templates: dict[str, str | tuple[str, ...]] | None = None, least: float = 0.8) -> DataFrame:
    """(row, license, coverage, licenses) for each row of df; row is a struct of the carried columns.

    A template is one wording of a licence, or several; by default, all of
    license_forms. coverage is the share of
    a wording's words that the alignment finds in order in a stretch of text at
    most a quarter (and a sixteenth, where stretches start) longer than it.
    licenses has (license, coverage) of each licence of a coverage of `least` or
    more, the best first: by coverage, then the longest wording, then by name;
    license and coverage are the first one's, else null and 0. A notice needs
    its TELLING words, and of relatives (FAMILY) that overlap in the text
    one counts: a versioned or whole one first, then the one with most words. Every place of whole texts is looked at; a
    wording is skipped only where too few of its words are near each other.
    Null and empty texts have no license. No row moves.
    """
    chosen = all_forms() if templates is None else templates
    forms = [Form(k, x, least) for k, t in chosen.items() for x in ([t] if isinstance(t, str) else t)]
    forms = [f for f in forms if f.size]
    known = frozenset().union(*(f.kinds for f in forms))

    def work():
        def run(texts: list[bytes]):
            found = []
            for text in texts:
                own = words(text)
                found.append(licenses_of(own, known.intersection(own), forms))
            return [[x[0][0] if x else None for x in found], [x[0][1] if x else 0.0 for x in found], [[{"license": n, "coverage": c} for n, c in x] for x in found]]

        return run

    return per_text(df, text_col, list(carry), "license string, coverage double, licenses array<struct<license: string, coverage: double>>", work)
