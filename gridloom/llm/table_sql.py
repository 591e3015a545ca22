"""SQL of the manifest and of the vector codes, which repeat a step for each level or round."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    step = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: {step}, 4294967295), 4294967295)"


def manifest_sql(levels: int = 5, top: int = 3) -> str:
    """Up to 16 ** levels rows a source, and 16 ** top sources."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    ctes = [
        f"c AS (SELECT *, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents)",
        f"l AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed')} AS other FROM c)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM l)",
        "a0 AS (SELECT source AS g, i, leaf AS h, m FROM d)",
    ]

    def sides(name: str, of: str) -> str:
        own = "OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        return f"{name} AS (SELECT g, i, m, coalesce(string_agg(h, '') {own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') {own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {of})"

    def above(name: str, of: str) -> str:
        return f"{name} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(m) + 15) // 16 AS m FROM {of} GROUP BY g, i // 16)"

    for k in range(levels):
        ctes += [sides(f"s{k}", f"a{k}"), above(f"a{k + 1}", f"a{k}")]
    ctes.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, count(*) OVER () AS m, g AS source FROM a{levels})")
    for k in range(top):
        ctes += [sides(f"t{k}", f"b{k}"), above(f"b{k + 1}", f"b{k}")]
    steps = [f"s{k}" for k in range(levels)] + [f"t{k}" for k in range(top)]
    joins = [f"JOIN s{k} ON s{k}.g IS NOT DISTINCT FROM d.source AND s{k}.i = d.i // {16**k}" for k in range(levels)]
    joins += ["JOIN b0 ON b0.source IS NOT DISTINCT FROM d.source", *(f"JOIN t{k} ON t{k}.i = b0.i // {16**k}" for k in range(top)), f"JOIN b{top} ON true"]
    chain = "d.other"
    out = []
    for k, s in enumerate(steps):
        out.append((f"f{k}", chain, s))
        chain = f"f{k}"
    sibling = " || ".join(f"{s}.b || {s}.e" for s in steps)
    # folded step by step, each in its own table, so that no expression is repeated
    ctes.append(f"w AS (SELECT d.doc_id, d.leaf, d.other, b0.h AS subroot, b{top}.h AS root, sha256({sibling}) AS proof_sha256, " + ", ".join(f"{s}.m AS m_{s}, {s}.b AS b_{s}, {s}.e AS e_{s}" for s in steps) + f" FROM d {' '.join(joins)})")
    before = "w"
    for k, s in enumerate(steps):
        x = "other" if k == 0 else "x"
        ctes.append(f"x{k} AS (SELECT * {'EXCLUDE (x)' if k else ''}, CASE WHEN m_{s} = 1 THEN {x} ELSE sha256(b_{s} || {x} || e_{s}) END AS x FROM {before})")
        before = f"x{k}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, x AS folded_root, x = root AS verified FROM {before}"


def vectors_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Vectors of one length that the number of parts divides."""
    ctes = [
        "k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM k, range({parts}) AS q(part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})",
    ]

    def near(k: int) -> str:
        distance = "list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"n{k} AS MATERIALIZED (SELECT r, part, min(distance * {entries} + entry) AS b FROM (SELECT p.r, p.part, c.entry, CAST({distance} AS BIGINT) AS distance FROM p JOIN c{k} AS c USING (part)) GROUP BY r, part)"

    for k in range(rounds):
        ctes.append(near(k))
        ctes.append(f"v{k} AS (SELECT part, entry, j, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM (SELECT p.part, b % {entries} AS entry, unnest(x) AS v, unnest(range(len(x))) AS j FROM p JOIN n{k} ON p.r = n{k}.r AND p.part = n{k}.part) GROUP BY ALL)")
        ctes.append(f"u{k} AS (SELECT part, entry, list(v ORDER BY j) AS c FROM v{k} GROUP BY ALL)")
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(u.c, c.c) AS c FROM c{k} AS c LEFT JOIN u{k} AS u ON c.part = u.part AND c.entry = u.entry)")
    ctes.append(near(rounds))
    ctes.append(f"e AS (SELECT r, string_agg(format('{{:02x}}', b % {entries}), '' ORDER BY part) AS code, CAST(sum(b // {entries}) AS BIGINT) AS error FROM n{rounds} GROUP BY r)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (r), h"
