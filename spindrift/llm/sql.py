"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def manifest_sql(levels: int = 6) -> str:
    """The manifest of op11 with `levels` levels of eight written out, in each of the two trees: 262,144 leaves a group."""
    enc = lambda v: f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = [enc(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bad = f"CASE WHEN crc_mod = 0 THEN {low} ELSE text END"
    parts = [
        # CRC-32 by its definition, over the bits of the digits of an id
        f"""
        ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
        crc AS (
            SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
                lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))) AS c
            FROM ids),
        rows_in AS (
            SELECT d.*, xor(crc.c, 4294967295::BIGINT) % 3 AS crc_mod, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g FROM documents d LEFT JOIN crc USING (doc_id)),
        hashed AS (
            SELECT g, doc_id, sha256({" || ".join([*fields, enc("text")])}) AS leaf, sha256({" || ".join([*fields, enc(bad)])}) AS forged FROM rows_in),
        l0 AS (
            SELECT g, doc_id, leaf, forged, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed)"""
    ]
    up = """
        {p}{k1} AS (
            SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {p}{k} GROUP BY g, i // 8)"""
    beside = """
        {p}s{k} AS (
            SELECT a.g, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS x, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS y
            FROM {p}{k} a JOIN {p}{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.i)"""
    parts += [up.format(p="l", k=k, k1=k + 1) for k in range(levels)] + [beside.format(p="l", k=k) for k in range(levels)]
    parts.append(f"""
        u0 AS (SELECT '' AS g, g AS lang, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM l{levels})""")
    parts += [up.format(p="u", k=k, k1=k + 1) for k in range(levels)] + [beside.format(p="u", k=k) for k in range(levels)]
    parts.append("""
        f0 AS (SELECT l0.g, l0.doc_id, l0.leaf, l0.i, u0.i AS j, u0.d AS subroot, l0.forged AS acc, '' AS proof FROM l0 JOIN u0 ON l0.g = u0.lang)""")
    step = 0
    for p, key, at in (("l", "f.g", "i"), ("u", "''", "j")):
        for k in range(levels):
            parts.append(f"""
        f{step + 1} AS (
            SELECT f.* REPLACE (CASE WHEN s.i IS NULL THEN f.acc ELSE sha256(s.x || f.acc || s.y) END AS acc, f.proof || coalesce(s.x || s.y, '') AS proof)
            FROM f{step} f LEFT JOIN {p}s{k} s ON s.g = {key} AND s.i = f.{at} // {8**k})""")
            step += 1
    return f"""WITH {",".join(parts)}
        SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.d AS verified FROM f{step} CROSS JOIN u{levels} r"""


ORACLES = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_merkle": manifest_sql(),
    "op13_url_filters": r"""
        WITH rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parted AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
        SELECT page_id, host, path,
               (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
               coalesce((SELECT arg_max(verdict, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
        FROM parted
    """,
}
